from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from smudgelab import spec as S
from smudgelab.operators import corruption as co
from smudgelab.operators import sampling

ROWS = [
    (0, 1.0, 10, "a", "n"), (1, 2.0, 20, "b", "y"), (2, None, 30, "c", "n"), (3, 4.0, 40, "a", "y"),
    (4, 5.0, 50, None, "n"), (5, 6.0, 60, "b", "y"), (6, 7.0, 70, "c", "n"), (7, 8.0, 80, "a", "y"),
    (8, 9.0, 90, "b", "n"), (9, 10.0, 100, "c", "y"),
]
MIXED = S.DatasetSpec("mixed", "row_id", "y", ("num", "num2"), ("cat",))


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(ROWS, "row_id long, num double, num2 int, cat string, y string")


def by_key(df):
    return {r["row_id"]: r for r in df.collect()}


def spec(kind, rows=40, columns=100, seed=7):
    return S.CorruptionSpec(kind, seed, rows, columns)


@pytest.mark.parametrize("kind", S.CORRUPTING_TYPES)
def test_only_chosen_cells_change(mixed, kind):
    done = co.corrupt(mixed, MIXED, spec(kind))
    before, after = by_key(mixed), by_key(done.data)
    hit = {r["row_id"] for r in done.rows.collect()}
    assert done.data.columns == mixed.columns
    for key, row in before.items():
        for c in mixed.columns:
            if key not in hit or c not in done.columns:
                assert after[key][c] == row[c]


@pytest.mark.parametrize("kind", S.CORRUPTING_TYPES)
def test_same_result_for_any_partitioning(mixed, kind):
    a = by_key(co.corrupt(mixed, MIXED, spec(kind)).data)
    b = by_key(co.corrupt(mixed.repartition(5), MIXED, spec(kind)).data)
    assert a == b


def test_missing_and_scaled_rows_are_the_same(mixed):
    rows = [sorted(r["row_id"] for r in co.corrupt(mixed, MIXED, spec(k)).rows.collect()) for k in (S.MCAR, S.SCAR)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_sizes_have_a_floor_of_one(mixed):
    done = co.corrupt(mixed, MIXED, spec(S.MCAR, 1, 1))
    assert done.rows.count() == 1 and len(done.columns) == 1


def test_scaling_uses_one_factor_per_column(mixed):
    done = co.corrupt(mixed, MIXED, spec(S.SCAR))
    before, after = by_key(mixed), by_key(done.data)
    for c in done.columns:
        factors = {after[r["row_id"]][c] / before[r["row_id"]][c] for r in done.rows.collect() if before[r["row_id"]][c]}
        assert len(factors) == 1 and factors <= {10, 100, 1000}


def test_shift_permutes_the_values_met(mixed):
    done = co.corrupt(mixed, MIXED, spec(S.CSCAR, 100))
    pairs = {(r["clean_cat"], r["cat"]) for r in done.flagged.where("clean_cat IS NOT NULL").collect()}
    assert {a for a, _ in pairs} == {b for _, b in pairs} == {"a", "b", "c"} and len(pairs) == 3
    changed = {r["row_id"] for r in done.flagged.where("NOT clean_cat <=> cat").collect()}
    assert changed == {r["row_id"] for r in done.rows.collect()}


def test_wide_domain_gives_the_same_shift(mixed, monkeypatch):
    narrow = by_key(co.corrupt(mixed, MIXED, spec(S.CSCAR, 100)).data)
    monkeypatch.setattr(co, "LITERAL_DOMAIN", 1)
    assert by_key(co.corrupt(mixed, MIXED, spec(S.CSCAR, 100)).data) == narrow


def test_single_category_changes_nothing(spark):
    df = spark.createDataFrame([(i, "x", "n") for i in range(4)], "row_id long, cat string, y string")
    done = co.corrupt(df, S.DatasetSpec("one", "row_id", "y", (), ("cat",)), spec(S.CSCAR))
    assert done.rows.count() == 0
    assert not co.is_meaningful(S.CLEAN_DIRTY, 0, 1)


def test_no_eligible_columns(spark):
    df = spark.createDataFrame([(i, "x", "n") for i in range(4)], "row_id long, cat string, y string")
    done = co.corrupt(df, S.DatasetSpec("text", "row_id", "y", (), ("cat",)), spec(S.SCAR))
    assert done.columns == () and done.rows.count() == 0 and by_key(done.data) == by_key(df)


@pytest.mark.parametrize("identity", [spec(S.NONE), spec(S.MCAR, 0), spec(S.MCAR, 10, 0)])
def test_identity(mixed, identity):
    done = co.corrupt(mixed, MIXED, identity)
    assert by_key(done.data) == by_key(mixed) and done.rows.count() == 0


def test_bad_arguments(mixed):
    with pytest.raises(ValueError):
        spec(S.MCAR, 101)
    with pytest.raises(ValueError):
        co.corrupt(mixed, MIXED, spec("OTHER"))
    with pytest.raises(ValueError):
        co.corrupt(mixed.limit(0), MIXED, spec(S.MCAR))


def test_new_type_can_be_registered(mixed):
    def blank(df, damage):
        return df.withColumns({c: F.when(F.col("chosen"), "?").otherwise(F.col(c)) for c in damage.columns})

    co.register_corruption("BLANK", co.CorruptionType(lambda d: d.categorical, blank))
    done = co.corrupt(mixed, MIXED, spec("BLANK"))
    assert done.data.where("cat = '?'").count() == done.rows.count() == 4
    del co.REGISTRY["BLANK"]


@pytest.mark.parametrize(("mode", "sides"), S.DIRTY_SIDES.items())
def test_mode_damages_its_sides(mixed, mode, sides):
    prepared = sampling.Prepared(sampling.split_train_test(mixed, "row_id", 1), MIXED)
    result = co.corrupt_by_mode(prepared, mode, spec(S.MCAR, 50))
    rows = result.corrupted_rows("row_id")
    found = {r["side"] for r in rows.collect()} if rows is not None else set()
    assert found == set(sides)
    clean = {r["row_id"]: r for r in prepared.data.collect()}
    for r in result.data.collect():
        if r["split"] not in sides:
            assert r == clean[r["row_id"]]


def test_audit_counts_real_changes(mixed):
    done = co.corrupt(mixed, MIXED, spec(S.MCAR, 100))
    found = {r["column"]: r["changed"] for r in co.audit(done).collect()}
    assert found == {"num": 9, "num2": 10, "cat": 9}
    again = {r["column"]: r["changed"] for r in co.audit_tables(mixed, done.data, "row_id", MIXED.features).collect()}
    assert again == found


def test_unknown_mode(mixed):
    with pytest.raises(ValueError):
        co.corrupt_by_mode(sampling.Prepared(mixed, MIXED), "DIRTY", spec(S.MCAR))


def test_roles_follow_types(mixed):
    assert S.DatasetSpec.infer(mixed, "mixed", "row_id", "y") == MIXED
    declared = S.DatasetSpec.infer(mixed, "mixed", "row_id", "y", categorical_numbers=("num2",))
    assert declared.categorical == ("num2", "cat")
