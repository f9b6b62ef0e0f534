from __future__ import annotations

from smudgelab.llm import mixing


def test_targets_stop_and_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, (5, 2, 1), 1.5, 2.0).collect()}
    assert got["a"] == 200 and got["c"] == 0
    assert got[None] == 20  # weight 5 again: fourth in order
    assert abs(got["b"] - (1.5 * 1110 - 220)) < 1e-9


def test_taken_words_come_near_and_stay_whole(spark, documents):
    rows = [(i, "w " * (1 + i * 7 % 50), "en", f"s{i % 3}") for i in range(900)]
    taken = mixing.mix(documents(*rows)).collect()
    for source in ("s0", "s1", "s2"):
        mine = [r for r in taken if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 25
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in taken)
    again = mixing.mix(documents(*rows).repartition(7)).collect()
    assert sorted(map(tuple, taken)) == sorted(map(tuple, again))


def test_chance_is_the_ratio(spark, documents):
    rows = [(i, "w w", "en", "a") for i in range(4000)] + [(10**6, "w " * 2000, "en", "b")]
    taken = [r for r in mixing.mix(documents(*rows), weights=(1, 1), total_share=0.5).collect() if r["source"] == "a"]
    p = taken[0]["target"] / 8000
    assert abs(sum(r["copies"] for r in taken) - p * 4000) <= 1
    halves = sum(r["copies"] for r in taken if r["doc_id"] % 2)
    assert abs(halves - p * 2000) < 150  # not by order of ids


def test_awkward_rows(spark, awkward):
    mixed = mixing.mix(awkward.withColumnRenamed("n_chars", "size"))
    rows = mixed.collect()
    assert len(rows) == awkward.count()
    assert {r["doc_id"]: r["size"] for r in rows}[1] == 0
    twins = [r["taken"] for r in rows if r["doc_id"] == 5]
    assert twins[0] == twins[1]
    assert mixing.mix(awkward.limit(0)).count() == 0
    repeated = mixing.repeated(awkward, mixing.mix(awkward))
    assert repeated.columns == awkward.columns
    assert repeated.count() == sum(r["copies"] for r in rows)
