from __future__ import annotations

import numpy as np
import pytest

from smudgelab.llm import components, simhash


def _groups(values, distance):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    return [find(a) for a in range(len(values))]


def _values(n=300, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**64, size=n // 6, dtype=np.uint64)
    out = []
    for i in range(n):
        v = int(base[i % len(base)])
        for _ in range(int(draw.integers(0, 8))):
            v ^= 1 << int(draw.integers(0, 64))
        out.append(v)
    return out


@pytest.mark.parametrize("distance", [2, 3, 4, 6])
def test_plan_finds_every_pair(distance):
    values = _values()
    plan = simhash.plan_search(np.array(values, dtype=np.uint64), 10**6, distance)
    assert sum(t + 1 for t in plan.thresholds) == distance + 1
    assert sum(plan.masks) == 2**64 - 1
    files = plan.kept_bits()
    for a in values[:120]:
        for b in values[:120]:
            if (a ^ b).bit_count() <= distance:
                assert any(not (a ^ b) & kept for kept in files)


@pytest.mark.parametrize("block", [3, 2048])
def test_groups_for_any_block(spark, block):
    values = _values()
    rows = [(i, v - 2**64 if v >> 63 else v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, block=block).collect()}
    groups = _groups(values, 4)
    least = {}
    for i, g in enumerate(groups):
        least.setdefault(g, i)
    assert got == {i: least[g] for i, g in enumerate(groups)}


def test_awkward_rows(spark, awkward):
    prints = simhash.fingerprints(awkward.withColumnRenamed("n_chars", "Fingerprint"))
    got = simhash.near_duplicates(prints.select("doc_id", "fingerprint")).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == 0
    assert by_id[3]["component_id"] == 1
    assert by_id[6]["component_id"] == 5
    empty = prints.limit(0).select("doc_id", "fingerprint")
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(awkward):
    kept = simhash.first_of_groups(awkward).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 5, 7]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id has this row but it has some words"]


def test_roots_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = components.roots(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {
        **{i: 0 for i in range(1, 41)},
        **{i: 100 for i in range(101, 160)},
    }
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_of_stars_stay_small(spark, monkeypatch):
    """A round's plan once held 90 exchanges, as one star read the other's edges three times over."""
    plans = []

    def noted(df, name, keep=components.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(components, "stored", noted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["root"] for r in components.roots(edges).collect()} == {0}
    assert len(plans) > 2
    assert max(p.count("Exchange") for p in plans) <= 12


def test_roots_with_hubs_and_edges_of_null_or_loops(spark):
    """Hubs get their minimum by broadcast; all edges have their least neighbour, whichever way."""
    edges = [(0, i) for i in range(2, 1500)] + [(5000 + i, 5001 + i) for i in range(0, 200, 2)] + [(None, 3), (7, 7), (1, 1499)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.roots(df).collect()}
    assert got == {i: 0 for i in range(1, 1500)} | {5001 + i: 5000 + i for i in range(0, 200, 2)}
