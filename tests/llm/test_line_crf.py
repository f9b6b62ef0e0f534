"""The line model against enumeration of all labellings, and on held-out documents."""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pytest
from conftest import SMALL

from smudgelab.llm import line_crf as crf
from smudgelab.llm.queries import QUERIES

LABELS = "doc_id long, quality int"


def chain_scores(emission, move):
    """Weight of every labelling of one chain."""
    for y in product((0, 1), repeat=len(emission)):
        yield y, sum(e for e, s in zip(emission, y, strict=True) if s) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    sizes = [3, 0, 6, 1, 3]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    emission, move = rng.normal(scale=2, size=sum(sizes)), rng.normal(size=(2, 2))
    good, moves, total = crf.Chains(starts).marginals(emission, move)
    slow_good, slow_moves, slow_total = [], np.zeros((2, 2)), 0.0
    for a, b in zip(starts, starts[1:], strict=False):
        scored = [(y, np.exp(s)) for y, s in chain_scores(emission[a:b], move)]
        whole = sum(w for _, w in scored)
        slow_total += np.log(whole) if b > a else 0
        slow_good += [sum(w for y, w in scored if y[t]) / whole for t in range(b - a)]
        for y, w in scored:
            for i, j in zip(y, y[1:], strict=False):
                slow_moves[i, j] += w / whole
    assert good == pytest.approx(slow_good)
    assert moves == pytest.approx(slow_moves)
    assert total == pytest.approx(slow_total)


def test_line_features_by_hand():
    lines = crf.lines_of(["One TWO two\n\n \t\nOne TWO two\n", "", "a | b | é 1 !! $"])
    assert lines.starts.tolist() == [0, 2, 2, 3]
    assert lines.chars.tolist() == [11, 11, 16]
    column = {f: lines.features[:, i].tolist() for i, f in enumerate(crf.FEATURES)}
    assert column["capitals"] == pytest.approx([4 / 9, 4 / 9, 0])
    assert column["seen"] == [0, 1, 0]
    assert column["bars"] == pytest.approx([0, 0, 2 / 8])
    assert column["digits"][2] == pytest.approx(1 / 16)
    assert column["shouts"][2] == pytest.approx(2 / 8)
    assert column["symbols"][2] == pytest.approx(1 / 8)
    assert column["foreign"][2] == pytest.approx(1 / 3)
    assert column["distinct"] == pytest.approx([1, 1, 7 / 8])


def model_for_tests():
    rng = np.random.default_rng(6)
    n = len(crf.FEATURES)
    return crf.Model(np.zeros(n), np.ones(n), rng.normal(scale=0.3, size=3 * n + 3), rng.normal(size=(2, 2)))


def test_rating_is_the_weighted_mean_of_marginals():
    model, texts = model_for_tests(), ["Some line here\nSHOUT!! SHOUT!!\nlast", "", "one $$ line", " \n "]
    got = model.ratings(texts)
    for text, rating in zip(texts, got, strict=True):
        lines = crf.lines_of([text])
        if not len(lines.chars):
            assert rating == pytest.approx(-crf.END)
            continue
        emission = model._emission(crf.Chains(lines.starts), lines)
        scored = [(y, np.exp(s)) for y, s in chain_scores(emission, model.move)]
        whole = sum(w for _, w in scored)
        mean = sum(w * (np.array(y) * lines.chars).sum() for y, w in scored) / whole / lines.chars.sum()
        assert rating == pytest.approx(np.log(mean / (1 - mean)), abs=1e-6)


def test_held_out_documents(spark):
    rows = QUERIES["op12_line_quality"](spark, SMALL).collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    for label in (0, 1):  # a constant answer gets one of them wrong
        mine = [p for y, p in held if y == label]
        assert mine and sum(p == label for p in mine) >= 0.85 * len(mine)


def test_other_labels_never_reach_the_model(spark, documents):
    docs = documents(*[(i, f"plain line {i}\nmore words here" if i % 2 else "BAD!! BAD!! $$$", "en", "a") for i in range(40)])
    rows = [(i, i % 2) for i in range(40)]
    hidden = spark.createDataFrame([(i, y if i < 30 else 1 - y) for i, y in rows], LABELS)
    whole = spark.createDataFrame(rows, LABELS)
    models = [crf.fit(docs, x, where=x["doc_id"] < 30) for x in (hidden, whole)]
    assert (models[0].weights == models[1].weights).all()


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 0), (5, 1), (6, 1), (None, 1), (7, None), (7, 0), (3, 7), (99, 0)], LABELS)
    model = crf.fit(awkward, labels)
    assert model is not None
    clash = awkward.selectExpr("*", "1 AS _rating", "2 AS RATING", "3 AS Score", "4 AS id", "5 AS label")
    found = crf.rated(clash, model)
    assert {"_rating", "rating", "id", "label"} <= set(found.columns)
    got = crf.scored(found, crf.threshold(found.drop("id", "label"), labels)).select("doc_id", "text", "_rating", "score", "predicted").collect()
    assert len(got) == awkward.count() and all(r["_rating"] == 1 and 0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
    assert crf.rated(awkward.limit(0), model).count() == 0
    assert crf.fit(awkward, labels.limit(0)) is None and crf.fit(awkward.limit(0), labels) is None
    assert {r["rating"] for r in crf.rated(awkward, None).collect()} == {-crf.END}
    assert crf.threshold(found.limit(0), labels) == 0.0


def test_very_many_lines():
    text = "\n".join(f"line {i} of a long text" for i in range(50_000)) + "\n" + "word " * 100_000
    rating = model_for_tests().ratings([text, "short"])
    assert np.isfinite(rating).all()


def test_cut_parts_the_labels(spark):
    ratings = [(i, float(r)) for i, r in enumerate([-5, -4, -3, -3.5, 2, 3, 4, 5, 11.9999, 12])]
    labels = spark.createDataFrame([(i, int(r > 0)) for i, r in ratings], LABELS)
    cut = crf.threshold(spark.createDataFrame(ratings, "doc_id long, rating double"), labels)
    assert -3 < cut <= 2
