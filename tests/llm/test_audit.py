"""Filter audit against a slow version that applies the filters one after another."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from smudgelab.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def slow(rows, labels):
    """Counts by (part, order, step): the filters really applied in each order."""
    docs = [(i, t or "", s or "") for i, t, _, s in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(k):
        i, text, _ = docs[k]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = ""
        out += "A" * (len(words) < 50)
        out += "B" * (100 * len(set(words)) < 65 * len(words))
        out += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        out += "D" * bool(re.search("[#$%&*|]", text))
        out += "E" * any(j is not None and i is not None and j < i and t == text for j, t, _ in docs)
        return out

    failed = [fails(k) for k in range(len(docs))]
    counts = {}
    for part in {d[2] for d in docs}:
        shapley = Counter()
        mine = [k for k in range(len(docs)) if docs[k][2] == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, f in enumerate(order, 1):
                out = {k for k in left if f in failed[k]}
                counts[part, order, step] = [
                    len(left) - len(out),
                    len(out),
                    sum(f in failed[k] for k in mine if k not in left),
                    sum(failed[k] == f for k in mine),
                    sum(docs[k][0] in good for k in out),
                    sum(docs[k][0] in toxic for k in out),
                ]
                shapley[f] += len(out)
                left -= out
        for (p, order, step), values in counts.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return counts


def found(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[m] for m in (*audit.MEASURES, "shapley")] for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture
def rows():
    many = " ".join(f"word{i}" for i in range(60))
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, "", "en", "a"),
        (4, many, "en", "a"),
        (5, many, "de", "b"),
        (5, many, "de", "b"),
        (4, many, "en", "a"),
        (6, many + " #", None, ""),
        (7, "A B " * 40, None, "b"),
        (8, ("same " * 9000).strip(), "fr", "b"),
        (None, many, "en", "a"),
        (9, "ünï ÇØDÉ 🙂 " * 30, "de", "a"),
        (10, many.upper() + " $", "de", "b"),
    ]


LABELLED = [(4, 1, 0), (5, None, 1), (5, 0, None), (7, 1, 1), (None, 1, 1), (99, 1, 1), (10, 1, 0), (3, 1, 0)]


def test_as_if_applied_one_after_another(spark, documents, rows):
    labels = spark.createDataFrame(LABELLED, LABELS)
    assert found(audit.audit(documents(*rows), labels)) == slow(rows, LABELLED)


def test_any_partitioning_and_clashing_columns(spark, documents, rows):
    labels = spark.createDataFrame(LABELLED, LABELS)
    docs = documents(*rows)
    for name in ("id", "PART", "digest", "mask", "n", "words", "good", "toxic", "quality"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    assert found(audit.audit(docs.repartition(7), labels.selectExpr("*", "1 AS id", "2 AS good"))) == slow(rows, LABELLED)


def test_no_rows_and_no_labels(spark, documents, rows):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(documents(), none).count() == 0
    assert found(audit.audit(documents(*rows), none)) == slow(rows, [])


def test_fields_never_run_over():
    most = (1 << 62) // 3
    total = sum(most * audit.packed("ABCDE", mask, True, True) for mask in (0, 31, 5))
    fields = audit.unpacked("ABCDE", total)
    for (order, step), row in zip(audit.steps("ABCDE"), fields, strict=True):
        early, f = order[: step - 1], order[step - 1]
        here = [f in fails for fails in ("", "ABCDE", "AC")]
        gone = [bool(set(early) & set(fails)) for fails in ("", "ABCDE", "AC")]
        assert row[0] == most * sum(not h and not g for h, g in zip(here, gone, strict=True))
        assert row[1] == most * sum(h and not g for h, g in zip(here, gone, strict=True))
        assert row[2] == most * sum(h and g for h, g in zip(here, gone, strict=True))


def test_other_conditions(spark, documents, rows):
    def two(text, words):
        return [text == "", F.get(words, 0) == "same"]

    labels = spark.createDataFrame(LABELLED, LABELS)
    got = found(audit.audit(documents(*rows), labels, two))
    assert len(got) == 3 * 6 * 3  # parts, orders of A, B and C, steps
    assert got["b", "BAC", 1][1] == 1  # the text of one word
