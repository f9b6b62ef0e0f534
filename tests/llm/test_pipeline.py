"""Every stage against a plain version of what it decides."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from smudgelab.llm import bpe, mixing

TEXT = "tar mol kep sim ond rul vak dor {} pel nim sot gar"


@pytest.fixture
def docs(documents):
    rows = [(i, TEXT.format(" ".join(f"n{i}w{k}" for k in range(30))), "en", f"s{i % 3}") for i in range(30)]
    rows += [
        (100, rows[0][1], "en", "s9"),  # an exact copy
        (101, "12 34 !! 56", "en", "s1"),  # no letter
        (102, None, None, None),
        (103, rows[5][1] + " password=hunter2hunter2", "en", "s1"),
        (104, rows[5][1] + " password=hunter2hunter2", "en", "s1"),
    ]
    return documents(*rows)


def _stage(number):
    return corpus_pipeline.STAGES[number][1]


def test_stages_are_those_dealt():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "secret_scan", "mixture", "byte_bpe",
    ]


def test_stages_one_after_another(spark, docs):
    known = spark.createDataFrame(_stage(0)(spark, docs, "").collect(), docs.schema)
    assert known.columns == docs.columns
    assert {r["doc_id"] for r in known.collect()} == set(range(30)) | {100, 103, 104}
    single = spark.createDataFrame(_stage(1)(spark, known, "").collect(), docs.schema)
    ids = {r["doc_id"] for r in single.collect()}
    assert 100 not in ids and 104 not in ids and 0 in ids
    clean = spark.createDataFrame(_stage(2)(spark, single, "").collect(), docs.schema)
    assert clean.count() == single.count()
    texts = {r["doc_id"]: r for r in clean.collect()}
    for r in single.collect():
        if "password" not in r["text"]:
            assert texts[r["doc_id"]]["text"] == r["text"]
        else:
            assert texts[r["doc_id"]]["text"].endswith(" [SECRET]")
            assert texts[r["doc_id"]]["n_chars"] == len(texts[r["doc_id"]]["text"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    mixed = spark.createDataFrame(_stage(3)(spark, clean, "").collect(), docs.schema)
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in copies.items() if n}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = _stage(4)(spark, mixed, "").collect()
    assert len(coded) == mixed.count()
    for r in coded:
        text = texts[r["doc_id"]]["text"]
        assert r["ids"] == library.encode_ordinary(text)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark, docs):
    none = docs.limit(0)
    for number in range(4):
        assert _stage(number)(spark, none, "").count() == 0
    assert _stage(4)(spark, none, "").count() == 0


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").agg(
        F.count("*").alias("n"), F.min("n_tokens").alias("least"), F.countDistinct("doc_id").alias("ids")
    ).first()
    assert rows["n"] >= rows["ids"] > 50 and rows["least"] > 0
