"""Language, toxicity and licences: learned, with defined results on awkward rows."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from smudgelab.llm import langid, licences, toxicity

WORDS = {
    "aa": "tar mol kep sim ond rul vak".split(),
    "bb": "yi zua qeo xai wuo jee uai".split(),
}


def _texts(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        out.append((i, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(3, 40))), lang))
    return out


def test_subwords_stay_inside_words():
    assert len(langid.subwords("123 !?")) == 0
    a, b = langid.subwords("ab cd"), langid.subwords("cd ab")
    assert sorted(a) == sorted(b)
    assert set(langid.subwords("AB")) == set(langid.subwords("ab"))


def test_language_of_unseen_texts(spark):
    rows = _texts(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 200"))
    got = langid.identify(df.where("doc_id >= 200"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    assert not any(r["rejected"] for r in got)


def test_language_of_awkward_rows(spark, awkward):
    model = langid.fit(awkward.withColumnRenamed("n_chars", "SCORE"))
    got = langid.identify(awkward.withColumnRenamed("n_chars", "SCORE"), model).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    untaught = langid.fit(awkward.limit(0))
    assert {r["lang_pred"] for r in langid.identify(awkward, untaught).collect()} == {"und"}


def _toxic(n, seed=2):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        words = [draw.choice("one two three four five six seven".split()) for _ in range(draw.randint(20, 200))]
        if i % 4 == 0:
            words[draw.randrange(len(words))] = "vile" + draw.choice(["", "ness", "ly", "st"])
        out.append((i, " ".join(words), "en", int(i % 4 == 0)))
    return out


def _judged(docs, labels, model, where=None):
    rated = toxicity.rated(docs, model)
    return toxicity.scored(rated, toxicity.thresholds(rated, labels, model, where=where))


def test_toxicity_of_unseen_texts(spark):
    rows = _toxic(600)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] * 2, "doc_id long, toxic int")
    taught = F.col("doc_id") < 450
    model = toxicity.fit(docs, labels, where=taught)
    assert max(model.taught) < 450
    got = [r for r in _judged(docs, labels, model, taught).collect() if r["doc_id"] >= 450]
    for label in (0, 1):  # a constant answer gets one of them wrong
        mine = [r["predicted"] for r in got if rows[r["doc_id"]][3] == label]
        assert sum(p == label for p in mine) >= 0.95 * len(mine)


def _slow_logit(model, text):
    """Every filter at every place, word by word."""
    rows = toxicity.hashed_words(text)
    words = [model.table[r].astype(float).sum(axis=0) for r in rows]
    words += [np.zeros(toxicity.WIDTH)] * (max(toxicity.FILTER_WIDTHS) - 1 + (not words))
    places = max(1, len(rows))
    total = model.bias
    for k, width in enumerate(toxicity.FILTER_WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(
                sum(
                    float(words[i + o] @ model.filters[k][o * toxicity.WIDTH : (o + 1) * toxicity.WIDTH, f])
                    for o in range(width)
                )
                for i in range(places)
            )
            total += max(0.0, best + model.shift[k][f]) * model.out[k * toxicity.FILTERS + f]
    return total


def test_scores_by_a_slow_network():
    rows = _toxic(80)
    model = toxicity.train([r[1] for r in rows], [r[3] for r in rows], ["en"] * 80)
    for text in ["", "one", "two vile", *[r[1] for r in rows[:6]]]:
        assert np.isclose(model.rate(text)[0], _slow_logit(model, text), atol=1e-3)


def test_cuts_by_language_are_blended_by_size(spark):
    model = toxicity.Model(None, [], [], None, 0.0, ("aa", "bb", "cc"), None, (3,))

    def cuts(n):
        rows, labels = [(3, 99.0, "aa")], [(3, 1)]
        for told, middle, size in (("aa", 0.0, 2000), ("bb", 5.0, n)):
            for i in range(size):
                key = len(rows) + 10
                rows.append((key, middle + (1 if i % 2 else -1) * (1 + i % 3), told))
                labels.append((key, i % 2))
        rated = spark.createDataFrame(rows, "doc_id long, logit double, told string")
        return toxicity.thresholds(rated, spark.createDataFrame(labels, "doc_id long, toxic int"), model)

    few, many = cuts(6), cuts(1500)
    assert abs(many["aa"]) < 1 and 4 < many["bb"] < 6
    assert abs(few["aa"]) < 1 and few["bb"] < many["bb"]
    assert "cc" not in many and "" in many
    rated = spark.createDataFrame([(1, 4.0, "aa"), (2, 4.0, "bb"), (3, 4.0, "cc")], "doc_id long, logit double, told string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(rated, {"": 9.0, "aa": 0.0, "bb": 5.0}).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_sample_is_even_over_languages(spark, monkeypatch):
    rows = [(i, f"word{i} " * 5, "aa" if i % 10 else "bb", int(i % 2)) for i in range(1500)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rows_per_label=100)
    taken = [(rows[i][2], rows[i][3]) for i in model.taught]
    assert len(taken) <= 200 and taken.count(("bb", 0)) >= 40 and 50 <= taken.count(("aa", 1)) <= 100
    assert toxicity.even_shares({"a": 10, "b": 500, None: 300}, 400) == {"a": 10, None: 195, "b": 195}
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 1000)
    few = toxicity.fit(docs, labels, rows_per_label=100)
    assert sum(len(rows[i][1]) for i in few.taught) <= 1000


def test_long_texts_in_parts_are_the_same(monkeypatch):
    rows = toxicity.hashed_words("one two three four five six seven eight nine ten " * 5)
    model = toxicity._network([rows, rows[:3]], [1, 0], 3)
    whole = model.logit(rows)
    monkeypatch.setattr(toxicity, "PART", 4)
    assert np.isclose(model.logit(rows), whole)


def test_toxicity_of_awkward_rows(spark, awkward, monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_OUT", 1 << 40)
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    assert set(model.taught) == {5, 7}
    clash = awkward.withColumnRenamed("n_chars", "Predicted").selectExpr("*", "1 AS _rated", "2 AS told", "3 AS id")
    got = _judged(clash, labels, model).collect()
    assert len(got) == awkward.count() and {(r["_rated"], r["id"]) for r in got} == {(1, 3)}
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity.fit(awkward, labels.limit(0)) is None
    none = _judged(awkward, labels, None).collect()
    assert {r["predicted"] for r in none} == {0} and max(r["score"] for r in none) < 1e-300
    assert toxicity.rated(awkward.limit(0), model).count() == 0


def test_licences_known_unknown_and_none(spark, documents):
    rows = [(i, "plain words of a text about nothing\nand another line of it", "en", "a") for i in range(40)]
    rows += [
        (100, "first line\nReleased under the MIT License.\nlast line", "en", "a"),
        (101, "Copyright (c) 2020 Somebody. All rights reserved.", "en", "a"),
        (102, "Licensed under the Quite Unheard-of Software License, Version 9.", "en", "a"),
        (103, "She got her driving license and all rights were explained.", "en", "a"),
        (104, None, "en", "a"),
        (105, "This library is licensed under the GNU Lesser General Public License, version 2.1.", "en", "a"),
    ]
    docs = documents(*rows).withColumnRenamed("n_chars", "Licences")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs, licences.train(docs)).collect()}
    assert [(x["paragraph"], x["family"]) for x in got[100]] == [(1, "mit")]
    assert [x["family"] for x in got[101]] == ["reserved"]
    assert [x["family"] for x in got[102]] == ["unknown"]
    assert got[103] == [] and got[104] == [] and got[0] == []
    assert [x["family"] for x in got[105]] == ["lgpl"]


def test_licences_of_awkward_rows(awkward):
    model = licences.train(awkward.limit(0))
    assert licences.scan(awkward, model).count() == awkward.count()
    assert licences.scan(awkward.limit(0), model).count() == 0


def _in_language(n, alphabet, seed, start=0):
    draw = random.Random(seed)
    words = ["".join(draw.choice(alphabet) for _ in range(draw.randint(2, 7))) for _ in range(60)]
    return [(start + i, " ".join(draw.choice(words) for _ in range(draw.randint(8, 60)))) for i in range(n)]


def test_unlearned_languages_are_rejected_and_learned_ones_kept(spark):
    alphabets = {"aa": "abcdeo", "bb": "fghiju", "cc": "klmnpy", "dd": "qrstvz"}
    rows = [
        (i, text, lang)
        for k, (lang, letters) in enumerate(alphabets.items())
        for i, text in _in_language(400, letters, k, 1000 * k)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 > 0 AND lang <> 'dd'"))
    got = langid.identify(df.where("doc_id % 4 = 0"), model).collect()
    learned = [r for r in got if r["lang"] != "dd"]
    unlearned = [r for r in got if r["lang"] == "dd"]
    assert sum(r["rejected"] for r in learned) <= 0.01 * len(learned)
    assert sum(r["rejected"] for r in unlearned) >= 0.95 * len(unlearned)
    assert all(r["lang_pred"] == r["lang"] for r in learned)
    assert model.calibration["learned"] <= 0.01 and all(model.calibration[x] >= 0.9 for x in ("aa", "bb", "cc"))


def test_many_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_IN_ALL", 200)
    monkeypatch.setattr(langid, "MOST_BROADCAST", 3)
    draw = random.Random(5)
    words = {f"l{k:02d}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(30)}
    rows = [(i, " ".join(draw.choice(words[f"l{i % 30:02d}"]) for _ in range(30)), f"l{i % 30:02d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 900"))
    assert len(model.languages) == 30 and model.head is not None
    got = langid.identify(df.where("doc_id >= 900"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.9 * len(got)


def test_sample_is_bounded_in_rows_and_characters(spark, monkeypatch):
    rows = [(i, "word " * (5 if i else 5000), "aa" if i % 3 else "bb") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, languages, seed=7: seen.append((texts, languages)))
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 2000)
    langid.fit(df, rows_per_language=20)
    texts, languages = seen[0]
    assert max(languages.count(x) for x in ("aa", "bb")) <= 20 and min(languages.count(x) for x in ("aa", "bb")) > 5
    assert all(sum(len(t) for t, x in zip(texts, languages, strict=True) if x == y) <= 1000 for y in ("aa", "bb"))


def test_internal_names_may_be_columns(spark, awkward):
    model = langid.fit(awkward)
    got = langid.identify(awkward.selectExpr("*", "1 AS _found"), model).collect()
    assert {r["_found"] for r in got} == {1}


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}
PROSE = "The ship left in the morning\nand nobody on the pier\nhad an idea of the weather\nthat the next day would bring\n"


def test_wrapped_notices_are_told_together(spark, documents):
    rows, want = [], {}
    for family, text in WRAPPED.items():
        for mark, end in (("", ""), ("# ", ""), (" * ", ""), ("// ", ""), ("/* ", " */")):
            for before in ("", PROSE * 5):
                body = "\n".join(f"{mark}{line}{end}" for line in text.split("\n"))
                rows.append((len(rows), f"{before}{body}\n{PROSE * 5}", "en", "a"))
                want[rows[-1][0]] = [family]
    rows.append((500, PROSE * 4 + "He had no licence to sail.\nThe copyright of the map was his.\n" + PROSE, "en", "a"))
    rows.append((501, "\n".join([WRAPPED["mit"], PROSE * 6, "Licensed under CC BY 4.0.", PROSE * 6, WRAPPED["gpl"]]), "en", "a"))
    rows.append((502, ("copyright and licences of ships\n" + PROSE) * 300, "en", "a"))
    docs = documents(*rows).selectExpr("*", "1 AS _lines", "2 AS _wide", "3 AS _single")
    found = {r["doc_id"]: r for r in licences.scan(docs, licences.train(docs)).collect()}
    got = {i: [x["family"] for x in r["licences"]] for i, r in found.items()}
    assert {i: got[i] for i in want} == want
    assert got[500] == [] and got[502] == []
    assert got[501] == ["mit", "cc-by", "gpl"]
    places = [x["paragraph"] for x in found[501]["licences"]]
    assert places == sorted(places)
    assert {(r["_lines"], r["_wide"], r["_single"]) for r in found.values()} == {(1, 2, 3)}


def _slow_told(model, words):
    """Features, softmax and likeness of one paragraph in plain Python; the hash is Spark's own."""
    z = [b + sum(row.get(i, 0.0) for i in words[1]) for row, b in zip(model.weights, model.bias, strict=True)]
    powers = np.exp(np.array(z) - max(z))
    n = len(licences.FAMILIES)
    best = int(np.argmax(powers[:n]))
    likeness = max(
        len(t & set(words[0])) / len(t)
        for t in (set(re.findall(r"[^\W_]+", x.lower())) for x in licences.TEMPLATES[licences.FAMILIES[best]])
    )
    share, none = powers[best] / powers[: n + 1].sum(), powers[n + 1] / powers.sum()
    family = licences.FAMILIES[best] if share >= model.threshold and likeness >= licences.CONFIRMED else licences.UNKNOWN
    return (none < 0.5, family, 1 - none, likeness)


def test_notices_by_a_slow_version(spark, documents):
    lines = [t for texts in licences.TEMPLATES.values() for t in texts] + list(licences.OTHER_NOTICES + licences.NO_NOTICES)
    docs = documents(*[(i, t, "en", "a") for i, t in enumerate(lines)])
    model = licences.train(docs)
    words = licences.words_of(F.col("text"))
    hashed = docs.select("doc_id", words.alias("w"), F.array_distinct(licences.features(words)).alias("at")).collect()
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs, model).collect()}
    for r in hashed:
        is_notice, family, probability, likeness = _slow_told(model, (r["w"], r["at"]))
        found = [x for x in got[r["doc_id"]] if x["family"] != licences.UNKNOWN or is_notice]
        assert [x["family"] for x in found] == ([family] if is_notice else [])
        if is_notice:
            assert np.isclose(found[0]["probability"], probability) and np.isclose(found[0]["likeness"], likeness)
