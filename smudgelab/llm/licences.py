"""Licence scans: a trained paragraph classifier, confirmed by licence templates.

A paragraph is a line with a word, or several neighbouring lines put together, comment marks taken
off: notices are often wrapped. Lines are told one by one; around a line with a licence word that is no
notice of a family by itself, the lines near it are told together. Features are hashed word n-grams (words
and pairs of neighbours) that occur in licence templates; a multinomial logistic regression over them tells
the licence family, another licence, or that the paragraph is none. It is trained on variants of the
templates (words dropped, holders and neighbours added) and on paragraphs of a bounded sample of
documents that hold no licence word. A paragraph that is a licence but whose best family is less
probable than a threshold is ``unknown``; the threshold is calibrated on variants that
training didn't see, and on notices of licences that are no family here. A family counts
only if the paragraph holds most words of one of its templates, else it is ``unknown``, too.

Everything is SQL functions over each text where it lies: no shuffle. Weights are one array per
family, of the size of the hash table, whatever the input.

Defined results: null and empty texts have no paragraphs; repeated paragraphs all count, but a family that
lines near by tell together counts once within ``NEAR`` lines, and their fragments don't count; without
documents the classifier learns from its own sentences. Columns that clash with the added ones
are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smudgelab.llm.common import fresh_name, sampled, stored, whole_texts, without

#: Licence notices by family (fixed values).
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc0": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": ("All rights reserved.", "Copyright 2020 the authors. All rights reserved."),
}
#: Notices of licences that are no family (every other one teaches ``unknown``, the rest
#: calibrate it), and sentences that use licence words without being a notice.
OTHER_NOTICES = (
    "Licensed under the Academic Free License, Version 3.0.",
    "Released under the zlib License.",
    "This work is licensed under the European Union Public Licence, version 1.2.",
    "This package is distributed under the Artistic License 2.0.",
    "Licensed under the Open Software License, version 3.0.",
    "Released under the Eclipse Public License.",
    "Published under the terms of the Microsoft Reciprocal License.",
    "This software is licensed under the Boost Software License, Version 1.0.",
    "Distributed under the Community Data License Agreement, version 1.",
    "Licensed under the Open Database License.",
)
NO_NOTICES = (
    "She got her driving license after the second test.",
    "The public may use the software of the library free of charge.",
    "All people have rights, and the work of the court is to protect them.",
    "The general version of the theory was released under pressure.",
    "The restaurant lost its liquor license in this case.",
    "You may copy the form and send it to the foundation.",
    "His pilot license was suspended for a year.",
    "All rights and duties of a citizen are listed in the law.",
    "They read him his rights and took his license.",
    "A license to fish is sold at the office.",
    "The licensed shop on the corner sells all of it.",
    "We talked about rights, duties and all the rest.",
    "The new version of the program was released under another name.",
    "Her work is general and free of errors.",
    "Subject to the weather, the work can be distributed over two days.",
    "The source of the river is in the public park.",
)
FAMILIES = tuple(sorted(TEMPLATES))
NONE, UNKNOWN = "none", "unknown"
#: Size of the hash table of n-grams.
TABLE = 1 << 14
#: Variants of each template and sentence, and documents whose paragraphs are none.
VARIANTS = 40
SAMPLED_DOCUMENTS = 300
#: Share of a template's distinct words that confirms it.
CONFIRMED = 0.7
#: Paragraphs with such words don't teach ``none``.
LICENCE_WORDS = r"(?i)licen[cs]e|copyright|rights reserved|public domain|creative commons|spdx|redistribut"


#: Lines around which others are told together, lines before and lines in all, and how near by
#: two notices are one.
HINTS = r"(?i)licen[cs]|copyright|hereby granted|redistribut|warrant|public domain|without restriction"
BEFORE, TOGETHER = 4, 14
NEAR = TOGETHER - 1
#: Marks of comments at the ends of a line.
MARKS = r"^[\s/#*;!%>\-]+|[\s*/]+$"


@dataclass(frozen=True)
class Model:
    """Weights per class (families, unknown, none) over the table, and the family threshold."""

    weights: tuple[dict[int, float], ...]
    bias: tuple[float, ...]
    threshold: float


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def features(words: Column) -> Column:
    """Table places of the words and of the pairs of neighbours."""
    size = F.size(words)
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(TABLE)).cast("int"))
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(size - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(size - 1, F.lit(0))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(TABLE)).cast("int"),
    )
    return F.concat(single, pairs)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def _literal(values: Iterable[float], kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _variants(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(class, words, variant): words dropped here and there, a holder or a neighbour added."""
    base = spark.createDataFrame(rows, "label string, text string")
    numbered = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    words = words_of(F.col("text"))
    # Every third variant is whole; of the others, up to every sixth word goes.
    kept = F.filter(
        words,
        lambda w, i: (F.col("variant") % 3 == 0) | (F.pmod(F.xxhash64(w, i, "variant"), F.lit(6)) > 0),
    )
    holder = F.split(F.lit("copyright c 2021 jane doe"), " ")
    after = F.split(F.lit("see the file for more details and thank you"), " ")
    mixed = (
        F.when(F.col("variant") % 5 == 1, F.concat(holder, kept))
        .when(F.col("variant") % 5 == 2, F.concat(kept, after))
        .otherwise(kept)
    )
    return numbered.select("label", mixed.alias("words"), "variant")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on variants of the templates and on paragraphs of sampled documents."""
    spark = df.sparkSession
    notices = [(family, text) for family in FAMILIES for text in TEMPLATES[family]]
    others = [(UNKNOWN, text) for text in OTHER_NOTICES[::2]]
    known = _variants(spark, notices + others + [(NONE, text) for text in NO_NOTICES])
    sample = sampled(df, [id_col], SAMPLED_DOCUMENTS, "licence sample").where(F.col(text_col).isNotNull())
    plain = (
        sample.select(F.explode(paragraphs(F.col(text_col))).alias("p"))
        .where(~F.col("p").rlike(LICENCE_WORDS))
        .select(F.lit(NONE).alias("label"), words_of(F.col("p")).alias("words"), F.lit(1).alias("variant"))
    )
    rows = stored(
        known.unionByName(plain).select("label", "variant", F.array_distinct(features(F.col("words"))).alias("at")),
        "licence-training",
    )
    # n-grams of whole notices are the features; at most those of the templates above.
    whole = rows.where((F.col("label") != NONE) & (F.col("variant") == 0))
    places = sorted(r[0] for r in whole.select(F.explode("at")).distinct().collect())
    present = F.transform(_literal(places, "int"), lambda v: F.array_contains("at", v).cast("double"))
    classes = (*FAMILIES, UNKNOWN, NONE)
    label = F.coalesce(*[F.when(F.col("label") == c, F.lit(float(k))) for k, c in enumerate(classes)])
    taught = stored(
        rows.where((F.col("variant") % 4 != 3) | (F.col("label") == NONE))
        .select(label.alias("label"), present.alias("present")),
        "licence-features",
    ).select("label", array_to_vector("present").alias("features"))
    fitted = LogisticRegression(
        family="multinomial", maxIter=40, regParam=0.002, standardization=False
    ).fit(taught.coalesce(1))
    matrix = fitted.coefficientMatrix.toArray().tolist()
    weights = tuple({at: w for at, w in zip(places, row, strict=True) if w} for row in matrix)
    model = Model(weights, tuple(fitted.interceptVector.toArray().tolist()), 0.0)
    # Calibration: variants that didn't teach, against notices of other licences.
    unseen = rows.where((F.col("variant") % 4 == 3) & (F.col("label") != NONE)).select("label", "at")
    others = _variants(spark, [(UNKNOWN, text) for text in OTHER_NOTICES[1::2]]).select(
        "label", F.array_distinct(features(F.col("words"))).alias("at")
    )
    told = unseen.unionByName(others).select("label", _told(F.col("at"), model).alias("t")).select("label", "t.*").collect()
    best, threshold = -1, 0.5
    for k in range(30, 96, 5):
        right = sum(
            (FAMILIES[r["best"]] if r["share"] >= k / 100 else UNKNOWN) == r["label"] for r in told
        )
        if right > best:
            best, threshold = right, k / 100
    return Model(model.weights, model.bias, threshold)


def _told(places: Column, model: Model) -> Column:
    """(best, share, none): the best family, its share among all licences, and P(none)."""
    tables = [
        _literal([row.get(i, 0.0) for i in range(TABLE)], "double") for row in model.weights
    ]

    def logit(weights: Column, bias: float) -> Column:
        return F.aggregate(places, F.lit(bias), lambda s, i: s + F.get(weights, i))

    logits = F.array(*[logit(t, b) for t, b in zip(tables, model.bias, strict=True)])

    def shares(z: Column) -> Column:
        top = F.array_max(z)
        powers = F.transform(z, lambda x: F.exp(x - top))
        return _let(powers, lambda e: _let(F.slice(e, 1, len(FAMILIES)), lambda f: F.struct(
            (F.array_position(f, F.array_max(f)) - 1).cast("int").alias("best"),
            (
                F.array_max(f)
                / F.aggregate(F.slice(e, 1, len(FAMILIES) + 1), F.lit(0.0), lambda s, x: s + x)
            ).alias("share"),
            (F.get(e, F.lit(len(FAMILIES) + 1)) / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)).alias("none"),
        )))

    return _let(logits, shares)


def _notices(candidates: Column, model: Model) -> Column:
    """(paragraph, family, probability, likeness) of candidates (paragraph, words, at) that are no plain text."""
    templates = F.array(
        *[
            F.array(*[F.array_distinct(words_of(F.lit(t))) for t in TEMPLATES[family]])
            for family in FAMILIES
        ]
    )
    names = F.array(*map(F.lit, FAMILIES))

    def likeness(x: Column) -> Column:
        return F.array_max(
            F.transform(
                F.get(templates, x["t"]["best"]),
                lambda t: F.size(F.array_intersect(t, x["words"])) / F.size(t),
            )
        )

    def notice(x: Column) -> Column:
        return _let(
            likeness(x),
            lambda like: F.struct(
                x["paragraph"],
                F.when((x["t"]["share"] >= model.threshold) & (like >= CONFIRMED), F.get(names, x["t"]["best"]))
                .otherwise(F.lit(UNKNOWN)).alias("family"),
                (1 - x["t"]["none"]).alias("probability"),
                like.alias("likeness"),
            ),
        )

    told = F.transform(candidates, lambda x: F.struct(x["paragraph"], x["words"], _told(x["at"], model).alias("t")))
    return F.transform(F.filter(told, lambda x: x["t"]["none"] < 0.5), notice)


def scan(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``licences``: (paragraph, family, probability, likeness) of each notice, in order.

    Paragraphs count from 0 over the lines with a word, and a notice of several lines has the number of the
    line that hinted at it; family is one of ``FAMILIES`` or ``unknown``; likeness is the share of a template's
    words that the paragraph holds.
    """
    text = whole_texts(F.col(text_col))
    df = without(df, "licences")
    used = sorted({i for row in model.weights for i in row})
    flags = _literal([int(i in set(used)) for i in range(TABLE)], "int")

    def candidate(place: Column, words: Column) -> Column:
        at = F.array_distinct(F.filter(features(words), lambda f: F.get(flags, f) == 1))
        return F.struct(place.cast("int").alias("paragraph"), words.alias("words"), at.alias("at"))

    lines, single, wide = (fresh_name(df.columns, f"_{n}") for n in ("lines", "single", "wide"))
    found = df.withColumn(lines, paragraphs(text))
    # First every line's features that have a weight: hardly any line has many.
    each = F.transform(lines, lambda p, i: _let(words_of(p), lambda w: candidate(i, w)))
    found = found.withColumn(single, F.filter(each, lambda x: F.size(x["at"]) > 0))
    found = found.withColumn(single, _notices(F.col(single), model))

    def told_alone(place: Column) -> Column:
        return F.exists(single, lambda n: (n["paragraph"] == place) & (n["family"] != UNKNOWN))

    def together(place: Column) -> Column:
        near = F.slice(F.col(lines), F.greatest(place - BEFORE, F.lit(0)) + 1, F.lit(TOGETHER))
        joined = F.array_join(F.transform(near, lambda p: F.regexp_replace(p, MARKS, " ")), " ")
        return _let(words_of(joined), lambda w: candidate(place, w))

    places = F.filter(
        F.transform(lines, lambda p, i: F.when(p.rlike(HINTS), i).otherwise(F.lit(-1))),
        lambda i: (i >= 0) & ~told_alone(i),
    )
    none = F.filter(single, lambda n: F.lit(False))
    around = F.when(text.rlike(HINTS), _notices(F.transform(places, together), model)).otherwise(none)
    found = found.withColumn(wide, F.filter(around, lambda n: n["family"] != UNKNOWN))

    def near_by(a: Column, b: Column) -> Column:
        return F.abs(a["paragraph"] - b["paragraph"]) <= NEAR

    # Of the notices that say the same near by, the first; none where a line says so by itself.
    alone = F.filter(
        wide,
        lambda n: ~F.exists(single, lambda x: (x["family"] == n["family"]) & near_by(x, n)),
    )
    found = found.withColumn(wide, alone)
    firsts = F.filter(
        wide,
        lambda n, k: ~F.exists(
            F.slice(F.col(wide), 1, k), lambda x: (x["family"] == n["family"]) & near_by(x, n)
        ),
    )
    found = found.withColumn(wide, firsts)
    whole = F.filter(single, lambda n: (n["family"] != UNKNOWN) | ~F.exists(wide, lambda x: near_by(x, n)))
    return found.withColumn("licences", F.array_sort(F.concat(whole, wide))).drop(lines, single, wide)
