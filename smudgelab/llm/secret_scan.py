"""Secret scans: fixed patterns, and character Markov models for anything random.

Two first-order models over characters, of random strings and of ordinary identifiers,
give each run of key-like characters a log-likelihood ratio per character. They are
counted from labelled samples: digests in several encodings are random; words of a
bounded sample of documents and usual names, joined as identifiers, paths and dates, are ordinary. A
quarter of the samples sets the thresholds, at which at most ``FALSE_SHARE`` of the
ordinary ones count as secrets.

Spans of fixed patterns are cut out of a text first. A run of what remains is judged as a
whole, and if that is ordinary, by its pieces between separators and by every window of
``WINDOW`` characters, so a key that is joined to words is still found; a window reports the
pieces it touches.

Everything is SQL functions: a text is scanned where it lies, without a shuffle, and
positions come from the lengths of the pieces between matches. Model and threshold are
a few thousand numbers, whatever the input.

Defined results: null texts are empty and have no spans; overlapping spans of different
fixed kinds all stay; random spans overlap no other. Columns that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from smudgelab.llm.common import fresh_name, sampled, whole_texts, without

#: Fixed kinds in their order: pattern, group that must be long enough, its least length.
KINDS = {
    "assign": (
        r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Cheap tests that a text with a span of a kind passes.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
RANDOM = "random"
#: Characters of the models, in order of their place; any other is one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SYMBOLS = len(ALPHABET) + 1
#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What joins pieces of a run, and the length of the windows and least length of the pieces judged.
SEPARATORS = r"[/_=-]"
WINDOW = 20
#: Labelled samples: random strings, and documents whose words make ordinary ones.
RANDOM_SAMPLES = 4000
SAMPLED_DOCUMENTS = 400
FALSE_SHARE = 0.0005
#: Runs of fewer different characters are rules and fillers, not random.
LEAST_DIFFERENT = 6
#: Usual parts of identifiers (fixed values), and how many names are made of them.
NAME_PARTS = (
    "get set value index count name user file path source main test data input output request response "
    "handler manager service config default error message length buffer table column result model view "
    "controller function variable long some very here quick brown the fox jumps over reader writer parser "
    "java python string number object array list map key node tree first last next previous start end time "
    "date year month day http www com org html image style class public private static void return while"
)
NAMES = 3000


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by (character, next character), and the thresholds a character:
    of a run or piece, and of the best window of a run."""

    ratios: tuple[float, ...]
    threshold: float
    window: float


def _numbers(values: Iterable[float]) -> Column:
    """An array literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _places(text: Column) -> Column:
    """The place in the alphabet of each character."""
    codes = [len(ALPHABET)] * 128
    for place, c in enumerate(ALPHABET):
        codes[ord(c)] = place
    places = F.split(F.lit(",".join(map(str, codes))), ",").cast("array<int>")
    chars = F.split(text, "")
    return F.transform(chars, lambda c: F.coalesce(F.get(places, F.ascii(c)), F.lit(len(ALPHABET))))


def _bigrams(text: Column) -> Column:
    """The cell of each pair of neighbouring characters."""
    places = _places(text)
    return F.zip_with(
        F.slice(places, 1, F.size(places) - 1),
        F.slice(places, 2, F.size(places) - 1),
        lambda a, b: a * SYMBOLS + b,
    )


def _random_strings(spark: SparkSession) -> DataFrame:
    """Digests as hex, Base64, Base64 for URLs, and capitals with digits."""
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    value = (
        F.when(F.col("id") % 4 == 0, digest)
        .when(F.col("id") % 4 == 1, base64)
        .when(F.col("id") % 4 == 2, F.translate(base64, "+/", "-_"))
        .otherwise(F.translate(F.upper(base64), "+/", "77"))
    )
    length = 20 + F.pmod(F.xxhash64("id"), F.lit(24))
    return spark.range(RANDOM_SAMPLES).select(
        F.substring(value, F.lit(1), length.cast("int")).alias("sample"), F.lit(1).alias("secret")
    )


def _identifiers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Words of a sample of documents, joined the ways identifiers are."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = sampled(rows, ["id"], SAMPLED_DOCUMENTS, "secret sample").where("text is not null")
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), 1)
    rows = chosen.select(words.alias("w")).where(F.size("w") >= 4)
    places = F.sequence(F.lit(1), F.size("w") - 3, F.lit(3))
    four = rows.select(F.explode(F.transform(places, lambda i: F.slice("w", i, 4))).alias("w"))
    parts = F.split(F.lit(NAME_PARTS), " ")
    picks = F.transform(
        F.sequence(F.lit(1), F.lit(5)),
        lambda i: F.get(parts, F.pmod(F.xxhash64("id", i), F.size(parts)).cast("int")),
    )
    four = four.unionByName(df.sparkSession.range(NAMES).select(picks.alias("w")))
    kind = F.pmod(F.xxhash64(F.concat_ws(" ", "w")), F.lit(7))
    number = F.pmod(F.xxhash64(F.concat_ws("+", "w")), F.lit(30)).cast("string")
    capital = F.transform("w", lambda x: F.initcap(x))
    value = (
        F.when(kind == 0, F.array_join("w", "_"))
        .when(kind == 1, F.array_join("w", "-"))
        .when(kind == 2, F.array_join("w", "/"))
        .when(kind == 3, F.array_join(capital, ""))
        .when(kind == 4, F.upper(F.array_join("w", "_")))
        .when(kind == 5, F.concat(F.array_join("w", ""), F.lit("_20"), number, F.lit("-01-"), number))
        .otherwise(F.array_join("w", ""))
    )
    return four.select(value.alias("sample"), F.lit(0).alias("secret"))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts both models; documents give words only, so no label of theirs is needed."""
    samples = _random_strings(df.sparkSession).unionByName(_identifiers(df, id_col, text_col))
    samples = samples.withColumn("check", F.pmod(F.xxhash64("sample"), F.lit(4)) == 0)
    counted = (
        samples.where(~F.col("check"))
        .select("secret", F.explode(_bigrams(F.col("sample"))).alias("cell"))
        .groupBy("cell")
        .agg(F.sum("secret").alias("random"), F.sum(1 - F.col("secret")).alias("ordinary"))
        .collect()
    )
    cells = {r["cell"]: (r["random"], r["ordinary"]) for r in counted}
    ratios = []
    for a in range(SYMBOLS):
        row = [cells.get(a * SYMBOLS + b, (0, 0)) for b in range(SYMBOLS)]
        totals = [sum(x[k] for x in row) + SYMBOLS for k in (0, 1)]
        ratios += [log((x[0] + 1) / totals[0]) - log((x[1] + 1) / totals[1]) for x in row]
    scored = samples.where("check and secret = 0").select(
        _mean_ratio(F.col("sample"), ratios).alias("score"),
        F.array_max(_let(_bigrams(F.col("sample")), lambda cells: F.transform(
            _window_starts(cells), lambda i: _window_ratio(cells, i, _numbers(ratios))
        ))).alias("window"),
    )
    limits = scored.agg(*[F.percentile_approx(c, 1 - FALSE_SHARE, 10_000) for c in ("score", "window")]).first()
    return Model(tuple(ratios), *[max(limit or 0.0, 0.0) + 0.1 for limit in limits])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_starts(cells: Column) -> Column:
    """Where windows of a run with these pairs start."""
    last = F.size(cells) - (WINDOW - 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _window_ratio(cells: Column, start: Column, table: Column) -> Column:
    pairs = F.slice(cells, start + 1, F.lit(WINDOW - 1))
    return F.aggregate(pairs, F.lit(0.0), lambda s, c: s + F.get(table, c)) / (WINDOW - 1)


def _mean_ratio(text: Column, ratios: Iterable[float]) -> Column:
    table = _numbers(ratios)
    cells = _bigrams(text)
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.get(table, c)) / F.size(cells)


#: Elements that are scanned in one go, and code points that a text is cut into.
RUN, CHUNK = 64, 4096
PLACES = "array<struct<start:int,end:int>>"


def _place(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _merged(places: Column, gap: int) -> Column:
    """Places in order, those at most ``gap`` characters apart joined."""
    start = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.array().cast(PLACES).alias("out"))

    def closed(acc: Column) -> Column:
        last = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        return F.when(acc["start"] >= 0, F.concat(acc["out"], last)).otherwise(acc["out"])

    def add(acc: Column, p: Column) -> Column:
        joins = (acc["start"] >= 0) & (p["start"] <= acc["end"] + gap)
        return F.struct(
            F.when(joins, acc["start"]).otherwise(p["start"]).alias("start"),
            F.when(joins, F.greatest(acc["end"], p["end"])).otherwise(p["end"]).alias("end"),
            F.when(joins, acc["out"]).otherwise(closed(acc)).alias("out"),
        )

    return F.aggregate(places, start, add, closed)


def _scanned(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``step`` makes of those before it, beginning with ``start``.

    Elements are taken in runs of ``RUN``, and runs put together after, so the work is
    nearly linear: an array that grows by one is copied for every element.
    """

    def scan(xs: Column) -> Column:
        empty = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            xs,
            empty,
            lambda acc, x: F.struct(
                step(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def whole(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(start), lambda acc, x: step(acc, x).cast("int"))

    def runs(xs: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest((F.size(xs) - 1), F.lit(0)).cast("int"), F.lit(RUN))
        return F.transform(firsts, lambda i: F.slice(xs, i + 1, F.lit(RUN)))

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, whole))
        inside = F.transform(parts, scan)
        return F.flatten(F.zip_with(inside, before, lambda p, b: F.transform(p, lambda x: step(x, b).cast("int"))))

    return _let(values, lambda xs: _let(runs(xs), joined))


def _cut(text: Column) -> Column:
    """A text in chunks of ``CHUNK`` code points, so that pieces of it are cut from near by."""
    firsts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(CHUNK))
    return F.transform(firsts, lambda i: F.substring(text, i + 1, F.lit(CHUNK)))


def _piece(chunks: Column, start: Column, length: Column) -> Column:
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + length) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(length > 0, F.substring(near, start - first * CHUNK + 1, length)).otherwise(F.lit(""))


def _pieces(run: Column) -> Column:
    """Places of the pieces between separators."""

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, F.length)
        starts = _scanned(F.transform(lengths, lambda n: n + 1), 0, lambda a, x: a + x)
        places = F.zip_with(starts, lengths, lambda at, n: _place(at, at + n))
        return F.filter(places, lambda p: p["end"] > p["start"])

    return _let(F.split(run, SEPARATORS, -1), placed)


def _random_places(run: Column, model: Model) -> Column:
    """Places in a run that are random: all of it, or the pieces that are or that a random window touches."""
    table = _numbers(model.ratios)

    def random(text: Column) -> Column:
        different = F.size(F.array_distinct(F.split(text, ""))) >= LEAST_DIFFERENT
        return different & (_mean_ratio(text, model.ratios) > model.threshold)

    def hits(cells: Column) -> Column:
        starts = F.filter(
            _window_starts(cells),
            lambda i: (_window_ratio(cells, i, table) > model.window)
            & (F.size(F.array_distinct(F.slice(cells, i + 1, F.lit(WINDOW - 1)))) >= LEAST_DIFFERENT),
        )
        return _merged(F.transform(starts, lambda i: _place(i, i + WINDOW)), 0)

    def touched(windows: Column) -> Column:
        pieces = F.filter(
            _pieces(run),
            lambda p: F.exists(windows, lambda w: (w["start"] < p["end"]) & (p["start"] < w["end"]))
            | (
                (p["end"] - p["start"] >= WINDOW)
                & random(F.substring(run, p["start"] + 1, p["end"] - p["start"]))
            ),
        )
        return _merged(pieces, 2)

    whole = F.array(_place(F.lit(0), F.length(run)))
    return F.when(random(run), whole).otherwise(_let(_let(_bigrams(run), hits), touched))


def _replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``mark(span, end of the spans before it)`` in place of the spans, which come in order."""

    def written(chunks: Column, ends: Column) -> Column:
        def part(s: Column, before: Column) -> Column:
            return F.concat(_piece(chunks, before, F.greatest(s["start"] - before, F.lit(0))), mark(s, before))

        last = F.greatest(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        rest = _piece(chunks, last, F.greatest(F.length(text) - last, F.lit(0)))
        return F.concat(F.array_join(F.zip_with(spans, ends, part), ""), rest)

    ends = _scanned(F.transform(spans, lambda s: s["end"]), 0, lambda a, x: F.greatest(a, x))
    return _let(_cut(text), lambda chunks: _let(ends, lambda e: written(chunks, e)))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans."""
    return _replaced(
        text, spans, lambda s, before: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(before, s["start"]), F.lit(0)))
    )


def _spans(text: Column, pattern: str, kind: int, places: Callable[[Column], Column]) -> Column:
    """(start, kind, end) of the places in each match, from the pieces around the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), F.length)

    def moved(both: Column) -> Column:
        begins = _scanned(F.transform(both, lambda x: x["gap"] + F.length(x["match"])), 0, lambda a, x: a + x)

        def spans(x: Column, at: Column) -> Column:
            begin = at + x["gap"]
            return F.transform(
                places(x["match"]),
                lambda p: F.struct(
                    (begin + p["start"]).alias("start"), F.lit(kind).alias("kind"), (begin + p["end"]).alias("end")
                ),
            )

        return F.flatten(F.zip_with(both, begins, spans))

    matches = _let(found, lambda f: F.zip_with(
        f, F.slice(between, 1, F.size(f)), lambda m, g: F.struct(m.alias("match"), g.alias("gap"))
    ))
    return _let(matches, moved)


NO_SPANS = "array<struct<start:int,kind:int,end:int>>"


def find(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``spans``: (start, kind, end) in code points, end exclusive, in order.

    ``kind`` is the place of the kind in ``KINDS``; the one after the last is ``random``.
    """
    df = without(df, "spans")
    text = whole_texts(F.col(text_col))
    none = F.array().cast(NO_SPANS)
    fixed = []
    for kind, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        def places(match: Column, pattern=pattern, group=group, least=least) -> Column:
            passes = F.length(F.regexp_extract(match, pattern, group)) >= least
            whole = F.array(_place(F.lit(0), F.length(match)))
            return F.when(passes, whole).otherwise(F.array().cast(PLACES))
        fixed.append(F.when(text.rlike(HINTS[name]), _spans(text, pattern, kind, places)).otherwise(none))
    own = fresh_name(df.columns, "_fixed")
    rest = fresh_name(df.columns, "_rest")
    found = df.withColumn(own, F.array_sort(F.concat(*fixed)))
    found = found.withColumn(rest, F.when(F.size(own) > 0, _blanked(text, F.col(own))).otherwise(text))
    random = F.when(
        F.col(rest).rlike(CANDIDATE),
        _spans(F.col(rest), CANDIDATE, len(KINDS), lambda run: _random_places(run, model)),
    ).otherwise(none)
    found = found.withColumn("spans", F.array_sort(F.concat(own, random)))
    return found.drop(own, rest)


def described(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` (with ``spans``) with every span of the text replaced by ``mark``."""
    text = F.col(text_col)
    cleaned = _replaced(
        text, F.col("spans"), lambda s, before: F.when(s["start"] >= before, F.lit(mark)).otherwise(F.lit(""))
    )
    return df.withColumn(text_col, F.when(F.size("spans") > 0, cleaned).otherwise(text))
