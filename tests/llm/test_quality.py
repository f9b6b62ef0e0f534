from __future__ import annotations

from smudgelab.llm import quality


def test_repeated_words():
    assert quality.repeated_words("a b c d a b c e".split()) == 6
    assert quality.repeated_words("a a a a".split()) == 4
    assert quality.repeated_words("a b c".split()) == 0
    assert quality.repeated_words([]) == 0


def test_counts():
    text = "# one two\nthree\n\n \t\nthree\nünï $\x0b%"
    assert quality.counts_of(text) == (8, 22, 3, 4, 1, 0)
    assert quality.counts_of("") == (0, 0, 0, 0, 0, 0)


def _texts(n, marks, lang, source, start):
    """Plain texts; every third has so many marks for 80 words."""
    words = [f"w{i}x{i % 7}" for i in range(80)]
    return [(start + i, " ".join(words[i % 5 :] + ["#" * marks] * (i % 3 == 0)), lang, source) for i in range(n)]


def _fences(df):
    groups = df.select("lang", "source").distinct()
    return {(r["lang"], r["source"]): r for r in quality.thresholds(quality.sketches(df), groups).collect()}


def test_fences_differ_where_rates_differ(spark, documents):
    rows = _texts(1200, 4, "en", "prose", 0) + _texts(1200, 60, "en", "code", 5000) + _texts(900, 20, "de", "prose", 9000)
    df = quality.counted(documents(*rows)).drop("text")
    fences = _fences(df)
    high = {g: r["symbols"]["high"] for g, r in fences.items()}
    assert high["en", "prose"] < high["de", "prose"] < high["en", "code"]
    # the same marks are usual in code and out of the way in prose
    more = documents((20000, rows[1][1] + " " + "#" * 30, "en", "prose"), (20001, rows[1][1] + " " + "#" * 30, "en", "code"))
    both = df.unionByName(quality.counted(more).drop("text"))
    kept = {(r["doc_id"], r["source"]): r["kept"] for r in quality.judged(both).collect()}
    assert kept[20001, "code"] and not kept[20000, "prose"]


def test_fences_by_hand(spark):
    counts = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    rows = [(i, "en", "a", 100, 1000, i, 10, 0, 0, False) for i in range(301)]
    rows += [(1000, "en", "b", 100, 1000, 900, 10, 0, 0, False), (1001, "de", "b", 100, 1000, 0, 10, 0, 0, False)]
    rows += [(1002, "de", "c", 100, 1000, 999, 10, 0, 0, True)]  # failed before: not sketched
    fences = _fences(spark.createDataFrame(rows, counts))
    # 301 texts show a symbol: cells 1 to 300, and 900
    overall = 298
    english = (301 * 298 + 200 * overall) // 501
    assert fences["en", "a"]["symbols"]["high"] == (300 * 297 + 200 * english) // 500
    assert fences["en", "b"]["symbols"]["high"] == (1 * 900 + 200 * english) // 201
    assert fences["de", "b"]["symbols"]["high"] == fences["de", "c"]["symbols"]["high"] == overall
    assert fences["de", "b"]["lines"] is None or fences["de", "b"]["lines"]["high"] is None
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, counts)).collect()}
    assert not kept[1000] and kept[1001] and not kept[1002] and not kept[300] and kept[297]


def test_a_group_is_drawn_to_its_language_by_its_size(spark, documents):
    def fence(n):
        rows = _texts(2000, 4, "en", "much", 0) + _texts(n, 40, "en", "few", 5000)
        return _fences(quality.counted(documents(*rows)).drop("text"))["en", "few"]["symbols"]["high"]

    found = [fence(n) for n in (3, 90, 900)]
    assert found == sorted(found) and found[0] < found[2]


def test_awkward_rows(awkward):
    clash = awkward.selectExpr("*", "1 AS _counts", "2 AS fence_lang", "3 AS rate", "4 AS fence_symbols", "5 AS _lang")
    df = quality.counted(clash.withColumnRenamed("n_chars", "Kept")).drop("text")
    rows = quality.judged(df).collect()
    assert {(r["_counts"], r["fence_lang"], r["rate"], r["fence_symbols"], r["_lang"]) for r in rows} == {(1, 2, 3, 4, 5)}
    assert len(rows) == awkward.count()
    assert {r["doc_id"]: r["base_failed"] for r in rows}[1]
    assert quality.judged(quality.counted(awkward.limit(0)).drop("text")).count() == 0
