from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken

from smudgelab.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_random_texts(coder, library):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abeinst \n0ñß日🙂'$aaa") for _ in range(draw.randint(0, 120))) for _ in range(800)]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids.tolist()) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 20_000, "abc" * 7_000, " " * 9_999, "éè" * 3_000])
def test_very_long_pretokens(coder, library, piece):
    assert next(iter(coder.encode_all([piece]))).tolist() == library.encode_ordinary(piece)


def test_one_at_a_time_is_the_same(coder):
    for piece in (b"aaaaaaa", b" thndhawh", "日本語日本".encode(), b"abababab"):
        if piece not in RANKS:
            ids, counts = coder.merge([piece, b"", b" the", piece])
            one = coder.merge_one(piece)
            assert ids.tolist() == [*one, RANKS[b" the"], *one] and counts.tolist() == [len(one), 0, 1, len(one)]


def test_lower_rank_that_appears_late():
    # "xab" has a rank below that of "ab", but no pair leads to it before "ab" is merged.
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"xab": 256, b"ab": 300, b"abab": 301, b"xabab": 302}
    coder = bpe.ByteBpe(ranks, r".+")
    library = tiktoken.Encoding("tiny", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xab", "xabab", "abxabab", "ababxab", "xxabab" * 3):
        assert next(iter(coder.encode_all([text]))).tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 5)
    monkeypatch.setattr(bpe, "MERGED_TOGETHER", 3)
    texts = ["one two three four", "two five six", "", "seven eight one"] * 3
    coder = bpe.ByteBpe(RANKS, PATTERN)
    for _ in range(3):  # as task after task
        got = [ids.tolist() for ids in coder.encode_all(texts)]
        assert got == [library.encode_ordinary(t) for t in texts]
        assert len(coder.pieces) <= 5
    monkeypatch.setattr(bpe, "KEPT_CHARS", 3)
    assert [ids.tolist() for ids in coder.encode_all(texts)] == got


def test_stopped_half_way(coder, library):
    some = coder.encode_all(["zzqx qqzx", "never read"])
    some.close()
    started = coder.encode_all(iter(["first wxyzq", "second"]))
    next(started)
    started.close()
    for text in ("first wxyzq", "zzqx second"):
        assert next(iter(coder.encode_all([text]))).tolist() == library.encode_ordinary(text)


def test_awkward_rows(spark, awkward):
    clash = awkward.withColumnRenamed("n_chars", "IDS").withColumnRenamed("lang", "_coded")
    coded = bpe.decode(bpe.encode(clash, RANKS, PATTERN), RANKS)
    rows = coded.select("text", "ids", "bytes").collect()
    assert len(rows) == awkward.count()
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in rows)
    assert bpe.encode(awkward.limit(0), RANKS, PATTERN).count() == 0
    once = bpe.encode_and_decode(clash, RANKS, PATTERN).select("text", "ids", "bytes")
    assert sorted(map(str, once.collect())) == sorted(map(str, rows))
    kept = bpe.encode_and_decode(clash, RANKS, PATTERN)
    assert sorted(map(str, kept.select("_coded").collect())) == sorted(map(str, clash.select("_coded").collect()))
