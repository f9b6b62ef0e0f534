from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest

from smudgelab.llm import resemblance, simhash


def _resemblance(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def _words(draw, n=120):
    return [f"w{k}" for k in draw.integers(0, 5000, size=n)]


def _changed(words, places):
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def _texts():
    """30 texts, each with a near copy (one or two words changed) and a far one (12 changed)."""
    draw = np.random.default_rng(4)
    out = []
    for _ in range(30):
        words = _words(draw)
        out += [" ".join(words), _changed(words, {20, 80}), _changed(words, set(range(5, 120, 10)))]
    return out


def test_stage_drops_near_copies_beyond_four_bits(spark, documents):
    texts = _texts()
    near = [(a, a + 1) for a in range(0, len(texts), 3)]
    assert all(0.8 <= _resemblance(texts[a], texts[b]) < 1 for a, b in near)
    assert all(_resemblance(texts[a], texts[a + 2]) < 0.8 for a, _ in near)
    bits = [(simhash.fingerprint_of(texts[a]) ^ simhash.fingerprint_of(texts[b])).bit_count() for a, b in near]
    assert max(bits) > 4
    docs = documents(*[(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()}
    assert kept == {i for i in range(len(texts)) if i % 3 != 1}


def test_stage_links_near_fingerprints_of_unlike_sets(spark, documents):
    """Texts of one often repeated passage with ends of their own: few shingles in common, near fingerprints."""
    body = " ".join(["seven words are said here once more"] * 60)
    ends = [" ".join(f"own{i}n{k}" for k in range(20)) for i in range(3)]
    texts = [f"{body} {end}" for end in ends] + [ends[0], ends[1]]
    bits = [simhash.fingerprint_of(t) for t in texts]
    assert all((bits[0] ^ b).bit_count() <= 4 for b in bits[1:3])
    assert all((bits[0] ^ b).bit_count() > 4 for b in bits[3:])
    assert all(_resemblance(texts[0], t) < 0.8 for t in texts[1:])
    docs = documents(*[(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()}
    assert kept == {0, 3, 4}


def test_groups_go_through_either_link(spark, documents):
    """Near fingerprints lead to a text that a third one resembles: one group of all."""
    passage = "seven words are said here once more"
    ends = [" ".join(_words(np.random.default_rng(k), 60)) for k in (9, 10)]
    often = " ".join([passage] * 60)
    texts = [f"{often} {ends[0]}", f"{often} {ends[1]}", f"{passage} {ends[1]}"]
    bits = [simhash.fingerprint_of(t) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 4 < min((bits[2] ^ b).bit_count() for b in bits[:2])
    assert _resemblance(texts[0], texts[2]) < 0.8 <= _resemblance(texts[1], texts[2])
    docs = documents(*[(i, t, "en", "a") for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, docs, "").collect()}
    assert kept == {0}


@pytest.mark.parametrize("block", [6, 512])
def test_chains_and_copies_for_any_block(documents, block):
    words = _words(np.random.default_rng(5), 400)
    chain = [_changed(words, set(range(10, 10 + 7 * k, 7))) for k in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(chain)] + [(100 + i, chain[3], "en", "b") for i in range(30)]
    kept = resemblance.first_of_groups(documents(*rows), block=block).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_forest_connects_what_brute_force_does():
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 40, size=30).astype(np.uint64)) for _ in range(60)]
    root = list(range(60))
    for a, b in resemblance.forest(sets, 0.5):
        root = [root[a] if r == root[b] else r for r in root]
    want = list(range(60))
    for a in range(60):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both / (len(sets[a]) + len(sets[b]) - both) >= 0.5:
                want = [want[a] if r == want[b] else r for r in want]
    assert all((root[a] == root[b]) == (want[a] == want[b]) for a in range(60) for b in range(60))


def test_awkward_rows(awkward):
    kept = resemblance.first_of_groups(awkward).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 4, 5, 7]
    assert len(kept) == 5
    assert resemblance.first_of_groups(awkward.limit(0)).count() == 0
