"""Byte-level BPE encoding and decoding.

Merging works on a rank queue: one bucket per merge rank holds the positions of a
linked list whose pair has that rank, and a bitmap of three levels of 64-bit words
says which buckets hold anything. Finding the first set bit on each level gives the
lowest rank at a cost that depends neither on the number of positions nor on the
number of ranks; positions whose pair has changed meanwhile are skipped when they
come up. One list holds many pre-tokens side by side (lowest rank first over all of
them is lowest rank first in each), so a bucket is merged by whole numpy arrays, and a
pre-token of a million letters is no special case: work is linear in its length.

Texts are independent, so there is no shuffle: one pass for the ids, one for the
bytes. A task remembers the ids of about ``KEPT`` pre-tokens and forgets the older
half beyond that; a Python worker that waits for its next task holds none of them, and gives its free memory
back. Results don't depend on it.

Defined results: a null or empty text has no ids, null ids decode to no bytes, rows
may repeat, an empty table gives an empty table, columns that clash with the added ones
(in any case) are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smudgelab.llm.common import bounded_batches, fresh_name, give_memory_back, whole_texts, without

#: New pre-tokens that are merged together, and pre-tokens a task remembers.
MERGED_TOGETHER = 80_000
KEPT = 150_000
#: Characters of pre-tokens merged together, and characters of text that wait for their ids.
MERGED_CHARS = 2_000_000
WAITING_CHARS = 4_000_000
#: Ids and characters of pre-tokens that a task remembers.
KEPT_IDS, KEPT_CHARS = 2_000_000, 4_000_000
#: Arrow batches: as much text as waits together.
BATCH = "4m"


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a line has the token in base64 and its rank."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class RankQueue:
    """Positions by rank, with a bitmap of three levels over the ranks in use."""

    def __init__(self, n_ranks: int) -> None:
        self.buckets: list[list] = [[] for _ in range(n_ranks)]
        self.low = [0] * (n_ranks // 64 + 1)
        self.middle = [0] * (n_ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int | np.ndarray) -> None:
        """Adds a position, or an array of them as the first entry of its bucket."""
        bucket = self.buckets[rank]
        if not bucket:
            word = rank >> 6
            self.low[word] |= 1 << (rank & 63)
            self.middle[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        bucket.append(position)

    def first(self) -> int:
        """The lowest rank in use, or -1."""
        top = self.top
        if not top:
            return -1
        upper = (top & -top).bit_length() - 1
        middle = self.middle[upper]
        word = (upper << 6) | ((middle & -middle).bit_length() - 1)
        low = self.low[word]
        return (word << 6) | ((low & -low).bit_length() - 1)

    def take(self, rank: int) -> list:
        """All positions of a rank; its bucket is empty afterwards."""
        bucket, self.buckets[rank] = self.buckets[rank], []
        word = rank >> 6
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.top &= ~(1 << (word >> 6))
        return bucket


def _every_other(positions: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of pairs that overlap in a row (as in "aaa"), the first, third, ... one."""
    chained = positions[1:] == after[positions[:-1]]
    if not chained.any():
        return positions
    place = np.arange(len(positions))
    starts = np.where(np.concatenate(([True], ~chained)), place, 0)
    return positions[(place - np.maximum.accumulate(starts)) % 2 == 0]


class _Pieces(dict):
    """Numbers pre-tokens; those not met before are listed in ``fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.fresh_chars = self.chars = 0

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        self.fresh.append(piece)
        self.fresh_chars += len(piece)
        return at

    def merged(self) -> None:
        """The fresh pre-tokens have their ids."""
        self.chars += self.fresh_chars
        self.fresh, self.fresh_chars = [], 0

    def newer_half(self) -> tuple[_Pieces, int]:
        """The pre-tokens numbered last, numbered anew, and how many were left out."""
        out, half = _Pieces(), len(self) // 2
        for piece, at in self.items():
            if at >= half:
                out[piece] = at - half
                out.chars += len(piece)
        return out, half


class ByteBpe:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values(), default=0) + 1
        self.queue = RankQueue(self.size)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # Every way to put a token together from two others, as one sorted key.
        keys, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    found.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(found, dtype=np.int32)[order], np.int32(-1))
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.flat = np.empty(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def remember_less(self) -> None:
        """Forgets older pre-tokens, half of them at a time, until few enough are left."""
        while len(self.pieces) > KEPT or len(self.flat) > KEPT_IDS or self.pieces.chars > KEPT_CHARS:
            if len(self.pieces) < 2:
                return self.forget()
            self.pieces, out = self.pieces.newer_half()
            self.flat = self.flat[self.ends[out] :].copy()
            self.ends = self.ends[out:] - self.ends[out]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; -1 where they don't merge (or right is no token)."""
        keys = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (right >= 0), self.pair_ranks[at], np.int32(-1))

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, strictly one merge at a time."""
        ranks, queue, n = self.ranks, self.queue, len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n

        def look(i: int) -> None:
            pair[i] = -1 if after[i] >= n else ranks.get(token[i] + token[after[i]], -1)
            if pair[i] >= 0:
                queue.push(pair[i], i)

        for i in range(n - 1):
            look(i)
        while (rank := queue.first()) >= 0:
            waiting = sorted(queue.take(rank))
            for done, i in enumerate(waiting, 1):
                if pair[i] != rank:
                    continue
                j = after[i]
                token[i] += token[j]
                after[i] = after[j]
                pair[j] = -1
                if after[i] < n:
                    before[after[i]] = i
                look(i)
                if before[i] >= 0:
                    look(before[i])
                if 0 <= queue.first() < rank:
                    for k in waiting[done:]:
                        queue.push(rank, k)
                    break
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i]])
            i = after[i]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after the other, and their number for each."""
        whole = np.array([self.ranks.get(piece, -1) for piece in pieces], dtype=np.int32)
        counts = (whole >= 0).astype(np.int64)
        open_ = [k for k in np.flatnonzero(whole < 0).tolist() if pieces[k]]
        found, counts[open_] = self._merged([pieces[k] for k in open_])
        last = np.cumsum(counts)
        ids = np.empty(int(last[-1]) if len(last) else 0, dtype=np.int32)
        ids[last[whole >= 0] - 1] = whole[whole >= 0]
        own = counts[open_]
        ids[np.arange(len(found)) + np.repeat(last[open_] - np.cumsum(own), own)] = found
        return ids, counts

    def _merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens that are no token; the pairs of one rank are merged all at once."""
        if not pieces:
            return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        n = len(raw)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        token = np.append(self.byte_ids[raw], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[starts] = n
        pair = np.full(n + 1, -1, dtype=np.int32)
        pair[:n] = self.lookup(token[:n], token[after[:n]])
        alive = np.ones(n, dtype=bool)
        queue, lower = self.queue, []

        def push(ranks: np.ndarray, positions: np.ndarray) -> None:
            for rank, position in zip(ranks.tolist(), positions.tolist(), strict=True):
                queue.push(rank, position)

        order = np.argsort(pair[:n], kind="stable").astype(np.int32)
        order = order[np.searchsorted(pair[order], 0) :]
        cuts = np.flatnonzero(np.diff(pair[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            queue.push(int(pair[same[0]]), same)
        while (rank := queue.first()) >= 0:
            bucket = queue.take(rank)
            if isinstance(bucket[0], np.ndarray):
                at = np.concatenate((bucket[0], np.array(bucket[1:], dtype=np.int32)))
            else:
                at = np.array(bucket, dtype=np.int32)
            at = at[pair[at] == rank]  # others are stale
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = _every_other(at, after)
            gone = after[at]
            right = after[gone]
            if len(at) > 1 and (beside := at[1:] == right[:-1]).any():
                # Two merges side by side: the pair that stands between them meanwhile.
                i = at[:-1][beside]
                between = self.lookup(np.full(len(i), rank), token[at[1:][beside]])
                lower.append(i[(between >= 0) & (between < rank)])
            token[at] = rank
            after[at] = right
            before[right] = at
            alive[gone] = False
            pair[gone] = -1
            left = before[at]
            left = left[left < n]
            touched = np.concatenate((at, left))
            found = self.lookup(token[touched], token[after[touched]])
            pair[touched] = found
            some = found >= 0
            touched, found = touched[some], found[some]
            if len(left) and len(touched) > 1:
                touched, once = np.unique(touched, return_index=True)
                found = found[once]
            lower.append(touched[found < rank])
            push(found, touched)
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        ids = token[:n][alive].astype(np.int32)
        # A pair of lower rank than the one being merged must go first, so such
        # pre-tokens are merged one step at a time. Usual vocabularies have none.
        late = np.unique(np.searchsorted(ends, np.concatenate(lower), side="right")) if lower else []
        if len(late):
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for m in late:
                rows[m] = np.array(self.merge_one(pieces[m]), dtype=np.int32)
            ids, counts = np.concatenate(rows), np.array([len(r) for r in rows])
        return ids, counts

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order. Texts wait until enough new pre-tokens are there."""
        waiting: list[np.ndarray] = []
        chars_waiting = 0

        def flush() -> Iterator[np.ndarray]:
            nonlocal chars_waiting
            if self.pieces.fresh:
                ids, counts = self.merge([p.encode() for p in self.pieces.fresh])
                self.ends = np.concatenate((self.ends, np.cumsum(counts) + self.ends[-1]))
                self.flat = np.concatenate((self.flat, ids))
                self.pieces.merged()
            for pieces in waiting:
                begin = self.ends[pieces]
                count = self.ends[pieces + 1] - begin
                last = np.cumsum(count)
                total = int(last[-1]) if len(last) else 0
                yield self.flat[np.arange(total) + np.repeat(begin - last + count, count)]
            waiting.clear()
            chars_waiting = 0
            self.remember_less()

        try:
            for text in texts:
                pieces = self.pieces
                waiting.append(np.fromiter(map(pieces.__getitem__, self.find(text)), dtype=np.int32))
                chars_waiting += len(text)
                if (
                    len(pieces.fresh) >= MERGED_TOGETHER
                    or pieces.fresh_chars >= MERGED_CHARS
                    or chars_waiting >= WAITING_CHARS
                ):
                    yield from flush()
            yield from flush()
        finally:
            if self.pieces.fresh:  # stopped half-way: numbers without ids
                self.forget()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_BUILT: dict[tuple[str, int], ByteBpe] = {}


def _built(ranks: dict[bytes, int], pattern: str) -> ByteBpe:
    """One per Python worker: its tables are built once."""
    key = (pattern, hash(frozenset(ranks.items())))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBpe(ranks, pattern)
    return _BUILT[key]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.empty(0, dtype=np.int32), *rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _joined(rows: Iterable[list[int]], tokens: list[bytes] | dict[int, bytes]) -> pa.Array:
    token = tokens.__getitem__
    return pa.array([b"".join(map(token, row)) for row in rows], type=pa.binary())


def encode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", to: str = "ids"
) -> DataFrame:
    """``df`` with the token ids of every whole text, as ``array<int>``.

    The vocabulary goes to the executors with the function; its size is the
    tokenizer's, whatever the input.
    """
    bounded_batches(df.sparkSession, BATCH)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _built(shared.value, pattern)
        for batch in batches:
            yield _lists(list(bpe.encode_all(text.as_py() for text in batch)))
        bpe.forget()
        give_memory_back()

    return without(df, to).withColumn(to, ids(whole_texts(df[text_col])))


def decode(
    df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "bytes"
) -> DataFrame:
    """``df`` with the bytes that an array of ids stands for."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(
        [token for token, _ in sorted(ranks.items(), key=lambda pair: pair[1])]
        if sorted(ranks.values()) == list(range(len(ranks)))
        else {rank: token for token, rank in ranks.items()}
    )

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = (row.values.to_numpy().tolist() if row.is_valid else [] for row in batch)
            yield _joined(rows, shared.value)

    return without(df, to).withColumn(to, joined(df[ids_col]))


def encode_and_decode(
    df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids: str = "ids", to: str = "bytes"
) -> DataFrame:
    """``decode(encode(df))`` in one pass: a task needs one Python worker instead of two."""
    bounded_batches(df.sparkSession, BATCH)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("struct<ids:array<int>,bytes:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = _built(shared.value, pattern)
        for batch in batches:
            rows = list(bpe.encode_all(text.as_py() for text in batch))
            decoded = _joined((row.tolist() for row in rows), bpe.tokens)
            yield pa.StructArray.from_arrays([_lists(rows), decoded], ["ids", "bytes"])
        bpe.forget()
        give_memory_back()

    df = without(df, ids, to)
    coded = fresh_name(df.columns, "_coded")
    found = df.withColumn(coded, both(whole_texts(df[text_col])))
    return found.select(*df.columns, F.col(f"{coded}.ids").alias(ids), F.col(f"{coded}.bytes").alias(to))
