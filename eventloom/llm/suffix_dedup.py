"""Suffix-array dedup by external induced sorting (bytes).

The frame in `repeats` routes the contexts of recurring anchors to shards. In a shard the
contexts are one string, with separators, and its suffixes are sorted by induction:

1. suffixes are of type L or S; the leftmost S of each run (LMS) are put in the queue by their
   first byte, and one pass up and one pass down induce the order of the LMS substrings;
2. equal LMS substrings get equal names; where names repeat, the string of names is sorted in
   turn (by doubling of its rank pairs, since its alphabet is as large as it is long);
3. the LMS suffixes, now in order, induce all others in two more passes.

The priority queue has one first-in-first-out file for each byte: the key is the first byte
of a suffix, ties are by arrival, and whole pieces of suffixes are taken and put at a time.
What exceeds QUEUE_BYTES in memory goes to files in the worker's temporary folder, which are
removed with the queue. Text, types and results of a group stay in memory, so the groups are
bounded (SORT_BYTES), not the queues alone.

Neighbours in suffix order are then compared to the window length, eight bytes at a time:
a window recurs if and only if a neighbour shares it.

Defined results: null texts have no bytes; windows do not cross documents; repeated rows are
occurrences of their own; a text shorter than a window keeps all its bytes; an empty table gives
no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.repeats import Kind, groups_of, remove_repeats, runs, spans_batch

WINDOW, GRAM = 400, 96
#: Bytes of contexts that are sorted together, and of queued suffixes that stay in memory.
SORT_BYTES, QUEUE_BYTES = 4 << 20, 64 << 20


class SymbolQueue:
    """First in, first out for each symbol, in memory up to a limit and in files beyond it."""

    def __init__(self, symbols: int, limit: int | None = None):
        self.parts: list[deque] = [deque() for _ in range(symbols)]
        self.limit, self.held, self.dir, self.files = QUEUE_BYTES if limit is None else limit, 0, None, 0

    def put(self, symbol: int, at: np.ndarray) -> None:
        if not len(at):
            return
        if self.held + at.nbytes > self.limit:
            if self.dir is None:
                self.dir = tempfile.mkdtemp(prefix="suffixes-")
            path = f"{self.dir}/{self.files}"
            self.files += 1
            at.tofile(path)
            self.parts[symbol].append((path, at.dtype))
            return
        self.held += at.nbytes
        self.parts[symbol].append(at)

    def deal(self, symbols: np.ndarray, at: np.ndarray) -> None:
        """Each position to the queue of its symbol, in order."""
        if not len(at):
            return
        o = np.argsort(symbols, kind="stable")
        symbols, at = symbols[o], at[o]
        cut = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for piece, s in zip(np.split(at, cut), symbols[np.concatenate([[0], cut])], strict=True):
            self.put(int(s), piece)

    def take(self, symbol: int) -> Iterator[np.ndarray]:
        """Pieces until the queue of the symbol is empty, those put meanwhile included."""
        q = self.parts[symbol]
        while q:
            x = q.popleft()
            if isinstance(x, tuple):
                piece = np.fromfile(x[0], x[1])
                os.unlink(x[0])
                yield piece
            else:
                self.held -= x.nbytes
                yield x

    def close(self) -> None:
        if self.dir is not None:
            shutil.rmtree(self.dir, ignore_errors=True)


def types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one after it (type S)."""
    n = len(t)
    out = np.zeros(n, bool)
    if n > 1:
        differ = np.flatnonzero(t[1:] != t[:-1])
        nxt = np.searchsorted(differ, np.arange(n))
        ok = nxt < len(differ)
        j = differ[nxt[ok]]
        out[ok] = t[j] < t[j + 1]
    return out


def induce(t: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All positions in the order that the given order of the LMS positions induces."""
    n = len(t)
    up, down, seeds = SymbolQueue(symbols), SymbolQueue(symbols), SymbolQueue(symbols)
    try:
        seeds.deal(t[lms], lms)
        up.put(int(t[n - 1]), np.array([n - 1], lms.dtype))
        kept: list[list[np.ndarray]] = []
        for c in range(symbols):  # type L, from the smallest symbol up
            own = []
            for piece in up.take(c):
                own.append(piece)
                before = piece[piece > 0] - 1
                s = t[before]
                ok = s >= c
                up.deal(s[ok], before[ok])
            kept.append(own)
            for piece in seeds.take(c):
                before = piece[piece > 0] - 1
                up.deal(t[before], before)
        out: list[np.ndarray] = []
        for c in range(symbols - 1, -1, -1):  # type S, from the largest down
            for piece in down.take(c):
                out.append(piece)
                before = piece[piece > 0] - 1
                s = t[before]
                ok = s <= c
                down.deal(s[ok], before[ok])
            for piece in reversed(kept[c]):
                back = piece[::-1]
                out.append(back)
                before = back[back > 0] - 1
                s = t[before]
                ok = s < c
                down.deal(s[ok], before[ok])
        return np.concatenate(out)[::-1]
    finally:
        for q in (up, down, seeds):
            q.close()


def named_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling, as far as the first depth names tell."""
    rank, h = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-h] = rank[h:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.zeros(len(rank), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        rank, h = new, 2 * h
        if rank[order[-1]] == len(rank) - 1:
            break
    return order


def suffix_order(t: np.ndarray, depth: int, symbols: int = 257) -> np.ndarray:
    """Positions of t in the order of their suffixes, exact as far as their first depth symbols."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if len(lms) > 1:
        first = induce(t, lms, symbols)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        first = first[is_lms[first]]
        # Names: an LMS substring reaches to the next LMS position, included.
        index = np.zeros(n, np.int32)
        index[lms] = np.arange(len(lms))
        end = np.append(lms[1:], n - 1)
        a, b = first[:-1], first[1:]
        size_a, size_b = end[index[a]] - a, end[index[b]] - b
        same = size_a == size_b
        alive = np.flatnonzero(same)
        o = 0
        while len(alive):
            alive = alive[size_a[alive] >= o]
            differ = t[a[alive] + o] != t[b[alive] + o]
            same[alive[differ]] = False
            alive = alive[~differ]
            o += 1
        names = np.empty(len(lms), np.int64)
        names[index[first]] = np.concatenate([[0], np.cumsum(~same)])
        order = index[first] if names.max() == len(lms) - 1 else named_order(names, depth)
        lms = lms[order]
    return induce(t, lms, symbols)


def shared_prefix(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each two neighbours of the order, whether their first length bytes are equal."""
    pad = np.concatenate([data, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(pad) - 7, np.uint64)
    for k in range(8):
        word |= pad[k : len(word) + k] << np.uint64(8 * k)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    out = np.zeros(len(a), bool)
    alive = np.arange(len(a))
    for o in [*range(0, length - 7, 8), length - 8]:
        alive = alive[word[a[alive] + o] == word[b[alive] + o]]
    out[alive] = True
    return out


def recurring(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Starts, in each context, of the windows that start elsewhere in the contexts too."""
    size = np.array([len(c) for c in contexts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    t = joined.astype(np.uint16) + 1
    t[begin[1:] - 1] = 0
    order = suffix_order(t, length)
    valid = np.zeros(len(t), bool)
    for a, n in zip(begin[:-1], size, strict=True):
        valid[a : a + max(0, n - length + 1)] = True
    order = order[valid[order]]
    same = shared_prefix(joined, order, length)
    hit = np.zeros(len(t), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(begin[:-1], size, strict=True)]


def _sorted(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    for rows, single in groups_of(batches, SORT_BYTES):
        # A context that occurs more than once recurs as a whole; others may share windows with it.
        out = [(ck, [(0, len(ctx))]) for ck, ctx, n in rows + single if n > 1]
        if rows:
            for (ck, _, n), at in zip(rows, recurring([r[1] for r in rows], kind.length), strict=True):
                if n == 1 and len(at):
                    out.append((ck, runs(at, kind.length)))
        yield spans_batch(out)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text that is left, if asked for)."""
    return remove_repeats(docs, Kind("byte", window, gram), _sorted, text).withColumnRenamed("n", "n_bytes")
