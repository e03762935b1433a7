"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as the bytes of their lower-case forms, with one space for each run of spaces.
An item of m bytes may differ from a region of a text by e = EDIT_SHARE * m edits. By the q-gram
lemma such a region shares at least m - q + 1 - q * e q-grams with the item, and all of them lie on
diagonals (text position less item position) no more than e apart. The shared q-grams are
counted in bands of 2 * (e + 1) diagonals that overlap by half; bands that reach the bound are verified by a
banded alignment of the item with the region.

The items are taken in parts of at most PART_BYTES; each part is sent to the executors, all
documents pass by it, and it is let go of, so a benchmark of any size is compared in full.

An item is found as a whole: a text that quotes only a part of it, however long and true to the word,
does not contain it.

Defined results: items of both fewer than MIN_WORDS words and fewer than MIN_BYTES bytes (or of fewer
than Q bytes) are too short to be evidence inside a text, and are found where they are the whole text; null and
empty items match nothing; null texts are empty and contain nothing; repeated items are reported by each of
their ids, each once; repeated rows are judged alike; a null item_id is reported as -1; an empty table gives no rows; columns
other than doc_id, text and item_id, text are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U64, blocks, flat, prepare, stage

Q, EDIT_SHARE, MIN_WORDS, MIN_BYTES, PART_BYTES = 8, 0.1, 5, 24, 4 << 20
_SIEVE_BITS = 22
#: Shared q-grams (a place in a text and one in an item) that are counted together.
POSTINGS = 1 << 21


def lowered(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def squeezed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with single spaces between words, and the rows' offsets."""
    if not len(data):
        return data, offs
    space = (data == 32) | ((data >= 9) & (data <= 13))
    after_word = np.zeros(len(data), bool)
    after_word[1:] = ~space[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    after_word[inner] = False
    keep = ~space | after_word
    out = data[keep]
    out[space[keep]] = 32
    return out, np.concatenate([[0], np.cumsum(keep)])[offs]


def grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(Q):
        out |= data[k : k + n].astype(U64) << U64(8 * k)
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * U64(0x9E3779B97F4A7C15)) >> U64(64 - _SIEVE_BITS)).astype(np.int64)


class Items:
    """A part of the benchmark, indexed by its q-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts = [], []
        self.whole: dict[bytes, list[int]] = {}
        for i, t in rows:
            x = squeezed(*flat(lowered(pa.array([t]))))[0].tobytes().strip()
            # Scripts without spaces have few words: their items are evidence by their bytes.
            if (x.count(b" ") + 1 >= MIN_WORDS or len(x) >= MIN_BYTES) and len(x) >= Q:
                self.ids.append(i)
                self.texts.append(np.frombuffer(x, np.uint8))
            elif x:
                self.whole.setdefault(x, []).append(i)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        # The budget leaves the lemma at least one shared q-gram.
        self.edits = np.minimum((self.size * EDIT_SHARE).astype(np.int64), (self.size - Q) // Q)
        self.bound = self.size - Q + 1 - Q * self.edits
        per = [grams(t) for t in self.texts]
        g = np.concatenate([np.zeros(0, U64), *per])
        item = np.repeat(np.arange(len(per)), [len(x) for x in per])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in per]])
        o = np.argsort(g, kind="stable")
        self.item, self.at = item[o], at[o]
        self.grams, self.first = np.unique(g[o], return_index=True)
        self.last = np.append(self.first[1:], len(g))
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[_slot(self.grams)] = True
        self.least = int(self.bound.min()) if len(self.ids) else 0
        self.reach = int((self.size + self.edits).max()) if len(self.ids) else 0
        self.longest = max(map(len, self.whole), default=0)

    def found(self, data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
        """The ids of the items that each row contains."""
        out = [[self.ids[k] for k in f] for f in self.search(data, offs)]
        for r in np.flatnonzero(np.diff(offs) <= self.longest + 2).tolist() if self.whole else ():
            out[r] += self.whole.get(data[offs[r] : offs[r + 1]].tobytes().strip(), [])
        return [sorted(set(f)) for f in out]

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
        """The items, by their number in this part, that each row has inside it."""
        out: list[list[int]] = [[] for _ in range(len(offs) - 1)]
        if not self.ids or len(data) < Q:
            return out
        g = grams(data)
        at = np.flatnonzero(self.sieve[_slot(g)])
        x = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        ok = self.grams[x] == g[at]
        at, x = at[ok], x[ok]
        row = np.searchsorted(offs, at, "right") - 1
        ok = at + Q <= offs[row + 1]
        at, x, row = at[ok], x[ok], row[ok]
        # A region has at least `least` positions that are in some item, within `reach` bytes.
        if len(at) < self.least:
            return out
        near = np.zeros(len(at) + 1, np.int64)
        k = self.least - 1
        dense = (at[k:] - at[: len(at) - k] < self.reach) & (row[k:] == row[: len(at) - k])
        np.add.at(near, np.flatnonzero(dense), 1)
        np.add.at(near, np.flatnonzero(dense) + k + 1, -1)
        ok = np.cumsum(near[:-1]) > 0
        at, x, row = at[ok], x[ok], row[ok]
        n = self.last[x] - self.first[x]
        bands = int(((np.diff(offs).max() + self.size) // (self.edits + 1)).max()) + 3
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.concatenate([[0], np.cumsum(n)])
        a = 0
        while a < len(at):  # so many places of texts that they have about POSTINGS q-grams in common with items
            z = max(a + 1, int(np.searchsorted(edge, edge[a] + POSTINGS, "right")) - 1)
            hit = np.repeat(np.arange(a, z), n[a:z])
            post = np.arange(len(hit)) - (edge[hit] - edge[a]) + self.first[x][hit]
            item = self.item[post]
            diagonal = at[hit] - offs[row[hit]] - self.at[post] + self.size[item]
            half = diagonal // (self.edits[item] + 1)
            own, c = np.unique(np.concatenate([((row[hit] * len(self.ids) + item) * bands + half + d) for d in (0, 1)]), return_counts=True)  # band b holds halves b-1 and b
            if len(keys):
                keys, same = np.unique(np.concatenate([keys, own]), return_inverse=True)
                counts = np.bincount(same, np.concatenate([counts, c]), minlength=len(keys)).astype(np.int64)
            else:
                keys, counts = own, c
            a = z
        key, count = keys, counts
        item = key // bands % len(self.ids)
        ok = count >= self.bound[item]
        for k, i in zip(key[ok].tolist(), item[ok].tolist(), strict=True):
            r, band = k // bands // len(self.ids), k % bands
            if i in out[r]:
                continue
            low = (band - 1) * (int(self.edits[i]) + 1) - int(self.size[i])
            if self.aligned(data[offs[r] : offs[r + 1]], i, low, low + 2 * (int(self.edits[i]) + 1)):
                out[r].append(i)
        return out

    def aligned(self, text: np.ndarray, i: int, low: int, high: int) -> bool:
        """Whether the item and some region on the diagonals low-e..high+e differ by at most its budget."""
        t, e = self.texts[i], int(self.edits[i])
        a, width = low - e, high - low + 2 * e + 1  # column j of row r is text position a + r + j
        pad = np.zeros(len(t) + width + 1, np.uint8)
        s, z = max(0, a), min(len(text), a + len(pad))
        if s < z:
            pad[s - a : z - a] = text[s:z]
        step = np.arange(width)
        d = np.zeros(width, np.int64)
        for r in range(len(t)):
            new = d + (pad[r : r + width] != t[r])
            new[:-1] = np.minimum(new[:-1], d[1:] + 1)
            d = np.minimum.accumulate(new - step) + step
            if d.min() > e:
                return False
        return bool(d.min() <= e)


_items: dict[str, Items] = {}


def _of(part) -> Items:
    """The index of a (name, broadcast) part, kept while the worker goes on with it."""
    if part[0] not in _items:
        _items.clear()
        _items[part[0]] = Items(part[1].value)
    return _items[part[0]]


def _search(batches: Iterator[pa.RecordBatch], part, at: int) -> Iterator[list[list[int]]]:
    index = _of(part)
    for b in batches:
        data, offs = flat(lowered(b.column(at)))
        found: list[list[int]] = []
        for i, j in blocks(offs, 1 << 20):
            found += index.found(*squeezed(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
        yield b, found


def _report(batches: Iterator[pa.RecordBatch], part) -> Iterator[pa.RecordBatch]:
    for b, found in _search(batches, part, 1):
        names = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, pa.list_(pa.int64()))], names=[*names, "items"])


def _clean(batches: Iterator[pa.RecordBatch], part, at: int) -> Iterator[pa.RecordBatch]:
    for b, found in _search(batches, part, at):
        yield b.filter(pa.array([not f for f in found], pa.bool_()))


def parts(benchmark: DataFrame) -> Iterator[tuple[tuple, bool]]:
    """The benchmark on the executors, PART_BYTES at a time: (name, broadcast) and whether it is the only part. A part is let
    go of when the next one is asked for, so what has used it must be written by then."""
    sc = benchmark.sparkSession.sparkContext
    held, size, sent = [], 0, None
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("i"), F.col("text").alias("t")).filter("t is not null")
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > PART_BYTES:
            sent = sc.broadcast(held)
            yield (uuid.uuid4().hex, sent), False
            sent.destroy()
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    yield (uuid.uuid4().hex, sc.broadcast(held)), sent is None


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, items (sorted ids of the items found) of every row."""
    prepare(docs.sparkSession)
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    keyed = src.withColumn("mark", F.xxhash64("text"))  # rows are told apart by doc_id and their text's hash when the parts' answers meet
    out = None
    for part, only in parts(benchmark):
        if only:
            found = src.mapInArrow(partial(_report, part=part), "doc_id long, items array<long>")
            break
        one = stage(keyed.mapInArrow(partial(_report, part=part), "doc_id long, mark long, items array<long>").filter(F.size("items") > 0), "benchmark-part")
        out = one if out is None else out.union(one)
    else:
        merged = out.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "items")
        found = keyed.select("doc_id", "mark").join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that contain no item, with all their columns."""
    prepare(docs.sparkSession)
    for part, only in parts(benchmark):
        docs = docs.mapInArrow(partial(_clean, part=part, at=docs.columns.index("text")), docs.schema)
        if not only:
            docs = stage(docs, "benchmark-part")
    return docs
