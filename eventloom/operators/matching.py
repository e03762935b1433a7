"""Pairs of similar strings within blocks: all of them, by filters that provably miss none.

The similarity is 2 * LCS / (m + n). Strings of lengths m and n that reach `least` share a subsequence of L = ceil(least * (m + n) / 2)
characters; m - L of one and n - L of the other are left out. Each one left out breaks at most q of the q-grams of its own
string and q - 1 of the other's, so that the two share at least

    (2q - 1) L - (q - 1) (m + n) - (q - 1)   q-grams, occurrences counted.

Where that bound is large, with high `least`, it selects: each string enters its rarest trigrams into an index, as
many as it takes to share one with any partner (`by_index`). Where it is small, lists of an index would hold nearly all strings, and the bound is
worth more as a filter of counts: strings are sorted by length into tiles, tiles whose lengths can match are paired, and
matrix products bound all shared characters and bigrams of two tiles (`by_tiles`). Either way one large block is the work of many
tasks, the pairs that are left are compared many at a time, and only similar ones leave the task that met them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import scans
from eventloom.session import ship
from eventloom.staging import staged

#: Strings of a tile, and dimensions that shared grams are counted in at most.
TILE, DIMENSIONS = 1024, 2048
#: Strings up to these lengths are compared many pairs at a time: beyond the second, where there are so many pairs of them.
LONG, TOGETHER = (0, 256, 512, 1024, 2048), 192
#: Pairs that are compared at a time.
PAIRS = 1 << 15
#: Strings of a list that are compared at a time.
CHUNK = 1024
#: Length of the indexed grams.
Q = 3


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _subsequence(total: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * total / 2 - 1e-9)


# --- common subsequences of many pairs ------------------------------------------------


class _Strings:
    """Strings as code points, and the bit masks of their characters where they are short enough for them."""

    def __init__(self, s: list[str]):
        self.s = s
        self.m = np.array([len(x) for x in s], np.int64)
        self.codes = np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.repeat(np.arange(len(s)), self.m)
        self.start = np.concatenate([[0], np.cumsum(self.m)[:-1]]).astype(np.int64) if s else np.zeros(0, np.int64)
        self.place = np.arange(len(self.codes)) - self.start[self.at] if len(self.codes) else np.zeros(0, np.int64)

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(string, token): each gram of one or two characters with the number of its occurrence in its string."""
        at, key = self.at, self.codes.astype(np.int64)
        if q == 2:
            inside = np.flatnonzero(at[:-1] == at[1:]) if len(at) else np.zeros(0, np.int64)
            at, key = at[inside], key[inside] << 21 | key[inside + 1]
        order = np.lexsort((key, at))
        at, key = at[order], key[order]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(fresh)
        count = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        return at, key | np.minimum(count, (1 << 20) - 1) << 42


def _shared(a: _Strings, b: _Strings, q: int) -> np.ndarray:
    """At least the number of q-grams that each two strings share, occurrences counted."""
    (ra, ka), (rb, kb) = a.grams(q), b.grams(q)
    both = np.intersect1d(ka, kb)
    width = min(len(both), DIMENSIONS)  # folded beyond that, which only adds
    out = []
    for n, r, k in ((len(a.s), ra, ka), (len(b.s), rb, kb)):
        x = np.zeros((n, max(1, width)), np.float32)
        if width:
            i = np.minimum(np.searchsorted(both, k), len(both) - 1)
            hit = both[i] == k
            np.add.at(x, (r[hit], i[hit] % width), 1)
        out.append(x)
    return out[0] @ out[1].T


def lcs_many(a: _Strings, b: _Strings, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the pairs a[i], b[j]; -1 where they are below need.

    Pairs of like length go together; long strings go one by one, where few pairs have such."""
    out = np.full(len(i), -1, np.int64)
    longer = np.maximum(a.m[i], b.m[j])
    for low, high in zip(LONG, (*LONG[1:], None)):
        some = np.flatnonzero((longer > low) & (longer <= high) if high else longer > low)
        if high and (low == 0 or len(some) >= TOGETHER):
            out[some] = _lcs_rows(a, b, i[some], j[some], need[some])
        else:
            for k in some:
                n = lcs(a.s[i[k]], b.s[j[k]])
                out[k] = n if n >= need[k] else -1
    empty = longer == 0
    out[empty] = np.where(need[empty] <= 0, 0, -1)
    return out


def _lcs_rows(a: _Strings, b: _Strings, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The bit-parallel rows of many pairs at a time, over as many words as the longest string takes; pairs that can't reach
    what they need any more are dropped on the way."""
    out, short = np.full(len(i), -1, np.int64), np.arange(len(i))
    if not len(short):
        return out
    used_a, used_b = np.unique(i[short]), np.unique(j[short])
    row_a, row_b = np.zeros(len(a.s), np.int64), np.zeros(len(b.s), np.int64)
    row_a[used_a], row_b[used_b] = np.arange(len(used_a)), np.arange(len(used_b))
    in_a, in_b = np.isin(a.at, used_a), np.isin(b.at, used_b)
    letters = np.unique(a.codes[in_a])
    words = max(1, -(-int(a.m[used_a].max()) // 64))
    none = len(letters)
    masks = np.zeros((words, len(used_a), none + 1), np.uint64)
    place = a.place[in_a]
    np.bitwise_or.at(masks, (place // 64, row_a[a.at[in_a]], np.searchsorted(letters, a.codes[in_a])), np.uint64(1) << (place % 64).astype(np.uint64))
    masks = masks.reshape(words, -1)
    text = np.full((len(used_b), max(1, int(b.m[used_b].max()))), none, np.int32)
    c = np.minimum(np.searchsorted(letters, b.codes[in_b]), max(0, none - 1))
    known = letters[c] == b.codes[in_b] if none else np.zeros(len(c), bool)
    text[row_b[b.at[in_b]], b.place[in_b]] = np.where(known, c, none)
    bits = np.clip(a.m[used_a][None, :] - 64 * np.arange(words)[:, None], 0, 64)
    full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
    short = short[np.argsort(b.m[j[short]], kind="stable")]
    for at in range(0, len(short), PAIRS):
        part = short[at : at + PAIRS]
        x, y = row_a[i[part]], row_b[j[part]]
        m, n, least = a.m[i[part]], b.m[j[part]], need[part]
        t, base, f = np.ascontiguousarray(text[y, : max(1, int(n.max()))].T), x * (none + 1), full[:, x]
        s = f.copy()
        for k in range(int(n.max())):
            if k and k % 12 == 0:
                left = m - np.bitwise_count(s).sum(0, dtype=np.int64) + np.maximum(n - k, 0)
                open_ = left >= least
                if open_.mean() < 0.8:
                    part, m, n, least, base = part[open_], m[open_], n[open_], least[open_], base[open_]
                    t, f, s = np.ascontiguousarray(t[:, open_]), f[:, open_], s[:, open_]
                    if not len(part):
                        break
            hit, carry = base + t[k], None
            for w in range(words):
                u = s[w] & masks[w].take(hit)
                v = s[w] + u
                if words > 1:
                    over = v < u
                    if carry is not None:
                        v = v + carry
                        over |= v < carry
                    carry = over.astype(np.uint64)
                s[w] = (v | (s[w] ^ u)) & f[w]
        if len(part):
            found = m - np.bitwise_count(s).sum(0, dtype=np.int64)
            out[part] = np.where(found >= least, found, -1)
    return out


def _ratio(both: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * both / np.maximum(total, 1), 1.0)


# --- by tiles -------------------------------------------------------------------------


def _tile_pairs(t: pa.Table, least: float, forms: int) -> pa.Table:
    """x, y: ids of the pairs in two tiles that are similar in one of their forms, and their best score. Rows: lo, hi, tile, id,
    sides, s0, s1..."""
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    tile, ids, sides = (t.column(c).to_numpy() for c in ("tile", "id", "sides"))
    a, b = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
    wanted = (sides[a][:, None] | sides[b][None, :]) == 3
    if lo == hi:
        wanted &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    texts = []
    for k in range(forms):
        s = t.column(f"s{k}").to_pylist()
        texts.append((_Strings([s[x] for x in a]), _Strings([s[x] for x in b])))
    m, n = texts[0][0].m, texts[0][1].m
    need = _subsequence(m[:, None] + n[None, :], least).astype(np.int32)
    wanted &= np.minimum(m[:, None], n[None, :]) >= need
    if wanted.any():
        wanted &= _shared(*texts[0], 1) >= need  # the forms have the same characters
    found = np.zeros(wanted.shape, bool)
    for x, y in texts:
        open_ = wanted & ~found
        if open_.mean() > 0.02:
            open_ &= _shared(x, y, 2) >= 3 * need - (m[:, None] + n[None, :]) - 1
        i, j = np.nonzero(open_)
        hit = lcs_many(x, y, i, j, need[i, j]) >= 0
        found[i[hit], j[hit]] = True
    i, j = np.nonzero(found)
    total, none = m[i] + n[j], np.zeros(len(i), np.int64)
    score = np.max([_ratio(lcs_many(x, y, i, j, none), total) for x, y in texts], axis=0) if len(i) else np.zeros(0)
    return pa.table({"x": ids[a[i]], "y": ids[b[j]], "score": score})


def scored_tiles(df: DataFrame, block: str, forms: list[str], least: float) -> DataFrame:
    """x, y (ids), score: pairs of a block, each once, one of whose forms are similar by `least` or more, and the larger similarity. The
    forms of a row are strings of the same characters. df: id (long), block, forms, and maybe sides (1, 2, or 3 for both: only
    pairs across)."""
    ship(df.sparkSession)
    known = df if "sides" in df.columns else df.withColumn("sides", F.lit(3))
    named = known.select(F.col(block).alias("block"), "id", F.col("sides").cast("int").alias("sides"), F.length(forms[0]).alias("m"), *[F.col(c).alias(f"s{k}") for k, c in enumerate(forms)])
    at = scans.numbered(scans.ranged(named, ["block"], ["m", "id"]), ["block"], ["m", "id"]).withColumn("tile", F.floor((F.col("position") - 1) / TILE))
    at = staged(at.select("block", "tile", "id", "sides", "m", *[f"s{k}" for k in range(len(forms))]), "match-tiles")
    sizes = at.groupBy("block", "tile").agg(F.min("m").alias("short"), F.max("m").alias("long"))
    x, y = sizes.alias("x"), sizes.alias("y")
    fits = 2 * F.col("x.long") >= least * (F.col("x.long") + F.col("y.short")) - 1e-6
    pairs = x.join(y, (F.col("x.block").eqNullSafe(F.col("y.block"))) & (F.col("x.tile") <= F.col("y.tile"))).filter(fits).select(F.col("x.block").alias("of"), F.col("x.tile").alias("lo"), F.col("y.tile").alias("hi"))
    dealt = pairs.select("of", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("own"))
    rows = at.join(dealt, F.col("block").eqNullSafe(F.col("of")) & (F.col("tile") == F.col("own"))).drop("of", "own", "m")
    even = rows.repartition(_tasks(df), "block", "lo", "hi")  # few bytes, much work: not to be put together by their bytes
    return even.groupBy("block", "lo", "hi").applyInArrow(lambda t: _tile_pairs(t, least, len(forms)), "x long, y long, score double")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_tiles(df: DataFrame, block: str, forms: list[str], least: float) -> DataFrame:
    """x, y of `scored_tiles`. df may have side (0, 1: only pairs across)."""
    known = df.withColumn("sides", F.col("side").cast("int") + 1) if "side" in df.columns else df
    return scored_tiles(known, block, forms, least).select("x", "y")


# --- by an index ----------------------------------------------------------------------


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grams of each s: its q-grams with the number of their occurrence; shorter strings have themselves."""
    for b in batches:
        out = []
        for s in b.column("s").to_pylist():
            seen: dict[str, int] = {}
            row = []
            for i in range(len(s) - Q + 1):
                g = s[i : i + Q]
                seen[g] = seen.get(g, 0) + 1
                row.append(g if seen[g] == 1 else f"{g}{seen[g]}")
            out.append(row)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names=[*b.schema.names, "grams"])


def _met(lists: np.ndarray, chunk: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows that a list holds; rows stand list by list. Of a list in chunks, a part has the rows of two."""
    edges = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
    i, j = [], []
    for at, end in zip(edges, np.append(edges[1:], len(lists)), strict=True):
        if lo[at] == hi[at]:
            x, y = np.triu_indices(end - at, 1)
        else:
            one = chunk[at:end] == lo[at]
            x, y = (g.ravel() for g in np.meshgrid(np.flatnonzero(one), np.flatnonzero(~one), indexing="ij"))
        i.append(at + x)
        j.append(at + y)
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64),) * 2


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Similar pairs of rows that stand in one list. Rows come sorted by list and part: id, side, s, block, list, chunk, lo, hi."""

    def judged(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, side, block, chunk, lo, hi = (t.column(c).to_numpy() for c in ("id", "side", "block", "chunk", "lo", "hi"))
        part, s = numbered(t), _Strings(t.column("s").to_pylist())
        sizes = np.bincount(part)
        upto = np.cumsum(sizes * (sizes - 1) // 2)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(part):  # as many lists at a time as hold a million pairs, one at least
            k = part[at]
            last = max(k, np.searchsorted(upto, (upto[k - 1] if k else 0) + (1 << 20), "right") - 1)
            x = slice(at, ends[last])
            i, j = _met(part[x], chunk[x], lo[x], hi[x])
            i, j, at = i + at, j + at, ends[last]
            need = _subsequence(s.m[i] + s.m[j], least).astype(np.int64)
            fit = (ids[i] != ids[j]) & (block[i] == block[j]) & ((side[i] < 0) | (side[i] != side[j])) & (np.minimum(s.m[i], s.m[j]) >= need)
            i, j, need = i[fit], j[fit], need[fit]
            both = lcs_many(s, s, i, j, need)
            i, j, both = i[both >= 0], j[both >= 0], both[both >= 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(_ratio(both, s.m[i] + s.m[j]))], names=["x", "y", "score"])

    def numbered(t) -> np.ndarray:
        """The number of each row's list or part of one, as they follow one another."""
        keys = [np.asarray(t.column(c)) for c in ("list", "lo", "hi")]
        return np.append(0, np.cumsum(np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(keys[0]) else np.zeros(0, np.int64)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        part = numbered(b)
        cut = int(np.searchsorted(part, part[-1]))  # what stands before the last list is whole
        if cut:
            yield from judged(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = []
        held.append(b.slice(cut))
    if held:
        yield from judged(pa.Table.from_batches(held))


def by_index(df: DataFrame, block: str, form: str, least: float) -> DataFrame:
    """x, y (ids, x < y), score: pairs of a block whose forms are similar by `least` or more. df: id (long), block, form,
    and maybe side (0, 1: only pairs across); equal forms are paired too.

    The strings of a list are compared where the list stands, and only similar pairs leave the task; a list of more than CHUNK
    strings is dealt out by pairs of its chunks. Strings that are too short for the bound to ask for a shared gram meet all of
    their block that are as short."""
    if not 5 * least / 2 - 2 > 0:
        raise ValueError("such a low threshold leaves no shared trigram: use by_tiles")
    ship(df.sparkSession)
    known = df if "side" in df.columns else df.withColumn("side", F.lit(-1))
    named = known.select(F.col(block).alias("block"), "id", F.col("side").cast("int").alias("side"), F.coalesce(form, F.lit("")).alias("s")).withColumn("m", F.length("s"))
    b, s = named.schema["block"].dataType.simpleString(), "id long, side int, s string, m int"
    rows = staged(named.mapInArrow(_grams, f"block {b}, {s}, grams array<string>"), "match-grams")
    each = rows.select("id", "m", F.explode("grams").alias("gram"), F.xxhash64(F.col("block").isNull(), "block").alias("of"))
    each = each.select("id", "m", "gram", F.xxhash64("of", "gram").alias("list"))  # lists go by numbers
    often = each.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sorted_ = each.join(often, "list").groupBy("id", "m").agg(F.array_sort(F.collect_list(F.struct("n", "list"))).alias("grams"))
    # What a string shares with its shortest partner, less what rounding up would add: no partner shares less.
    shortest = F.ceil(F.col("m") * least / (2 - least) - 1e-9)
    shared = F.ceil((F.col("m") + shortest) * ((2 * Q - 1) * least / 2 - (Q - 1)) - (Q - 1) - 1e-9)
    listed = F.greatest(F.lit(0), F.least(F.size("grams"), F.size("grams") - shared + 1)).cast("int")
    tokens = sorted_.select("id", F.explode(F.slice("grams", F.lit(1), listed)).alias("g")).select("id", F.col("g.list").alias("list"))
    # Strings that need share no gram meet by their lengths.
    lone = rows.filter(shared < 1).select("id", "block", F.explode(F.sequence(shortest, F.col("m").cast("long"))).alias("of")).select("id", F.xxhash64(F.lit("length"), F.col("block").isNull(), "block", "of").alias("list"))
    keyed = staged(tokens.union(lone), "match-lists")
    sizes = keyed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = keyed.join(sizes, "list").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    parts = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("id", "list", "chunk", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"))
    full = parts.join(rows.select("id", "side", "s", F.xxhash64(F.col("block").isNull(), "block").alias("block")), "id")
    even = full.repartition(_tasks(df), "list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    return even.select("id", "side", "s", "block", "list", "chunk", "lo", "hi").mapInArrow(partial(_verified, least=least), "x long, y long, score double").distinct()


# --- what pairs make of their members -------------------------------------------------


def first_reachable(edges: DataFrame) -> DataFrame:
    """id, first: the smallest id that steps to smaller ids reach, for every id that has such a step. edges: id, to (to < id).

    It is what a greedy pass in order of ids finds, which puts each one into the first cluster that has a member like it."""
    label = staged(edges.groupBy("id").agg(F.min("to").alias("first")), "first")
    while True:
        of = label.select(F.col("id").alias("to"), F.col("first").alias("next"))
        by_edge = edges.join(of, "to").groupBy("id").agg(F.min("next").alias("far"))
        by_label = label.join(of.withColumnRenamed("to", "first").withColumnRenamed("next", "jump"), "first", "left").select("id", "first", "jump")
        moved = by_label.join(by_edge, "id", "left").select("id", F.least("first", F.coalesce("jump", "first"), F.coalesce("far", "first")).alias("first"), (F.least(F.coalesce("jump", "first"), F.coalesce("far", "first")) < F.col("first")).alias("moved"))
        label = staged(moved, "first")
        if not label.filter("moved").limit(1).count():
            return label.drop("moved")
        label = label.drop("moved")


def roots(parents: DataFrame) -> DataFrame:
    """id, root: where following the one parent of each leads. parents: id, to."""
    at = staged(parents.select("id", F.col("to").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        nxt = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        at = staged(at.join(nxt, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.drop("moved")
