"""MinHash near-dedup by bottom-k sketches from one hash function.

A document's set is its distinct shingles of SHINGLE words. Its sketch retains the K smallest values that one
hash function gives them; of a set with at most K shingles, that is the whole set.

Inverted lists. If two sets link (100 * intersection >= PERCENT * union), the K smallest values of their union
are a sample without replacement of it, of which a share of at least PERCENT / 100 is in both sets. By Hoeffding's bound, fewer
than `shared(K, percent)` of them are so with a probability below 2^-RISK a pair. Values that only one
distinct set retains are left out, since no two share them; a sketch that has fewer values left meets nobody. Two sketches with so many common values share one among all but the last shared - 1 of
each, in an order by rarity, so only these are entered into inverted lists. For sets with few shingles the count is exact.

Union sketches. The candidates of the lists are estimated: of the K smallest values of both sketches
together, so many are in both. Where that is less than the bound, the pair is dropped.

Exact Jaccard. The rest is confirmed on the full sets. The lists are merged as in jaccard_join. Of lists with many entries, from
large groups of near copies or texts of frequent shingles, no pairs are formed: their members are compared with a
centre, and where that does not join them all, the overlaps of all full sets are counted in tiles, by products of
0/1 matrices of sets and tokens. A tile gives no more links than it has members.

Defined results: null and wordless texts have n_shingles 0, link with nothing and are their own
component; repeated rows are members of one class, and have one component; a null doc_id is a row of its own,
whose component_id is the smallest non-null doc_id reachable (null if there is none, and then it is kept); ties need no
rule, since a component's id is its smallest doc_id; very long texts are hashed in vectors, their sketch has K
values as any other; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U64, blocks, flat, mix, stage
from eventloom.llm.components import components
from eventloom.llm.jaccard_join import SALT, centred, classes_and_components, digests, linked, sets

#: Words of a shingle and least similarity in per cent, by default.
SHINGLE, PERCENT = 2, 80
#: Retained values of a sketch. A pair that links is missed with a probability below 2^-RISK.
K, RISK = 64, 24
#: Tokens of the sets of a tile, about, and columns of a matrix.
TILE_TOKENS, COLUMNS = 150_000, 2048
#: Makes the one hash function of sketches independent of the shingles' own hashes.
_KEY = 0x5851F42D4C957F2D


def shared(k: int, percent: int) -> int:
    """So many of the k smallest values of the union are in both sets of a pair that links, but for the risk."""
    p = percent / 100

    def divergence(x: float) -> float:
        return (x * math.log(x / p) if x else 0) + ((1 - x) * math.log((1 - x) / (1 - p)) if x < 1 else 0)

    return next(x for x in range(math.floor(p * k), -1, -1) if x == 0 or k * divergence((x - 1) / k) >= RISK * math.log(2))


def _index(batches: Iterator[pa.RecordBatch], order, shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Set and sketch (tokens) of each text; entered: so many common values with any partner, at least."""
    least = shared(K, percent)
    for b in batches:
        data, offs = flat(b.column(1))
        for i, j in blocks(offs):
            h, g, size, begin = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
            r = np.repeat(np.arange(j - i), size)
            value = mix(h ^ U64(_KEY))
            o = np.lexsort((value, r))
            value = value[o[np.arange(len(o)) - begin[r] < K]]  # r[o] is r
            at = np.concatenate([[0], np.cumsum(np.minimum(size, K))])
            common = np.where(size * 100 <= percent * K, -(-percent * size // 100), least)  # partners of the smaller ones are whole in their sketches, too
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(digests(h, g, begin), pa.string()), pa.array(size, pa.int64()), pa.array(common, pa.int64()), tokens, pa.nulls(j - i, pa.binary())], names=["doc_id", "mark", "class", "n", "entered", "tokens", "outline"])


def _listed(classes: DataFrame) -> DataFrame:
    """cid, n, tokens, entered: the values that each class enters into lists, rare ones first."""
    each = classes.select("cid", "n", "entered", F.explode("tokens").alias("tok"))
    often = each.groupBy("tok").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    held = each.join(often, "tok").groupBy("cid", "n", "entered").agg(F.array_sort(F.collect_list(F.struct("often", "tok"))).alias("held"))
    first = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.size("held") - F.col("entered") + 1).cast("int"))
    out = held.filter(F.size("held") >= F.col("entered")).select("cid", "n", F.transform(first, lambda x: x["tok"]).alias("tokens"))
    return out.withColumn("entered", F.size("tokens").cast("long"))


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Of the sorted values of two sketches: those of the union's sketch that are in both, and its size."""
    both = np.intersect1d(x, y, assume_unique=True)
    union = np.union1d(x, y)[:K]
    return (int(np.searchsorted(both, union[-1], "right")) if len(union) else 0), len(union)


def _estimated(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose union sketch leaves a link possible."""
    least = shared(K, percent)
    for b in batches:
        keep = []
        (x, i), (y, j) = ((c.flatten().to_numpy().view(U64), np.asarray(c.offsets) - c.offsets[0].as_py()) for c in (b.column("outline_u"), b.column("outline_v")))
        for k, (n, m) in enumerate(zip(b.column("n_u").to_pylist(), b.column("n_v").to_pylist(), strict=True)):
            p, q = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
            if max(n, m) <= K:  # both are whole
                keep.append(linked(len(np.intersect1d(p, q, assume_unique=True)), n, m, percent))
            else:
                keep.append(estimate(p, q)[0] >= least)
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _with_centre(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members that link with their centre."""
    for b in batches:
        ok = [linked(len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(c, U64), assume_unique=True)), len(x) // 8, len(c) // 8, percent) for x, c in zip(b.column("set").to_pylist(), b.column("centre").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("cid")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _tile(t: pa.Table, percent: int) -> pa.Table:
    """Links that join what is not joined yet among the members of two tiles, by the overlaps of all their sets."""
    lo, hi, tile, cid, comp = (t.column(c).to_numpy() for c in ("lo", "hi", "tile", "cid", "comp"))
    a, b = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
    sets_ = [np.frombuffer(x, U64) for x in t.column("set").to_pylist()]
    size = np.array([len(x) for x in sets_])
    row = np.repeat(np.arange(len(size)), size)
    _, column, often = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    shared_ = (often > 1)[column]  # what only one set has, no overlap has
    row, column = row[shared_], np.unique(column[shared_], return_inverse=True)[1]
    o = np.argsort(column, kind="stable")
    row, column = row[o], column[o]
    overlap = np.zeros((len(a), len(b)), np.float32)  # whole numbers below 2^24 are exact
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(size), COLUMNS), np.float32)
        m[row[i:j], column[i:j] - at] = 1
        overlap += m[a] @ m[b].T
    ok = (100 + percent) * overlap.astype(np.int64) >= percent * (size[a][:, None] + size[b][None, :])
    ok &= comp[a][:, None] != comp[b][None, :]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        x, y = root(int(comp[a[i]])), root(int(comp[b[j]]))
        if x != y:
            parent[x] = y
            out.append((int(cid[a[i]]), int(cid[b[j]])))
    return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


def _crowds(long: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """u, v: links that join the members of each long list as all their links would. whole: cid, set, n."""
    members = stage(centred(long), "bottomk-members")
    groups = members.select("g").distinct()
    salted = F.explode(F.array(*[F.lit(k) for k in range(SALT)])).alias("salt")
    centres = whole.join(groups, F.col("cid") == F.col("g")).select("g", F.col("set").alias("centre"), salted)
    near = members.join(whole, "cid").withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT)).cast("int")).join(centres, ["g", "salt"])
    links = stage(near.select("g", "cid", "set", "centre").mapInArrow(partial(_with_centre, percent=percent), "u long, v long"), "bottomk-links")
    comps = stage(components(links), "bottomk-comps")
    joined = members.join(comps.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("comp", F.coalesce("root", "cid")).drop("root")
    sized = joined.join(whole.select("cid", "n"), "cid")
    open_ = sized.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.ceil(F.sum("n") / TILE_TOKENS).cast("int").alias("tiles")).filter("x <> y").select("g", "tiles")
    own = joined.join(open_, "g").withColumn("tile", F.pmod(F.xxhash64("cid"), "tiles").cast("int"))
    each = own.select("g", "cid", "comp", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = each.select("g", "cid", "comp", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")).join(whole.select("cid", "set"), "cid")
    tiles = dealt.groupBy("g", "lo", "hi").applyInArrow(lambda t: _tile(t, percent), "u long, v long")
    return links.union(stage(tiles, "bottomk-links"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, comp = classes_and_components(docs, shingle, percent, _index, _estimated, _listed, _crowds)
    full = rows.filter("class is not null").select("doc_id", "n", "class").join(comp, "class").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    out = full.union(rows.filter("class is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
    s as (select doc_id, list_distinct(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
        when len(w) = 1 then w else [] end) as s from w),
    sized as (select doc_id, len(s) as n, list_sort(s) as s from s),
    class as (select s, n, min(doc_id) as c from sized where n > 0 group by all),
    each as (select c, n, unnest(s) as g from class),
    pair as (select a.c as u, b.c as v from each a join each b on a.g = b.g and a.c <> b.c and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        group by a.c, b.c, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach as (select c, c as r from class union select reach.c, v from reach join pair on u = reach.r),
    root as (select s, min(r) as comp from class join reach using (c) group by s)
select doc_id, n as n_shingles, coalesce(comp, doc_id) as component_id, doc_id = coalesce(comp, doc_id) as kept from sized left join root using (s)"""
