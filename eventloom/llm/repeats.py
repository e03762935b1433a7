"""Where windows of fixed length recur: the frame that both substring operators stand on.

Units are words or bytes; a window is `length` units of one text. Every window holds one anchor:
the run of `gram` units with the smallest hash in it (leftmost on ties), which depends on the
window's content alone, so two equal windows have equal anchors at equal places.

1. One pass over all texts emits the anchors' hashes, summed per task; anchors that occur once
   cannot lie in a recurring window and end here.
2. A second pass cuts, around every recurring anchor, the context of the windows that it
   anchors (at most 2 * length - gram units), and the contexts are counted: copies collapse
   in the map-side sum, however many there are.
3. Contexts that occur more than once recur as a whole. Distinct contexts of one anchor meet in
   one shard, where the operator's own method (automata, suffix sorting) finds the windows that
   different contexts share. An anchor with more than HOT_CONTEXTS distinct contexts (a very common line in ever
   new surroundings) is split by further anchors: the windows of its contexts are dealt out anew by
   the smallest of their runs under another hash, which is mostly outside the common line, and the parts of
   contexts go through step 3 in their turn. Windows that stay in a crowd after LEVELS such
   splits are counted one by one, by their content.
4. The spans found go back to the texts that hold the contexts, and each text is cut once.

All of it is linear in the texts; nothing is capped, sampled or sent to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U64, blocks, flat, gram_hash, mix, prepare, sliding_min, span_hash, stage, unstage, words

HOT_CONTEXTS, LEVELS = 2_000, 3
#: Bits of a position that ride along with a hash in one number, and so many windows are looked at together.
POS_BITS = 26

_rng = np.random.default_rng(20)
BYTE_UNITS = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64)


@dataclass(frozen=True)
class Kind:
    """unit: 'word' or 'byte'."""

    unit: str
    length: int
    gram: int


def units(data: np.ndarray, offs: np.ndarray, kind: Kind):
    """Unit values, first unit of each row, and the bytes' starts and ends of each unit (None for bytes)."""
    if kind.unit == "byte":
        return BYTE_UNITS[data], offs, None, None
    s, e, first = words(data, offs)
    return span_hash(data, s, e)[0], first, s, e


def smallest(g: np.ndarray, starts: int, width: int) -> np.ndarray:
    """For each of the first starts, the place of the smallest of the width hashes from there on (leftmost on ties)."""
    out, most = np.empty(starts, np.int64), 1 << POS_BITS
    part = max(1, most - width)
    for a in range(0, starts, part):
        own = g[a : min(a + part, starts) + width - 1]
        key = (own >> U64(POS_BITS) << U64(POS_BITS)) | np.arange(len(own), dtype=U64)
        out[a : a + part] = (sliding_min(key, width) & U64(most - 1)).astype(np.int64) + a
    return out


def anchors(values: np.ndarray, first: np.ndarray, kind: Kind, level: int = 0):
    """Rows, hashes, anchor positions and window ranges (first start, last start) of the contexts of all rows, in text order."""
    starts = len(values) - kind.length + 1
    if starts <= 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U64), z, z, z
    g = gram_hash(values, kind.gram)
    if level:
        g = mix(g ^ mix(np.full(1, level, U64)))
    at = smallest(g, starts, kind.length - kind.gram + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:starts]
    left = first[row + 1] - np.arange(starts)
    ok = np.flatnonzero(left >= kind.length)
    if not len(ok):
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U64), z, z, z
    p, r = at[ok], row[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (p[1:] != p[:-1]) | (r[1:] != r[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(ok)) - 1
    return r[begin], g[p[begin]], p[begin], ok[begin], ok[end]


def _scan(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """Distinct (row, anchor) with its number of contexts in the row."""
    for b in batches:
        data, offs = flat(b.column(2))
        for i, j in blocks(offs):
            values, first, _, _ = units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], kind)
            r, h, _, _, _ = anchors(values, first, kind)
            o = np.lexsort((h, r))
            r, h = r[o], h[o]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            k = np.diff(np.append(at, len(r)))
            take = pa.array(i + r[at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(h[at].view(np.int64)), pa.array(k, pa.int32())], names=["doc_id", "mark", "h", "k"])


_CTX = pa.struct([("h", pa.int64()), ("a", pa.int64()), ("z", pa.int64()), ("ck", pa.binary())])
_CUT = "doc_id long, mark long, n long, sha string, body binary, ctxs array<struct<h:long,a:long,z:long,ck:binary>>"


def body_of(data: np.ndarray, s, e, a: int, z: int) -> bytes:
    """Units a..z-1 as bytes: words joined by one space, or the bytes."""
    if s is None:
        return data[a:z].tobytes()
    if z <= a:
        return b""
    raw = data[s[a] : e[z - 1]].tobytes()
    if np.array_equal(s[a + 1 : z], e[a : z - 1] + 1):
        return raw.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ")
    return b" ".join(raw.split())


def _cut(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """Where the contexts of each text's recurring anchors are, and their digests. body: the text, only where it has such contexts."""
    for b in batches:
        data, offs = flat(b.column(2))
        hot = b.column(3)
        for i, j in blocks(offs):
            block = data[offs[i] : offs[j]]
            values, first, s, e = units(block, offs[i : j + 1] - offs[i], kind)
            wanted = [hot[k].values for k in range(i, j)]
            if any(w is not None and len(w) for w in wanted):
                r, h, _, lo, hi = anchors(values, first, kind)
                edge = np.searchsorted(r, np.arange(j - i + 1))
            n, sha, body, ctxs = [], [], [], []
            for k in range(j - i):
                a, z = int(first[k]), int(first[k + 1])
                n.append(z - a)
                whole = body_of(block, s, e, a, z)
                w, own = wanted[k], []
                if w is not None and len(w):
                    x, y = edge[k], edge[k + 1]
                    for q in x + np.flatnonzero(np.isin(h[x:y], w.to_numpy().view(U64))):
                        c = body_of(block, s, e, int(lo[q]), int(hi[q]) + kind.length)
                        own.append({"h": int(h[q].view(np.int64)), "a": int(lo[q]) - a, "z": int(hi[q]) + kind.length - a, "ck": hashlib.md5(c).digest()})
                sha.append(None if own else hashlib.sha256(whole).hexdigest())
                body.append(whole if own else None)
                ctxs.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(body, pa.binary()), pa.array(ctxs, pa.list_(_CTX))], names=["doc_id", "mark", "n", "sha", "body", "ctxs"])


def _contexts(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """The contexts themselves."""
    for b in batches:
        for body, ctxs in zip(b.column("body").to_pylist(), b.column("ctxs").to_pylist(), strict=True):
            s, e = context_units(body, kind) if kind.unit == "word" else (None, None)
            cut = [body[c["a"] : c["z"]] if s is None else body[s[c["a"]] : e[c["z"] - 1]] for c in ctxs]
            yield pa.RecordBatch.from_arrays([pa.array([c["h"] for c in ctxs], pa.int64()), pa.array([c["ck"] for c in ctxs], pa.binary()), pa.array(cut, pa.binary()), pa.array([c["z"] - c["a"] for c in ctxs], pa.int32())], names=["h", "ck", "ctx", "size"])


def context_units(ctx: bytes, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the units of a context."""
    if kind.unit == "byte":
        at = np.arange(len(ctx))
        return at, at + 1
    gap = np.flatnonzero(np.frombuffer(ctx, np.uint8) == 32)
    return np.concatenate([[0], gap + 1]), np.append(gap, len(ctx))


def _split(batches: Iterator[pa.RecordBatch], kind: Kind, level: int) -> Iterator[pa.RecordBatch]:
    """Parts of crowded contexts by another anchor: h (of both anchors), pk, part, where it begins in its context ck, and its size."""
    for b in batches:
        out: list[tuple] = []
        for h, ck, ctx, n in zip(*(b.column(c).to_pylist() for c in ("h", "ck", "ctx", "n")), strict=True):
            s, e = context_units(ctx, kind)
            raw = np.frombuffer(ctx, np.uint8)
            values = BYTE_UNITS[raw] if kind.unit == "byte" else span_hash(raw, s, e)[0]
            _, other, _, lo, hi = anchors(values, np.array([0, len(values)]), kind, level)
            both = mix(other ^ np.array(h, np.int64).view(U64)).view(np.int64).tolist()
            for x, a, z in zip(both, lo.tolist(), (hi + kind.length).tolist(), strict=True):
                part = ctx[s[a] : e[z - 1]]
                out.append((x, hashlib.md5(part).digest(), part, z - a, n, ck, a))
        cols = list(zip(*out, strict=True)) or [()] * 7
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["h", "pk", "part", "size", "n", "ck", "a"])


def _windows(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    """Every window of crowded contexts."""
    for b in batches:
        for ck, ctx, n in zip(*(b.column(c).to_pylist() for c in ("ck", "ctx", "n")), strict=True):
            s, e = context_units(ctx, kind)
            wins = [ctx[a:z] for a, z in zip(s[: len(s) - kind.length + 1].tolist(), e[kind.length - 1 :].tolist(), strict=True)]
            m = len(wins)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array([ck] * m, pa.binary()), pa.array(np.arange(m), pa.int32()), pa.array([n] * m, pa.int64())], names=["win", "ck", "at", "n"])


_SPANS = "ck binary, spans array<struct<s:int,e:int>>"


def _moved(spans, by):
    return F.transform(spans, lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e")))


def recurring_spans(distinct: DataFrame, kind: Kind, shard: Callable, level: int = 1) -> DataFrame:
    """ck, spans (several rows a context at times) of the windows that recur, from distinct contexts h, ck, ctx, n, size."""
    spark = distinct.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowd = stage(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_CONTEXTS).select("h"), "repeat-crowds")
    crowded = bool(crowd.limit(1).count())
    usual = distinct.join(crowd, "h", "left_anti") if crowded else distinct
    shards = usual.select("h", "ck", "ctx", "n").repartition(n_parts, "h").sortWithinPartitions("h", "ck")
    found = shards.mapInArrow(partial(shard, kind=kind), _SPANS)
    if not crowded:
        return found
    tight = distinct.join(crowd, "h", "left_semi").select("h", "ck", "ctx", "n")
    if level <= LEVELS:
        parts = stage(tight.mapInArrow(partial(_split, kind=kind, level=level), "h long, pk binary, part binary, size int, n long, ck binary, a int"), "repeat-parts")
        own = stage(parts.groupBy("h", F.col("pk").alias("ck"), F.col("part").alias("ctx")).agg(F.sum("n").alias("n"), F.any_value("size").alias("size")), "repeat-contexts")
        inner = stage(recurring_spans(own, kind, shard, level + 1).filter(F.size("spans") > 0).withColumnRenamed("ck", "pk"), "repeat-spans")
        return found.union(parts.select("ck", "pk", "a").join(inner, "pk").select("ck", _moved("spans", F.col("a")).alias("spans")))
    wins = stage(tight.select("ck", "ctx", "n").mapInArrow(partial(_windows, kind=kind), "win binary, ck binary, at int, n long"), "repeat-windows")
    twice = wins.groupBy("win").agg(F.sum("n").alias("k")).filter("k > 1").select("win")
    each = F.array(F.struct(F.col("at").alias("s"), (F.col("at") + kind.length).cast("int").alias("e")))
    return found.union(wins.join(twice, "win").select("ck", each.alias("spans")))


def runs(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Units covered by windows at sorted starts, as maximal half-open runs."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(at, cut)]


_FINAL = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string"


def _apply(batches: Iterator[pa.RecordBatch], kind: Kind, text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, spans, sha, kept_texts = [], [], [], []
        for body, cover in zip(b.column("body").to_pylist(), b.column("cover").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for c in sorted((c["s"], c["e"]) for c in cover or []):
                if merged and c[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], c[1])
                else:
                    merged.append(list(c))
            gone = sum(z - a for a, z in merged)
            if kind.unit == "byte":
                keep, at = [], 0
                for a, z in merged:
                    keep.append(body[at:a])
                    at = z
                kept = b"".join([*keep, body[at:]])
            else:
                w, keep, at = body.split(b" ") if body else [], [], 0
                for a, z in merged:
                    keep += w[at:a]
                    at = z
                kept = b" ".join(keep + w[at:])
            removed.append(gone)
            spans.append(len(merged))
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "replace") if text else None)
        cols = [b.column("doc_id"), b.column("n"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n", "n_removed", "n_spans", "kept_sha256"]
        if text:
            cols, names = [*cols, pa.array(kept_texts, pa.string())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def remove_repeats(docs: DataFrame, kind: Kind, shard: Callable, text: bool = False) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept_sha256 (and kept, the text that is left, if asked for).

    shard(batches): rows h, ck, ctx, n (n occurrences) of distinct contexts, all of an anchor in a row, to rows
    ck, spans (array of struct s, e: units covered) by windows that occur twice or more."""
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"), docs["text"])
    seen = stage(src.mapInArrow(partial(_scan, kind=kind), "doc_id long, mark long, h long, k int"), "repeat-anchors")
    again = seen.groupBy("h").agg(F.sum("k").alias("k")).filter("k > 1").select("h")
    # One row for each (doc_id, mark): rows repeated in the table share it.
    hot = seen.join(again, "h").groupBy("doc_id", "mark").agg(F.collect_set("h").alias("hs")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "hs").hint("shuffle_hash")  # texts need no sort
    joined = src.join(hot, src["doc_id"].eqNullSafe(hot["d"]) & src["mark"].eqNullSafe(hot["m"]), "left").select("doc_id", "mark", "text", "hs")
    cut = stage(joined.mapInArrow(partial(_cut, kind=kind), _CUT), "repeat-texts")

    unstage(seen)

    held = cut.filter("body is not null")
    each = held.select("body", "ctxs").mapInArrow(partial(_contexts, kind=kind), "h long, ck binary, ctx binary, size int")
    distinct = stage(each.groupBy("h", "ck", "ctx").agg(F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size")), "repeat-contexts")
    spans = stage(recurring_spans(distinct, kind, shard).filter(F.size("spans") > 0), "repeat-spans")
    unstage(distinct)

    hits = held.select("doc_id", "mark", F.explode("ctxs").alias("c")).select("doc_id", "mark", "c.a", "c.ck").join(spans, "ck").select("doc_id", "mark", _moved("spans", F.col("a")).alias("x"))
    cover = hits.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("x")).alias("cover")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "cover").hint("shuffle_hash")
    held = held.select("doc_id", "mark", "n", "body")
    done = held.join(cover, held["doc_id"].eqNullSafe(cover["d"]) & held["mark"].eqNullSafe(cover["m"]), "left").select("doc_id", "n", "body", "cover")
    out = done.mapInArrow(partial(_apply, kind=kind, text=text), _FINAL + (", kept string" if text else ""))
    rest = cut.filter("body is null").select("doc_id", "n", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    if text:
        own = src.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("text").alias("kept")).dropDuplicates(["d", "m"])
        rest = cut.filter("body is null").join(own, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m")), "left").select("doc_id", "n", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), "kept")
    return out.union(rest)


Rows = list[tuple[bytes, bytes, int]]


def groups_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Rows, Rows]]:
    """(ck, ctx, n) of whole anchors with two contexts or more, and of those with one that occurs twice or
    more; so many at a time that their contexts have about limit bytes."""
    several: Rows = []
    single: Rows = []
    own: Rows = []
    size, last = 0, None

    def close() -> int:
        if len(own) > 1:
            several.extend(own)
        elif own and own[0][2] > 1:
            single.extend(own)
        else:
            return 0
        return sum(len(r[1]) for r in own)

    for b in batches:
        for h, *row in zip(*(b.column(c).to_pylist() for c in ("h", "ck", "ctx", "n")), strict=True):
            if h != last:
                size += close()
                own, last = [], h
                if size >= limit:
                    yield several, single
                    several, single, size = [], [], 0
            own.append(tuple(row))
    close()
    if several or single:
        yield several, single


def spans_batch(rows: list[tuple[bytes, list[tuple[int, int]]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([[{"s": s, "e": e} for s, e in r[1]] for r in rows], kind)], names=["ck", "spans"])
