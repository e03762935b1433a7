"""N-gram Jaccard join by set relations: index lists skipped by size and position, and answers
derived from those of a highly similar set.

A document's set is its distinct shingles, of three words in op7 and of five in the pipeline's near
stage, which link from similarity 0.9 and 0.8 on. Documents of one set form a class, and only
classes take part in the join (copies are never paired).

Index lists. The tokens of a class are ordered rare first, by a counting sketch over all
documents. Of two sets that link, the one that is closer to the centre (below; at first: the smaller one) has a
shared token among the few tokens that it enters into index lists, and the other among the more
tokens that it looks up. A list is ordered by set size, in blocks of one size, and inside a block by how much
overlap the position still allows. A set looks only into blocks whose sizes fit, and of a block it
reads only the front: all behind the first entry that cannot reach the needed overlap is skipped.

Set relations. Lists with many entries come from large groups of near copies. Their members are not paired: a
list names a centre, the member with the fewest rare tokens, and every member is compared with it
once. That answers the links to the centre. What two members share follows from their differences
to the centre: with D(A) the tokens that only one of A and the centre has,

    |A ^ B| = |D(A) ^ D(B)|,   and A, B link  <=>  (100+p) |D(A) ^ D(B)| <= (100-p) (|A| + |B|)

(^: tokens in one of the two only). Two members that both link with the centre are joined by it. Any other
pair must share tokens of D, so the differences are indexed in their turn (the start is the case without a
centre: D = all tokens), and lists of differences with many entries name centres again. The tokens of D
are ordered by how many members of the group have them in D, so that what sets the centre apart
from all others, which every member has, comes last. Lists with many entries after ROUNDS
rounds are paired in full, by tasks of LOOKUPS members. No link between different sets is lost.

Candidates from the first lists are held against histograms of the two sets, which bound their
overlap from above, before the sets are fetched.

Shingles are 64-bit hashes, distinct inside one pair of documents but for a chance of 2^-64 a
pair; sets are named by sums over two independent hashes of each shingle (128 bits).

Defined results: null and wordless texts have n_shingles 0, link with nothing and are their own
component; repeated rows are members of one class; a null doc_id is a row of its own class, whose
component_id is the smallest non-null doc_id reachable (null if there is none); ties need no
rule, since a component's id is its smallest doc_id; an empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U64, blocks, flat, gram_hash, lower_az, mix, prepare, span_hash, stage, unstage, words
from eventloom.llm.components import components

#: Words of a shingle and least similarity in per cent, by default.
SHINGLE, PERCENT = 3, 90
#: Counters of the sketch that orders tokens (fixed size, filled from all documents).
SKETCH_BITS, SLICE = 20, 4096
#: Groups of tasks whose counts are summed first.
SUMS = 64
#: Pairs that a task forms at a time.
PAIRS = 1 << 18
#: With more entries, the members of a list go by their differences to a centre.
SHORT_LIST = 64
#: Look-ups of one list that share a task: with more, the list's entries are copied to further tasks.
LOOKUPS = 2048
#: Rounds of centres, and copies of a centre's set that its members are dealt to.
ROUNDS, SALT = 3, 16
#: Stands for a difference that no position bounds.
UNBOUNDED = 1 << 40
#: Keys of the two hashes of a word, and bases of those of a run of words.
KEYS = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def shingles(data: np.ndarray, offs: np.ndarray, size: int, hashes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row and hashes of every shingle, in text order; a shorter text has one of all its words."""
    n = len(offs) - 1
    low = lower_az(data)
    s, e, first = words(low, offs)
    count = np.diff(first)
    own = np.maximum(count - size + 1, 0)
    row = np.repeat(np.arange(n), own)
    at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + first[row]
    few = [np.flatnonzero(count == k) for k in range(1, size)]
    out = []
    for unit, (_, base) in zip(span_hash(low, s, e, tuple(k for k, _ in KEYS[:hashes])), KEYS, strict=False):
        short = [gram_hash(unit, k, base)[first[f]] ^ U64(k) for k, f in enumerate(few, 1) if len(f)]
        out.append(np.concatenate([gram_hash(unit, size, base)[at], *short]))
    return np.concatenate([row, *(f for f in few if len(f))]), out


def sets(data: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row: hashes, second hashes, sizes, and where each row begins."""
    r, (h, g) = shingles(data, offs, shingle, 2)
    o = np.lexsort((h, r))
    r, h, g = r[o], h[o], g[o]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    r, h, g = r[new], h[new], g[new]
    size = np.bincount(r, minlength=len(offs) - 1)
    return h, g, size, np.concatenate([[0], np.cumsum(size)])


def digests(h: np.ndarray, g: np.ndarray, begin: np.ndarray) -> list[str | None]:
    total = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(x ^ U64(c)), dtype=U64)]) for x, c in ((h, 0x1B56C4E9), (g, 0xA2F9836E4E441529))]
    one, two = ((t[begin[1:]] - t[begin[:-1]]).tolist() for t in total)
    return [f"{x:016x}{y:016x}" if n else None for x, y, n in zip(one, two, np.diff(begin).tolist(), strict=True)]


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        data, offs = flat(b.column(0))
        for i, j in blocks(offs):
            _, (h,) = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
            total += np.bincount((h >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
    at = [k for k in range(0, len(total), SLICE) if total[k : k + SLICE].any()]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[k : k + SLICE].astype(np.uint32).tobytes() for k in at], pa.binary())], names=["at", "counts"])


def _sum(t: pa.Table) -> pa.Table:
    rows = t.column("counts").to_pylist()
    total = reduce(np.add, (np.frombuffer(x, np.uint32).astype(np.uint64) for x in rows))
    return pa.table({"at": pa.array([t.column("at")[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


def sketch(docs: DataFrame, shingle: int) -> np.ndarray:
    """Counts of hashed shingles over all documents; its size is fixed. What the tasks have counted is summed in two levels."""
    each = docs.select("text").mapInArrow(partial(_sketch, shingle=shingle), "at int, counts binary").withColumn("part", F.spark_partition_id() % SUMS)
    parts = each.groupBy("at", "part").applyInArrow(_sum, "at int, counts binary").groupBy("at").applyInArrow(_sum, "at int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in parts.collect():
        out[r.at : r.at + SLICE] = np.frombuffer(r.counts, np.uint32)
    return out


def _index(batches: Iterator[pa.RecordBatch], order, shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    freq = order.value
    for b in batches:
        data, offs = flat(b.column(1))
        for i, j in blocks(offs):
            h, g, size, begin = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
            r = np.repeat(np.arange(j - i), size)
            o = np.lexsort((h, freq[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)], r))
            rank = np.arange(len(h)) - begin[r]
            prefix = size - -(-percent * size // 100) + 1  # looked up
            entered = size - -(-2 * percent * size // (100 + percent)) + 1
            first = rank < prefix[r]
            tok = h[o][first].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, prefix, 0))]).astype(np.int32)
            hist = [histogram(h[x:y]) for x, y in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(digests(h, g, begin), pa.string()), pa.array(size, pa.int64()), pa.array(entered, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tok, pa.int64())), pa.array(hist, pa.binary())], names=["doc_id", "mark", "class", "n", "entered", "tokens", "outline"])


def _sets_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = flat(b.column(1))
        for i, j in blocks(offs):
            h, _, _, begin = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
            own = [h[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.tobytes() for x in own], pa.binary())], names=["cid", "set"])


def histogram(h: np.ndarray) -> bytes | None:
    """Tokens by the top bits of their hash, about two a bin: a sixteenth of the set's size. None where a bin overflows."""
    bits = max(4, int(len(h) // 2).bit_length())
    count = np.bincount((h >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else None


def _reachable(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may be linked: two sets share no more tokens of a bin than the one with fewer has in it."""
    for b in batches:
        keep = []
        for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("outline_u", "outline_v", "n_u", "n_v")), strict=True):
            ok = True
            if x is not None and y is not None:
                x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
                short = min(len(x), len(y))  # bins are powers of two: the finer ones are summed
                ok = linked(int(np.minimum(x.reshape(short, -1).sum(1), y.reshape(short, -1).sum(1)).sum()), n, m, percent)
            keep.append(ok)
        yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of an entry and a look-up of one list that may be linked. Rows g, tok, salt, looks, n, late,
    need, cid, comp are sorted by all of them: lists, in them the entries before the look-ups, the entries in blocks
    of one size, in a block those with most room first.

    need is (100+p) d - (100-p) n of the set, and the room -late is (100+p) (d - 2 pos) + (100-p) n: a pair
    can reach its overlap only if the need of each is at most the room of the other, so a block is read up to
    the first entry whose room is less than the need of the set that looks."""
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        new = np.flatnonzero(_new_list(t)[1:]) + 1
        last = int(new[-1]) if len(new) else 0
        carry = t.slice(last)
        if last:
            yield from _paired(t.slice(0, last), percent)
    if carry is not None and carry.num_rows:
        yield from _paired(carry, percent)


def _new_list(t: pa.Table) -> np.ndarray:
    out = np.ones(t.num_rows, bool)
    out[1:] = False
    for c in ("g", "tok", "salt"):
        x = t.column(c).to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def _paired(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    g, n, late, need, cid, comp = (t.column(c).to_numpy() for c in ("g", "n", "late", "need", "cid", "comp"))
    looks = t.column("looks").to_numpy() == 1
    new_list = _new_list(t)
    of = np.cumsum(new_list)
    new_block = new_list | looks
    new_block[1:] |= n[1:] != n[:-1]
    new_block[1:] |= looks[:-1]
    begin = np.flatnonzero(new_block)
    end = np.append(begin[1:], len(g))
    begin, end = begin[~looks[begin]], end[~looks[begin]]  # blocks of entries
    if not len(begin):
        return
    size, of_list = n[begin], of[begin]
    most = int(n.max()) + 2
    low, width = int(late.min()), int(late.max() - late.min()) + 2
    entries = np.flatnonzero(~looks)
    block = np.searchsorted(begin, entries, "right") - 1
    key = block * width + (late[entries] - low)
    first_entry = np.searchsorted(entries, begin)
    last_entry = first_entry + end - begin
    probe = np.flatnonzero(looks)
    k = np.searchsorted(of_list * most + size, of[probe] * most + -(-percent * n[probe] // 100))
    while len(probe):
        ok = k < len(size)
        probe, k = probe[ok], k[ok]
        ok = (of_list[k] == of[probe]) & (percent * size[k] <= 100 * n[probe])
        probe, k = probe[ok], k[ok]
        if not len(probe):
            break
        front = np.searchsorted(key, k * width + np.clip(-need[probe] - low, -1, width - 1), "right")
        count = np.maximum(np.minimum(front, last_entry[k]) - first_entry[k], 0)
        edge = np.concatenate([[0], np.cumsum(count)])
        i = 0
        while i < len(probe):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + PAIRS, "right")) - 1)
            own = count[i:j]
            b = np.repeat(probe[i:j], own)
            a = entries[np.arange(len(b)) - np.repeat(edge[i:j] - edge[i], own) + np.repeat(first_entry[k[i:j]], own)]
            closer = (need[a] < need[b]) | ((need[a] == need[b]) & (cid[a] < cid[b]))
            ok = closer & (need[a] <= -late[b]) & (comp[a] != comp[b])
            x, y = cid[a[ok]], cid[b[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(g[a[ok]]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["g", "u", "v"])
            i = j
        k = k + 1


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each member of a group: the tokens that only it and that only the centre has, and whether the two link (far: they do not)."""
    more, less = 100 + percent, 100 - percent
    for b in batches:
        rows = []
        for a, c in zip(b.column("set").to_pylist(), b.column("centre").to_pylist(), strict=True):
            a, c = np.frombuffer(a, U64), np.frombuffer(c, U64)
            own, gone = np.setdiff1d(a, c, assume_unique=True), np.setdiff1d(c, a, assume_unique=True)
            d = len(own) + len(gone)
            need = more * d - less * len(a)
            rows.append((len(a), len(c), d, need, need > less * len(c), own.view(np.int64), gone.view(np.int64)))
        n, size, d, need, far, own, gone = zip(*rows, strict=True) if rows else ([],) * 7
        tokens = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("cid"), *(pa.array(x, pa.int64()) for x in (n, size, d, need)), pa.array(far, pa.bool_()), pa.array(own, tokens), pa.array(gone, tokens)], names=["g", "cid", "n", "size", "d", "need", "far", "own", "gone"])


def _prefixes(batches: Iterator[pa.RecordBatch], order, percent: int) -> Iterator[pa.RecordBatch]:
    """The first tokens of each difference, that it looks up, and how many of them are entered into lists.

    The centre's tokens are ordered by how many members lack them, others by how many documents have them."""
    freq, more, less = order.value, 100 + percent, 100 - percent
    group, known, count = None, None, None
    for b in batches:
        rows = []
        lacking = b.column("lacking")
        for k, (g, size, need, far) in enumerate(zip(*(b.column(x).to_pylist() for x in ("g", "size", "need", "far")), strict=True)):
            own, gone = (b.column(x)[k].values.to_numpy(zero_copy_only=False).view(U64) for x in ("own", "gone"))
            if g != group:
                x = lacking[k].values
                known, count = (np.zeros(0, np.int64),) * 2 if x is None else (x.field(c).to_numpy(zero_copy_only=False) for c in ("tok", "count"))
                group = g
            d = np.concatenate([own, gone])
            seen = freq[(own >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
            lack = count[np.searchsorted(known, gone.view(np.int64))] if len(gone) else np.zeros(0, np.int64)
            o = np.lexsort((d, np.concatenate([seen, lack])))
            # The farther of two looks up, the closer is entered: they must share the mean of their needs, at least the closer's own.
            # Partners of a far set need at least -less * |centre|, those of a near set more than less * |centre|.
            enters = max(1, -(-need // more) if far else -(-(need + less * size + 1) // (2 * more)))
            looks = max(1, -(-(need - less * size) // (2 * more))) if far else enters
            rows.append((d[o][: max(0, len(d) - looks + 1)].view(np.int64), len(d) - enters + 1, np.sort(d).tobytes()))
        tokens, entered, whole = zip(*rows, strict=True) if rows else ([],) * 3
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("g", "cid", "n", "d", "need", "far")), pa.array(tokens, pa.list_(pa.int64())), pa.array(entered, pa.int64()), pa.array(whole, pa.binary())], names=["g", "cid", "n", "d", "need", "far", "tokens", "entered", "set"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The linked ones of pairs, by their differences to one centre (all tokens, where there is none)."""
    for b in batches:
        ok = []
        for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("set_u", "set_v", "n_u", "n_v")), strict=True):
            x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            ok.append((100 + percent) * (len(x) + len(y) - 2 * shared) <= (100 - percent) * (n + m))
        yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))


def classes_and_components(docs: DataFrame, shingle: int, percent: int, index: Callable = _index, possible: Callable = _reachable, listed: Callable | None = None, crowds: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, class) and (class, comp: smallest doc_id reachable, for classes with a set), by
    shingles of so many words and links of so many per cent (below 100) or more.

    index gives an outline of each set and its tokens for the first lists, possible drops pairs by their outlines. listed picks
    of tokens itself, which are no beginnings of whole sets then: no position bounds an overlap, and they are the outlines. crowds
    links the members of long lists in its own way, in place of the rounds of differences."""
    spark = docs.sparkSession
    prepare(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.xxhash64(docs["text"]).alias("mark"))
    order = spark.sparkContext.broadcast(sketch(src, shingle))
    rows = stage(src.mapInArrow(partial(index, order=order, shingle=shingle, percent=percent), "doc_id long, mark long, class string, n long, entered long, tokens array<long>, outline binary"), "jaccard-rows")
    per = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").alias("d"), F.col("mark").alias("m"))).alias("row"), F.first(F.struct("n", "entered", "tokens", "outline")).alias("x"))
    # Once written, a class keeps the number that it got.
    classes = stage(per.select("class", "rep", "row", "x.*", F.monotonically_increasing_id().alias("cid")), "jaccard-classes")
    full, rows = rows, stage(rows.select("doc_id", "mark", "n", "class"), "jaccard-members")
    unstage(full)

    more, less = 100 + percent, 100 - percent

    def side(df: DataFrame, key: str) -> DataFrame:
        return df.select(*[F.col(c).alias(key if c == "cid" else f"{c}_{key}") for c in df.columns])

    def lists_of(entries: DataFrame) -> DataFrame:
        """g, tok, n, pos, late, need, cid, far, close (it is entered), and how many of the list are entered and look it up, of
        lists in which some pair is open.

        entries: g, cid, comp (pairs of one are joined already), n, d, need, far, tokens, entered."""
        each = entries.select("g", "cid", "far", "entered", F.posexplode("tokens").alias("pos", "tok")).select("g", "tok", "cid", "pos", "far", (F.col("pos") < F.col("entered")).alias("close"))
        counted = each.groupBy("g", "tok").agg(F.count(F.lit(1)).alias("all"), F.count_if("close").alias("length"), F.count_if("far").alias("lookups"))
        # Most tokens are in no open list: the counts' shuffle goes before the tokens' comes, and these carry no more than they need.
        open_ = stage(counted.filter("all > 1 and length > 0 and lookups > 0").drop("all"), "jaccard-open")
        late = -(more * (F.col("d") - 2 * F.col("pos")) + less * F.col("n"))
        kept = each.join(open_, ["g", "tok"]).join(entries.select("g", "cid", "comp", "n", "d", "need"), ["g", "cid"])
        return stage(kept.select("g", "tok", "n", "pos", late.alias("late"), "need", "cid", "comp", "far", "close", "length", "lookups"), "jaccard-lists")

    def merged(lists: DataFrame) -> DataFrame:
        """Pairs of the lists' members."""
        by = ("g", "tok", "salt", "looks", "n", "late", "need", "cid", "comp")
        short = lists.withColumn("salts", F.ceil(F.col("lookups") / LOOKUPS).cast("int"))
        entered = short.filter("close").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("looks", F.lit(0))
        looked = short.filter("far").withColumn("salt", F.pmod(F.xxhash64("cid"), "salts").cast("int")).withColumn("looks", F.lit(1))
        return entered.select(*by).union(looked.select(*by)).repartition(n_parts, "g", "tok", "salt").sortWithinPartitions(*by).mapInArrow(partial(_pairs, percent=percent), "g long, u long, v long").distinct()

    none = F.lit(-1).cast("long")  # the group without a centre
    plain = (listed(classes) if listed else classes).select(none.alias("g"), "cid", F.col("cid").alias("comp"), "n", (F.lit(UNBOUNDED) if listed else F.col("n")).alias("d"), (F.col("n") * (more - less)).alias("need"), F.lit(True).alias("far"), "tokens", "entered")
    lists = lists_of(plain)
    small = classes.select("cid", "n", (F.col("tokens") if listed else F.col("outline")).alias("outline"))
    is_short = F.col("length") <= SHORT_LIST
    both = merged(lists.filter(is_short)).join(side(small, "v"), "v").join(side(small, "u"), "u").select("u", "v", "outline_u", "outline_v", "n_u", "n_v")
    near = stage(both.mapInArrow(partial(possible, percent=percent), "u long, v long"), "jaccard-near").select(none.alias("g"), "u", "v")
    long = lists.filter(~is_short)
    listed = near.select(F.col("u").alias("cid")).union(near.select("v")).union(long.select("cid")).distinct()
    wanted = classes.join(listed, "cid", "left_semi").select("cid", F.col("row.d").alias("d"), F.col("row.m").alias("m"))
    texts = src.join(wanted.hint("shuffle_hash"), src["doc_id"].eqNullSafe(wanted["d"]) & src["mark"].eqNullSafe(wanted["m"])).dropDuplicates(["cid"]).select("cid", "text")
    whole = stage(texts.mapInArrow(partial(_sets_of, shingle=shingle), "cid long, set binary"), "jaccard-sets")

    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)])))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT)).cast("int"))

    def with_comp(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(key), F.col("root").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    links, comps = spark.createDataFrame([], "u long, v long"), None
    differing = whole.join(small.drop("outline"), "cid").select(none.alias("g"), "cid", "n", "set")
    if crowds and long.limit(1).count():
        links, long = crowds(long, whole.join(small.select("cid", "n"), "cid"), percent), None
    for at in range(ROUNDS):
        if long is None or not long.limit(1).count():
            long = None
            break
        members = stage(centred(long), f"jaccard-members-{at}")
        groups = members.select(F.col("g").alias("cid")).distinct()
        centres = salted(whole.withColumnRenamed("set", "centre").join(groups, "cid").withColumnRenamed("cid", "g"))
        apart = stage(dealt(members.join(whole, "cid")).join(centres, ["g", "salt"]).select("g", "cid", "set", "centre").mapInArrow(partial(_differences, percent=percent), _DIFFERENCE), "jaccard-differences")
        links = links.union(stage(apart.filter("not far").select(F.col("g").alias("u"), F.col("cid").alias("v")), "jaccard-links"))
        sides = apart
        # Where the links so far have joined all members of a centre, no pair is open.
        comps = stage(components(links), "jaccard-comps")
        one = with_comp(apart.select("g", "cid").union(groups.select(F.col("cid").alias("g"), "cid")), "cid", "comp").groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
        apart = apart.join(one.filter("x <> y").select("g"), "g", "left_semi")
        lacking = apart.select("g", F.explode("gone").alias("tok")).groupBy("g", "tok").agg(F.count(F.lit(1)).alias("count")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("tok", "count"))).alias("lacking"))
        apart = stage(dealt(apart).join(salted(lacking), ["g", "salt"], "left").sortWithinPartitions("g").drop("salt").mapInArrow(partial(_prefixes, order=order, percent=percent), _PREFIX), "jaccard-prefixes")
        unstage(sides, members, lists)
        differing = differing.union(apart.select("g", "cid", "n", "set"))
        lists = lists_of(with_comp(apart, "cid", "comp"))
        near = near.union(stage(merged(lists.filter(is_short)), "jaccard-near"))
        long = lists.filter(~is_short)

    comps = stage(components(links), "jaccard-comps") if comps is None else comps
    if long is not None and long.limit(1).count():  # lists that no centre has broken up
        near = near.union(stage(merged(long), "jaccard-near"))
    # Pairs whose components still differ are compared.
    open_ = with_comp(with_comp(near, "u", "comp_u"), "v", "comp_v").filter("comp_u <> comp_v").select("g", "u", "v")
    pairs = open_.join(side(differing, "v").withColumnRenamed("g_v", "g"), ["g", "v"]).join(side(differing, "u").withColumnRenamed("g_u", "g"), ["g", "u"])
    links = links.union(stage(pairs.select("u", "v", "set_u", "set_v", "n_u", "n_v").mapInArrow(partial(_verify, percent=percent), "u long, v long"), "jaccard-links"))
    comps = stage(components(links), "jaccard-comps")
    unstage(whole, lists)

    rooted = classes.select("class", "cid", "rep").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("comp"))
    return rows, rooted.join(smallest, "root").select("class", "root", "comp")


_DIFFERENCE = "g long, cid long, n long, size long, d long, need long, far boolean, own array<long>, gone array<long>"
_PREFIX = "g long, cid long, n long, d long, need long, far boolean, tokens array<long>, entered long, set binary"


def centred(long: DataFrame) -> DataFrame:
    """g, cid: the members of long lists with their new centre, which is left out. The centre of a list is the member that is in most
    of the long lists, so that the lists of one group of near copies agree on few centres; of several, the one
    that has its first long list earliest: few of its tokens are rarer."""
    at = long.groupBy("g", "cid").agg((-F.count(F.lit(1))).alias("lists"), F.min("pos").alias("early"))
    chosen = long.join(at, ["g", "cid"]).groupBy("g", "tok").agg(F.min(F.struct("lists", "early", "cid")).alias("c"))
    met = long.join(chosen, ["g", "tok"]).select(F.col("c.cid").alias("g"), "cid")
    return met.filter("g <> cid").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, comp = classes_and_components(docs, SHINGLE, PERCENT)
    full = rows.filter("class is not null").select("doc_id", "n", "class").join(comp, "class").select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    return full.union(rows.filter("class is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Of each component, the row with the smallest doc_id stays (of several, the one whose text's hash is
    smallest), with all its columns; rows without words stay. Rows repeated whole stay or go together."""
    rows, comp = classes_and_components(docs, shingle, percent)
    key = F.struct(F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    # A component is named by its class, not by its doc_id, which other texts may carry too.
    first = rows.join(comp, "class").groupBy("root").agg(F.min(F.when(F.col("doc_id").isNotNull(), key)).alias("k"), F.min(key).alias("any")).select(F.coalesce("k", "any").alias("k"))
    stays = stage(first.select("k.*").union(rows.filter("class is null").select("doc_id", "mark")).distinct(), "near-keep").hint("shuffle_hash")
    return docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(stays["d"]) & F.xxhash64(docs["text"]).eqNullSafe(stays["m"]), "left_semi")
