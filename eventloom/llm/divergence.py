"""Source divergence audit: which terms a source uses more than its language does, and how far the
sources of a language are from each other, by upper-bound term search.

A term is a run of letters A-Z, a-z and of all characters beyond ASCII, only A-Z lower-cased. A lang keeps
the terms that at least MIN_DOCS of its documents have (V of them). In a group of documents, a kept term
that occurs count times has p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), N the count of all kept
terms there. All of it is integer arithmetic.

Terms. The postings of a group (lang, source) fall into buckets of nearly equal count. A bucket's
largest p, less the smallest probability that its terms have in the lang, bounds every p - q in it from above. Buckets
are evaluated best first, in rounds that grow GROWTH-fold; a group is done when the bounds of all its
unseen buckets are strictly below its kth value, so that ties of the kth are all seen.

Pairs. Over all kept terms, sum |p_a - p_b| = P_a + P_b - 2 * sum min(p_a, p_b). Let a be the one whose p of an
absent term (p0) is smaller. Then a term that a lacks gives p0_a, and

    sum min = (V - n_a) p0_a + sum over a's postings of min(p_a, p0_b)
                             + sum over shared postings of (min(p_a, p_b) - min(p_a, p0_b))

so that only postings are read. Sources are dealt to tiles of about TILE, the postings of two tiles to
tasks of about TASK_ROWS by their term, and the sums of the tasks add up.

Defined results: null text, lang and source are ''; a text without terms (null, empty, digits) only makes its
group occur; groups and langs without kept terms have pairs of value 0 and no terms; a lang with one source has
no pairs; very long texts are cut into words piece by piece; repeated rows count as often as they
occur; ties are ranked by the item's bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import pieces, prepare, stage, unstage

#: Documents of the lang that a kept term occurs in at least; added to each count; what probabilities are given in; ranks of terms.
MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Distinct terms that a task counts before it passes them on.
HELD_TERMS = 200_000
#: Sources of a tile, and postings of a task of two tiles, about.
TILE, TASK_ROWS = 256, 4096
#: Pairs of postings that a task forms at a time.
PAIRS = 1 << 20
#: Terms evaluated in the first round of a group, at least, and the factor from round to round.
FIRST, GROWTH = TOP, 16

_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term, and documents that have it, by lang and source."""
    held: dict = defaultdict(lambda: (Counter(), Counter()))

    def out():
        rows = [(*g, t, k, docs[t]) for g, (n, docs) in held.items() for t, k in n.items()]
        held.clear()
        for k in range(0, len(rows), 50_000):
            lang, source, term, n, docs = zip(*rows[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            n, docs = held[lang, source]
            seen: set = set()
            for words in pieces(text, _LETTERS):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from out()
    yield from out()


def probability(count: str, total: str, kept: str) -> Column:
    """p of a count, exact in decimals of 38 digits; null where nothing is kept."""
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(20, 0)) div nullif(cast({total} + {PRIOR} * {kept} as decimal(20, 0)), 0)")


def _overlaps(t: pa.Table) -> pa.Table:
    """Of the groups in two tiles and some of their postings: what each pair adds to the sum of min(p_a, p0_b), and over shared terms.

    Rows without tid are the groups themselves."""
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    tid, gid, tile, p, p0 = (t.column(c).to_numpy() for c in ("tid", "gid", "tile", "p", "p0"))
    head = tid < 0
    o = np.lexsort((gid[head], p0[head]))  # the group with the smaller p0 comes first
    group, least, own = gid[head][o], p0[head][o], tile[head][o]
    size = len(group)
    name = np.argsort(group)
    at = name[np.searchsorted(group[name], gid[~head])]
    tid, p = tid[~head], p[~head]
    total = np.zeros((size, size), np.int64)
    for a in range(size):
        mine = np.sort(p[at == a])
        below = np.searchsorted(mine, least)
        total[a] = np.concatenate([[0], np.cumsum(mine)])[below] + (len(mine) - below) * least
    o = np.lexsort((at, tid))
    tid, p, at = tid[o], p[o], at[o]
    end = np.searchsorted(tid, tid, "right")
    rest = end - np.arange(len(tid)) - 1  # later postings of the same term, of groups with larger p0
    edge = np.concatenate([[0], np.cumsum(rest)])
    x0 = 0
    while x0 < len(tid):
        x1 = max(x0 + 1, int(np.searchsorted(edge, edge[x0] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(x0, x1), rest[x0:x1])
        y = np.arange(len(x)) - np.repeat(edge[x0:x1] - edge[x0], rest[x0:x1]) + x + 1
        np.add.at(total, (at[x], at[y]), np.minimum(p[x], p[y]) - np.minimum(p[x], least[at[y]]))
        x0 = x1
    a, b = np.triu_indices(size, 1)
    if lo != hi:
        across = own[a] != own[b]
        a, b = a[across], b[across]
    return pa.table({"ga": group[a], "gb": group[b], "least": total[a, b]})


def _pairs(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """ga, gb, value: every two sources of a lang, once."""
    deal = ["lang", "lo", "hi", "part"]
    each = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    both = [F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi")]
    heads = groups.select("*", each).select("lang", *both, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("tid"), "gid", "tile", F.lit(0).cast("long").alias("p"), "p0")
    posts = scored.select("*", each).select("lang", *both, F.pmod(F.xxhash64("tid"), "parts").cast("int").alias("part"), "tid", "gid", "tile", "p", "p0")
    sums = heads.union(posts).groupBy(*deal).applyInArrow(_overlaps, "ga long, gb long, least long").groupBy("ga", "gb").agg(F.sum("least").alias("least"))
    side = lambda k: groups.select(F.col("gid").alias(f"g{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "p0", "all_p", "kept")])
    return sums.join(side("a"), "ga").join(side("b"), "gb").select("ga", "gb", F.expr("all_p_a + all_p_b - 2 * ((kept_a - n_a) * p0_a + least)").alias("value"))


def _terms(scored: DataFrame, top: int) -> DataFrame:
    """gid, term, value, rank: the terms with the largest p - q of each group, best buckets first."""
    bits = F.length(F.bin("count")) - 1
    bucket = F.when(F.col("count") < 16, F.col("count")).otherwise(16 * bits + F.expr("shiftright(count, length(bin(count)) - 5)") - 16)
    scored = scored.withColumn("bucket", bucket)
    first = Window.partitionBy("gid").orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("terms").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = stage(scored.groupBy("gid", "bucket").agg(F.count(F.lit(1)).alias("terms"), (F.max("p") - F.min("q")).alias("bound")).filter("bound > 0").withColumn("before", before), "divergence-buckets")
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"), "term")
    best, seen, limit = None, 0, FIRST
    while True:
        frontier = buckets.filter((F.col("before") >= seen) & (F.col("before") < limit))
        if best is not None:
            frontier = frontier.join(kth, "gid", "left").filter("bound >= coalesce(kth, 0)")
        found = scored.join(frontier.select("gid", "bucket"), ["gid", "bucket"]).filter("p > q").select("gid", "term", (F.col("p") - F.col("q")).alias("value"))
        found = found if best is None else found.union(best.drop("rank"))
        old, best = best, stage(found.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top), "divergence-best")
        if old is not None:
            unstage(old)
        kth = best.filter(F.col("rank") == top).select("gid", F.col("value").alias("kth"))
        if not buckets.filter(F.col("before") >= limit).join(kth, "gid", "left").filter("bound >= coalesce(kth, 0)").limit(1).count():
            return best
        seen, limit = limit, limit * GROWTH


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, value, rank."""
    spark = docs.sparkSession
    prepare(spark)
    name = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    src = docs.select(name("lang"), name("source"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    counted = src.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = stage(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("count").alias("all_count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = stage(kept.select("lang", "term", "all_count", F.monotonically_increasing_id().alias("tid")), "divergence-kept")
    postings = stage(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "tid", "count", "all_count"), "divergence-postings")
    unstage(counts)

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_count").alias("all_n"))
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n"))
    occurring = docs.select(name("lang"), name("source")).distinct()
    groups = occurring.join(totals, ["lang", "source"], "left").fillna(0, ["total", "n"])
    dealt = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("posts"))
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    parts = F.greatest(F.lit(1), F.ceil(2 * F.col("posts") / tiles / F.greatest(F.lit(TASK_ROWS), (F.col("sources") / tiles) ** 2 / 4))).cast("int")
    dealt = dealt.select("lang", tiles.alias("tiles"), parts.alias("parts"))
    groups = groups.join(langs, "lang", "left").join(dealt, "lang").fillna(0, ["kept", "all_n"])
    groups = groups.withColumn("p0", F.coalesce(probability("0", "total", "kept"), F.lit(0))).withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    groups = stage(groups.withColumn("gid", F.monotonically_increasing_id()), "divergence-groups")
    scored = postings.join(groups.drop("n"), ["lang", "source"]).withColumn("p", probability("count", "total", "kept")).withColumn("q", probability("all_count", "all_n", "kept"))
    scored = stage(scored.select("lang", "gid", "tile", "tiles", "parts", "p0", "term", "tid", "count", "p", "q"), "divergence-scored")
    unstage(postings, kept)

    sums = scored.groupBy("gid").agg(F.sum("p").alias("sum_p"))
    groups = groups.join(sums, "gid", "left").withColumn("all_p", F.coalesce("sum_p", F.lit(0)) + (F.col("kept") - F.col("n")) * F.col("p0")).drop("sum_p")
    pairs = stage(_pairs(groups, scored), "divergence-pairs")
    known = groups.select("gid", "lang", "source")
    other = known.select(F.col("gid").alias("of"), F.col("source").alias("item"))
    both = pairs.select(F.col("ga").alias("gid"), F.col("gb").alias("of"), "value").union(pairs.select("gb", "ga", "value"))
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    ranked = both.join(other, "of").withColumn("rank", F.row_number().over(by_value)).select("gid", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = _terms(scored, top).select("gid", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return ranked.union(terms).join(known, "gid").select("lang", "source", "part", "item", "value", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
    occurs as (select distinct lang, source from d),
    t as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    kept as (select lang, term, count(*) as c from t group by all having count(distinct id) >= 30),
    langs as (select lang, count(*) as v, sum(c)::bigint as n from kept group by lang),
    posts as (select lang, source, term, count(*) as c from t semi join kept using (lang, term) group by all),
    grp as (select lang, source, coalesce(v, 0) as v, coalesce(langs.n, 0) as ln, coalesce(sum(c), 0)::bigint as n
        from occurs left join posts using (lang, source) left join langs using (lang) group by all),
    probs as (select g.lang, g.source, k.term, coalesce(p.c, 0) as c,
            1 + (1000000000 * (coalesce(p.c, 0) + 5)) // (g.n + 5 * g.v) as p, 1 + (1000000000 * (k.c + 5)) // (g.ln + 5 * g.v) as q
        from grp g join kept k using (lang) left join posts p on p.lang = g.lang and p.source = g.source and p.term = k.term),
    pair as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
        from occurs a join occurs b on a.lang = b.lang and a.source <> b.source
        left join probs x on x.lang = a.lang and x.source = a.source
        left join probs y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
    both_parts as (select lang, source, 'pair' as part, item, value from pair
        union all select lang, source, 'term', term, (p - q)::bigint from probs where c > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as r from both_parts)
select lang, source, part, item, value, r::int as rank from ranked where part = 'pair' or r <= 50"""
