"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers. They are the
seeds of a bootstrap: every word with a numeral or an @ is an instance; its shape, the word on
its left and the word on its right are lexical patterns. Spark scores the graph of patterns and
instances in turns: a pattern's confidence for a kind is the mean confidence of its instances
(seeds have 1), an instance's is what its shape and its better context agree on; a shape that no seed
has is judged by the better context alone. After ROUNDS turns, instances of at least ACCEPT confidence that no
base span touches are added as spans of that kind; those with one space between them make one span.

Positions are code points: matches are put between two marker characters (noncharacters, which
a text that holds them loses to a third, of the same length) and the pieces' lengths are summed.

Defined results: a null text is empty; repeated rows are judged alike; a null doc_id is a row
as any other; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import stage

# The base patterns. Possessive where nothing could be given back, so that long
# runs take no stack; a match starts where a run starts, which is where the leftmost one does.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
OPEN, CLOSE, SPARE = "\ufdd0", "\ufdd1", "\ufdd2"
#: A word with a numeral or an @, without punctuation at its end.
INSTANCE = r"(?<!\S)(?=\S*[0-9@])\S*[\p{L}0-9)]"
ROUNDS, SUPPORT, ACCEPT = 3, 10, 0.9
#: Characters around an instance in which its neighbouring words are looked for (a longer word counts as its part), and matches numbered together.
CONTEXT, GROUP = 40, 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once, however often a lambda in body names it."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str) -> Column:
    """Array of struct(start, end, hit, before, after) of the matches of a pattern; before and after hold up to CONTEXT characters.

    Matches are numbered off in groups of GROUP, so that the work grows little faster than their number."""
    kind = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"

    def step(acc: Column, piece: Column) -> Column:
        hit, rest = F.substring_index(piece, CLOSE, 1), F.substring_index(piece, CLOSE, -1)
        one = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(hit)).alias("end"), hit.alias("hit"), acc["before"].alias("before"), F.left(rest, F.lit(CONTEXT)).alias("after"))
        before = F.right(F.concat(F.right(hit, F.lit(CONTEXT)), rest), F.lit(CONTEXT))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), before.alias("before"), F.concat(acc["out"], F.array(one)).alias("out"))

    def grouped(p: Column) -> Column:
        last = F.right(F.element_at(p, 1), F.lit(CONTEXT))

        def group(g: Column) -> Column:
            before = F.when(g == 0, last).otherwise(F.right(F.translate(F.element_at(p, g * GROUP + 1), CLOSE, ""), F.lit(CONTEXT)))
            zero = F.struct(F.lit(0).alias("at"), before.alias("before"), F.array().cast(kind).alias("out"))
            return F.aggregate(F.slice(p, g * GROUP + 2, F.lit(GROUP)), zero, step)

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 2) / GROUP).cast("int")), group)

    def placed(p: Column) -> Column:
        zero = F.struct(F.length(F.element_at(p, 1)).alias("at"), F.array().cast("array<int>").alias("from"))
        begins = lambda r: F.aggregate(r, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["from"], F.array(acc["at"])).alias("from")), lambda acc: acc["from"])
        moved = lambda x, by: F.transform(x["out"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["hit"].alias("hit"), m["before"].alias("before"), m["after"].alias("after")))
        return F.when(F.size(p) > 1, let(grouped(p), lambda r: F.flatten(F.zip_with(r, begins(r), moved)))).otherwise(F.array().cast(kind))

    return let(F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN), placed)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(at(i))).otherwise(at(i)))
    return total % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), p), F.lit(-3), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        # nested, as a conjunction may be evaluated in any order
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,ord:int,end:int>>"


def _base(text: Column, kind: str, worth: Column) -> Column:
    found = F.transform(F.filter(located(text, PATTERNS[kind]), lambda m: _passes(kind, m["hit"])), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), m["end"].alias("end")))
    return F.when(worth, found).otherwise(F.array().cast(_SPANS))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(words: Column, last: bool) -> Column:
    w = F.filter(F.split(words, r"\s+"), lambda x: x != "")
    w = F.try_element_at(w, F.lit(-1 if last else 1))
    return F.regexp_replace(F.regexp_replace(F.lower(w), r"[.,;:!?]+$", ""), "[0-9]", "9")


def _shape(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"\p{L}+", "a"), "[0-9]", "9")


def base_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark, base spans, and the instances with their patterns and the kind of the base span that they touch (-1: none)."""
    raw = F.coalesce(docs["text"], F.lit(""))
    marked = F.contains(raw, F.lit(OPEN)) | F.contains(raw, F.lit(CLOSE))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"), F.when(marked, F.translate(raw, OPEN + CLOSE, SPARE * 2)).otherwise(raw).alias("t"))
    t = F.col("t")
    at, plus, digit = F.contains(t, F.lit("@")), F.contains(t, F.lit("+")), t.rlike("[0-9]")
    worth = {"email": at, "ip": digit & t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": digit & t.rlike(r"[0-9](?:[ -]?[0-9]){13}"), "phone": plus & digit}
    seeds = src.select("doc_id", "mark", "t", (at | digit).alias("any"), *[_base(t, k, worth[k]).alias(k) for k in KINDS])
    base = F.concat(*KINDS)
    words = F.when(F.col("any"), located(t, INSTANCE)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>"))

    def judged(group: Column, near: Column) -> Column:
        return F.transform(
            group,
            lambda m: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                _shape(m["hit"]).alias("shape"),
                _context(m["before"], True).alias("left"),
                _context(m["after"], False).alias("right"),
                F.coalesce(F.try_element_at(F.filter(near, lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])), F.lit(1))["ord"], F.lit(-1)).alias("seed"),
            ),
        )

    def grouped(w: Column) -> Column:
        # A group of instances is held against the spans that touch the group.
        touching = lambda g: F.filter(F.col("base"), lambda b: (b["start"] < F.element_at(g, -1)["end"]) & (b["end"] > F.element_at(g, 1)["start"]))
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / GROUP).cast("int")), lambda k: F.slice(w, k * GROUP + 1, F.lit(GROUP)))
        return F.when(F.size(w) > 0, F.flatten(F.transform(groups, lambda g: let(touching(g), lambda near: judged(g, near))))).otherwise(judged(w, F.col("base")))

    insts = let(words, grouped)
    return seeds.withColumn("base", base).select("doc_id", "mark", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", insts.alias("insts"))


def discovered(table: DataFrame) -> DataFrame:
    """doc_id, mark, start, end, ord of the instances that the bootstrap adds."""
    inst = table.select("doc_id", "mark", F.explode("insts").alias("i")).select("doc_id", "mark", "i.*")
    # The graph is between kinds of instances, not instances: equal (shape, left, right) are one node with a weight.
    nodes = stage(inst.groupBy("shape", "left", "right").agg(F.count(F.lit(1)).alias("w"), *[F.sum((F.col("seed") == k).cast("int")).alias(f"s{k}") for k in range(len(KINDS))]), "pii-nodes")
    kinds = F.array(*[F.struct(F.lit(k).alias("ord"), F.col(f"s{k}").alias("s")) for k in range(len(KINDS))])
    known = nodes.groupBy("shape").agg((F.sum(sum(F.col(f"s{k}") for k in range(len(KINDS)))) > 0).alias("known"))
    node = nodes.join(known, "shape").withColumn("k", F.explode(kinds)).select("shape", "left", "right", "w", "known", "k.ord", "k.s", (F.col("k.s") / F.col("w")).alias("conf"))
    # A pattern can only tell of a kind of which it has seeds.
    for _ in range(ROUNDS):
        score = F.sum(F.col("w") * F.col("conf")) / F.sum("w")
        some = (F.sum("s") > 0) & (F.sum("w") >= SUPPORT)
        shapes = node.groupBy("shape", "ord").agg(score.alias("cs"), some.alias("ok")).filter("ok").drop("ok")
        lefts = node.filter("left is not null").groupBy("left", "ord").agg(score.alias("cl"), some.alias("ok")).filter("ok").drop("ok")
        rights = node.filter("right is not null").groupBy("right", "ord").agg(score.alias("cr"), some.alias("ok")).filter("ok").drop("ok")
        both = node.join(shapes, ["shape", "ord"], "left").join(lefts, ["left", "ord"], "left").join(rights, ["right", "ord"], "left")
        context = F.greatest(F.coalesce("cl", F.lit(0.0)), F.coalesce("cr", F.lit(0.0)))
        agreed = F.when(F.col("known"), F.least(F.coalesce("cs", F.lit(0.0)), context)).otherwise(context)
        seeded = F.col("s") / F.col("w")
        node = stage(both.select("shape", "left", "right", "w", "known", "ord", "s", (seeded + (1 - seeded) * agreed).alias("conf"), agreed.alias("agreed")), "pii-scores")
    best = node.filter(F.col("agreed") >= ACCEPT).groupBy("shape", "left", "right").agg(F.max_by("ord", F.struct("agreed", -F.col("ord"))).alias("ord"))
    x, y = inst.filter("seed = -1").alias("x"), best.alias("y")
    same = (F.col("x.shape") == F.col("y.shape")) & F.col("x.left").eqNullSafe(F.col("y.left")) & F.col("x.right").eqNullSafe(F.col("y.right"))
    found = x.join(y, same).select("x.doc_id", "x.mark", "x.start", "x.end", "y.ord").distinct()
    row = Window.partitionBy("doc_id", "mark", "ord").orderBy("start")
    apart = F.coalesce((F.col("start") > F.lag("end").over(row) + 1).cast("int"), F.lit(0))
    runs = found.withColumn("apart", apart).withColumn("run", F.sum("apart").over(row))
    return runs.groupBy("doc_id", "mark", "ord", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row. The counts are those of base spans."""
    table = stage(base_table(docs), "pii-base")
    more = discovered(table).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "ord", "end")).alias("extra")).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "extra")
    full = table.select("doc_id", "mark", *[f"n_{k}" for k in KINDS], "base").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m")), "left")
    every = F.concat("base", F.coalesce(F.col("extra").cast(_SPANS), F.array().cast(_SPANS)))
    return full.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))
