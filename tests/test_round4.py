"""What the fourth review found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import jaccard_join
from eventloom.operators import dedup, matching, search, similar
from eventloom.plans import queries as plans
from tests.test_matching import SCHEMA, profile, score
from tests.test_operators import frame, row


def test_titles_are_compared_without_case(spark):
    """Capitals of ß are SS: the same title, in capitals, is the same event."""
    old = frame(spark, row("a", "Chßkeit"), row("b", "Straße"))
    new = frame(spark, row("n1", "CHSSKEIT !"), row("n2", "STRASSE"), row("n3", "Chkeit und mehr")).withColumn("url", F.concat(F.lit("https://other.example.net/"), F.sha1("key")))
    got = {r.key for r in dedup.resolve(new.withColumn("ord", F.monotonically_increasing_id()), old, "ord").collect()}
    assert got == {"n3"}


def test_mentions_of_pages_with_one_url(spark, tmp_path):
    """Pages that share a url, with a fragment, with a parameter or bare, are counted each."""
    urls = ["https://a.example.com/p#top", "https://a.example.com/p#top", "https://a.example.com/p?page=1", "https://a.example.com/p?page=5", "https://a.example.com:8080", "https://a.example.com:8080"]
    spark.createDataFrame([(40 * i, u, "<p>x</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.kind: r.n for r in plans.QUERIES["q_page_mentions"](spark, str(tmp_path)).collect()}
    assert got == {"github": 6, "calendar": 6, "telegram": 2}


def test_common_subsequences_of_many_pairs():
    """Short, long and empty strings, and letters beyond ASCII, as one by one."""
    rng = random.Random(4)
    s = ["", "", "a", "ß𝄞é", *["".join(rng.choice("abcd é𝄞") for _ in range(n)) for n in (1, 5, 63, 64, 65, 128, 129, 256, 257, 300, 600, 2100) for _ in range(5)]]
    a, b = matching._Strings(s), matching._Strings(s[::-1])
    i, j = (x.ravel() for x in np.meshgrid(range(len(s)), range(len(s)), indexing="ij"))
    want = np.array([matching.lcs(a.s[x], b.s[y]) for x, y in zip(i, j, strict=True)])
    assert (matching.lcs_many(a, b, i, j, np.zeros(len(i), np.int64)) == want).all()
    need = np.minimum(want + np.array([rng.randint(-2, 2) for _ in want]), 10**6)
    assert (matching.lcs_many(a, b, i, j, need) == np.where(want >= need, want, -1)).all()


def test_equal_titles_are_compared_once(spark, monkeypatch):
    """Records that share a title are one string of the tiles, and titles of nothing in common give no pairs."""
    written = {}
    monkeypatch.setattr(dedup, "staged", lambda df, name, put=dedup.staged: written.setdefault((name, "_words" in df.columns), put(df, name)))
    h = lambda c: F.sha1(F.concat(F.lit(c), F.col("ord").cast("string")))
    rows = spark.range(400).select(F.col("id").alias("ord"), F.lit("Pune").alias("city"), F.lit("2026-09-01").cast("date").alias("start_date")).withColumns({"title": F.concat(h("t"), F.lit(" "), h("u")), "url": F.concat(F.lit("https://e.example.com/"), h("v"))})
    twice = rows.unionByName(rows.withColumns({"ord": F.col("ord") + 400, "url": F.concat(F.lit("https://e.example.com/"), h("w"))}))
    got = {r.ord: r.cluster for r in dedup.clusters(twice, "ord").collect()}
    assert got == {k: k % 400 for k in range(800)}
    assert written["dedup-values", True].count() == 400 and written["dedup-like", False].count() == 400


@pytest.mark.parametrize(("cost", "tile"), [(0, 1024), (50, 1024), (50, 16)])
def test_organisers_with_many_common_values(spark, monkeypatch, cost, tile):
    """Whether by combinations (cost 0) or by tiles: the same pairs with the same scores, as by comparing all."""
    monkeypatch.setattr(similar, "PAIRS_A_COMBINATION", cost)
    monkeypatch.setattr(similar, "TILE", tile)
    rng = random.Random(6)
    some = lambda xs: rng.choice([None, [], *[rng.sample(xs, k) for k in range(1, len(xs) + 1)]])
    rows = [profile(i, key=rng.choice(["same", "", None, f"k{i}"]), chapter=rng.choice(["gdg", "acm", "", None]), university=rng.choice(["IIT", "muj"]), city=rng.choice(["Pune", "Goa"]), venue=rng.choice(["h1", "H1", "h2"]), series=some(["a", "b", "c", "d", "e"]), technologies=some(["y1", "y2", "y3", "y4", "y5", "y6", "y7"]), sponsors=some(["o", "f", "p"])) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    member = {r.id: r["class"] for r in similar.classes(df)[1].collect()}
    kept = [r for r in rows if member[r[0]] == r[0]]
    got = {(r.a, r.b): (r.total, r.shared_series) for r in similar.similar(df, 0.5).collect()}
    want = {(a[0], b[0]): (score(a, b), bool(set(a[6] or []) & set(b[6] or []))) for a in kept for b in kept if a[0] < b[0] and score(a, b) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-4 and got[k][1] == want[k][1] for k in want)


def test_pairs_of_an_index_are_judged_where_they_meet(spark):
    """Only similar pairs are shuffled: strings that all share a rare beginning, and nothing else, give none."""
    df = spark.range(600).select("id", F.lit("b").alias("block"), F.concat(F.lit("qxz"), F.sha1(F.col("id").cast("string"))).alias("s"))
    got = matching.by_index(df.union(df.filter("id < 3").withColumn("id", F.col("id") + 1000)), "block", "s", 0.92)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("MapInArrow")[0]  # copies of a pair go after pairs have been judged
    assert sorted((r.x, r.y, r.score) for r in got.collect()) == [(0, 1000, 1.0), (1, 1001, 1.0), (2, 1002, 1.0)]


def test_long_lists_are_dealt_out_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 7)
    rng = random.Random(8)
    s = [f"example{rng.randint(0, 99)} of a name" for _ in range(120)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(s)], "id long, s string").withColumn("block", F.lit(None).cast("string"))
    got = sorted((r.x, r.y) for r in matching.by_index(df, "block", "s", 0.92).collect())
    assert got == [(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if matching.indel(s[i], s[j]) >= 0.92]


def test_terms_are_counted_in_one_shuffle(spark, tmp_path):
    """Postings are written with their counts, repeated keys summed, and leave no copy of themselves in the shared folder."""
    docs = spark.createDataFrame([(1, "b a b, B c"), (2, ""), (3, None), (4, "a"), (4, "a d")], "key long, text string")
    ix = search.Index(spark, f"{tmp_path}/terms")
    ix.upsert(docs, "key", F.col("text"))
    got = {(r.key, r.term): r.tf for r in ix._postings().collect()}
    assert got == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (4, "a"): 2, (4, "d"): 1}
    assert search._terms(docs, "key", F.col("text"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_tokens_of_no_open_list_are_not_joined_wide(spark, monkeypatch):
    """The near stage writes its open lists before it shuffles tokens for them; components are as by comparing all."""
    written = []
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name, put=jaccard_join.stage: written.append(name) or put(df, name))
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(15)]
    texts = [" ".join(w if rng.random() > 0.01 else "x" for w in b) for b in base for _ in range(3)]
    grams = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 100 * len(grams[i] & grams[j]) >= 90 * len(grams[i] | grams[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and written.index("jaccard-open") < written.index("jaccard-lists")
