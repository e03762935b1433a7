"""Small fixtures with the expected values of the survey."""

import datetime as dt

from pyspark.sql import functions as F

from eventloom import schema
from eventloom.functions import scoring, text, urls
from eventloom.operators import analytics, crawl, dedup, extract, graph, merge, scans, search, users
from eventloom.operators.predicates import Query
from eventloom.sources import connectors

DAY = dt.date(2026, 9, 1)
T0 = dt.datetime(2026, 7, 15, 12)


def row(key, title="T", **kw):
    base = dict(key=key, title=title, description=None, url=f"https://x.example.com/{key}", city=None, location=None, is_online=False, start_date=DAY, end_date=None, category="meetup", is_free=None, price=None, provider="seed", content_hash="h", first_seen_at=T0, last_seen_at=T0, status="active", status_reason=None, version=1)
    base |= kw
    return tuple(base.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schema.CATALOG)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_indel_similarity():
    assert dedup.title_ratio("genai meetup", "gen ai meetup") >= 0.85
    assert dedup.title_ratio("devops meetup", "machine learning bootcamp") < 0.6
    assert dedup.indel("", "") == 1.0


def test_pair_gates(spark):
    a = frame(spark, row("a", "Same Title", city="Delhi"), row("b", "Same Title", city="Bangalore"), row("c", "Same Title", start_date=dt.date(2026, 12, 1)), row("d", "Other words here", url="https://x.example.com/a"))
    k = dedup.keyed(a)
    pairs = k.alias("a").join(k.alias("b"), F.col("a.key") < F.col("b.key")).select(F.concat("a.key", "b.key").alias("p"), dedup.pair_score("a", "b").alias("s"))
    got = {r.p: r.s for r in pairs.collect()}
    assert got["ab"] == 0 and got["ac"] == 0 and got["ad"] == 1.0


def test_greedy_clusters_and_survivor(spark):
    df = frame(spark, row("a", "DevFest"), row("b", "Dev-Fest!", description="long text", location="Hall"), row("c", "Rust Workshop")).withColumn("ord", F.monotonically_increasing_id())
    got = dedup.survivors(dedup.clusters(df, "ord"), "ord")
    assert {r.key for r in got.collect()} == {"b", "c"}


def test_upsert(spark):
    old = frame(spark, row("a", content_hash="1"), row("b", content_hash="1", version=2))
    later = dt.datetime(2026, 7, 16)
    new = frame(spark, row("a", content_hash="1", last_seen_at=later), row("b", "first", content_hash="2", last_seen_at=T0), row("b", "second", content_hash="3", last_seen_at=later), row("c", last_seen_at=later))
    got = {r.key: r for r in merge.upsert(old, new, F.col("last_seen_at")).collect()}
    assert [got[k].action for k in "abc"] == ["touched", "updated", "inserted"]
    assert got["a"].last_seen_at == later and got["a"].version == 1 and got["b"].version == 3 and got["b"].title == "second" and got["b"].first_seen_at == T0


def test_changes(spark):
    prev = frame(spark, row("u", content_hash="1", location="A", price="1"), row("w"), row("e"), row("same"), row("gone"))
    cur = frame(spark, row("new"), row("u", content_hash="2", location="B", price="2", start_date=dt.date(2026, 9, 2)), row("w", status="withdrawn"), row("e", status="expired"), row("same"))
    got = {(r.key, r.change) for r in merge.detect_changes(prev, cur).collect()}
    assert got == {("new", "NEW"), ("u", "UPDATED"), ("u", "VENUE_CHANGED"), ("u", "COST_CHANGED"), ("u", "DATE_CHANGED"), ("w", "CANCELLED"), ("e", "EXPIRED")}


def test_illegal_transitions(spark):
    h = spark.createDataFrame([("a", 1, "new"), ("a", 2, "live"), ("b", 1, "live"), ("b", 2, "new")], "key string, at int, state string")
    legal = spark.createDataFrame([("new", "live")], "source string, target string")
    assert [r.key for r in merge.transitions(h, legal).collect()] == ["b"]


def test_names_and_cities(spark):
    assert [one(spark, text.normalize_name(F.lit(x))) for x in ("Google LLC", "FOSS United!", "  GDG   Bangalore ")] == ["google", "foss united", "gdg bangalore"]
    assert one(spark, text.normalize_city(F.lit(" Bengaluru "))) == "Bangalore"
    assert one(spark, text.detect_city(F.lit("a hall in New Delhi"))) == "Delhi"
    assert one(spark, text.labels(F.lit("intro to javascript"), text.TECHNOLOGIES)) == ["JavaScript"]
    assert one(spark, text.series_name(F.lit("3rd Annual PyCon 2026 – Pune"), F.lit("Pune"))) == "PyCon"
    assert one(spark, text.find_dates(F.lit("on 3 May 2026, or 2026-05-04"))) == ["2026-05-04", "3 May 2026", "May 2026"]


def test_urls(spark):
    assert one(spark, urls.dedup_url(F.lit("https://www.Lu.ma/X/?a=1"))) == "lu.ma/x"
    assert one(spark, urls.crawl_url(F.lit("HTTPS://Www.Ex.com:443/A/?b=2&utm_source=x&a=1#f"))) == "https://www.ex.com/A?a=1&b=2"
    assert one(spark, urls.registrable_domain(F.lit("a.b.co.in"))) == "b.co.in"
    cur = one(spark, urls.encode_cursor(F.lit("2026-01-02"), F.lit("k?>")))
    assert one(spark, urls.decode_cursor(F.lit(cur))) == ["2026-01-02", "k?>"]


def test_date_decay_and_weights(spark):
    assert abs(sum(scoring.RANK_WEIGHTS.values()) - 1) < 1e-9
    today = F.lit("2026-07-15").cast("date")
    at = lambda d: one(spark, scoring.date_score(F.lit(d).cast("date"), today))
    assert (at("2026-07-15"), at("2026-07-01"), at("2026-08-14")) == (1.0, 0.0, 0.5)
    assert one(spark, scoring.present_mean([(0.5, F.lit(1.0)), (0.5, F.lit(None).cast("double"))])) == 1.0


def test_fusion_and_plan(spark):
    a = spark.createDataFrame([("keyword", "a", 0), ("keyword", "b", 1)], "source string, key string, rank int")
    b = spark.createDataFrame([("entity", "b", 0), ("entity", "c", 1)], "source string, key string, rank int")
    got = search.fuse([a, b], 10).collect()
    assert got[0].key == "b" and got[0].sources == "entity+keyword" and {r.key for r in got} == {"a", "b", "c"}
    assert [search.plan(q, n)[0] for q, n in ((Query(keywords=["gdg"]), True), (Query(keywords=["kubernetes"]), False), (Query(city="Pune"), False), (Query(), False))] == ["hybrid", "keyword", "structured", "browse"]


def test_bm25_prefers_rare_and_short(spark):
    d = spark.createDataFrame([(1, "rust rust meetup"), (2, "rust " + "filler " * 50), (3, "meetup meetup")], "id int, text string")
    assert [r.key for r in search.bm25(d, "id", F.col("text"), ["rust"], 5).collect()] == [1, 2]


def test_graph(spark):
    df = frame(spark, *[row(k, f"GDG talk {k}", provider="gdg", city=c) for k, c in (("a", "Bangalore"), ("b", "Bombay"), ("c", "Chennai"))])
    v, e = graph.build(df)
    g = v.filter("type = 'community'").collect()
    assert len(g) == 1 and g[0].events == 3
    assert [r.id for r in graph.neighbours(e, g[0].id, "ACTIVE_IN").collect()] == ["city:bangalore", "city:chennai", "city:mumbai"]
    _, folded = graph.fold(v, e, "city:mumbai", "city:chennai")
    assert folded.filter("target = 'city:chennai'").count() == 0


def test_profile_signs(spark):
    log = spark.createDataFrame([("u", "ignore", T0, "a"), ("u", "attend", T0, "b"), ("u", "view", T0, "b")], "user_id string, type string, at timestamp, event_key string")
    feats = spark.createDataFrame([("a", ["city:Pune"]), ("b", ["topic:LLMs"])], "key string, features array<string>")
    p = users.profile(log, feats)
    assert {r.feature: r.weight for r in p.collect()} == {"city:Pune": -1.0, "topic:LLMs": 6.0}


def test_reasons(spark):
    log = spark.createDataFrame([("went", "attend", T0, "b"), ("clicked", "click", T0, "b"), ("other", "view", T0, "c")], "user_id string, type string, at timestamp, event_key string")
    feats = spark.createDataFrame([("b", ["topic:LLMs", "city:Pune", "tech:Rust", "category:meetup", "format:online"]), ("c", ["budget:free"]), ("x", ["topic:LLMs", "city:Pune", "tech:Rust", "category:meetup"])], "key string, features array<string>")
    top = spark.createDataFrame([("went", "x", False), ("clicked", "x", True), ("other", "x", False)], "user_id string, key string, similar boolean")
    got = {r.user_id: r.reasons for r in users.reasons(top, feats, users.profile(log, feats), log).collect()}
    assert got["went"] == ["Recommended because you frequently attend LLMs events.", "Recommended because you're interested in Rust.", "Recommended because you attend events in Pune."]
    assert got["clicked"] == ["Recommended because you're interested in LLMs.", "Recommended because you're interested in Rust.", "Recommended because it's similar to events you've engaged with."]
    assert got["other"] == ["Recommended based on freshness and trending signals."]


def test_streaks(spark):
    r = spark.createDataFrame([("p", i, i, ok, 1.0) for i, ok in enumerate([True, False, False, False])], "provider string, run_id int, at int, ok boolean, found double")
    got = analytics.provider_state(r).first()
    assert (got.streak, got.worst, got.circuit) == (3, 3, "open")


def test_robots(spark):
    rules = crawl.robots_rules(spark.createDataFrame([("d", "User-agent: *\nDisallow: /a\nAllow: /a/b\n\nUser-agent: other\nDisallow: /")], "domain string, body string"), "mine")
    u = spark.createDataFrame([("d", "/a/x", "1"), ("d", "/a/b/c", "2"), ("d", "/z", "3")], "domain string, path string, url string")
    assert {r.url: r.allowed for r in crawl.robots_allowed(u, rules).collect()} == {"1": False, "2": True, "3": True}


def test_extract(spark):
    ld = '<script type="application/ld+json">{"@type":"Event","name":"Conf","startDate":"2026-09-01","location":{"name":"Hall"}}</script>'
    table = "<table><tr><th>Event</th><th>Date</th></tr><tr><td>Talk</td><td>2026-09-02</td></tr></table>"
    pages = spark.createDataFrame([("1", ld), ("2", table), ("3", '<script type="application/ld+json">{bad</script>'), ("4", '<script type="application/ld+json">{"@type":"Organization","name":"x"}</script>')], "url string, html string")
    got = {r.page: (r.title, r.start_date) for r in extract.merge_fields(extract.extract_fields(pages)).collect()}
    assert got == {"1": ("Conf", "2026-09-01"), "2": ("Talk", "2026-09-02")}


def test_calendar(spark):
    ics = "BEGIN:VEVENT\r\nSUMMARY:Rust \r\n meetup\\, May\r\nURL:https://x.example.com/1\r\nDTSTART;TZID=Asia/Kolkata:20260901T100000\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:No link\r\nDTSTART:20260901\r\nEND:VEVENT"
    got = connectors.calendar(spark.createDataFrame([("Pune", ics)], "city string, body string"), "ics").collect()
    assert [(r.title, r.city, r.start_date) for r in got] == [("Rust meetup, May", "Pune", DAY)]


def test_conference_list(spark):
    df = spark.createDataFrame([("C", "https://c.example.com", "2026-09-01", "2026-09-01", "Bombay", "India", None), ("D", "bad", "2026-09-01", None, None, "India", None)], "name string, url string, startDate string, endDate string, city string, country string, online boolean")
    got = connectors.conference_list(df).collect()
    assert len(got) == 1 and got[0].city == "Mumbai" and got[0].end_date is None


def test_stream_matches_batch(spark, tmp_path):
    from eventloom.streaming import incremental

    log = spark.createDataFrame([("u", "view", T0, "a"), ("u", "attend", T0, "a"), ("v", "click", T0, "b")], "user_id string, type string, at timestamp, event_key string")
    feats = spark.createDataFrame([("a", ["f:1"]), ("b", ["f:1", "f:2"])], "key string, features array<string>")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    seen: dict = {}
    s = incremental.profile_stream(incremental.stream(spark, str(tmp_path / "log"), log.schema), feats)
    incremental.run_available(s, str(tmp_path / "cp"), lambda b, n: seen.update({(r.user_id, r.feature): r.weight for r in b.collect()}))
    assert seen == {(r.user_id, r.feature): r.weight for r in users.profile(log, feats).collect()}


def test_entry_survives_without_text_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "eventloom", tmp_path / "eventloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_percentiles_round_half_even(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(6)], "g string, v double")
    assert scans.percentiles(df, "g", "v", [0.5]).first().p50 == 2.0
