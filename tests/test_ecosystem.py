"""Relations around organisers, merged pages, refined records, payloads of pages: rows with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.operators import admission, ecosystem, hydration, scans, upkeep

NOW = dt.datetime(2026, 7, 15, 12)


def test_relations(spark):
    p = spark.createDataFrame([("org:gdg pune", "Google Developer Group", "gdg", None, None, "Hall 1", ["DevFest"], ["Acme Labs"], ["https://c/x.ics"], None, ["gdg.dev"], {"github": "https://github.com/GDG", "blog": "https://b"})], "id string, parent_org string, chapter string, university string, department string, venue string, series array<string>, sponsors array<string>, calendars array<string>, feeds array<string>, domains array<string>, socials map<string,string>")
    v, e = ecosystem.relations(p)
    assert {(r.source, r.type, r.target) for r in e.collect()} == {
        ("org:gdg pune", "chapter_of", "org:developer google"), ("org:gdg pune", "organizes", "series:devfest"), ("series:devfest", "recurring", "series:devfest"), ("sponsor:acme lab", "sponsors", "org:gdg pune"), ("org:gdg pune", "hosts", "venue:1 hall"),
        ("org:gdg pune", "uses_calendar", "cal:https://c/x.ics"), ("org:gdg pune", "announces_on", "web:gdg.dev"), ("org:gdg pune", "announces_on", "github:https://github.com/gdg"), ("org:gdg pune", "announces_on", "blog:https://b"),
    }
    assert {r.id: r.type for r in v.collect()}["github:https://github.com/gdg"] == "github_org"


def test_richer_page_merges_in(spark):
    f = spark.createDataFrame([("o", 0, "city", None, 0.0), ("o", 1, "city", "Pune", 0.6), ("o", 2, "city", "Goa", 0.6), ("o", 3, "city", None, 0.9)], "id string, ord int, field string, value string, confidence double")
    k = spark.createDataFrame([("o", 0, "organization"), ("o", 1, "community"), ("o", 2, "organization")], "id string, ord int, kind string")
    assert [tuple(r) for r in ecosystem.merge_profiles(f, k).collect()] == [("o", "city", "Pune", 0.6, "community")]


@pytest.mark.parametrize(("title", "given", "want"), [("GenAI Meetup", "meetup", "ai"), ("Founders night", "meetup", "startup"), ("Hackathon for AI", "meetup", "ai"), ("Hands-on Rust", "meetup", "workshop"), ("Maintainers", "meetup", "meetup"), ("GenAI", "conference", "conference")])
def test_refined_categories(spark, title, given, want):
    df = spark.createDataFrame([(title, None, "Bengaluru", given)], "title string, description string, city string, category string")
    r = ecosystem.refine(df).first()
    assert (r.city, r.category) == ("Bangalore", want)


# --- payloads ---------------------------------------------------------------------------------

NEXT = '<script id="__NEXT_DATA__" type="application/json">{"props":{"events":[{"name":"A","start_at":"x"},{"title":"B","start_date":"y"}]}}</script>'


@pytest.mark.parametrize(
    ("html", "framework", "source", "events"),
    [
        (NEXT, "Next.js", "__NEXT_DATA__", 2),
        ('<script id="__NUXT_DATA__">[{"name":"A","date":"x"}]</script>', "Nuxt", "__NEXT_DATA__", 1),
        ('<script>window.__NUXT__ = {"a":{"name":"x } y","startTime":"1"}}; more({})</script>', "Nuxt", "__NUXT__", 1),
        ('<script>window.__NUXT__=(function(a){return {"startDate":a,"x":1}}(1))</script>', "Nuxt", "embedded", 1),
        ('<script>window.__APOLLO_STATE__ = {"E:1":{"type":"Event"}};</script>', "React (Apollo)", "__APOLLO_STATE__", 1),
        ('<script type="application/json">[{"type":"event"},{"name":"n","datetime":"d"}]</script>', None, "embedded_json", 2),
        ('<script>self.__next_f.push([1,"{\\"startDate\\":1,\\"x\\":[\\"startTime\\"]}"])</script>', "Next.js", "__next_f", 1),
        ('<script type="application/json">{broken</script><div data-astro-x></div>', "Astro", None, 0),
        ("<p>plain</p>", None, None, 0),
        (None, None, None, 0),
        (NEXT + '<script>window.__INITIAL_STATE__ = {"l":[{"name":1,"start":2},{"name":1,"start":2},{"name":1,"start":2}]}</script>', "Next.js", "__INITIAL_STATE__", 3),
    ],
)
def test_payloads(spark, html, framework, source, events):
    r = hydration.analyse(spark.createDataFrame([("https://a.example.com", html)], "url string, html string")).first()
    assert (r.framework, r.source, r.events) == (framework, source, events)


def test_rendered_candidates(spark):
    api = '<script>fetch("/api/events?city=pune")</script>'
    pages = spark.createDataFrame([("a", NEXT), ("b", api), ("c", "<p>x</p>"), ("d", '<script>fetch("/graphql")</script>')], "url string, html string")
    got = {r.url: (r.is_event, r.provider_type, r.confidence, r.usable) for r in hydration.candidates(pages).collect()}
    assert got == {"a": (True, "next_data", 0.508, True), "b": (True, "json_api", 0.3, False), "c": (False, "crawl", 0.0, False), "d": (False, "graphql", 0.2, False)}


# --- rules of the control plane ----------------------------------------------------------------


def test_domain_guard_counts_only_admitted(spark):
    df = spark.createDataFrame([("d", i, NOW + dt.timedelta(seconds=i)) for i in range(6)], "domain string, id int, at timestamp")
    got = [r.admitted for r in admission.admitted(df, ["domain"], F.col("at"), 2, "id").orderBy("id").collect()]
    assert got == [True, False, True, False, True, False]


def test_limiter_spaces_calls(spark):
    df = spark.createDataFrame([("p", i, NOW + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 10])], "p string, id int, at timestamp")
    assert [r.waited for r in admission.spaced(df, ["p"], F.col("at"), 1, "id").orderBy("id").collect()] == [0.0, 1.0, 2.0, 0.0]


def test_cache_expires(spark):
    df = spark.createDataFrame([("k", i, NOW + dt.timedelta(seconds=s)) for i, s in enumerate([0, 9, 10, 15, 30])] + [("j", 9, NOW), ("j", 10, None)], "k string, id int, at timestamp")
    got = {r.id: (r.hit, r.evicts) for r in admission.cached(df, ["k"], F.col("at"), 10, "id").collect()}
    assert got == {0: (False, False), 1: (True, False), 2: (False, True), 3: (True, False), 4: (False, True), 9: (False, False), 10: (False, False)}


def test_health_trend_and_circuit(spark):
    runs = [("p", i, ok, 10.0 * (i + 1), NOW, 0.5, 0.1) for i, ok in enumerate([True, False, True])] + [("q", i, False, 0.0 if i else 8.0, NOW, 0.5, 0.1) for i in range(6)] + [("r", 0, True, 4.0, NOW, 1.0, 0.0)]
    df = spark.createDataFrame(runs, "provider string, run int, ok boolean, latency_ms double, at timestamp, quality double, duplicates double")
    got = {r.provider: (r.success_trend, r.health_status, r.circuit_state, r.failures, r.retries, r.latency_ms) for r in upkeep.health_snapshot(df, F.lit(NOW)).collect()}
    assert got == {"p": ("down", "healthy", "closed", 1, 0, 20.0), "q": ("flat", "failing", "open", 6, 6, 8.0), "r": ("flat", "healthy", "closed", 0, 0, 4.0)}


def test_retry_waits_for_the_cooldown_only(spark):
    seeds = spark.createDataFrame([("new",), ("undecided",), ("given up",), ("verified",)], "seed string")
    v = spark.createDataFrame([("undecided", 5, "insufficient"), *[("given up", i, "insufficient") for i in range(3)], ("verified", 2, "verified")], "seed string, run int, decision string")
    due = lambda run, **kw: {r.seed for r in upkeep.retry_eligible(seeds, v, run, **kw).collect()}
    assert due(5) == {"new", "verified"} and due(6) == {"new", "undecided", "verified"} and due(7, cooldown=3) == {"new", "verified"}


def _stage(spark, **kw):
    row = {"cycle": 1, "ord": 1, "stage": "search", "enabled": True, "paused": False, "cooldown_until": None, "status": "success", "trigger": "both", "manual": False, "last_run": None, "next_run": None, "retries": 0, "retry_max": 3, "priority": 1.0, "backlog": 0, "degraded": False, "budgets": {"search": 100}} | kw
    return spark.createDataFrame([tuple(row.values())], "cycle int, ord int, stage string, enabled boolean, paused boolean, cooldown_until timestamp, status string, trigger string, manual boolean, last_run timestamp, next_run timestamp, retries int, retry_max int, priority double, backlog int, degraded boolean, budgets map<string,int>")


@pytest.mark.parametrize(("left", "kw", "want"), [(0, {}, None), (20, {}, (0.4, 20)), (100, {}, (1.0, 100)), (100, {"budgets": {"search": 100, "ai": 1}}, None), (0, {"budgets": {}}, (1.0, None)), (100, {"paused": True}, None), (100, {"status": "dead_letter"}, None), (100, {"backlog": 4}, (3.0, 100))])
def test_planner_affords_what_it_runs(spark, left, kw, want):
    pool = spark.createDataFrame([(1, "search", 100, 100 - left)], "cycle int, kind string, limit int, consumed int")
    got = [(r.score, (r.granted or {}).get("search")) for r in upkeep.plan_stage(_stage(spark, **kw), pool, F.lit(NOW)).collect()]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_scans_of_one_hot_key(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        n = 300
        df = spark.range(n).select(F.lit("k").alias("p"), F.col("id").alias("o"), (F.col("id") % 7 > 4).alias("ok"), (F.col("id") * 37 % 101).cast("double").alias("v"))
        log = scans.ranged(df, ["p"], ["o"])
        assert [r.position for r in scans.numbered(log, ["p"], ["o"]).orderBy("o").collect()] == list(range(1, n + 1))
        s = scans.streaks(log, ["p"], ["o"], "ok").first()
        oks = [i % 7 > 4 for i in range(n)]
        worst = cur = 0
        for ok in oks:
            cur = 0 if ok else cur + 1
            worst = max(worst, cur)
        assert (s.streak, s.worst) == (cur, worst)
        vs = [i * 37 % 101 for i in range(n)]
        got = [r.m for r in scans.sliding(df, ["p"], ["o"], 17, m=F.max("v")).orderBy("o").collect()]
        assert got == [max(vs[max(0, i - 16) : i + 1]) for i in range(n)]
        q = scans.percentiles(df, "p", "v", [0.0, 0.5, 0.95, 1.0]).first()
        assert (q.p0, q.p50, q.p95, q.p100) == tuple(sorted(vs)[round(x * (n - 1))] for x in (0, 0.5, 0.95, 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
