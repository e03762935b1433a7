"""Expansion crawls and discovery runs against sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import expansion

A = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)


def test_mentions(spark):
    html = A("/cal/events.ics", "https://github.com/rust-lang/rust", "https://github.com/about", "https://discord.gg/abc", "https://t.me/rust", "https://foo.medium.com/x", "https://www.notion.so/p", "rel/page") + '<link rel="alternate" type="application/rss+xml" href="/feed.xml"> see https://gitlab.com/Team/x and https://calendar.google.com/c?x=1'
    got = {(r.kind, r.target) for r in expansion.mentions(spark.createDataFrame([("https://a.example.com/d/p", html)], "url string, html string")).collect()}
    assert got == {
        ("calendar", "https://a.example.com/cal/events.ics"), ("calendar", "https://calendar.google.com/c?x=1"), ("github", "https://github.com/rust-lang"), ("gitlab", "https://gitlab.com/Team"), ("discord", "https://discord.gg/abc"),
        ("telegram", "https://t.me/rust"), ("blog", "https://foo.medium.com/x"), ("notion", "https://www.notion.so/p"), ("feed", "https://a.example.com/feed.xml"),
    }


def sequential(pages, seeds, budget, most, skip, ruled):
    """The same crawl with a list for a frontier. pages: url -> links, all in normal form."""
    dom = lambda u: ".".join(u.split("/")[2].split(".")[-2:])
    home, seen, used, status, edges = {dom(s) for s in seeds}, set(seeds), {}, {}, set()
    frontier = [(1.0, s) for s in seeds]
    for at in range(3):
        offers: dict = {}
        for _, u in sorted(frontier, key=lambda x: (-x[0], x[1])):
            d = dom(u)
            if u == skip:
                status[u] = "deferred"
            elif u in ruled:
                status[u] = "blocked"
            elif used.get(d, 0) >= budget:
                status[u] = "deferred"
            else:
                used[d] = used.get(d, 0) + 1
                status[u] = "visited" if u in pages else "failed"
            if status[u] != "visited":
                continue
            edges.add((f"domain:{d}", "OWNS", u))
            for link in list(dict.fromkeys(pages[u]))[:most]:
                t = dom(link)
                if t in expansion.BLOCKED or at == 2 or (t not in home and t not in expansion.TRUSTED):
                    edges.add((u, "REFERENCES", f"domain:{t}"))
                elif link not in seen:
                    seen.add(link)
                    offers[link] = None
                    edges.add((u, "LINKS_TO", link))
        frontier = [(0.10 * (dom(x) in expansion.TRUSTED), x) for x in offers]
    return status, edges


@pytest.mark.parametrize(("budget", "most"), [(50, 120), (3, 120), (3, 2), (1, 1)])
def test_crawl_equals_a_sequential_frontier(spark, budget, most):
    rng = random.Random(budget * 7 + most)
    hosts = ["a.example.com", "b.example.com", "x.sample.org", "lu.ma", "facebook.com", "far.away.net"]
    urls = [f"https://{rng.choice(hosts)}/p{i}" for i in range(60)]
    pages = {u: [rng.choice(urls) for _ in range(rng.randint(0, 6))] for u in urls if rng.random() < 0.8}
    seeds = [u for u in urls if "example.com" in u][:3] + ["https://x.sample.org/gone"]
    df = spark.createDataFrame([(u, A(*ls)) for u, ls in pages.items()], "url string, html string")
    rules = spark.createDataFrame([("example.com", False, "/p1")], "domain string, allow boolean, prefix string")
    done, edges = expansion.expand(df, spark.createDataFrame([(s,) for s in seeds], "url string"), rules=rules, crawled=spark.createDataFrame([(urls[5],)], "url string"), per_domain=budget, max_links=most)
    status, links = sequential(pages, seeds, budget, most, urls[5], {u for u in urls if "example.com" in u and "/p1" in u})
    assert {r.url: r.status for r in done.collect()} == status
    assert {tuple(r) for r in edges.collect()} == links


def test_discovery_run_counts(spark):
    rows = [("q1", 0, 1, "u1", False, False, 0.9), ("q1", 0, 2, "u2", False, False, 0.1), ("q2", 1, 1, "u1", True, False, 0.2), ("q2", 1, 0, "u3", True, False, 0.9), ("q3", 2, 1, "u4", False, True, 0.9), ("q4", 3, 1, "known", False, False, 0.9), ("q5", 4, 3, "old", False, False, 0.5), ("q6", 5, 1, "never", False, False, 0.9)]
    results = spark.createDataFrame(rows, "query string, ord int, rank int, url string, hit boolean, failed boolean, worth double")
    history = spark.createDataFrame([("known",)], "url string")
    inbox = spark.createDataFrame([("old", 0.4, 3), ("other", 0.7, 1)], "url string, score double, runs int")
    productive = spark.createDataFrame([("q5",)], "query string")
    after, counters, ran = expansion.discovery_run(results, history, inbox, F.col("worth"), budget=5, productive=productive)
    assert [r["query"] for r in ran.orderBy("later", "ord").collect()] == ["q5", "q1", "q2", "q3", "q4"]
    assert {r.url: (r.score, r.runs) for r in after.collect()} == {"old": (0.5, 4), "other": (0.7, 1), "u1": (0.9, 1), "u3": (0.9, 1)}
    assert counters == {"queries_executed": 5, "cache_hits": 1, "cache_misses": 3, "provider_errors": 1, "results_collected": 6, "unique_results": 5, "skipped_known": 1, "below_threshold": 1, "inserted": 2, "updated": 1}
