"""Expansion of a crawl over stored pages, and runs of searches into an inbox."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from eventloom.functions import confidence as C
from eventloom.functions.urls import crawl_url, host, links, registrable_domain
from eventloom.operators.crawl import robots_allowed
from eventloom.staging import staged

# What urls on a page refer to, segments of code hosts that are no organisations, blocked and trusted hosts.
CALENDAR = r"(?i)\.ics(\b|$)|calendar\.google\.com|outlook\.(office|live)\.com|/calendar/ical"
VCS = r"(?i)^https?://(github|gitlab)\.com/([A-Za-z0-9][\w.-]{0,38})"
VCS_STOP = "features about login join pricing marketplace explore sponsors topics search settings notifications orgs apps".split()
BLOG = r"(?i)(medium\.com|substack\.com|wordpress\.com|blogspot\.|blogger\.com)"
REFERENCES = {"notion": (r"(?i)notion\.(site|so)", "host"), "discord": (r"(?i)discord\.(gg|com/invite)/", "url"), "telegram": (r"(?i)^https?://(t\.me|telegram\.me)/", "url"), "blog": (BLOG, "domain")}
BLOCKED = "facebook.com instagram.com twitter.com x.com linkedin.com youtube.com amazon.in flipkart.com bookmyshow.com".split()
TRUSTED = "community.dev gdg.community.dev fossunited.org hasgeek.com lu.ma commudle.com eventbrite.com devfolio.co townscript.com".split()
FEED_LINK = r"""(?is)<link\b(?=[^>]*type=["']application/(?:rss|atom)\+xml)[^>]*\bhref=["']([^"'#]+)"""
#: Links of a page that are followed, and pages of a domain.
MAX_LINKS, MAX_PAGES, MAX_DEPTH = 120, 50, 2


def _resolved(href: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+", 0)
    return crawl_url(F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^[a-zA-Z]+:", 0), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?", 0), href)))


def page_links(pages: DataFrame, most: int | None = MAX_LINKS) -> DataFrame:
    """source, i, target: the links of each page in order, each once, the first `most`."""
    hrefs = F.transform(links(F.coalesce("html", F.lit(""))), lambda h: _resolved(h, F.col("url")))
    every = F.array_distinct(F.filter(hrefs, lambda u: u.isNotNull()))
    few = F.slice(every, 1, most) if most else every
    return pages.select(crawl_url(F.col("url")).alias("source"), F.posexplode(few).alias("i", "target"))


def mentions(pages: DataFrame) -> DataFrame:
    """source, kind, target of the calendars, feeds, code hosts' organisations, chats, notes and blogs that a page names."""
    html = F.coalesce("html", F.lit(""))
    raw = F.transform(F.regexp_extract_all(html, F.lit(r"https?://[^\s\"'<>)\]]+"), F.lit(0)), crawl_url)
    hrefs = F.transform(links(html), lambda h: _resolved(h, F.col("url")))
    every = F.array_distinct(F.filter(F.concat(hrefs, raw), lambda u: u.isNotNull()))
    fed = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(FEED_LINK), F.lit(1)), lambda h: _resolved(h, F.col("url"))))
    src = crawl_url(F.col("url")).alias("source")
    u = F.col("u")
    org = F.when(u.rlike(VCS) & ~F.lower(F.regexp_extract(u, VCS, 2)).isin(*VCS_STOP), F.concat(F.lit("https://"), F.lower(F.regexp_extract(u, VCS, 1)), F.lit(".com/"), F.regexp_extract(u, VCS, 2)))
    at = {"host": host(u), "url": u, "domain": registrable_domain(u)}
    found = F.array(
        F.when(u.rlike(CALENDAR), F.struct(F.lit("calendar").alias("kind"), u.alias("target"))), F.when(org.isNotNull(), F.struct(F.lower(F.regexp_extract(u, VCS, 1)).alias("kind"), org.alias("target"))),
        *[F.when(at[where].rlike(p), F.struct(F.lit(k).alias("kind"), u.alias("target"))) for k, (p, where) in REFERENCES.items()],
    )
    named = pages.select(src, F.explode(every).alias("u")).select("source", F.explode(F.array_compact(found)).alias("x")).select("source", "x.*")
    return named.union(pages.select(src, F.lit("feed").alias("kind"), F.explode(F.filter(fed, lambda x: x.isNotNull())).alias("target"))).distinct()


def expand(pages: DataFrame, seeds: DataFrame, *, rules: DataFrame | None = None, crawled: DataFrame | None = None, trusted: list[str] = TRUSTED, blocked: list[str] = BLOCKED, max_depth: int = MAX_DEPTH, per_domain: int = MAX_PAGES, max_links: int = MAX_LINKS) -> tuple[DataFrame, DataFrame]:
    """(url, domain, depth, priority, status) and (source, type, target) of a crawl from seeds over stored pages.

    Rounds go by depth. In a round, the pages of a domain are fetched in order of priority and url while its budget lasts; what
    is over is deferred. Skipped without cost to the budget: what `crawled` names (deferred) and what the rules forbid (blocked).
    A page that is not stored has failed, and costs. Of a fetched page the first links count: into a seed's or a trusted domain they
    are offered to the next round, once; a page's domain is referred to where they lead elsewhere, are blocked or too deep.
    Budgets are carried as one row a domain; what was seen is kept in a table a round, partitioned by the url."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = staged(pages.withColumn("at", crawl_url(F.col("url"))).filter("at is not null").groupBy("at").agg(F.first("html").alias("html"), F.first("url").alias("url")), "expand-pages")
    out_links = staged(page_links(stored.select("url", "html"), max_links).repartition(parts, "source"), "expand-links")
    first = seeds.select(crawl_url(F.col("url")).alias("url")).filter("url is not null").distinct().withColumn("domain", registrable_domain(F.col("url")))
    home = staged(first.select("domain").distinct(), "expand-home")
    offered = first.select("url", "domain", F.lit(0).alias("depth"), F.lit(1.0).alias("priority"))
    seen, used, done, edges = None, None, None, None
    for depth in range(max_depth + 1):
        offered = staged(offered.repartition(parts, "url"), "expand-offered")
        seen = offered.select("url") if seen is None else seen.union(offered.select("url"))
        judged = offered.withColumn("skip", F.lit(None).cast("string"))
        if crawled is not None:
            judged = judged.join(crawled.select(crawl_url(F.col("url")).alias("url"), F.lit(True).alias("_again")).distinct(), "url", "left").withColumn("skip", F.when(F.col("_again"), "deferred")).drop("_again")
        if rules is not None:
            asked = judged.filter("skip is null").select("url", "domain", F.regexp_replace("url", r"^[a-z]+://[^/]+", "").alias("path"))
            judged = judged.join(robots_allowed(asked, rules), "url", "left").withColumn("skip", F.coalesce("skip", F.when(~F.col("allowed"), "blocked"))).drop("allowed")
        there = stored.select(F.col("at").alias("url"), F.lit(True).alias("there"))
        order = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("priority"), "url"))
        open_ = judged.filter("skip is null").withColumn("rn", order)
        if used is not None:
            open_ = open_.join(used, "domain", "left").withColumn("rn", F.col("rn") + F.coalesce("used", F.lit(0))).drop("used")
        open_ = open_.join(there, "url", "left").withColumn("status", F.when(F.col("rn") > per_domain, "deferred").when(F.col("there"), "visited").otherwise("failed"))
        cols = ["url", "domain", "depth", "priority", "status"]
        now = staged(open_.select(*cols).union(judged.filter("skip is not null").withColumnRenamed("skip", "status").select(*cols)), "expand-round")
        done = now if done is None else done.union(now)
        spent = now.filter("status in ('visited', 'failed')").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
        used = spent.withColumnRenamed("n", "used") if used is None else used.join(spent, "domain", "full_outer").select("domain", (F.coalesce("used", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("used"))
        used = staged(used, "expand-used")
        fetched = now.filter("status = 'visited'").select("url", F.col("domain").alias("own"), "priority")
        led = out_links.join(fetched, F.col("source") == F.col("url")).drop("url").withColumn("domain", registrable_domain(F.col("target")))
        inside = led.join(home.withColumn("_home", F.lit(True)), "domain", "left")
        into = F.when(F.col("domain").isin(*blocked), "blocked").when(F.lit(depth + 1 > max_depth), "too_deep").when(F.col("_home") | F.col("domain").isin(*trusted), "offered").otherwise("elsewhere")
        led = staged(inside.withColumn("into", into), "expand-led")
        # The first offer of a url is that of the first page to be fetched.
        new = led.filter("into = 'offered'").join(seen, F.col("target") == seen["url"], "left_anti")
        one = new.groupBy("target", "domain").agg(F.min_by("source", F.struct((-F.col("priority")).alias("p"), "source", "i")).alias("source"))
        one = staged(one, "expand-new")
        round_edges = fetched.select(F.concat(F.lit("domain:"), "own").alias("source"), F.lit("OWNS").alias("type"), F.col("url").alias("target"))
        round_edges = round_edges.union(one.select("source", F.lit("LINKS_TO"), "target")).union(led.filter("into <> 'offered'").select("source", F.lit("REFERENCES"), F.concat(F.lit("domain:"), "domain")))
        edges = round_edges if edges is None else edges.union(round_edges)
        offered = one.select(F.col("target").alias("url"), "domain", F.lit(depth + 1).alias("depth"), C.crawl_priority(F.col("target"), F.lit(""), F.col("domain").isin(*trusted), F.lit(False), F.lit(0.0)).alias("priority"))
    named = mentions(stored.join(done.filter("status = 'visited'").select(F.col("url").alias("at")), "at", "left_semi").select("url", "html"))
    kind = F.when(F.col("kind") == "calendar", "CONTAINS_CALENDAR").when(F.col("kind") == "feed", "CONTAINS_FEED").otherwise("REFERENCES")
    return done, edges.union(named.select("source", kind.alias("type"), F.concat("kind", F.lit(":"), "target"))).distinct()


COUNTERS = ["results_collected", "unique_results", "skipped_known", "below_threshold", "inserted", "updated"]


def discovery_run(results: DataFrame, history: DataFrame, inbox: DataFrame, score: Column, *, least: float = 0.3, budget: int | None = None, productive: DataFrame | None = None, tie: str = "rank") -> tuple[DataFrame, dict[str, int], DataFrame]:
    """(inbox after the run, its counters, the queries in the order in which they ran) of searches.

    results: query, ord (of the query), rank, url, hit (from a cache), failed, and what score needs. Queries that brought
    something before (productive: query) go first, and as many as the budget allows. Of a url the best rank counts, on ties that of the
    first query, then the smallest by the column tie; known ones (history: url) are skipped, weak ones dropped, the rest merged into the inbox: url, score, runs.

    Everything is counted while it passes: results are read once, and the counters are observed beside the write."""
    queries = results.groupBy("query").agg(F.min("ord").alias("ord"), F.max("hit").alias("hit"), F.max("failed").alias("failed"))
    good = productive.select("query").distinct().withColumn("_good", F.lit(0)) if productive is not None else queries.select("query", F.lit(1).alias("_good")).limit(0)
    order = [F.coalesce("_good", F.lit(1)), F.col("ord"), F.col("query")]
    ran = queries.join(good, "query", "left").orderBy(*order)
    ran = staged((ran.limit(budget) if budget is not None else ran).select("query", "ord", F.coalesce("_good", F.lit(1)).alias("later"), "hit", "failed"), "run-queries")
    asked = ran.filter("not failed").select("query", "ord", "later")
    all_, one, kept = Observation("all"), Observation("unique"), Observation("kept")
    found = results.drop("ord", "hit", "failed").filter("url is not null").join(asked, "query").observe(all_, F.count(F.lit(1)).alias("results_collected"))
    known = history.select(F.col("url").alias("_known")).distinct()
    best = found.groupBy("url").agg(F.min_by(F.struct(*[c for c in found.columns if c != "url"]), F.struct(F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.lit(math.inf)).alias("r"), "later", "ord", "rank", tie)).alias("x")).select("url", "x.*")
    judged = best.join(known, F.col("url") == F.col("_known"), "left").withColumn("score", score)
    weak = F.col("score") < least
    judged = judged.observe(one, F.count(F.lit(1)).alias("unique_results"), F.count_if(F.col("_known").isNotNull()).alias("skipped_known"), F.count_if(F.col("_known").isNull() & weak).alias("below_threshold"))
    new = judged.filter(F.col("_known").isNull() & ~weak).select("url", F.col("score").alias("_score"), F.lit(True).alias("_new"))
    merged = inbox.withColumn("_old", F.lit(True)).join(new, "url", "full_outer").observe(kept, F.count_if(F.col("_new") & F.col("_old").isNull()).alias("inserted"), F.count_if(F.col("_new") & F.col("_old")).alias("updated"))
    after = staged(merged.select("url", F.coalesce(F.greatest("score", "_score"), "score", "_score").alias("score"), (F.coalesce("runs", F.lit(0)) + F.coalesce("_new", F.lit(False)).cast("int")).cast("int").alias("runs")), "run-inbox")
    counted: dict[str, int] = {}
    for x in (all_, one, kept):
        counted |= {k: int(v or 0) for k, v in x.get.items()}
    q = ran.agg(F.count(F.lit(1)).alias("queries_executed"), F.count_if("hit").alias("cache_hits"), F.count_if(~F.col("hit") & ~F.col("failed")).alias("cache_misses"), F.count_if("failed").alias("provider_errors")).first()
    return after, {**q.asDict(), **{k: counted[k] for k in COUNTERS}}, ran
