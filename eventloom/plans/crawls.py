"""Queries over crawls and search runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import confidence as C
from eventloom.operators import expansion
from eventloom.plans.adapters import read
from eventloom.plans.queries import query

# A site of pages: a page for each customer on the host of its nation, a third of them under /events/; each links to the
# customers that its orders' keys lead to.
_URL = "concat('https://nation', {n}, CASE WHEN {c} % 3 = 0 THEN '.com/events/p' ELSE '.com/p' END, {c})"
_HOSTS = 10  # seeds: the first customer of so many nations
_BUDGET, _LINKS = 8, 5
_EVENTS = C.CRAWL["events"]


def _site(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.expr(_URL.format(n="c_nationkey", c="c_custkey")).alias("url"), "c_nationkey")
    n = c.agg(F.count(F.lit(1))).first()[0]
    led = read(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") * 7 % n + 1).alias("to")).join(c.select(F.col("c_custkey").alias("to"), "url"), "to")
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "url"))), lambda x: F.concat(F.lit('<a href="'), x["url"], F.lit('">to</a>'))), "")
    pages = c.join(led.groupBy("o_custkey").agg(html.alias("html")), F.col("c_custkey") == F.col("o_custkey"), "left").select("url", "html")
    seeds = c.filter(F.col("c_nationkey") < _HOSTS).groupBy("c_nationkey").agg(F.min_by("url", "c_custkey").alias("url")).select("url")
    return pages, seeds


# Vertices are numbers here, and urls only order and name them.
_NAME = _URL.format(n="c_nationkey", c="c_custkey")
_SITE = f"""c AS (SELECT c_custkey AS v, c_nationkey AS dom, {_NAME} AS url FROM customer),
raw AS (SELECT o_custkey AS source, c.v AS target, c.dom, min(o_orderkey) AS k FROM orders JOIN c ON c.v = o_orderkey * 7 % (SELECT count(*) FROM customer) + 1 GROUP BY ALL),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS i FROM raw) WHERE i < {_LINKS}),
o0 AS (SELECT min(v) AS v, dom, 1.0::DOUBLE AS priority FROM c WHERE dom < {_HOSTS} GROUP BY dom), u0 AS (SELECT dom, 0::BIGINT AS used FROM o0)"""


def _round(k: int) -> str:
    """Offers, what is fetched, what is spent and what is offered next, of one depth."""
    seen = " UNION ALL ".join(f"SELECT v FROM o{j}" for j in range(k + 1))
    return f""",
r{k} AS (SELECT v, dom, {k} AS depth, priority, CASE WHEN rn + used > {_BUDGET} THEN 'deferred' ELSE 'visited' END AS status FROM (SELECT o.*, row_number() OVER (PARTITION BY o.dom ORDER BY priority DESC, url) AS rn FROM o{k} o JOIN c USING (v)) JOIN u{k} USING (dom)),
u{k + 1} AS (SELECT dom, sum(used)::BIGINT AS used FROM (SELECT dom, used FROM u{k} UNION ALL SELECT dom, count(*) FROM r{k} WHERE status = 'visited' GROUP BY 1) GROUP BY 1),
o{k + 1} AS (SELECT target AS v, dom, CASE WHEN target % 3 = 0 THEN {_EVENTS} ELSE 0.0 END::DOUBLE AS priority FROM (SELECT DISTINCT target, links.dom FROM links JOIN r{k} ON source = r{k}.v AND r{k}.status = 'visited' WHERE links.dom < {_HOSTS}) WHERE target NOT IN ({seen}))"""


_ROUNDS = f"{_SITE}{_round(0)}{_round(1)}{_round(2)}, r AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)"


@query(f"WITH {_ROUNDS} SELECT c.url, concat('nation', c.dom, '.com') AS domain, depth, priority, status FROM r JOIN c ON c.v = r.v")
def q_expand_crawl(spark, d):
    done, _ = expansion.expand(*_site(spark, d), per_domain=_BUDGET, max_links=_LINKS)
    return done


@query(f"""WITH {_ROUNDS}, f AS (SELECT v, dom, depth, priority FROM r WHERE status = 'visited'), led AS (SELECT f.v AS source, f.depth, f.priority, target, links.dom, i FROM f JOIN links ON source = f.v),
n AS (SELECT led.target, arg_min(led.source, (-led.priority, c.url, i)) AS source FROM led JOIN c ON c.v = led.source JOIN r ON r.v = led.target AND r.depth = led.depth + 1 WHERE led.depth < 2 AND led.dom < {_HOSTS} GROUP BY led.target),
owns AS (SELECT dom, v FROM f), refs AS (SELECT DISTINCT source, dom FROM led WHERE depth = 2 OR dom >= {_HOSTS})
SELECT concat('domain:nation', owns.dom, '.com') AS source, 'OWNS' AS type, c.url AS target FROM owns JOIN c ON c.v = owns.v
UNION ALL SELECT s.url, 'LINKS_TO', t.url FROM n JOIN c s ON s.v = n.source JOIN c t ON t.v = n.target UNION ALL SELECT c.url, 'REFERENCES', concat('domain:nation', refs.dom, '.com') FROM refs JOIN c ON c.v = refs.source""")
def q_expand_edges(spark, d):
    _, edges = expansion.expand(*_site(spark, d), per_domain=_BUDGET, max_links=_LINKS)
    return edges


# Searches: an order is a query of its customer, its lines the results; the part is the url, the supplier its domain.
_RESULTS = """SELECT concat('q', CAST(o_custkey % 97 AS {text})) AS query, o_custkey % 97 AS ord, l_linenumber AS rank, concat('https://d', CAST(l_suppkey % 50 AS {text}), '.example.com/e', CAST(l_partkey AS {text})) AS url,
 o_custkey % 97 % 4 = 0 AS hit, o_custkey % 97 % 11 = 5 AS failed, l_discount * 5 AS worth, l_orderkey + l_discount AS line FROM {lines} JOIN {orders} ON o_orderkey = l_orderkey"""
_INBOX = "SELECT concat('https://d', CAST({k} % 50 AS {text}), '.example.com/e', CAST({k} AS {text})) AS url, CAST(0.2 AS double) AS score, 1 AS runs FROM {parts} WHERE p_size < 10"
_KNOWN = "SELECT concat('https://d', CAST({k} % 50 AS {text}), '.example.com/e', CAST({k} AS {text})) AS url FROM {parts} WHERE p_size > 45"


@query(f"""WITH res AS ({_RESULTS.format(text='varchar', lines='lineitem', orders='orders')}), qs AS (SELECT query, min(ord) AS ord, max(hit) AS hit, max(failed) AS failed FROM res GROUP BY query),
ran AS (SELECT *, CASE WHEN ord % 7 = 3 THEN 0 ELSE 1 END AS later FROM qs ORDER BY later, ord, query LIMIT 80), found AS (SELECT res.*, later FROM res JOIN ran USING (query) WHERE NOT ran.failed),
best AS (SELECT url, min(rank) AS rank FROM found GROUP BY url), pick AS (SELECT url, arg_min(worth, (CASE WHEN rank > 0 THEN rank ELSE 1e9 END, later, ord, rank, line)) AS worth FROM found GROUP BY url),
known AS ({_KNOWN.format(k='p_partkey', text='varchar', parts='part')}), box AS ({_INBOX.format(k='p_partkey', text='varchar', parts='part')}),
j AS (SELECT pick.url, worth, known.url IS NOT NULL AS known, box.url IS NOT NULL AS old FROM pick LEFT JOIN known ON known.url = pick.url LEFT JOIN box ON box.url = pick.url)
SELECT * FROM (SELECT count(*) AS queries_executed, count(*) FILTER (WHERE hit) AS cache_hits, count(*) FILTER (WHERE NOT hit AND NOT failed) AS cache_misses, count(*) FILTER (WHERE failed) AS provider_errors FROM ran),
(SELECT count(*) AS results_collected FROM found), (SELECT count(*) AS unique_results, count(*) FILTER (WHERE known) AS skipped_known, count(*) FILTER (WHERE NOT known AND worth < 0.2) AS below_threshold,
 count(*) FILTER (WHERE NOT known AND worth >= 0.2 AND NOT old) AS inserted, count(*) FILTER (WHERE NOT known AND worth >= 0.2 AND old) AS updated FROM j)""")
def q_discovery_run(spark, d):
    lines, orders, parts = (read(spark, d, t) for t in ("lineitem", "orders", "part"))
    results = spark.sql(_RESULTS.format(text="string", lines="{lines}", orders="{orders}"), lines=lines, orders=orders)
    history = spark.sql(_KNOWN.format(k="p_partkey", text="string", parts="{parts}"), parts=parts)
    inbox = spark.sql(_INBOX.format(k="p_partkey", text="string", parts="{parts}"), parts=parts)
    good = results.filter("ord % 7 = 3").select("query")
    _, counted, _ = expansion.discovery_run(results, history, inbox, F.col("worth"), least=0.2, budget=80, productive=good, tie="line")
    return spark.createDataFrame([tuple(counted.values())], ", ".join(f"{k} long" for k in counted))


@query("""WITH m AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages) SELECT kind, count(*) AS n FROM (SELECT DISTINCT page_id, 'github' AS kind, unnest(regexp_extract_all(html, 'https://github\\.com/org-[0-9]+')) AS t FROM (SELECT page_id, concat(html, '<a href="https://github.com/org-', page_id % 40, '/repo">code</a>') AS html FROM m)
 UNION SELECT page_id, 'calendar', '/c.ics' FROM m UNION SELECT page_id, 'telegram', 't.me' FROM m WHERE page_id % 3 = 0) GROUP BY kind""")
def q_page_mentions(spark, d):
    """What pages name besides their links, with a code host's organisation, a calendar and a chat put into them."""
    # Urls repeat and may have fragments, which name no page: each page is its url up to there, and its number.
    bare = F.substring_index("url", "#", 1)
    url = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("page_id="), F.col("page_id").cast("string"))
    p = read(spark, d, "pages").select(url.alias("url"), F.concat(F.coalesce("html", F.lit("")), F.expr("concat('<a href=\"https://github.com/org-', page_id % 40, '/repo\">code</a><a href=\"/c.ics\">dates</a>')"), F.when(F.col("page_id") % 3 == 0, ' <a href="https://t.me/group">chat</a>').otherwise("")).alias("html"))
    return expansion.mentions(p).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
