"""Queries over query texts, catalog access, small stores and the control plane, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import confidence as C
from eventloom.functions import parse as P
from eventloom.functions import scoring as S
from eventloom.functions import text as T
from eventloom.operators import admission, graph, upkeep
from eventloom.operators.predicates import Query, where
from eventloom.plans.adapters import CATALOG_SQL, LOG_SQL, NOW, TODAY, catalog, log, read
from eventloom.plans.pages import _GRAPH, _joined, _uniq
from eventloom.plans.queries import _CITY_SQL, _COMPLETE, _END, _PROFILE, _now, _today, query
from eventloom.operators import users

# --- texts of queries --------------------------------------------------------------------------

_SAID = ["Free AI hackathons in New Delhi this weekend", "rust + c# meet ups near me", "upcoming conf on machine learning by PyData, Bengaluru", "startup summits", "", "show me free workshops for Go at bombay", "LLMs & gen AI webinar events in Pune", "kubernetes kubernetes docker"]
_PICK = "{open}{texts}{close}[c_custkey % 8 + {first}]"
_SAID_SQL = "concat(" + _PICK.format(open="[", texts=", ".join(repr(x) for x in _SAID), close="]", first=1) + ", ' ', c_name)"
_SAID_SPARK = "concat(" + _PICK.format(open="array(", texts=", ".join(repr(x) for x in _SAID), close=")", first=0) + ", ' ', c_name)"
_ALIASES = sorted(P.QUERY_CITIES, key=len, reverse=True)
_PARSED = f"""said AS (SELECT c_custkey AS id, trim(lower({_SAID_SQL})) AS low FROM customer),
tok AS (SELECT *, list_filter(regexp_extract_all(low, '[a-z0-9+#]+'), lambda t: length(t) > 1 AND t NOT IN ({", ".join(repr(w) for w in P.NO_KEYWORDS)})) AS ts FROM said),
parsed AS (SELECT id, {_uniq("ts")} AS keywords, CASE {" ".join(f"WHEN regexp_matches(low, '(^|[^a-z0-9_]){a}($|[^a-z0-9_])') THEN '{P.QUERY_CITIES[a]}'" for a in _ALIASES)} END AS city,
 list_filter([{", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{c}' END" for c, p in P.TRIGGERS.items())}], lambda x: x IS NOT NULL) AS categories, regexp_matches(low, '\\bfree\\b') AS free_only FROM tok)"""


def _parsed(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.parse_query(F.expr(_SAID_SPARK)).alias("q"))


@query(f"WITH {_PARSED} SELECT id, {_joined('keywords')} AS keywords, city, {_joined('categories')} AS categories, free_only FROM parsed")
def q_parse_query(spark, d):
    return _parsed(spark, d).select("id", F.array_join("q.keywords", "|").alias("keywords"), "q.city", F.array_join("q.categories", "|").alias("categories"), "q.free_only")


_GOOD = '{"keywords":["x"],"city":"Goa","categories":["ai"],"free_only":true}'
_BAD = '{"keywords":["x"],"categories":["circus"],"free_only":true}'


@query(f"WITH {_PARSED} SELECT id, CASE WHEN id % 4 IN (1, 2) THEN 'Goa' ELSE city END AS city, CASE WHEN id % 4 IN (1, 2) THEN 'ai' ELSE {_joined('categories')} END AS categories FROM parsed")
def q_parse_fallback(spark, d):
    answers = F.expr(f"case c_custkey % 4 when 0 then array('no json', '{_BAD}') when 1 then array('{_GOOD}') when 2 then array('{_BAD}', '{_GOOD}') end")
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), P.parse_with_model(F.expr(_SAID_SPARK), answers).alias("q"))
    return q.select("id", "q.city", F.array_join("q.categories", "|").alias("categories"))


_JSON = "concat('[', array_to_string(list_transform(list_sort({0}), lambda x: concat('\"', x, '\"')), ','), ']')"


_NO_NUMBERS = "list_filter(keywords, lambda x: NOT regexp_matches(x, '[0-9]'))"


@query(f"""WITH {_PARSED} SELECT concat('{{"categories":', {_JSON.format('categories')}, ',"city":"', coalesce(city, ''), '","free_only":', free_only, ',"keywords":', {_JSON.format(_NO_NUMBERS)}, '}}') AS key, count(*) AS n FROM parsed GROUP BY 1""")
def q_cache_key(spark, d):
    plain = F.filter("q.keywords", lambda x: ~x.rlike("[0-9]"))  # the customers' numbers would make every key its own
    q = _parsed(spark, d).select(F.struct(plain.alias("keywords"), F.col("q.city").alias("city"), F.reverse("q.categories").alias("categories"), F.col("q.free_only").alias("free_only")).alias("q"))
    return q.groupBy(P.cache_key(F.col("q")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{CATALOG_SQL}, {_PARSED}, c AS (SELECT city AS wanted FROM parsed WHERE id = 2) SELECT key FROM catalog, c WHERE status = 'active' AND {_END} >= date '{TODAY}' AND lower({_CITY_SQL}) = lower(wanted)")
def q_query_criteria(spark, d):
    # the parse of one text, as a conjunction over active and upcoming records
    r = _parsed(spark, d).filter("id = 2").first()
    c = catalog(spark, d).withColumn("city", T.normalize_city(F.col("city")))
    return c.filter(where(Query(city=r.q.city), upcoming=TODAY)).select("key")


_MARKED = "concat(n_name, ' ', {open}'pycon at the college', 'Acme Inc. careers', 'open source user group', 'govt. hackathon', 'nothing here'{close}[n_nationkey % 5 + {first}])"
_RULES = ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {{'confidence': {c}::DOUBLE, 'label': '{k}'}} END" for k, (p, c) in P.CLASSES.items())


@query(f"""WITH t AS (SELECT n_nationkey AS id, lower({_MARKED.format(open='[', close=']', first=1)}) AS low FROM nation), l AS (SELECT id, unnest(list_filter([{{'confidence': CASE WHEN id % 3 > 0 THEN 0.5 + (id % 3) * 0.2 ELSE 0.6 END::DOUBLE, 'label': CASE WHEN id % 3 > 0 THEN 'tech' ELSE 'non_tech' END}}, {_RULES}], lambda x: x IS NOT NULL)) AS x FROM t)
SELECT id, string_agg(x.label, '|' ORDER BY x.confidence DESC, x.label) AS labels FROM l GROUP BY id""")
def q_source_classes(spark, d):
    n = read(spark, d, "nation")
    found = P.source_classes(F.expr(_MARKED.format(open="array(", close=")", first=0)), F.slice(F.array(F.lit("Python"), F.lit("Rust")), F.lit(1), (F.col("n_nationkey") % 3).cast("int")))
    return n.select(F.col("n_nationkey").alias("id"), F.array_join(F.transform(found, lambda x: x["label"]), "|").alias("labels"))


# --- the catalog and small stores ------------------------------------------------------------------


@query(f"{CATALOG_SQL} SELECT key, (row_number() OVER (ORDER BY key) - 1) // 500 AS batch FROM catalog")
def q_scan_batches(spark, d):
    return upkeep.scan(catalog(spark, d), 500).select("key", "batch")


_WANTED = "concat('x.example.com/e', lpad(cast({0} * 7919 % 3000 AS {1}), 9, '0'))"


@query(f"{CATALOG_SQL} SELECT n_nationkey AS ord, key, title FROM nation JOIN catalog ON key = {_WANTED.format('n_nationkey', 'varchar')}")
def q_multi_get(spark, d):
    keys = read(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.expr(_WANTED.format("n_nationkey", "string")).alias("key"))
    return upkeep.get_many(catalog(spark, d), keys).select("ord", "key", "title")


@query(f"{CATALOG_SQL} SELECT key, title FROM catalog WHERE {_END} >= date '{TODAY}' AND regexp_matches(title, '(?i)^the|and$')")
def q_title_regex(spark, d):
    return catalog(spark, d).filter((F.coalesce("end_date", "start_date") >= _today()) & F.col("title").rlike("(?i)^the|and$")).select("key", "title")


_INBOX = """old AS (SELECT c_custkey AS key, c_name AS url, c_custkey % 9 AS first_seen, c_custkey % 9 AS last_seen, 1 + c_custkey % 3 AS version, CASE c_custkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'new' END AS status FROM customer),
new AS (SELECT s_suppkey * 11 AS key, s_name AS url, 50 AS first_seen, 60 AS last_seen, 1 AS version, 'new' AS status FROM supplier)"""


@query(f"WITH {_INBOX} SELECT coalesce(o.key, n.key) AS key, coalesce(n.url, o.url) AS url, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen, CASE WHEN o.key IS NOT NULL AND n.key IS NOT NULL THEN o.version + 1 ELSE coalesce(o.version, 1) END AS version, CASE WHEN o.status <> 'new' THEN o.status ELSE coalesce(n.status, o.status) END AS status FROM old o FULL JOIN new n USING (key)")
def q_inbox_upsert(spark, d):
    old = read(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS url", "c_custkey % 9 AS first_seen", "c_custkey % 9 AS last_seen", "1 + c_custkey % 3 AS version", "CASE c_custkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'new' END AS status")
    new = read(spark, d, "supplier").selectExpr("s_suppkey * 11 AS key", "s_name AS url", "50L AS first_seen", "60L AS last_seen", "1L AS version", "'new' AS status")
    return upkeep.inbox_upsert(old, new)


@query("""WITH a AS (SELECT page_id % 50 AS page, page_id % 3 AS type, page_id % 20 AS url, 0.5 + page_id % 7 / 20.0::DOUBLE AS confidence, 0 AS r FROM pages), b AS (SELECT page_id % 60 AS page, page_id % 4 AS type, page_id % 20 AS url, 0.9::DOUBLE AS confidence, 1 AS r FROM pages)
SELECT page, type, url, confidence FROM (SELECT *, row_number() OVER (PARTITION BY page, type, url ORDER BY r, confidence DESC) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE rn = 1""")
def q_merge_detections(spark, d):
    p = read(spark, d, "pages")
    one = p.selectExpr("page_id % 50 AS page", "page_id % 3 AS type", "page_id % 20 AS url", "0.5D + page_id % 7 / 20.0D AS confidence")
    two = p.selectExpr("page_id % 60 AS page", "page_id % 4 AS type", "page_id % 20 AS url", "0.9D AS confidence")
    return upkeep.merge_detections(one, two)


@query("""WITH f AS (SELECT o_custkey AS id, o_orderpriority AS field, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS value, o_orderkey % 11 / 10.0::DOUBLE AS confidence, o_orderkey AS ord FROM orders)
SELECT id, field, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY confidence DESC, ord) AS rn FROM f WHERE value IS NOT NULL) WHERE rn = 1""")
def q_profile_merge(spark, d):
    f = read(spark, d, "orders").selectExpr("o_custkey AS id", "o_orderpriority AS field", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS value", "o_orderkey % 11 / 10.0D AS confidence", "o_orderkey AS ord")
    return upkeep.merge_profile_fields(f)


@query(f"{CATALOG_SQL}, {LOG_SQL} SELECT user_id, count(*) AS saved FROM (SELECT DISTINCT user_id, event_key FROM log WHERE type IN ('click', 'view')) GROUP BY 1")
def q_saved_union(spark, d):
    # two collections of a user, as one set
    x = log(spark, d)
    both = x.filter("type = 'click'").select("user_id", "event_key").union(x.filter("type = 'view'").select("user_id", "event_key")).distinct()
    return both.groupBy("user_id").agg(F.count(F.lit(1)).alias("saved"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY 1, 2)
SELECT doc_id, sha256(string_agg(x, ' ' ORDER BY i)) AS words, count(*) AS n FROM f GROUP BY 1""")
def q_stable_distinct(spark, d):
    """The distinct words of whole texts, in order of their first places."""
    w = F.array_distinct(F.split("text", " ", -1))
    return read(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.array_join(w, " ").cast("binary"), 256).alias("words"), F.size(w).cast("long").alias("n"))


@query("SELECT word, ord FROM (SELECT concat('q', n_nationkey, ' ', n_name) AS word, n_nationkey AS ord FROM nation) WHERE ord NOT IN (3, 7) ORDER BY CASE WHEN contains(lower(word), 'an') OR contains(lower(word), 'q1') THEN 0 ELSE 1 END, ord LIMIT 10")
def q_prioritized_queries(spark, d):
    q = read(spark, d, "nation").selectExpr("concat('q', n_nationkey, ' ', n_name) AS query", "n_nationkey AS ord")
    return upkeep.prioritized(q, q.filter("ord in (3, 7)"), ["AN", "q1"]).limit(10).select(F.col("query").alias("word"), "ord")


@query(f"{CATALOG_SQL} SELECT key, epoch_us(timestamp '{NOW}') - epoch_us(first_seen_at) <= 7 * 86400000000 AS recently_added, version > 1 AND epoch_us(timestamp '{NOW}') - epoch_us(last_seen_at) <= 7 * 86400000000 AS recently_updated, start_date - date '{TODAY}' BETWEEN 0 AND 14 AS trending_soon, {_END} - date '{TODAY}' BETWEEN 0 AND 7 AS ending_soon FROM catalog")
def q_freshness_flags(spark, d):
    return catalog(spark, d).select("key", *[c.alias(n) for n, c in P.freshness_flags(_now()).items()])


@query(f"""{CATALOG_SQL}, old AS (SELECT * FROM catalog WHERE doc_id % 7 > 0 OR doc_id % 11 = 0), new AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE content_hash END AS content_hash) FROM catalog WHERE doc_id % 11 > 0)
SELECT CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n FROM old o FULL JOIN new n USING (key) GROUP BY 1""")
def q_change_counts(spark, d):
    # Two snapshots that together hold the whole catalog (A06): some records are only in one of them.
    c = catalog(spark, d)
    old, new = c.filter("doc_id % 7 > 0 or doc_id % 11 = 0").alias("o"), c.filter("doc_id % 11 > 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("content_hash"))).alias("n")
    change = F.when(F.col("o.key").isNull(), "added").when(F.col("n.key").isNull(), "removed").when(F.col("o.content_hash") != F.col("n.content_hash"), "updated").otherwise("unchanged")
    return old.join(new, F.col("o.key") == F.col("n.key"), "full").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{CATALOG_SQL}, {_GRAPH} SELECT type, count(*) AS n FROM v GROUP BY type")
def q_graph_counts(spark, d):
    v, _ = graph.build(catalog(spark, d))
    return v.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{CATALOG_SQL}, {_GRAPH} SELECT DISTINCT concat('event:', key) AS source, id AS target FROM mm WHERE type = 'city' AND id IN ('city:pune', 'city:delhi')""")
def q_graph_view(spark, d):
    v, e = graph.build(catalog(spark, d), ("IN_CITY",))
    events = e.select(F.col("source").alias("id")).distinct().withColumn("type", F.lit("event"))
    some = v.filter("id in ('city:pune', 'city:delhi')").select("id", "type").unionByName(events)
    return graph.subgraph(some, e, ["city", "event"], ["IN_CITY"])[1].select("source", "target")


@query("SELECT s_suppkey, concat('city:', s_nationkey % 3, ' -[HOSTS]-> organizer:', s_name, CASE WHEN s_suppkey % 2 = 0 THEN concat(' -[RUNS]-> series:', s_suppkey) ELSE '' END) AS path FROM supplier")
def q_render_path(spark, d):
    two = lambda a, b, c: F.when(F.col("s_suppkey") % 2 == 0, F.array(a, b, c)).otherwise(F.array(a, b))
    relations = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("HOSTS"), F.lit("RUNS"))).otherwise(F.array(F.lit("HOSTS")))
    path = P.render_path(two(F.lit("city"), F.lit("organizer"), F.lit("series")), relations, two((F.col("s_nationkey") % 3).cast("string"), F.col("s_name"), F.col("s_suppkey").cast("string")))
    return read(spark, d, "supplier").select("s_suppkey", path.alias("path"))


@query(r"SELECT s_suppkey, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM supplier")
def q_slugs(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", P.slug(F.col("s_name")).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def q_ics_dates(spark, d):
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(F.col("o_orderkey") % 3 == 0, stamp).when(F.col("o_orderkey") % 3 == 1, F.concat(stamp, F.lit("T101500Z"))).otherwise("soon")
    return read(spark, d, "orders").select("o_orderkey", P.ics_date(text).alias("day"))


@query("SELECT page_id, substr(sha1(url), 1, 16) AS short, sha256(concat_ws(chr(31), url, html)) AS full FROM pages".replace(" AS full", ' AS "whole"'))
def q_hashes(spark, d):
    return read(spark, d, "pages").select("page_id", F.substring(F.sha1("url"), 1, 16).alias("short"), F.sha2(F.concat_ws("\x1f", "url", "html").cast("binary"), 256).alias("whole"))


@query("SELECT page_id, " + _joined(_uniq("g")) + r" AS names FROM (SELECT page_id, regexp_extract_all(concat(html, '<script>window.__A', page_id % 3, '__ = {}; window.b=1; window.b = 2; window.c == 3</script>'), 'window\.([A-Za-z_$][\w$]*)\s*=', 1) AS g FROM pages)")
def q_window_globals(spark, d):
    html = F.concat("html", F.lit("<script>window.__A"), (F.col("page_id") % 3).cast("string"), F.lit("__ = {}; window.b=1; window.b = 2; window.c == 3</script>"))
    return read(spark, d, "pages").select("page_id", F.array_join(P.window_globals(html), "|").alias("names"))


_CODE = """regexp_replace(concat(coalesce(html, ''), '<script>fetch("/api/other"); fetch("https://x.example.com/api/events"); var u = "/v1/list"; open("GET", "/rpc")</script>'), '(?is)<script[^>]*application/(?:ld\\+)?json[^>]*>.*?</script>', ' ', 'g')"""
_CALLS = [r"fetch\(\s*[`''\"]([^`''\"]+)[`''\"]", r"axios(?:\.(?:get|post|put|request))?\(\s*[`''\"]([^`''\"]+)[`''\"]", r"(?i)\.open\(\s*[`''\"](?:GET|POST)[`''\"]\s*,\s*[`''\"]([^`''\"]+)[`''\"]", r"(?i)[`''\"]([^`''\"]*/(?:graphql|gql)[^`''\"]*)[`''\"]", r"(?i)[`''\"](/(?:api|v\d+)/[^`''\"\s]*)[`''\"]"]


@query(f"""WITH p AS (SELECT page_id, {_CODE} AS code FROM pages), u AS (SELECT DISTINCT page_id, unnest(flatten([{", ".join(f"regexp_extract_all(code, '{c}', 1)" for c in _CALLS)}])) AS url FROM p),
r AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY contains(lower(url), 'event') DESC, encode(url)) AS rank FROM u) SELECT page_id, url, rank FROM r WHERE rank <= 25""")
def q_endpoint_ranking(spark, d):
    """The endpoints that scripts of every page call, with some more put into each, event-like ones first."""
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<script>fetch("/api/other"); fetch("https://x.example.com/api/events"); var u = "/v1/list"; open("GET", "/rpc")</script>'))
    return read(spark, d, "pages").select("page_id", F.posexplode(C.endpoints(html)).alias("at", "url")).select("page_id", "url", (F.col("at") + 1).alias("rank"))


@query("SELECT doc_id, left(text, 200) AS snippet, least(1.0, n_chars / 1000.0::DOUBLE) AS c FROM documents WHERE text IS NOT NULL".replace("least(1.0, n_chars / 1000.0::DOUBLE)", "round_even(least(1.0::DOUBLE, n_chars / 1000.0::DOUBLE), 3)"))
def q_provenance(spark, d):
    p = P.provenance(F.col("doc_id"), F.col("text"), F.col("n_chars") / 1000, "rule")
    return read(spark, d, "documents").filter("text is not null").select("doc_id", p.alias("p")).select("doc_id", "p.snippet", F.col("p.confidence").alias("c"))


# --- users -------------------------------------------------------------------------------------------


@query(f"{_PROFILE}, w AS (SELECT user_id, coalesce(sum(weight) FILTER (WHERE feature = 'budget:free'), 0) AS f, coalesce(sum(weight) FILTER (WHERE feature = 'budget:paid'), 0) AS p, coalesce(sum(weight) FILTER (WHERE feature = 'format:online'), 0) AS n, coalesce(sum(weight) FILTER (WHERE feature = 'format:offline'), 0) AS o FROM prof GROUP BY 1) SELECT user_id, CASE WHEN f > p AND f > 0 THEN 'free' WHEN p > f AND p > 0 THEN 'paid' ELSE 'any' END AS budget, CASE WHEN n > o AND n > 0 THEN 'online' WHEN o > n AND o > 0 THEN 'offline' ELSE 'any' END AS format FROM w")
def q_preferences(spark, d):
    prof = users.profile(log(spark, d), catalog(spark, d).select("key", users.features().alias("features")))
    w = prof.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight"))).alias("w"))
    return w.select("user_id", P.preference(F.col("w"), "budget:free", "budget:paid").alias("budget"), P.preference(F.col("w"), "format:online", "format:offline").alias("format"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT user_id, event_key FROM log WHERE type IN ('save', 'unsave') GROUP BY 1, 2 HAVING arg_max(type, "at") = 'save'), a AS (SELECT user_id, event_key FROM log WHERE type IN ('register', 'attend') GROUP BY 1, 2 HAVING arg_max(type, "at") = 'attend')
SELECT user_id, count(*) AS engaged FROM (SELECT * FROM s UNION SELECT * FROM a) GROUP BY 1""")
def q_engaged(spark, d):
    return users.engaged(log(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("engaged"))


# --- the control plane ----------------------------------------------------------------------------------

# Stages are orders, their cycles customers with budgets of their own; the clock stands amid the orders' dates.
_CLOCK = "timestamp '1998-07-01 00:00:00'"
_STAGES = """SELECT o_custkey AS cycle, o_orderkey AS ord, concat('s', cast(o_orderkey % 10 as {text})) AS stage, o_orderkey % 7 > 0 AS enabled, o_orderkey % 29 = 0 AS paused,
 CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate END AS cooldown_until, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 23 = 0 THEN 'dead_letter' ELSE 'success' END END AS status,
 CASE o_orderkey % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'backlog' ELSE 'both' END AS trigger, o_orderkey % 17 = 0 AS manual, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS last_run, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS next_run,
 o_orderkey % 4 AS retries, 3 AS retry_max, cast(substr(o_orderpriority, 1, 1) as double) AS priority, cast(floor(o_totalprice) as bigint) % 8 AS backlog, o_orderstatus = 'P' AS degraded"""
_KINDS = ["crawl", "search", "ai", "page"]
_PLANNED = f"""st AS ({_STAGES.format(text="varchar")}, [{", ".join(map(repr, _KINDS))}][o_orderkey % 4 + 1] AS k1, CASE WHEN o_orderkey % 3 = 0 THEN [{", ".join(map(repr, _KINDS))}][(o_orderkey + 1) % 4 + 1] END AS k2, o_orderkey % 9 + 1 AS ask FROM orders),
pool AS (SELECT c_custkey AS cycle, unnest(['crawl', 'search', 'ai']) AS kind, unnest([20, 10, c_custkey % 3 * 10]) AS lim, unnest([c_custkey % 21, c_custkey % 8, c_custkey % 12]) AS consumed FROM customer),
asked AS (SELECT cycle, ord, ask, unnest(list_filter([k1, k2], lambda x: x IS NOT NULL)) AS kind FROM st),
has AS (SELECT a.*, greatest(0, coalesce(lim - consumed, 0)) AS lft, CASE WHEN lim <> 0 THEN greatest(0, lim - consumed) / lim::DOUBLE ELSE 1.0::DOUBLE END AS part FROM asked a LEFT JOIN pool p ON p.cycle = a.cycle AND p.kind = a.kind),
money AS (SELECT cycle, ord, bool_and(lft > 0) AS affordable, sum(CASE WHEN part < 0.5 THEN (0.5::DOUBLE - part) * 2.0::DOUBLE ELSE 0.0::DOUBLE END) AS penalty,
 string_agg(concat(kind, '=', least(CASE WHEN part < 0.25 THEN greatest(1, ceil(ask * 0.5))::BIGINT ELSE ask END, lft)), ',' ORDER BY kind) AS granted FROM has GROUP BY ALL),
due AS (SELECT *, CASE WHEN status = 'failed' THEN retries < retry_max AND (next_run IS NULL OR next_run <= {_CLOCK}) ELSE NOT manual AND (next_run IS NULL OR last_run IS NULL OR next_run <= {_CLOCK}) END AS due FROM st JOIN money USING (cycle, ord)),
sc AS (SELECT *, priority + least(3.0::DOUBLE, backlog * 0.5::DOUBLE) + CASE WHEN next_run < {_CLOCK} THEN least(2.0::DOUBLE, (epoch({_CLOCK}) - epoch(next_run)) / 3600.0::DOUBLE) ELSE 0.0 END - penalty - CASE WHEN degraded THEN 1.5::DOUBLE ELSE 0.0 END AS score FROM due
 WHERE enabled AND NOT paused AND status <> 'dead_letter' AND coalesce(cooldown_until <= {_CLOCK}, true) AND affordable AND CASE trigger WHEN 'schedule' THEN due WHEN 'backlog' THEN backlog > 0 ELSE due OR backlog > 0 END)"""


@query(f"WITH {_PLANNED} SELECT cycle, stage, round_even(score, 3) AS score, granted FROM (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY score DESC, ord) AS rn FROM sc) WHERE rn = 1")
def q_plan_stage(spark, d):
    k, kinds = F.col("o_orderkey"), F.array(*[F.lit(x) for x in _KINDS])
    asked = F.map_from_entries(F.filter(F.array(F.struct(F.get(kinds, (k % 4).cast("int")).alias("kind"), (k % 9 + 1).alias("ask")), F.when(k % 3 == 0, F.struct(F.get(kinds, ((k + 1) % 4).cast("int")).alias("kind"), (k % 9 + 1).alias("ask")))), lambda x: x.isNotNull()))
    o = read(spark, d, "orders")
    st = spark.sql(_STAGES.format(text="string") + ", budgets FROM {o}", o=o.withColumn("budgets", asked))
    c = F.col("c_custkey")
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), lim.cast("long").alias("limit"), used.alias("consumed")) for x, lim, used in (("crawl", F.lit(20), c % 21), ("search", F.lit(10), c % 8), ("ai", c % 3 * 10, c % 12))]))
    pool = read(spark, d, "customer").select(c.alias("cycle"), rows.alias("x")).select("cycle", "x.*")
    best = upkeep.plan_stage(st, pool, F.expr(_CLOCK))
    return best.select("cycle", "stage", "score", F.array_join(F.transform(F.array_sort(F.map_entries("granted")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("granted"))


@query("SELECT o_custkey, o_orderkey, rank, round(1.0 / (rank + 1), 9)::DOUBLE AS score FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders)")
def q_reciprocal_rank(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return upkeep.reciprocal_ranks(o, "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank", F.round("score", 9).alias("score"))


@query("SELECT user_id, event_id, floor(avg(value) OVER w * 1000 + 0.01) AS mean, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 999 PRECEDING)")
def q_sliding_latency(spark, d):
    return upkeep.sliding_latency(read(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.floor(F.col("mean") * 1000 + 0.01).cast("double").alias("mean"), "most")


@query("SELECT n_regionkey, n_name, round(c / sum(c) OVER (PARTITION BY n_regionkey), 6) AS share FROM (SELECT n_regionkey, n_name, count(*) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def q_shares(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("c"))
    return upkeep.shares(n, "c", "n_regionkey").drop("c")


@query(f"WITH s AS (SELECT c_custkey AS provider, CASE WHEN c_custkey % 6 > 0 THEN timestamp '{NOW}' - to_hours(CAST(c_custkey % 90 AS BIGINT)) END AS t, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'half_open' END AS circuit FROM customer) SELECT provider, coalesce(epoch(timestamp '{NOW}') - epoch(t) <= 172800, false) AND circuit <> 'open' AS active FROM s")
def q_provider_activity(spark, d):
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("provider"), F.when(F.col("c_custkey") % 6 > 0, F.expr(f"timestamp '{NOW}' - make_dt_interval(0, int(c_custkey % 90))")).alias("last_success"), F.expr("case c_custkey % 3 when 0 then 'open' when 1 then 'closed' else 'half_open' end").alias("circuit"))
    return upkeep.provider_activity(s, _now()).select("provider", "active")


@query("SELECT s_suppkey AS id FROM supplier ORDER BY s_nationkey % 4 * 15, s_suppkey % 10 DESC, s_suppkey LIMIT 20")
def q_job_order(spark, d):
    return upkeep.job_order(read(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_nationkey % 4 * 15 AS refresh_minutes", "s_suppkey % 10 AS expected")).limit(20).select("id")


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 10 OFFSET 20")
def q_inbox_page(spark, d):
    return upkeep.page_of(read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key")), 10, 20, "key")


_RUNS = "r AS (SELECT user_id % 20 AS provider, event_id AS run, event_type <> 'error' AS ok, value AS latency_ms, event_id % 10 / 10.0::DOUBLE AS quality, event_id % 4 / 8.0::DOUBLE AS duplicates, ts FROM events)"


@query(f"""WITH RECURSIVE {_RUNS}, h AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY run) AS i, count(*) OVER (PARTITION BY provider) AS n FROM r),
walk AS (SELECT provider, i, n, CASE WHEN ok THEN 0 ELSE 1 END AS streak, CASE WHEN ok OR latency_ms <> 0 THEN latency_ms ELSE 0.0 END::DOUBLE AS mean FROM h WHERE i = 1
 UNION ALL SELECT h.provider, h.i, h.n, CASE WHEN h.ok THEN 0 ELSE w.streak + 1 END, CASE WHEN h.ok OR h.latency_ms <> 0 THEN w.mean + (h.latency_ms - w.mean) / h.i ELSE w.mean END FROM walk w JOIN h ON h.provider = w.provider AND h.i = w.i + 1),
g AS (SELECT provider, n, count(*) FILTER (WHERE ok) AS s, max(CASE WHEN ok THEN ts END) AS t, avg(quality) AS q, avg(duplicates) AS d, avg(CASE WHEN i > n // 2 THEN CAST(ok AS INT) END) AS b, avg(CASE WHEN i <= n // 2 THEN CAST(ok AS INT) END) AS a FROM h GROUP BY ALL)
SELECT provider, CASE WHEN streak = 0 THEN 'healthy' WHEN streak >= 5 THEN 'failing' ELSE 'degraded' END AS health_status, CASE WHEN streak >= 5 THEN 'open' ELSE 'closed' END AS circuit_state, round_even(s / g.n, 4) AS uptime, floor(round(mean, 2)) AS latency_ms,
 floor((epoch_us(timestamp '{NOW}') - epoch_us(t)) / 3600000000.0) AS freshness_hours, round_even(q, 4) AS event_quality, round_even(d, 4) AS duplicate_pct, g.n - s AS failures, streak::BIGINT AS retries, CASE WHEN b > a + 1e-9 THEN 'up' WHEN b < a - 1e-9 THEN 'down' ELSE 'flat' END AS success_trend, g.n AS total_runs, s AS total_successes
FROM g JOIN walk USING (provider) WHERE walk.i = walk.n""")
def q_provider_health(spark, d):
    e = read(spark, d, "events")
    r = e.select((F.col("user_id") % 20).alias("provider"), F.col("event_id").alias("run"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"), (F.col("event_id") % 10 / 10).alias("quality"), (F.col("event_id") % 4 / 8).alias("duplicates"), F.col("ts").alias("at"))
    return upkeep.health_snapshot(r, _now()).withColumns({"freshness_hours": F.floor("freshness_hours").cast("double"), "latency_ms": F.floor("latency_ms").cast("double")})


_V = "v AS (SELECT o_orderstatus AS s, o_orderkey % 9 AS k FROM orders)"


@query(f"WITH {_V} SELECT round_even(count(*) FILTER (WHERE s IN ('F', 'P')) / count(*), 4) AS verification, round_even(count(*) FILTER (WHERE s = 'F') / count(*), 4) AS acceptance, round_even(count(*) FILTER (WHERE s = 'F' AND k = 0) / count(*) FILTER (WHERE s = 'F'), 4) AS duplicate, 0.0::DOUBLE AS never FROM v")
def q_validation_metrics(spark, d):
    s, k, every = F.col("o_orderstatus"), F.col("o_orderkey") % 9, F.lit(True)
    return upkeep.rates(read(spark, d, "orders"), [], verification=(s.isin("F", "P"), every), acceptance=(s == "F", every), duplicate=((s == "F") & (k == 0), s == "F"), never=(s == "F", s == "no such"))


@query(f"WITH {_V.replace('o_orderkey % 9 AS k', 'o_custkey % 9 AS k')} SELECT k AS cycle, round_even(count(*) FILTER (WHERE s = 'F') / count(*), 4) AS velocity FROM v GROUP BY k")
def q_growth_metrics(spark, d):
    r = read(spark, d, "orders").withColumn("cycle", F.col("o_custkey") % 9)
    return upkeep.rates(r, ["cycle"], velocity=(F.col("o_orderstatus") == "F", F.lit(True)))


_M = "SELECT c_custkey AS id, c_custkey % 10 / 10.0{0} AS duplicate_rate, c_custkey % 7 / 10.0{0} AS promotion_rate, c_custkey % 5 / 25.0{0} AS efficiency, c_custkey % 2 AS found FROM {1}"


@query(f"""WITH m AS ({_M.format('::DOUBLE', 'customer')}) SELECT id, concat_ws('; ', CASE WHEN duplicate_rate > 0.5 THEN printf('throttle expansion (duplicate_rate=%.2f)', duplicate_rate) END, CASE WHEN promotion_rate > 0.3 THEN printf('boost search frontier (promotion_rate=%.2f)', promotion_rate) END,
 CASE WHEN efficiency < 0.1 AND found > 0 THEN printf('low crawl efficiency (%.2f) — tighten scope', efficiency) END) AS said FROM m""")
def q_tuning(spark, d):
    m = spark.sql(_M.format("D", "{c}"), c=read(spark, d, "customer"))
    return upkeep.tuning(m).select("id", F.array_join("recommendations", "; ").alias("said"))


@query("SELECT line FROM (SELECT * FROM (SELECT 0 AS p, r_regionkey AS ord, concat('COVERAGE: ', r_name) AS line FROM region ORDER BY ord LIMIT 3) UNION ALL SELECT * FROM (SELECT 1, s_suppkey, concat('QUERY[retire]: ', s_name) FROM supplier ORDER BY s_suppkey LIMIT 3) UNION ALL SELECT * FROM (SELECT 2, n_nationkey, concat('BUDGET: ', n_name) FROM nation ORDER BY n_nationkey LIMIT 5)) ORDER BY p, ord")
def q_headlines(spark, d):
    r, s, n = (read(spark, d, t) for t in ("region", "supplier", "nation"))
    lists = [("COVERAGE: ", r.selectExpr("r_regionkey AS ord", "r_name AS line"), 3), ("QUERY[retire]: ", s.selectExpr("s_suppkey AS ord", "s_name AS line"), 3), ("BUDGET: ", n.selectExpr("n_nationkey AS ord", "n_name AS line"), 5)]
    return upkeep.headlines(lists).select("line")


def _greedy(log: str, seconds: int) -> str:
    """The rule of admission, row by row: log has key, t (microseconds), event_id."""
    gap = seconds * 1_000_000
    return f"""{log}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event_id) AS i FROM log),
w AS (SELECT key, event_id, i, true AS admitted, t AS since FROM r WHERE i = 1 UNION ALL
 SELECT r.key, r.event_id, r.i, r.t - w.since >= {gap}, CASE WHEN r.t - w.since >= {gap} THEN r.t ELSE w.since END FROM w JOIN r ON r.key = w.key AND r.i = w.i + 1)"""


@query(f"WITH RECURSIVE {_greedy('log AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id FROM events)', 21600)} SELECT event_id, admitted, since // 1000000 AS since FROM w")
def q_rate_limit(spark, d):
    return admission.admitted(read(spark, d, "events"), ["user_id"], F.col("ts"), 21600, "event_id").select("event_id", "admitted", F.unix_seconds("since").alias("since"))


@query("""WITH RECURSIVE r AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), w AS (SELECT key, event_id, i, t, t AS goes FROM r WHERE i = 1
 UNION ALL SELECT r.key, r.event_id, r.i, r.t, greatest(r.t, w.goes + 21600000000) FROM w JOIN r ON r.key = w.key AND r.i = w.i + 1) SELECT event_id, goes - t AS waited_us FROM w""")
def q_rate_spacing(spark, d):
    return admission.spaced(read(spark, d, "events"), ["user_id"], F.col("ts"), 21600, "event_id").select("event_id", F.round(F.col("waited") * 1_000_000).cast("long").alias("waited_us"))


_ASKED = """log AS (SELECT concat('{"categories":["', CASE WHEN user_id % 2 = 0 THEN 'ai","' ELSE '' END, 'meetup"],"city":"', CASE user_id % 3 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Delhi' ELSE '' END, '","free_only":', event_type = 'view', ',"keywords":[', CASE WHEN 'k' || j < event_type THEN '"k' || j || '","' || event_type || '"' ELSE '"' || event_type || '","k' || j || '"' END, ']}') AS key,
 epoch_us(ts) AS t, event_id FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT % 5 AS j FROM events))"""


@query(f"WITH RECURSIVE {_greedy(_ASKED, 21600)} SELECT event_id, key, NOT admitted AS hit, since // 1000000 AS stored_at, admitted AND i > 1 AS evicts FROM w")
def q_query_cache(spark, d):
    """Requests name the same query in different orders; a result is good for six hours."""
    k = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 5).cast("string"))
    ab = lambda x, y, c: F.when(c, F.array(x, y)).otherwise(F.array(y, x))
    odd = F.col("event_id") % 2 == 1
    categories = F.when(F.col("user_id") % 2 == 0, ab(F.lit("meetup"), F.lit("ai"), odd)).otherwise(F.array(F.lit("meetup")))
    city = F.expr("case user_id % 3 when 0 then 'Pune' when 1 then 'Delhi' end")
    asked = F.struct(ab(F.col("event_type"), k, odd).alias("keywords"), city.alias("city"), categories.alias("categories"), (F.col("event_type") == "view").alias("free_only"))
    log = read(spark, d, "events").withColumn("q", asked).withColumn("key", P.cache_key(F.col("q")))
    return admission.cached(log, ["key"], F.col("ts"), 21600, "event_id").select("event_id", "key", "hit", F.unix_seconds("stored_at").alias("stored_at"), "evicts")


_TASKS = f"SELECT c_custkey AS id, c_custkey % 13 AS priority, c_custkey % 5 AS attempts, CASE WHEN c_custkey % 7 = 0 THEN timestamp '2030-01-01 00:00:00' END AS lease_until, CASE WHEN c_custkey % 11 = 0 THEN timestamp '2030-01-01 00:00:00' END AS cool_until"


@query(f"WITH t AS ({_TASKS} FROM customer), j AS (SELECT *, CASE WHEN attempts >= 3 THEN 'dead' WHEN lease_until > timestamp '{NOW}' THEN 'leased' WHEN cool_until > timestamp '{NOW}' THEN 'cooling' ELSE 'ready' END AS state FROM t) SELECT id, state, state = 'ready' AND row_number() OVER (PARTITION BY state ORDER BY priority DESC, id) <= 16 AS taken FROM j")
def q_task_leases(spark, d):
    t = spark.sql(_TASKS + " FROM {c}", c=read(spark, d, "customer"))
    return upkeep.leased(t, _now(), 16).select("id", "state", "taken")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'approved' WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'rejected' WHEN c_custkey % 3 = 0 THEN 'manual_review' ELSE 'live' END AS state, c_custkey % 3 = 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 = 0) AS moved FROM customer")
def q_review(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    k = F.col("key")
    decisions = c.filter("key % 2 = 0 or key % 5 = 0").withColumn("approve", k % 2 == 0)
    return upkeep.review(c.withColumn("state", F.when(k % 3 == 0, "manual_review").otherwise("live")), decisions)


@query("SELECT s_suppkey, round_even(CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 / 3 WHEN 2 THEN 2 / 3 ELSE 1 END::DOUBLE, 4) AS score, array_to_string(['a', 'b', 'c'][s_suppkey % 4 + 1:], '|') AS missing FROM supplier")
def q_strategy_score(spark, d):
    expected, present = F.array(*[F.lit(x) for x in "abc"]), F.slice(F.array(*[F.lit(x) for x in "abc"]), F.lit(1), (F.col("s_suppkey") % 4).cast("int"))
    score, missing = upkeep.strategy_score(expected, present)
    return read(spark, d, "supplier").select("s_suppkey", score.alias("score"), F.array_join(missing, "|").alias("missing"))


_VERDICTS = "SELECT o_custkey AS seed, o_orderkey AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'verified' WHEN '2-HIGH' THEN 'rejected' ELSE 'insufficient' END AS decision FROM"


@query(f"""WITH v AS ({_VERDICTS} orders), l AS (SELECT seed, count(*) FILTER (WHERE decision = 'insufficient') AS attempts, max(run) FILTER (WHERE decision = 'insufficient') + 1000 AS next_run, arg_max(decision, run) AS last_decision FROM v GROUP BY 1)
SELECT c_custkey AS seed, coalesce(attempts, 0) AS attempts, last_decision FROM customer LEFT JOIN l ON seed = c_custkey WHERE coalesce(attempts, 0) < 6 AND coalesce(next_run, 0) <= (SELECT max(o_orderkey) FROM orders)""")
def q_retry_seeds(spark, d):
    """Every order is a verdict on its customer, its key the run; pauses are of 1000 runs."""
    o = read(spark, d, "orders")
    run = o.agg(F.max("o_orderkey")).first()[0]
    return upkeep.retry_eligible(read(spark, d, "customer").select(F.col("c_custkey").alias("seed")), spark.sql(_VERDICTS + " {o}", o=o), run, 6, 1000)


@query(f"""{CATALOG_SQL}, j AS (SELECT provider, key, title <> '' AND start_date IS NOT NULL AS ok, ({_COMPLETE}) / 6.0::DOUBLE AS q FROM catalog), r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ok DESC, key) AS rn FROM j)
SELECT provider, count(*) AS fetched, count(*) FILTER (WHERE ok) AS valid, round_even(avg(q), 4) AS quality, string_agg(CASE WHEN rn <= 3 THEN key END, ',' ORDER BY key) AS samples, round_even(avg(q), 4) >= 0.3 AS passed FROM r GROUP BY provider""")
def q_sandbox_preview(spark, d):
    full = S.completeness(*[F.col(c) for c in S.OPTIONAL]) / 6
    return upkeep.sandbox_preview(catalog(spark, d), (F.col("title") != "") & F.col("start_date").isNotNull(), full)
