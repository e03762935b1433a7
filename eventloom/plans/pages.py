"""Queries over pages, links and records whose text is enriched, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.functions import confidence as C
from eventloom.functions import text as T
from eventloom.functions import urls as U
from eventloom.operators import dedup, extract, graph, search, users
from eventloom.plans.adapters import CATALOG_SQL, DISCOVERY_SQL, TODAY, catalog, read
from eventloom.plans.queries import _BM25, _BM_TERMS, _CITY_SQL, _COMPLETE, _END, _ENRICHED, _SOURCE, _today, ORACLE, query
from eventloom.staging import shared_dir

_A = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def _uniq(xs: str) -> str:
    """First occurrences, in order."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


def _joined(xs: str) -> str:
    return f"array_to_string({xs}, '|')"


# --- enrichment ---------------------------------------------------------------------------

_CAREERS = f"flatten(list_transform(topics, lambda x: CASE x {' '.join(f'WHEN {k!r} THEN {v}' for k, v in T.CAREERS.items())} ELSE [] END))"


def _part(lead: str, xs: str, n: int) -> str:
    return f"CASE WHEN len({xs}) > 0 THEN concat('{lead}', array_to_string({xs}[1:{n}], ', ')) ELSE '' END"


@query(f"""{CATALOG_SQL}, {_ENRICHED}, u AS (SELECT *, {_uniq("audiences")} AS people, {_uniq("skills")} AS able, {_CAREERS} AS c0 FROM enr)
SELECT key, {_joined("topics")} AS topics, {_joined("technologies")} AS technologies, level, {_joined("able")} AS skills, {_joined("people")} AS audiences, {_joined(_uniq("c0"))} AS careers,
 concat('A ', level, '-level ', category, {_part(" on ", "topics", 3)}, {_part(" featuring ", "technologies", 3)}, {_part(", aimed at ", "people", 2)}, CASE WHEN coalesce(city, '') <> '' THEN concat(', in ', city) ELSE '' END, '.') AS summary FROM u""")
def q_enrichment(spark, d):
    e = users.enriched(catalog(spark, d)).withColumn("careers", T.careers(F.col("topics")))
    summary = T.summary(F.col("category"), F.col("city"), F.col("topics"), F.col("technologies"), F.col("audiences"), F.col("level"))
    return e.select("key", "level", *[F.array_join(c, "|").alias(c) for c in ("topics", "technologies", "skills", "audiences", "careers")], summary.alias("summary"))


ORACLE["q_browse_difficulty"] = f"{CATALOG_SQL}, {_ENRICHED} SELECT key FROM enr WHERE level = 'beginner'"

# --- the entity graph as SQL ----------------------------------------------------------------

_SLUG = "regexp_replace(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' ', '-', 'g')"
_PROVIDERS = "CASE provider " + " ".join(f"WHEN '{k}' THEN ['{v}']" for k, v in T.PROVIDER_COMMUNITY.items()) + " ELSE [] END"
_B = r"[^\p{L}\p{N}_]"


def _labelled(table: dict[str, str]) -> str:
    from eventloom.plans.queries import re2

    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '{re2(p)}') THEN '{n}' END" for n, p in table.items()) + "], lambda x: x IS NOT NULL)"


_SERIES = r"""regexp_replace(regexp_replace(regexp_replace(title, '\b(19|20)\d{2}\b', '', 'g'), '(?i)\b\d{1,2}(st|nd|rd|th)\b', '', 'g'), '(?i)\b(annual|edition|season|vol|volume)\b', '', 'g')"""
_TRIMMED = r"""regexp_replace(regexp_replace(CASE WHEN coalesce(city, '') <> '' THEN regexp_replace(s, concat('(?i)\b', city, '\b'), '', 'g') ELSE s END, '\s+', ' ', 'g'), '^[ \-–—:|,]+|[ \-–—:|,]+$', '', 'g')"""
_GRAPH = f"""{_ENRICHED}, ser AS (SELECT *, {_SERIES} AS s FROM enr), tri AS (SELECT *, {_TRIMMED} AS series, trim(split_part(location, ',', 1)) AS v FROM ser),
m AS (SELECT key, category, start_date, {_CITY_SQL} AS town, 'community' AS type, unnest(list_concat({_PROVIDERS}, {_labelled(T.COMMUNITY_PATTERNS)})) AS name FROM enr
 UNION ALL SELECT key, category, start_date, {_CITY_SQL}, 'organization', unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(low, '(^|{_B})({k})($|{_B})') THEN '{v}' END" for k, v in T.ORGANISATIONS.items())}], lambda x: x IS NOT NULL)) FROM enr
 UNION ALL SELECT key, category, start_date, {_CITY_SQL}, 'event_series', series FROM tri WHERE length(series) >= 3
 UNION ALL SELECT key, category, start_date, {_CITY_SQL}, 'venue', v FROM tri WHERE length(v) >= 3 AND lower(v) NOT IN ('online', 'virtual') AND NOT coalesce(lower(v) = lower(city), false)
 UNION ALL SELECT key, category, start_date, {_CITY_SQL}, 'city', {_CITY_SQL} FROM catalog WHERE coalesce({_CITY_SQL}, '') <> ''),
mm AS (SELECT DISTINCT key, category, start_date, town, type, name, concat(type, ':', {_SLUG}) AS id FROM m),
v AS (SELECT id, type, min(name) AS name, count(DISTINCT key) AS events, min(start_date) AS first_seen, max(start_date) AS last_seen FROM mm GROUP BY 1, 2)"""
ORACLE["q_directory"] = f"{CATALOG_SQL}, {_GRAPH} SELECT type, id, events FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY events DESC, name, id) AS rn FROM v) WHERE rn <= 24"

_LAST = "last_day({0}) = {0}"
_MONTHS = f"(year(b) - year(a)) * 12 + month(b) - month(a) + CASE WHEN day(a) = day(b) OR ({_LAST.format('a')} AND {_LAST.format('b')}) THEN 0 ELSE (day(b) - day(a)) / 31.0::DOUBLE END"
_PROFILES = f"""pe AS (SELECT DISTINCT id, type, key FROM mm WHERE type IN ('community', 'organization', 'event_series')),
pa AS (SELECT id, type, count(*) AS total, count(*) FILTER (WHERE {_END} >= date '{TODAY}') AS active, count(*) FILTER (WHERE {_END} < date '{TODAY}') AS historical, sum({_COMPLETE}) / (count(*) * 6)::DOUBLE AS q,
 list_sort(list_distinct(list({_CITY_SQL}))) AS cities, min(start_date) AS a, max(start_date) AS b FROM pe JOIN catalog USING (key) GROUP BY 1, 2),
p AS (SELECT *, round_even(q, 3) AS quality, round(total / greatest(1.0, {_MONTHS} + 1), 3) AS per_month FROM pa)"""


@query(f"{CATALOG_SQL}, {_GRAPH}, {_PROFILES} SELECT id, total, active, historical, quality, {_joined('cities')} AS cities, per_month FROM p")
def q_organizer_profiles(spark, d):
    c = catalog(spark, d)
    _, e = graph.build(c, ("HOSTED_BY", "ORGANIZED_BY", "PART_OF"))
    return graph.profiles(c, e, _today()).withColumn("cities", F.array_join("cities", "|"))


ORACLE["q_community_insights"] = f"""{CATALOG_SQL}, {_GRAPH}, {_PROFILES}, n AS (SELECT p.*, name FROM p JOIN v USING (id, type)),
l AS (SELECT 'fastest_growing' AS list, name, active AS n FROM n WHERE type = 'community' UNION ALL SELECT 'most_active_cities', name, events FROM v WHERE type = 'city' UNION ALL SELECT 'most_active_organizers', name, total FROM n WHERE type = 'organization'
 UNION ALL SELECT 'recurring_series', name, total FROM n WHERE type = 'event_series' AND total >= 2 UNION ALL SELECT 'inactive_communities', name, total FROM n WHERE type = 'community' AND active = 0)
SELECT list, rank, name, n FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, name) AS rank FROM l) WHERE rank <= 5"""

# --- pages ------------------------------------------------------------------------------------


def _crawl_url(url: str) -> str:
    """Canonical form of a URL, null if it is not http(s)."""
    part = lambda p: f"regexp_extract({url}, '{p}', 1)"
    scheme, host, port = f"lower({part('^([a-zA-Z]+)://')})", f"lower({part(_A + '([^/?#:@]+)')})", part("^[a-zA-Z]+://[^/?#:]+:([0-9]+)")
    path = f"regexp_replace({part(_A + '[^/?#]*([^?#]*)')}, '/+$', '')"
    keep = f"list_sort(list_filter(string_split({part('[?]([^#]*)')}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({', '.join(repr(x) for x in U.TRACKING)})))"
    return f"""CASE WHEN {scheme} IN ('http', 'https') AND {host} <> '' THEN concat({scheme}, '://', {host}, CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE concat(':', {port}) END,
 CASE WHEN {path} = '' THEN '/' ELSE {path} END, CASE WHEN len({keep}) > 0 THEN concat('?', array_to_string({keep}, '&')) ELSE '' END) END"""


ORACLE["q_url_canonical"] = f"SELECT page_id, {_crawl_url('url')} AS url FROM pages"

_STRIPPED = r"""regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs')"""
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIPPED = f"replace({_STRIPPED}, '{_entity}', '{_char}')"
_STRIPPED = rf"trim(regexp_replace({_STRIPPED}, '\s+', ' ', 'g'))"
ORACLE["q_strip_tags"] = f"SELECT page_id, {_STRIPPED} AS text FROM pages"

_DATED = "concat(html, ' ', [{0}][page_id % 6 + {1}])"
_DATES = ["on 2026-03-04 and March 5, 2026", "5th march 2026; 2026-03-04", "01/02/2026 or Sept 2027", "may 1, 2026 - May 1, 2026", "no date", "12 dec. 2026 12/12/2026"]


@query(f"SELECT page_id, {_joined(_uniq('ds'))} AS dates FROM (SELECT page_id, list_concat({', '.join(f'regexp_extract_all(t, {p!r})' for p in T.DATE_PATTERNS)}) AS ds FROM (SELECT page_id, {_DATED.format(', '.join(repr(x) for x in _DATES), 1)} AS t FROM pages))".replace("\\\\", "\\"))
def q_find_dates(spark, d):
    t = F.expr(_DATED.format(", ".join(repr(x) for x in _DATES), 0).replace("[", "array(", 1).replace("][", ")[", 1))
    return read(spark, d, "pages").select("page_id", F.array_join(T.find_dates(t), "|").alias("dates"))


_LINKS = f"""p AS (SELECT url, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=["'']([^"''#]+)', 1))) AS href FROM pages),
r AS (SELECT url, CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN starts_with(href, '/') THEN concat(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+'), href) END AS t FROM p), l AS (SELECT DISTINCT {_crawl_url('url')} AS source, {_crawl_url('t')} AS target FROM r)"""
_SIGNALS = " + ".join(f"CASE WHEN regexp_matches(lower(target), '{p}') THEN {C.CRAWL[k]} ELSE 0 END" for k, p in C.URL_SIGNALS.items())
ORACLE["q_crawl_priority"] = f"WITH {_LINKS} SELECT source, target, round_even(least(1.0, ({_SIGNALS})::DOUBLE), 4) AS priority FROM l WHERE target IS NOT NULL"

_O = C.ONBOARDING
_HEALTH = "CASE feed_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.FEED_HEALTH.items()) + " ELSE 0.3 END"
_SANDBOX = "round_even(0.25 * greatest(0, least(1, len(technologies) / 4.0)) + 0.35 * greatest(0, least(1, event_count / 10.0)) + 0.25 * sandbox_quality + 0.15 * 0.5, 3)"
ORACLE["q_onboarding_bands"] = f"""{DISCOVERY_SQL}, s AS (SELECT round_even(({_O['discovery']} * round_even(least(1, sandbox_quality), 3) + {_O['sandbox']} * {_SANDBOX} + {_O['extraction']} * 0.5 + {_O['provider_health']} * {_HEALTH} + {_O['content']} * round_even(least(1, event_count / 15.0::DOUBLE), 3)
 + {_O['duplicate']} * round_even(1 - duplicate_rate, 3) + {_O['tech']} * round_even(least(1, len(technologies) / 3.0::DOUBLE), 3) + {_O['india']} * 0.5)::DOUBLE, 4) AS total FROM records)
SELECT CASE WHEN total >= 0.72 THEN 'auto_approve' WHEN total >= 0.45 THEN 'review' ELSE 'reject' END AS band, count(*) AS n, round(avg(total)::DOUBLE, 4) AS mean FROM s GROUP BY 1"""

# --- extraction over pages that hold records ----------------------------------------------------

_T = "concat('Meet ', doc_id)"
_S = f"cast(date '{TODAY}' + cast(doc_id % 300 as int) as {{text}})"
_HTML = {
    0: """'<html><script type="application/ld+json">{"@graph":[{"@type":"SocialEvent","name":"', %(t)s, '","startDate":"', %(s)s, 'T10:00","location":{"name":"Hall ', doc_id %% 7, '"},"url":"https://e.example.com/', doc_id, '"}]}</script></html>'""",
    1: """'<meta property="og:type" content="event"><meta property="og:title" content="', %(t)s, ' &amp; more"><meta property="event:start_time" content="', %(s)s, 'T09:00"><meta property="og:url" content="https://e.example.com/', doc_id, '">'""",
    2: """'<div itemscope itemtype="https://schema.org/EducationEvent"><b itemprop="name">', %(t)s, '</b><time itemprop="startDate" datetime="', %(s)s, 'T08:00">soon</time><i itemprop="location">Hall ', doc_id %% 7, '</i></div>'""",
    3: """'BEGIN:VCALENDAR', chr(10), 'BEGIN:VEVENT', chr(10), 'SUMMARY:', %(t)s, chr(10), 'DTSTART;VALUE=DATE:', replace(%(s)s, '-', ''), chr(10), 'LOCATION:Hall ', doc_id %% 7, chr(10), 'END:VEVENT'""",
    4: """'<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[{"title":"', %(t)s, '","startTime":"', %(s)s, '","venue":"Hall ', doc_id %% 7, '"}]}}</script>'""",
    5: """'<table><tr><th>Talk</th><th>When</th><th>Where</th></tr><tr><td>', %(t)s, '</td><td>', %(s)s, '</td><td>Hall ', doc_id %% 7, '</td></tr></table>'""",
    6: """'<section class="event-card"><h3>', %(t)s, '</h3><p>on ', %(s)s, '</p></section>'""",
    7: """'<script type="application/ld+json">{"@type":"Event","name":"', %(t)s, '"}</script><script type="application/ld+json">{"@type":"Thing"</script><meta property="og:type" content="event"><meta property="og:title" content="', %(t)s, '">'""",
}
_TIER = {0: "jsonld", 1: "opengraph", 2: "microdata", 3: "ics", 4: "hydration", 5: "table", 6: "block", 7: "jsonld"}
_SURE = {0: 0.95, 1: 0.6, 2: 0.9, 3: 0.9, 4: 0.8, 5: 0.7, 6: 0.5, 7: 0.95}


def _pages_html(text: str) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN concat({h % {'t': _T, 's': _S.format(text=text)}})" for k, h in _HTML.items()) + " END"


@query(f"""SELECT concat('https://p.example.com/', doc_id) AS page, lower(concat({_T}, CASE WHEN doc_id % 8 = 1 THEN ' more' ELSE '' END)) AS cluster, concat({_T}, CASE WHEN doc_id % 8 = 1 THEN ' & more' ELSE '' END) AS title, CASE WHEN doc_id % 8 <> 7 THEN {_S.format(text='varchar')} END AS start_date,
 CASE WHEN doc_id % 8 NOT IN (1, 6, 7) THEN concat('Hall ', doc_id % 7) END AS location, CASE WHEN doc_id % 8 IN (0, 1) THEN concat('https://e.example.com/', doc_id) END AS url,
 CASE doc_id % 8 {' '.join(f"WHEN {k} THEN {v}" for k, v in _SURE.items())} END::DOUBLE AS confidence, CASE doc_id % 8 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _TIER.items())} END AS sources FROM documents""")
def q_page_extract(spark, d):
    pages = read(spark, d, "documents").select(F.expr("concat('https://p.example.com/', doc_id)").alias("url"), F.expr(_pages_html("string")).alias("html"))
    pages = pages.union(read(spark, d, "pages").select("url", "html"))  # which hold none, and must give none
    got = extract.merge_fields(extract.extract_fields(pages))
    return got.select("page", "cluster", "title", "start_date", "location", "url", "confidence", F.array_join("sources", "|").alias("sources"))


@query("SELECT doc_id, len(regexp_extract_all(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) > 0 AS dated, len(regexp_extract_all(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS n FROM (SELECT doc_id, text, concat(text, CASE WHEN doc_id % 3 = 0 THEN ' 2026-01-02, 2026-1-2, 12026-03-04' ELSE ' 26-01-02' END) AS t FROM documents WHERE text IS NOT NULL)")
def q_iso_dates(spark, d):
    t = F.concat("text", F.expr("CASE WHEN doc_id % 3 = 0 THEN ' 2026-01-02, 2026-1-2, 12026-03-04' ELSE ' 26-01-02' END"))
    n = F.size(F.regexp_extract_all(t, F.lit("([0-9]{4}-[0-9]{2}-[0-9]{2})"))).cast("long")
    return read(spark, d, "documents").filter("text is not null").select("doc_id", (n > 0).alias("dated"), n.alias("n"))


# --- the term index ---------------------------------------------------------------------------------


@query(f"WITH {_BM25} SELECT key, score FROM bm ORDER BY score DESC, key LIMIT 20")
def q_bm25_index(spark, d):
    # Half of the documents come twice, the second time as they are, and some that are not there are deleted again.
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    ix = search.Index(spark, f"{shared_dir(spark)}/terms-{uuid.uuid4().hex}")
    ix.upsert(docs.withColumn("text", F.when(F.col("key") % 2 == 0, F.concat("text", F.lit(" trash"))).otherwise(F.col("text"))), "key", F.col("text"))
    ix.upsert(docs.filter("key % 2 = 0").union(docs.select(-F.col("key") - 1, "text")), "key", F.col("text"))
    ix.delete(docs.select((-F.col("key") - 1).alias("key")))
    return ix.bm25(_BM_TERMS).select("key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "key").limit(20)


@query(f"""{CATALOG_SQL}, r AS (SELECT *, sha1(title) AS t FROM catalog UNION ALL SELECT * REPLACE (doc_id + 1000000 AS doc_id, concat(description, ' more') AS description), sha1(title) FROM catalog),
k AS (SELECT *, min(doc_id) OVER (PARTITION BY start_date, t) AS cluster FROM r) SELECT doc_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {_COMPLETE} DESC, CAST({_SOURCE} AS DOUBLE) DESC, length(description) DESC, doc_id) AS rn FROM k) WHERE rn = 1""")
def q_dedup_clusters(spark, d):
    # Titles that are alike or have nothing in common, each record twice in one city: clusters are equal titles of a date.
    c = catalog(spark, d)
    twice = c.unionByName(c.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "description": F.concat("description", F.lit(" more"))}))
    rows = twice.withColumns({"title": F.concat(F.sha1("title"), F.lit(" "), F.sha1(F.sha1("title"))), "url": F.concat(F.lit("https://e.example.com/"), F.sha1(F.col("doc_id").cast("string"))), "city": F.lit("Pune")})
    kept = dedup.survivors(dedup.clusters(rows, "doc_id"), "doc_id")
    return kept.select("doc_id", "cluster")
