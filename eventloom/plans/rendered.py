"""Queries over what pages carry for their scripts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import hydration
from eventloom.plans.adapters import read
from eventloom.plans.queries import query

# Every page once as it is, and once more with a payload of its own: events by its number, named after its url.
_KINDS = {
    0: ('<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[', ']}}</script><script src="/_next/static/x.js"></script>'),
    1: ('<script>window.__INITIAL_STATE__ = {"a":{"items":[', ']},"note":"a } in a string"}; start();</script>'),
    2: ('<script type="application/json">[', ']</script><div data-astro-x></div>'),
    3: ('<script>self.__next_f.push([1,"', '"])</script>'),
    4: ('<script>window.__NUXT__=(function(a){return {list:[', ']}}(1))</script>'),
}
_INNER = ["page_id + 1000000 AS id", "url", "html", "page_id % 5 AS k", "cast(page_id % 4 + 1 as int) AS n"]


def _planted(spark: bool) -> list[str]:
    text = "string" if spark else "varchar"
    one = f"""concat('{{"name":"', url, ' ', cast(i as {text}), '","startDate":"2026-09-01","tags":[{{"name":"no event"}}]}}')"""
    listed = f"array_join(transform(sequence(1, n), i -> {one}), ',')" if spark else f"array_to_string(list_transform(range(1, n + 1), lambda i: {one}), ',')"
    body = f"CASE WHEN k = 3 THEN replace({listed}, '\"', '{chr(92) * (2 if spark else 1)}\"') ELSE {listed} END"
    lead, tail = (" ".join(f"WHEN {k} THEN '{v[j]}'" for k, v in _KINDS.items()) for j in (0, 1))
    return ["id", "concat(url, '#state') AS url", f"concat(html, CASE k {lead} END, {body}, CASE k {tail} END) AS html"]


def _pages(spark, d):
    p = read(spark, d, "pages")
    return p.selectExpr("page_id AS id", "url", "html").union(p.selectExpr(*_INNER).selectExpr(*_planted(True)))


_TREE = """(SELECT count(*) FROM json_tree(v) t WHERE t.type = 'OBJECT' AND (
 (list_has_any(list_transform(json_keys(t.value), lambda x: lower(x)), ['name', 'title', 'event_name', 'eventname', 'summary']) AND list_has_any(list_transform(json_keys(t.value), lambda x: lower(x)), ['start_date', 'start_at', 'startdate', 'startdatetime', 'start_time', 'starttime', 'start', 'date', 'datetime', 'start_date_time']))
 OR lower(coalesce(json_extract_string(t.value, '$."@type"'), json_extract_string(t.value, '$.type'), '')) = 'event'))"""
_SIGN = """len(regexp_extract_all(x, '(?i)"(?:start_at|start_date|startDate|startTime|start_time|startDateTime)"\\s*:'))"""
_ANALYSED = f"""pg AS (SELECT page_id AS id, url, html FROM pages UNION ALL SELECT {", ".join(_planted(False))} FROM (SELECT {", ".join(_INNER)} FROM pages)),
raw AS (SELECT id, 0 AS o, '__NEXT_DATA__' AS source, regexp_extract(html, '(?is)<script id="__NEXT_DATA__" type="application/json"[^>]*>(.*?)</script>', 1) AS x FROM pg
 UNION ALL SELECT id, 3, '__INITIAL_STATE__', regexp_extract(html, 'window\\.__INITIAL_STATE__\\s*=\\s*(\\{{.*?\\}}); start', 1) FROM pg
 UNION ALL SELECT id, 5, 'embedded_json', unnest(regexp_extract_all(html, '(?is)<script[^>]+type="application/json"[^>]*>(.*?)</script>', 1)) FROM pg),
parsed AS (SELECT id, o, source, {_TREE} AS n FROM (SELECT *, CASE WHEN json_valid(x) THEN x::JSON ELSE 'null'::JSON END AS v FROM raw WHERE x <> '')),
flight AS (SELECT id, 6 AS o, '__next_f' AS source, {_SIGN} AS n FROM (SELECT id, replace(array_to_string(regexp_extract_all(html, 'self\\.__next_f\\.push\\(\\[\\d+,\\s*"((?:[^"\\\\]|\\\\.)*)"', 1), chr(10)), '\\"', '"') AS x FROM pg WHERE contains(html, 'self.__next_f.push'))),
best AS (SELECT id, arg_max(source, (n, -o)) AS source, max(n) AS n FROM (SELECT * FROM parsed UNION ALL SELECT * FROM flight) GROUP BY id HAVING max(n) > 0),
signs AS (SELECT id, {_SIGN} AS n FROM (SELECT id, html AS x FROM pg))
SELECT pg.id, CASE WHEN contains(lower(html), 'id="__next_data__"') OR contains(html, '__next_f.push') OR contains(lower(html), '/_next/static/') THEN 'Next.js' WHEN contains(lower(html), 'window.__nuxt__') THEN 'Nuxt' WHEN contains(lower(html), 'data-astro-') THEN 'Astro' END AS framework,
 CASE WHEN best.n > 0 THEN best.source WHEN signs.n > 0 THEN CASE WHEN contains(html, '__next_f') THEN '__next_f' ELSE 'embedded' END END AS source, coalesce(nullif(best.n, 0), signs.n) AS events FROM pg JOIN signs USING (id) LEFT JOIN best USING (id)"""


@query(f"WITH {_ANALYSED}")
def q_framework_analysis(spark, d):
    p = _pages(spark, d)
    a = hydration.analyse(p.select(F.col("id").cast("string").alias("url"), "html"))
    return a.select(F.col("url").cast("long").alias("id"), "framework", "source", "events")


@query(f"""WITH a AS (WITH {_ANALYSED}), c AS (SELECT id, framework, CASE WHEN source IN ('__NEXT_DATA__', '__INITIAL_STATE__', 'embedded_json') OR framework = 'Next.js' AND source = '__next_f' THEN events ELSE 0 END AS n, source FROM a)
SELECT id, n > 0 AS is_event, CASE WHEN n = 0 THEN 'crawl' WHEN source = '__NEXT_DATA__' THEN 'next_data' ELSE 'hydration_state' END AS provider_type, n AS expected_events,
 round_even(CASE WHEN n > 0 THEN 0.4::DOUBLE + least(0.2::DOUBLE, n / 50.0::DOUBLE * 0.2::DOUBLE) ELSE 0.0 END + CASE WHEN framework IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0 END, 4) AS confidence FROM c""")
def q_rendered_sources(spark, d):
    p = _pages(spark, d)
    c = hydration.candidates(p.select(F.col("id").cast("string").alias("url"), "html"))
    return c.select(F.col("url").cast("long").alias("id"), "is_event", "provider_type", "expected_events", "confidence")
