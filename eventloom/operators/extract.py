"""Page to record extraction (E01-E11): structured, embedded and textual tiers, as one mapInPandas pass and Column merges.

Tiers run in one pass over a page's text, and a page stops after a tier whose best record is
sure enough; what is recursive JSON or look-around markup is Python, the rest Columns."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import ship

PEAK, LEAST = 0.8, 0.35
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)
_META = re.compile(r"<meta\b[^>]*?(?:property|name)=[\"']([^\"']+)[\"'][^>]*?content=[\"']([^\"']*)[\"']", re.I)
_ITEM = re.compile(r"<(\w+)[^>]*\bitemscope\b[^>]*itemtype=[\"'][^\"']*Event[\"'][^>]*>(.*?)(?=<\w+[^>]*\bitemscope\b[^>]*Event|\Z)", re.S | re.I)
_PROP = re.compile(r"<\w+[^>]*\bitemprop=[\"'](\w+)[\"']([^>]*)>([^<]*)", re.I)
_ROW, _CELL = re.compile(r"<tr\b.*?</tr>", re.S | re.I), re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", re.S | re.I)
_TAG = re.compile(r"<[^>]+>")
_DATE = re.compile(r"\b(\d{4}-\d{2}-\d{2})")
# Words of table heads by role, and names of fields in structured data.
ROLES = {"title": r"event|title|name|talk", "start_date": r"date|when|day", "location": r"venue|where|location|place", "url": r"link|url|register", "price": r"fee|price|cost"}
FIELDS = {"name": "title", "title": "title", "startDate": "start_date", "start_date": "start_date", "start": "start_date", "startTime": "start_date", "endDate": "end_date", "end_date": "end_date", "url": "url", "description": "description", "location": "location", "venue": "location"}


def plain(x: str) -> str:
    return " ".join(html_lib.unescape(_TAG.sub(" ", x)).split())


def _value(v) -> str | None:
    if isinstance(v, dict):
        return _value(v.get("name") or v.get("address"))
    if isinstance(v, list):
        return _value(v[0]) if v else None
    return None if v is None else " ".join(str(v).split()) or None


def _fields(node: dict) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, f in FIELDS.items():
        if f not in out and (v := _value(node.get(k))):
            out[f] = v[:10] if f.endswith("_date") and _DATE.match(v) else v
    return out


def walk(obj, wanted) -> Iterator[dict]:
    """All wanted objects of a JSON value, level by level."""
    todo = deque([obj])
    while todo:
        x = todo.popleft()
        if isinstance(x, dict):
            if wanted(x):
                yield x
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)


def _is_ld(x: dict) -> bool:
    t = x.get("@type")
    return any(str(y).endswith("Event") for y in (t if isinstance(t, list) else [t]))


def _event_shaped(x: dict) -> bool:
    return bool(x.get("name") or x.get("title")) and any(x.get(k) for k in ("startDate", "start_date", "startTime", "start"))


def unfold_ics(text: str) -> list[dict[str, str]]:
    out, cur = [], None
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        if line == "BEGIN:VEVENT":
            cur = {}
        elif line == "END:VEVENT" and cur is not None:
            out.append(cur)
            cur = None
        elif cur is not None and ":" in line:
            k, v = line.split(":", 1)
            cur[k.split(";")[0].upper()] = re.sub(r"\\([,;\\])", r"\1", v.replace("\\n", " ").replace("\\N", " "))
    return out


def structured(page: str) -> Iterator[tuple[str, float, dict]]:
    for attrs, body in _SCRIPT.findall(page):
        if "ld+json" in attrs:
            try:
                for node in walk(json.loads(body), _is_ld):
                    yield "jsonld", 0.95, _fields(node)
            except ValueError:
                continue
    for _, block in _ITEM.findall(page):
        node: dict[str, str] = {}
        for prop, attrs, text in _PROP.findall(block):
            at = re.search(r"(?:content|datetime|href)=[\"']([^\"']*)", attrs)
            node.setdefault(prop, at[1] if at else plain(text))
        yield "microdata", 0.9, _fields(node)
    if "BEGIN:VEVENT" in page:
        for v in unfold_ics(page):
            d = v.get("DTSTART", "")
            yield "ics", 0.9, {k: x for k, x in {"title": v.get("SUMMARY"), "url": v.get("URL"), "location": v.get("LOCATION"), "description": (v.get("DESCRIPTION") or "")[:300] or None, "start_date": f"{d[:4]}-{d[4:6]}-{d[6:8]}" if len(d) >= 8 else None}.items() if x}


def embedded(page: str) -> Iterator[tuple[str, float, dict]]:
    meta = {k.lower(): html_lib.unescape(v) for k, v in _META.findall(page)}
    if "event" in meta.get("og:type", "") and meta.get("og:title"):
        yield "opengraph", 0.6, {k: v for k, v in {"title": meta["og:title"], "url": meta.get("og:url"), "description": meta.get("og:description"), "start_date": (meta.get("event:start_time") or "")[:10] or None}.items() if v}
    for attrs, body in _SCRIPT.findall(page):
        if "__NEXT_DATA__" in attrs or "application/json" in attrs:
            try:
                for node in walk(json.loads(body), _event_shaped):
                    yield "hydration", 0.8, _fields(node)
            except ValueError:
                continue


def textual(page: str) -> Iterator[tuple[str, float, dict]]:
    rows = [[plain(c) for c in _CELL.findall(r)] for r in _ROW.findall(page)]
    if len(rows) > 1:
        roles = [next((f for f, p in ROLES.items() if re.search(p, h, re.I)), None) for h in rows[0]]
        if "title" in roles and "start_date" in roles:
            for r in rows[1:]:
                yield "table", 0.7, {f: v for f, v in zip(roles, r, strict=False) if f and v}
    for block in re.findall(r"<(?:article|section|li|div)[^>]*class=[\"'][^\"']*(?:event|card|talk)[^\"']*[\"'][^>]*>(.{0,1200})", page, re.S | re.I):
        d, h = _DATE.search(plain(block)), re.search(r"<h\d[^>]*>(.*?)</h\d>", block, re.S | re.I)
        if d and h:
            yield "block", 0.5, {"title": plain(h[1]), "start_date": d[1]}


TIERS = (structured, embedded, textual)


def records(page: str) -> list[tuple[str, float, dict]]:
    """Of all tiers up to the first whose surest record reaches PEAK."""
    out: list[tuple[str, float, dict]] = []
    for tier in TIERS:
        out += [r for r in tier(page) if r[2].get("title") and r[1] >= LEAST]
        if max((c for _, c, _ in out), default=0) >= PEAK:
            break
    return out


def extract_fields(pages: DataFrame) -> DataFrame:
    """url, cluster, field, value, confidence, source: one row for each field of each raw record."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url, page in zip(f["url"], f["html"], strict=True):
                for n, (source, conf, fields) in enumerate(records(page or "")):
                    cluster = re.sub(r"[^a-z0-9]+", " ", fields["title"].lower()).strip()[:80] or fields.get("start_date", "")
                    out += [(url, cluster, k, v, conf, source, n) for k, v in fields.items()]
            yield pd.DataFrame(out, columns=["url", "cluster", "field", "value", "confidence", "source", "ord"])

    return pages.select("url", "html").mapInPandas(run, "url string, cluster string, field string, value string, confidence double, source string, ord long")


def merge_fields(fields: DataFrame) -> DataFrame:
    """The surest value of each field of a cluster, first seen on ties (M16), and the records they make."""
    w = Window.partitionBy("url", "cluster", "field").orderBy(F.desc("confidence"), "ord")
    best = fields.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    names = ["title", "start_date", "end_date", "location", "url", "description", "price"]
    wide = best.groupBy(F.col("url").alias("page"), "cluster").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names], F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("source")).alias("sources"))
    return wide


def fingerprint(html):
    """sha1 of the whitespace-squeezed page."""
    return F.sha1(F.trim(F.regexp_replace(html, r"\s+", " ")))
