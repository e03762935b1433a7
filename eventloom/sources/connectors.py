"""Landed payloads to event rows (S01-S12): each connector is a projection of a typed JSON frame.

Fetching is not Spark's work; payloads are read from files with declared schemas. A row without
name, url or start is dropped, as the validation of the original drops it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import category, detect_city, normalize_city

FIELDS = ["title", "description", "url", "city", "location", "is_online", "start_date", "end_date", "category", "is_free", "price", "provider"]


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def event(df: DataFrame, provider: str, **cols: Column) -> DataFrame:
    base = {f: _null({"is_online": "boolean", "is_free": "boolean", "start_date": "date", "end_date": "date"}.get(f, "string")) for f in FIELDS} | {"is_online": F.lit(False), "provider": F.lit(provider)}
    out = df.select(*[(cols.get(f) if f in cols else base[f]).alias(f) for f in FIELDS])
    valid = (F.trim("title") != "") & F.col("url").rlike("^https?://[^/ ]+") & F.col("start_date").isNotNull()
    return out.filter(F.coalesce(valid, F.lit(False)))


def ist_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.try_to_timestamp(ts), "Asia/Kolkata"))


def squeeze(c: Column, n: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def iso(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def conference_list(df: DataFrame, country: str = "India") -> DataFrame:
    """Name, url, startDate, endDate, city, country, online."""
    d = df.filter(F.col("country") == country).dropDuplicates(["url"])
    start, end = iso(F.col("startDate")), iso(F.col("endDate"))
    return event(d, "confs.tech", title=F.col("name"), url=F.col("url"), city=normalize_city(F.col("city")), is_online=F.coalesce("online", F.lit(False)), start_date=start, end_date=F.when(end != start, end), category=F.lit("conference"))


def search_hits(df: DataFrame) -> DataFrame:
    """Hits.hits[]._source of a search API; dates in Indian time."""
    h = df.select(F.explode("hits.hits").alias("h")).select("h._source.*").dropDuplicates(["uuid"])
    return event(h, "devfolio", title=F.col("name"), description=squeeze(F.col("desc")), url=F.concat(F.lit("https://"), F.col("slug"), F.lit(".devfolio.co")), city=normalize_city(F.col("city")), location=F.col("location"), is_online=F.coalesce("is_online", F.lit(False)), start_date=ist_date(F.col("starts_at")), end_date=ist_date(F.col("ends_at")), category=F.lit("hackathon"), is_free=F.lit(True))


def chapter_events(df: DataFrame, provider: str, kind: str, today: Column) -> DataFrame:
    """Paged results of a chapter platform, newest first; the early stop is a filter."""
    r = df.select(F.explode("results").alias("r")).select("r.*")
    start = ist_date(F.col("start_date"))
    return event(r, provider, title=F.col("title"), description=squeeze(F.col("description_short")), url=F.col("url"), city=normalize_city(F.col("chapter.city")), location=F.col("chapter.chapter_location"), start_date=start, end_date=ist_date(F.col("end_date")), category=category(F.col("title"), F.lit(kind))).filter(F.col("start_date") >= today)


CHAPTERS = {"gdg": "meetup", "cncf": "meetup", "atlassian": "meetup", "salesforce": "meetup", "snowflake": "meetup"}


def period(text: Column) -> tuple[Column, Column]:
    """'MMM DD - [MMM ]DD, YYYY' or 'MMM DD, YYYY' to start and end."""
    year = F.regexp_extract(text, r"(\d{4})", 1)
    m1, d1 = F.regexp_extract(text, r"^([A-Z][a-z]{2}) (\d{1,2})", 1), F.regexp_extract(text, r"^([A-Z][a-z]{2}) (\d{1,2})", 2)
    m2, d2 = F.regexp_extract(text, r"- (?:([A-Z][a-z]{2}) )?(\d{1,2})", 1), F.regexp_extract(text, r"- (?:([A-Z][a-z]{2}) )?(\d{1,2})", 2)
    at = lambda m, d: F.to_date(F.try_to_timestamp(F.concat_ws(" ", m, d, year), F.lit("MMM d yyyy")))
    start = at(m1, d1)
    return start, F.when(d2 != "", at(F.when(m2 == "", m1).otherwise(m2), d2)).otherwise(start)


def hackathon_pages(df: DataFrame) -> DataFrame:
    """S04."""
    h = df.select(F.explode("hackathons").alias("h")).select("h.*").filter(F.col("open_state").isin("open", "upcoming"))
    start, end = period(F.col("submission_period_dates"))
    return event(h, "devpost", title=F.col("title"), url=F.col("url"), location=F.col("displayed_location.location"), city=detect_city(F.col("displayed_location.location")), is_online=F.col("displayed_location.icon") == "globe", start_date=start, end_date=end, category=F.lit("hackathon"))


def rest_rows(df: DataFrame, site: str) -> DataFrame:
    """Rows of a REST resource; free is what is not paid, unknown where that is unknown."""
    kinds = F.when(F.lower("event_type").contains("hack"), "hackathon").when(F.lower("event_type").contains("conf"), "conference").when(F.lower("event_type").contains("workshop"), "workshop").otherwise("meetup")
    return event(df, "fossunited", title=F.col("event_name"), url=F.concat(F.lit(site.rstrip("/") + "/"), F.col("route")), location=F.col("event_location"), city=detect_city(F.col("event_location")), start_date=iso(F.col("event_start_date")), end_date=iso(F.col("event_end_date")), category=kinds, is_free=F.when(F.col("is_paid_event").isNotNull(), F.col("is_paid_event") == 0))


def opportunities(df: DataFrame, kind: str, today: Column) -> DataFrame:
    """Closed ones go, titles must be technical, a missing start is the end."""
    tech = r"(?i)hack|code|coding|ai|ml|data|cloud|web|dev|tech|robot|cyber|program"
    d = df.filter((F.lower(F.coalesce("status", F.lit(""))) != "closed") & F.col("title").rlike(tech))
    end = iso(F.col("end_date"))
    return event(d, "unstop", title=F.col("title"), url=F.concat(F.lit("https://unstop.com/"), F.col("public_url")), city=normalize_city(F.col("city")), start_date=F.coalesce(iso(F.col("start_date")), end), end_date=end, category=F.lit(kind)).filter(F.coalesce("end_date", "start_date") >= today)


def json_in_html(html: Column, marker: str) -> Column:
    """Body of the script of that id, as text for from_json."""
    return F.regexp_extract(html, rf"(?is)<script[^>]*(?:id|type)=[\"']{marker}[\"'][^>]*>(.*?)</script>", 1)


def calendar(df: DataFrame, provider: str) -> DataFrame:
    """iCalendar texts (source, city, body): unfolded, one row for each VEVENT with summary, url and start."""
    unfolded = F.regexp_replace("body", r"\r?\n[ \t]", "")
    ev = df.select("city", F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("v"))
    get = lambda k: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract("v", rf"(?m)^{k}(?:;[^:\n]*)?:(.*)$", 1)), r"\\[nN]", " "), r"\\([,;\\])", "$1")
    day = lambda k: F.to_date(F.try_to_timestamp(F.substring(get(k), 1, 8), F.lit("yyyyMMdd")))
    blank = lambda c: F.when(c != "", c)
    return event(ev, provider, title=get("SUMMARY"), description=blank(squeeze(get("DESCRIPTION"))), url=get("URL"), city=F.coalesce("city", detect_city(get("LOCATION"))), location=blank(get("LOCATION")), start_date=day("DTSTART"), end_date=day("DTEND"), category=category(get("SUMMARY"), F.lit("meetup")))


def search_results(df: DataFrame) -> DataFrame:
    """Anchors of a result page: query, rank, url (redirects decoded), title."""
    rows = df.select("query", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<a[^>]*class=[\"'][^\"']*result__a[^\"']*[\"'][^>]*href=[\"']([^\"']+)[\"'][^>]*>.*?</a>"), F.lit(0))).alias("i", "a"))
    href = F.regexp_extract("a", r"(?i)href=[\"']([^\"']+)", 1)
    inner = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return rows.select("query", (F.col("i") + 1).alias("rank"), F.when(inner != "", F.url_decode(inner)).otherwise(href).alias("url"), F.trim(F.regexp_replace("a", r"<[^>]+>", "")).alias("title"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """One catalog of several sources; a source that cannot be read is left out by its reader."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
