"""Discovery scalars and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.confidence import clamp, num
from eventloom.functions.text import literal_map

# Parser by feed, page templates of seeds, weights of social sources.
PROVIDER_TYPES = {"rss": "rss", "atom": "atom", "ics": "ics", "google_calendar": "ics", "json_feed": "json_feed", "jsonld_event": "jsonld", "next_data": "next_data", "json_api": "json_api", "graphql": "graphql", "ai_extracted": "ai_assisted", "search_result": "crawl_pending"}
HOSTS = {
    "chapter_sibling": ["https://gdg.community.dev/%s/", "https://www.meetup.com/%s/"], "series_instance": ["https://%s.dev/", "https://www.meetup.com/%s/"],
    "sponsor_program": ["https://developers.google.com/community/%s", "https://%s.dev/"], "university_unit": ["https://%s.ac.in/", "https://%s.edu/"],
    "venue_unit": ["https://%s.ac.in/", "https://%s.com/"], "similar_organizer": ["https://%s.dev/", "https://www.meetup.com/%s/"],
}
SOCIAL = {"organizer_reputation": 0.20, "tech_relevance": 0.25, "public_accessibility": 0.15, "structured_data": 0.20, "freshness": 0.10, "historical_yield": 0.10}


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def query_matrix(platforms: DataFrame, cities: DataFrame, technologies: DataFrame) -> DataFrame:
    """site:platform city technology, spaces squeezed, distinct (J13). Three small dimensions, crossed on purpose."""
    q = F.concat_ws(" ", F.concat(F.lit("site:"), "platform"), "city", "technology")
    return platforms.crossJoin(F.broadcast(cities)).crossJoin(F.broadcast(technologies)).select(F.trim(F.regexp_replace(q, r"\s+", " ")).alias("query")).distinct()


def gap_query(city: Column, tech: Column) -> Column:
    return F.when(city.isNotNull(), F.concat(F.lit("site:meetup.com "), city, F.lit(" "), tech)).otherwise(F.concat(tech, F.lit(" conference India")))


def organization_hint(domain: Column) -> Column:
    """First label: short ones in capitals."""
    label = F.substring_index(F.regexp_replace(domain, r"^www\.", ""), ".", 1)
    return F.when(F.length(label) <= 4, F.upper(label)).otherwise(F.initcap(label))


def candidate_urls(kind: Column, target: Column) -> Column:
    """Pages to check for a seed."""
    slug = slugify(target)
    built = F.transform(F.coalesce(F.try_element_at(literal_map(HOSTS), kind), F.array().cast("array<string>")), lambda h: F.replace(h, F.lit("%s"), slug))
    direct = F.when(target.contains("://"), F.array(target)).when(target.contains(".") & ~target.contains(" "), F.array(F.concat(F.lit("https://"), target))).otherwise(F.array(F.concat(F.lit("https://"), slug, F.lit(".dev/"))))
    return F.when(kind == "connected_resource", direct).otherwise(built)


def promotion(feed: Column, events: Column, india: Column, total: Column) -> Column:
    """Parser, volume, refresh hours, first backoff and risk of a promoted source."""
    volume = F.when(events >= 20, "high").when(events >= 5, "medium").otherwise("low")
    unproven = feed.isin("search_result", "unknown")
    factors = F.array_compact(F.array(F.when(unproven, "unproven source type"), F.when(feed.isin("ai_extracted", "json_api", "graphql"), "needs validation/probing before ingestion"), F.when(events == 0, "no event evidence"), F.when(india < 0.5, "weak India relevance"), F.when(total < 0.5, "low onboarding confidence")))
    return F.struct(
        F.coalesce(F.try_element_at(literal_map(PROVIDER_TYPES), feed), F.lit("manual")).alias("provider_type"), volume.alias("volume"), F.when(events >= 20, 6).when(events >= 5, 12).otherwise(24).alias("refresh_hours"),
        F.when(events >= 20, 120).when(events >= 5, 300).otherwise(600).alias("backoff_seconds"), F.when(unproven | (events == 0) | (total < 0.5), "high").when(F.size(factors) > 0, "medium").otherwise("low").alias("risk"), factors.alias("factors"),
    )


def social_priority(reputation: Column, tech: Column, public: Column, title_conf: Column, date_known: Column, yield_: Column) -> Column:
    parts = {"organizer_reputation": clamp(reputation), "tech_relevance": clamp(tech), "public_accessibility": num(public), "structured_data": F.when(title_conf >= 0.9, 1.0).when(title_conf > 0, 0.5).otherwise(0.0), "freshness": F.when(date_known, 0.7).otherwise(0.0), "historical_yield": clamp(yield_)}
    return F.bround(sum((w * parts[k] for k, w in SOCIAL.items()), F.lit(0.0)), 4)


def endpoint_confidence(best: Column, api: Column, graphql: Column, feed: Column, framework: Column) -> Column:
    """What the evidence on a rendered page is worth."""
    total = F.when(best > 0, 0.4 + F.least(F.lit(0.2), best / 50 * 0.2)).otherwise(0.0) + F.when(api, 0.3).when(graphql, 0.2).otherwise(0.0) + F.when(feed, 0.15).otherwise(0.0) + F.when(framework, 0.1).otherwise(0.0)
    return F.bround(F.least(F.lit(1.0), total), 4)


def sitemap_locs(xml: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>(.*?)</loc>"), F.lit(1)), F.trim))


def vcs_org(url: Column) -> Column:
    """Organisation of a code host's url, but for pages that are none (P10)."""
    org = F.regexp_extract(url, r"(?i)^https?://(?:www\.)?(?:github|gitlab)\.com/([A-Za-z0-9-]+)", 1)
    return F.when((org != "") & ~F.lower(org).isin("about", "features", "login", "join", "explore", "topics", "marketplace", "pricing", "orgs", "sponsors", "settings", "search", "collections", "events"), org)


def login_wall(html: Column) -> Column:
    """Reasons why a social page is not safe to use."""
    return F.array_compact(F.array(F.when(html.rlike(r"(?i)(log ?in|sign ?in) to (continue|view|see)|you must be logged in"), "login wall"), F.when(html.rlike(r"(?i)captcha|verify you are human"), "bot check")))
