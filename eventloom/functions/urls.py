"""URL identity: six rules that must not be merged, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels, and query parameters that only track.
MULTI_TLDS = ["co.in", "org.in", "net.in", "ac.in", "gov.in", "edu.in", "res.in", "firm.in", "gen.in", "co.uk", "org.uk", "com.au", "co.jp"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "mc_cid", "mc_eid", "igshid"]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:@]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def event_key(url: Column, provider: Column, title: Column, start: Column) -> Column:
    """Host and path, lower-cased; without a path, the host and a digest of what else names the event."""
    p = F.lower(F.regexp_replace(path(url), r"/+$", ""))
    digest = F.substring(F.sha1(F.concat_ws("|", F.coalesce(provider, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(start.cast("string"), F.lit("")))), 1, 16)
    return F.when(bare_host(url) == "", digest).when(p == "", F.concat(bare_host(url), F.lit("#"), digest)).otherwise(F.concat(bare_host(url), p))


def content_hash(*cols: Column) -> Column:
    """sha256 over all fields, nulls as empty, so that separators stay."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), "\x1f").cast("binary"), 256)


def dedup_url(url: Column) -> Column:
    return F.concat(bare_host(url), F.lower(F.regexp_replace(path(url), r"/+$", "")))


def query_pairs(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")


def crawl_url(url: Column) -> Column:
    """http(s) only: lower-case host, no default port or fragment, no tracking parameters, sorted pairs, path without end slash."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1))
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#:]+:(\d+)", 1)
    keep = F.array_sort(F.filter(query_pairs(url), lambda p: ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    tail = F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise("")
    p = F.regexp_replace(path(url), r"/+$", "")
    at = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(scheme.isin("http", "https") & (host(url) != ""), F.concat(scheme, F.lit("://"), host(url), at, F.when(p == "", "/").otherwise(p), tail))


def registrable_domain(host_or_url: Column) -> Column:
    h = F.when(host_or_url.contains("://"), bare_host(host_or_url)).otherwise(F.regexp_replace(F.lower(host_or_url), r"^www\.", ""))
    two, three = F.substring_index(h, ".", -2), F.substring_index(h, ".", -3)
    return F.when(two.isin(*MULTI_TLDS), three).otherwise(two)


def links(html: Column) -> Column:
    """href targets in order, distinct."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"'#]+)"), F.lit(1)))


def feeds(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*type=[\"'](application/(?:rss|atom)\+xml|text/calendar)[\"']"), F.lit(1)))


def encode_cursor(start: Column, key: Column) -> Column:
    raw = F.base64(F.concat_ws("|", start.cast("string"), key).cast("binary"))
    return F.translate(F.regexp_replace(raw, r"\s", ""), "+/", "-_")


def decode_cursor(cursor: Column) -> Column:
    padded = F.rpad(cursor, ((F.length(cursor) + 3) / 4).cast("int") * 4, "=")
    return F.split(F.unbase64(F.translate(padded, "-_", "+/")).cast("string"), r"\|", 2)
