"""Crawl planning over stored pages (S19-S21, F15, R16): frontier loops, budgets, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.urls import crawl_url, links, registrable_domain


def page_links(pages: DataFrame) -> DataFrame:
    """source, target: normalised links of each page."""
    resolved = F.when(F.col("href").rlike("^[a-zA-Z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+", 0), F.col("href")))
    return pages.select("url", F.explode(links(F.col("html"))).alias("href")).select(crawl_url(F.col("url")).alias("source"), crawl_url(resolved).alias("target")).filter("target is not null").distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, checkpoint=lambda df: df) -> DataFrame:
    """url, depth: pages within `depth` links of the seeds; each round joins the frontier with the edges and drops what was visited."""
    visited = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = visited
    for d in range(1, depth + 1):
        nxt = frontier.join(edges, frontier["url"] == edges["source"]).select(F.col("target").alias("url")).distinct()
        frontier = checkpoint(nxt.join(visited, "url", "left_anti").withColumn("depth", F.lit(d)))
        visited = checkpoint(visited.union(frontier))
    return visited


def frontier(candidates: DataFrame, per_domain: int) -> DataFrame:
    """Best first within each domain's budget."""
    w = Window.partitionBy("domain").orderBy(F.desc("priority"), "url")
    return candidates.withColumn("domain", registrable_domain(F.col("url"))).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_domain)


def scope(domain: Column, depth: Column, *, blocked: list[str], allowed: list[str], trusted: list[str], most: int) -> Column:
    """block > depth > allow > trusted > out."""
    return F.when(domain.isin(*blocked), "blocked").when(depth > most, "too_deep").when(domain.isin(*allowed), "allowed").when(domain.isin(*trusted), "trusted").otherwise("out_of_scope")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """domain, allow, prefix: the rules of the agent's group, or of *, in a robots.txt."""
    lines = files.select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("i", "line")).select("domain", "i", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).filter("line <> ''")
    kv = lines.select("domain", "i", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("v"))
    w = Window.partitionBy("domain").orderBy("i")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    g = kv.withColumn("g", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    groups = g.filter("k = 'user-agent'").select("domain", "g", F.lower("v").alias("ua"))
    mine = groups.filter((F.col("ua") == agent.lower()) | (F.col("ua") == "*")).withColumn("own", F.col("ua") == agent.lower())
    best = mine.groupBy("domain").agg(F.max("own").alias("own"))
    chosen = mine.join(best, ["domain", "own"]).select("domain", "g").distinct()
    rules = g.filter(F.col("k").isin("allow", "disallow") & (F.col("v") != "")).join(chosen, ["domain", "g"])
    return rules.select("domain", (F.col("k") == "allow").alias("allow"), F.col("v").alias("prefix"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: the longest matching prefix decides, ties allow, no match allows (S21). Rules meet the urls of their own domain only."""
    hit = urls.join(rules, "domain", "left").filter("prefix is null or startswith(path, prefix)")
    got = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix").alias("n"), F.col("allow"))).alias("a"))
    return urls.select("url").join(got, "url", "left").select("url", F.coalesce("a", F.lit(True)).alias("allowed"))
