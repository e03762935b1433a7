"""Organiser identity and structure as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import labels, literal_map

# Abbreviations, plurals, filler, and the tables of families, series, units and cadences.
ABBREVIATIONS = {
    "gdg": "google developer group", "gdgs": "google developer group", "gdsc": "google developer student club", "gdscs": "google developer student club", "dsc": "developer student club",
    "sb": "student branch", "ug": "user group", "tfug": "tensorflow user group", "coe": "center of excellence", "k8s": "kubernetes", "pug": "python user group", "lug": "linux user group",
    "csi": "computer society of india", "ecell": "entrepreneurship cell", "icell": "innovation cell", "awsug": "aws user group",
}
PLURALS = {"developers": "developer", "groups": "group", "clubs": "club", "chapters": "chapter", "societies": "society", "communities": "community", "labs": "lab", "branches": "branch"}
FILLER = "the of for and a an student branch chapter group club society user community official presents by at in".split()
FAMILIES = {
    "gdsc": r"\bgdsc\b|google developer student club", "gdg": r"\bgdg\b|google developers? group", "ieee": r"\bieee\b", "acm": r"\bacm\b", "csi": r"\bcsi\b|computer society of india", "mozilla": r"mozilla|\bmoz\b",
    "aws_ug": r"aws user group|\baws ug\b|awsug", "kubernetes": r"kubernetes|kcd\b|k8s", "cncf": r"cloud native|cncf", "pydata": "pydata", "pyladies": "pyladies", "tfug": r"tfug|tensorflow user group",
    "reactjs": r"\breact\b|reactjs", "rust": r"\brust\b", "linux": r"\blug\b|linux user group|\blinux\b", "fossunited": r"foss united|fossunited", "pythonuser": r"python user group|\bpug\b", "devops": r"devops days|\bdevopsdays\b",
}
SERIES = {
    "DevFest": ("devfest", "annual"), "Build with AI": ("build with ai", "quarterly"), "Hacktoberfest": ("hacktoberfest", "annual"), "Cloud Community Day": ("cloud community day", "annual"),
    "Google Cloud Arcade": ("cloud arcade|arcade facilitator", "quarterly"), "PyCon": (r"\bpycon\b", "annual"), "FOSS Meetup": ("foss meetup", "monthly"), "Study Jam": ("study jam", "quarterly"),
    "Monthly Meetup": ("monthly meetup", "monthly"), "Weekly Workshop": ("weekly workshop", "weekly"),
}
UNITS = {
    "student chapter": r"student chapter|student branch|\bsb\b", "club": r"\bclub\b|\bcell\b", "department": r"department|\bdept\.?\b|school of", "innovation cell": r"innovation cell|i-?cell|entrepreneurship cell|e-?cell",
    "incubator": r"incubat(?:or|ion)", "center of excellence": r"center of excellence|centre of excellence|\bcoe\b",
}
CADENCES = {"weekly": r"\bweekly\b|every week", "monthly": r"\bmonthly\b|every month|each month", "quarterly": r"\bquarterly\b|every quarter", "annual": r"\bannual\b|\byearly\b|every year"}
CADENCE_DAYS = {"weekly": 7, "monthly": 31, "quarterly": 93, "annual": 366}
SPONSOR = r"(?i)(?:sponsored by|in partnership with|powered by)\s+([A-Z][\w& ]{1,39})"
UNIVERSITY = r"\b(?:IIT|NIT|IIIT|BITS|VIT|SRM|MUJ|Manipal|university|college|institute of technology|institute)\b"


def canonical_tokens(name: Column) -> Column:
    """Distinct, sorted words of identity: abbreviations spelled out, plurals and filler gone (X11)."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\w\s]", " "), r"\s+"), lambda w: w != "")
    full = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(literal_map(ABBREVIATIONS), w), w), " ")))
    single = F.transform(full, lambda w: F.coalesce(F.try_element_at(literal_map(PLURALS), w), w))
    return F.array_sort(F.array_distinct(F.filter(single, lambda w: ~w.isin(*FILLER))))


def canonical_key(name: Column) -> Column:
    return F.array_join(canonical_tokens(name), " ")


def same_organizer(a: Column, b: Column, least: float = 0.6) -> Column:
    x, y = canonical_tokens(a), canonical_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) >= least)


def alias_groups(names: DataFrame) -> DataFrame:
    """key, names: sorted surface forms of each identity."""
    return names.select(canonical_key(F.col("name")).alias("key"), F.trim("name").alias("name")).filter("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"))


def chapters(text: Column) -> Column:
    return labels(text, FAMILIES)


def series(text: Column) -> Column:
    return labels(text, {k: p for k, (p, _) in SERIES.items()})


def university_units(text: Column) -> Column:
    return labels(text, UNITS)


def cadence(text: Column) -> Column:
    """A stated cadence before the most frequent one of the series found."""
    said = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(c)) for c, p in CADENCES.items()])
    found = F.transform(series(text), lambda s: F.element_at(literal_map({k: c for k, (_, c) in SERIES.items()}), s))
    return F.coalesce(said, _mode(found), F.lit("unknown"))


def _mode(a: Column) -> Column:
    """Most frequent value of an array, first seen on ties."""
    counted = F.transform(F.array_distinct(a), lambda v, i: F.struct(F.size(F.filter(a, lambda x: x == v)).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(counted)["v"]


def sponsors(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(SPONSOR), F.lit(1)), lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", ""))


def is_university(text: Column) -> Column:
    return text.rlike(f"(?i){UNIVERSITY}")


def health(dates: DataFrame, now: Column) -> DataFrame:
    """id, state, next, chance from (id, cadence, d): by the cadence's period, else the median positive gap, else 45 days."""
    from pyspark.sql import Window

    gap = F.datediff("d", F.lag("d").over(Window.partitionBy("id").orderBy("d")))
    g = dates.withColumn("gap", gap).groupBy("id", "cadence").agg(F.max("d").alias("last"), F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("median"))
    period = F.coalesce(F.try_element_at(literal_map(CADENCE_DAYS), F.col("cadence")).cast("double"), F.col("median"), F.lit(45.0))
    g = g.withColumns({"period": period, "age": F.datediff(now, F.col("last"))})
    sparse = F.col("cadence").isin("annual", "quarterly")
    state = (
        F.when(F.col("age") < 0, "active").when(F.col("n") == 1, F.when(F.col("age") <= 2 * F.col("period"), "new").otherwise("inactive")).when(F.col("age") <= 1.5 * F.col("period"), "active")
        .when(sparse & (F.col("age") <= 2 * F.col("period")), "seasonal").when(F.col("age") <= 3 * F.col("period"), "dormant").otherwise("inactive")
    )
    chance = F.when(F.col("age") < 0.75 * F.col("period"), "low").when(F.col("age") <= 2 * F.col("period"), "high").otherwise("medium")
    return g.select("id", state.alias("state"), F.date_add("last", F.floor("period").cast("int")).alias("next"), chance.alias("chance"))


def page_profile(pages: DataFrame) -> DataFrame:
    """url and the fields of an organiser's page: name, chapters, series, cadence, units, sponsors, link classes."""
    from eventloom.functions.text import strip_tags
    from eventloom.functions.urls import feeds, links

    text, hrefs = strip_tags(F.col("html")), links(F.col("html"))
    of = lambda p: F.filter(hrefs, lambda h: h.rlike(p))
    name = F.coalesce(*[F.when(x != "", x) for x in (F.regexp_extract("html", r"(?is)property=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']+)", 1), F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>([^<]+)", 1)), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]+)", 1)))])
    return pages.select(
        "url", name.alias("name"), chapters(text).alias("chapters"), series(text).alias("series"), cadence(text).alias("cadence"), university_units(text).alias("units"), sponsors(text).alias("sponsors"),
        of(r"(?i)//(?:www\.)?(?:twitter|x|linkedin|facebook|instagram|youtube|github)\.com").alias("social"), of(r"(?i)\.ics\b|calendar\.google").alias("calendars"), feeds(F.col("html")).alias("feeds"), of(r"(?i)(?:discord\.(?:gg|com)|t\.me|notion\.so)").alias("chats"),
    )


# Hosts of social platforms, in order.
PLATFORMS = {"github": r"github\.com", "discord": r"discord\.(?:gg|com)", "telegram": r"//t\.me", "linkedin": r"linkedin\.com", "notion": r"notion\.(?:so|site)", "forum": r"forum|discourse|community\.", "blog": r"blog|medium\.com|dev\.to|hashnode"}


def platform(url: Column) -> Column:
    """Which kind of social page a url is; the first that fits."""
    return F.coalesce(*[F.when(url.rlike(f"(?i){p}"), F.lit(k)) for k, p in PLATFORMS.items()])
