"""Free text to a structured query, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# City aliases of a query, words that name a category, and words that are no keywords.
QUERY_CITIES = {
    "bangalore": "Bangalore", "bengaluru": "Bangalore", "mumbai": "Mumbai", "bombay": "Mumbai", "pune": "Pune", "delhi": "Delhi", "new delhi": "Delhi", "hyderabad": "Hyderabad", "chennai": "Chennai", "madras": "Chennai",
    "kolkata": "Kolkata", "calcutta": "Kolkata", "gurgaon": "Gurgaon", "gurugram": "Gurgaon", "noida": "Noida", "ahmedabad": "Ahmedabad", "jaipur": "Jaipur", "kochi": "Kochi", "chandigarh": "Chandigarh",
}
TRIGGERS = {
    "hackathon": r"hackathons?", "workshop": r"workshops?", "webinar": r"webinars?", "meetup": r"meet\s?ups?", "conference": r"conferences?|\bconf\b|summits?", "startup": r"startups?",
    "ai": r"\bai\b|\bml\b|machine learning|artificial intelligence|deep learning|\bllms?\b|generative ai|gen ai",
}
TRIGGER_WORDS = "hackathon hackathons workshop workshops webinar webinars meetup meetups conference conferences conf summit summits startup startups ai ml".split()
STOP_WORDS = "in on at the a an for this next near me of to and or happening around find show events event upcoming by with some any is are there".split()
NO_KEYWORDS = sorted({*STOP_WORDS, *TRIGGER_WORDS, "free", *(w for alias in QUERY_CITIES for w in alias.split())})


def parse_query(text: Column) -> Column:
    """Struct of keywords, city, categories and free_only (R26); the longest city alias wins."""
    low = F.trim(F.lower(text))
    aliases = sorted(QUERY_CITIES, key=len, reverse=True)
    city = F.coalesce(*[F.when(low.rlike(rf"\b{a}\b"), F.lit(QUERY_CITIES[a])) for a in aliases])
    categories = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(c)) for c, p in TRIGGERS.items()]))
    tokens = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9+#]+)"), F.lit(1)), lambda t: F.length(t) > 1)
    keywords = F.array_except(F.array_distinct(tokens), F.array(*[F.lit(w) for w in NO_KEYWORDS]))
    return F.struct(keywords.alias("keywords"), city.alias("city"), categories.alias("categories"), low.rlike(r"\bfree\b").alias("free_only"))


_SHAPE = "struct<keywords:array<string>,city:string,categories:array<string>,free_only:boolean>"


def parse_with_model(text: Column, answers: Column) -> Column:
    """A model's parse with the rules as its fallback (R27). answers: its attempts as JSON, in order; the first that
    is whole and names known categories only is taken."""
    known = F.array(*[F.lit(c) for c in TRIGGERS])
    tries = F.transform(answers, lambda a: F.from_json(a, _SHAPE))
    good = F.filter(tries, lambda q: q["keywords"].isNotNull() & q["categories"].isNotNull() & q["free_only"].isNotNull() & (F.size(F.array_except(q["categories"], known)) == 0))
    return F.coalesce(F.try_element_at(good, F.lit(1)), parse_query(text))


def cache_key(query: Column) -> Column:
    """Equal queries have equal keys, whatever the order of their lists."""
    return F.to_json(F.struct(F.array_sort(query["categories"]).alias("categories"), F.coalesce(query["city"], F.lit("")).alias("city"), query["free_only"].alias("free_only"), F.array_sort(query["keywords"]).alias("keywords")))


# Source classes with their markers and confidence.
CLASSES = {
    "university": (r"\buniversity\b|\bcollege\b|\binstitute\b|student branch|campus|\.edu\b|\.ac\.in", 0.85), "government": (r"\bministry\b|\bgovernment\b|\bgovt\b|gov\.in|nic\.in|municipal", 0.85),
    "community": (r"\bcommunity\b|user group|\bchapter\b|meetup group|\bgdg\b|foss united|pydata", 0.8), "conference": (r"\bconference\b|\bsummit\b|\bconf\b|rootconf|pycon", 0.8), "meetup": (r"\bmeetups?\b|user group", 0.8),
    "hackathon": (r"\bhackathons?\b|devfolio|hack\b", 0.85), "webinar": (r"\bwebinars?\b|online session|virtual event", 0.75), "workshop": (r"\bworkshops?\b|\bbootcamp\b|hands-?on", 0.75),
    "startup": (r"\bstartups?\b|\bfounders?\b|accelerator|incubator|pitch|demo day", 0.75), "product": (r"product launch|product demo|our platform|\bsaas\b|launch event", 0.7),
    "open_source": (r"open source|\boss\b|\bfoss\b|github\.com|apache|linux foundation", 0.8), "company": (r"\bpvt\.?\s*ltd\b|\binc\.?\b|we are hiring|\bcareers\b|engineering team", 0.65),
}


def source_classes(text: Column, technologies: Column) -> Column:
    """Array of struct(confidence, label), surest first, by name on ties."""
    low, n = F.lower(text), F.size(technologies)
    tech = F.when(n > 0, F.struct(-F.bround(F.least(F.lit(1.0), 0.5 + n * 0.2), 3), F.lit("tech"))).otherwise(F.struct(F.lit(-0.6), F.lit("non_tech")))
    rules = [F.when(low.rlike(p), F.struct(F.lit(-c), F.lit(k))) for k, (p, c) in CLASSES.items()]
    return F.transform(F.array_sort(F.array_compact(F.array(tech, *rules))), lambda s: F.struct((-s["col1"]).alias("confidence"), s["col2"].alias("label")))


def freshness_flags(now: Column, recent_days: int = 7, soon_days: int = 14, ending_days: int = 7) -> dict[str, Column]:
    """recently_added, recently_updated, trending_soon, ending_soon."""
    age = lambda c: (F.unix_micros(now) - F.unix_micros(c)) <= recent_days * 86_400_000_000
    ahead = lambda c: F.datediff(c, F.to_date(now))
    last = F.coalesce("end_date", "start_date")
    return {
        "recently_added": age(F.col("first_seen_at")), "recently_updated": (F.col("version") > 1) & age(F.col("last_seen_at")),
        "trending_soon": ahead(F.col("start_date")).between(0, soon_days), "ending_soon": ahead(last).between(0, ending_days),
    }


def preference(weights: Column, one: str, other: str) -> Column:
    """The one of two features whose weight is larger and above 0, else any (P19). weights: map of feature to weight."""
    a, b = (F.coalesce(F.try_element_at(weights, F.lit(x)), F.lit(0.0)) for x in (one, other))
    name = lambda x: x.split(":", 1)[1]
    return F.when((a > b) & (a > 0), name(one)).when((b > a) & (b > 0), name(other)).otherwise("any")


def window_globals(html: Column) -> Column:
    """Names that scripts set on window, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"window\.([A-Za-z_$][\w$]*)\s*="), F.lit(1)))


def provenance(value: Column, snippet: Column, confidence: Column, method: str, inferred: bool = False) -> Column:
    """A value with where it comes from: snippet of at most 200 characters, confidence within 0..1 to three places."""
    return F.struct(value.alias("value"), F.left(snippet, F.lit(200)).alias("snippet"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 3).alias("confidence"), F.lit(method).alias("method"), F.lit("inferred" if inferred else "known").alias("status"))


def slug(name: Column) -> Column:
    """Lower case, one hyphen for what is no letter or numeral."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def ics_date(value: Column) -> Column:
    """yyyymmdd, with or without a time, as a date."""
    return F.try_to_date(F.regexp_extract(value, r"^(\d{8})", 1), "yyyyMMdd")


def render_path(kinds: Column, relations: Column, names: Column) -> Column:
    """`kind:name -[relation]-> kind:name ...` (G07); relations is shorter by one."""
    nodes = F.zip_with(kinds, names, lambda k, n: F.concat(k, F.lit(":"), n))
    steps = F.zip_with(relations, F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))), lambda r, n: F.concat(F.lit(" -["), r, F.lit("]-> "), n))
    return F.concat(nodes[0], F.array_join(steps, ""))

