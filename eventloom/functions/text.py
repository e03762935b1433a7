"""Text scalars as Columns: cities, titles, names, taxonomy, dates. All JVM-side."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# City aliases and their canonical names.
CITIES = {
    "bengaluru": "Bangalore", "bangalore": "Bangalore", "bombay": "Mumbai", "mumbai": "Mumbai", "gurugram": "Gurgaon", "gurgaon": "Gurgaon",
    "new delhi": "Delhi", "delhi": "Delhi", "madras": "Chennai", "chennai": "Chennai", "calcutta": "Kolkata", "kolkata": "Kolkata",
    "cochin": "Kochi", "kochi": "Kochi", "trivandrum": "Thiruvananthapuram", "thiruvananthapuram": "Thiruvananthapuram", "pune": "Pune",
    "hyderabad": "Hyderabad", "noida": "Noida", "ahmedabad": "Ahmedabad", "jaipur": "Jaipur", "chandigarh": "Chandigarh", "goa": "Goa",
}
# Topics and technologies with their patterns, in output order.
TOPICS = {
    "Artificial Intelligence": r"\ba\.?i\.?\b|artificial intelligence", "Machine Learning": r"machine learning|\bml\b|\bmlops\b",
    "LLMs": r"\bllms?\b|large language model|\bgpt\b|chatgpt", "Generative AI": r"generative ai|gen ?ai|\bgenai\b|diffusion model|\bgemma\b",
    "Data Science": r"data science|data scientist|data engineering|big data|\banalytics\b", "Cloud": r"\bcloud\b|serverless",
    "DevOps": r"\bdevops\b|ci ?/ ?cd|\bcicd\b|site reliability|\bsre\b", "Kubernetes": r"kubernetes|\bk8s\b|cloud native",
    "Backend": r"\bbackend\b|back[- ]end|server[- ]side|microservices?", "Frontend": r"\bfrontend\b|front[- ]end|\breact\b|\bangular\b|\bvue\b",
    "Mobile": r"\bmobile\b|\bandroid\b|\bios\b|\bflutter\b|react native", "Cybersecurity": r"cyber ?security|infosec|\bpentest|ethical hack|application security",
    "Blockchain": r"blockchain|\bethereum\b|\bbitcoin\b|smart contract", "Web3": r"\bweb3\b|decentrali[sz]ed|\bdefi\b|\bnfts?\b",
    "Product": r"product management|product manager|\bproduct\b", "Startup": r"start[- ]?ups?|founders?|entrepreneur|pitch|demo day|fundrais",
    "Open Source": r"open ?source|\bfoss\b|\boss\b", "Robotics": r"robotics|\brobots?\b", "IoT": r"\biot\b|internet of things|embedded systems",
    "AR/VR": r"\bar ?/ ?vr\b|augmented reality|virtual reality|metaverse|\bxr\b", "Gaming": r"\bgaming\b|game ?dev|game development",
}
TECHNOLOGIES = {
    "Python": r"\bpython\b", "Java": r"\bjava\b", "JavaScript": r"\bjavascript\b|\bjs\b", "TypeScript": r"\btypescript\b|\bts\b", "React": r"\breact\b",
    "Next.js": r"next\.?js\b", "Node.js": r"node\.?js\b|\bnodejs\b", "Docker": r"\bdocker\b", "Kubernetes": r"kubernetes|\bk8s\b", "TensorFlow": r"tensor ?flow",
    "PyTorch": r"py ?torch", "AWS": r"\baws\b|amazon web services", "Azure": r"\bazure\b", "GCP": r"\bgcp\b|google cloud", "Rust": r"\brust\b", "Go": r"\bgolang\b",
    "Flutter": r"\bflutter\b", "LangChain": r"lang ?chain", "OpenAI": r"open ?ai", "Claude": r"\bclaude\b", "Gemini": r"\bgemini\b|\bgemma\b",
}
# What topics stand for (skills, audiences, careers), words of level, legal forms, communities, organisations.
SKILLS = {
    "Artificial Intelligence": ["AI Engineering"], "Machine Learning": ["Machine Learning", "MLOps"], "LLMs": ["Prompt Engineering", "AI Engineering"],
    "Generative AI": ["Prompt Engineering", "AI Engineering"], "Data Science": ["Data Analysis", "Machine Learning"], "Cloud": ["Cloud Architecture"],
    "DevOps": ["DevOps", "MLOps"], "Kubernetes": ["Cloud Architecture", "DevOps"], "Backend": ["Backend Development"], "Frontend": ["Frontend Development"],
    "Mobile": ["Mobile Development"], "Cybersecurity": ["Security Engineering"], "Startup": ["Product Management", "Leadership"],
    "Product": ["Product Management"], "Open Source": ["Open Source Contribution"],
}
AUDIENCES = {
    "Artificial Intelligence": ["Developers", "Data Scientists"], "Machine Learning": ["Data Scientists", "Researchers"], "LLMs": ["Developers", "Researchers"],
    "Generative AI": ["Developers"], "Data Science": ["Data Scientists"], "Cloud": ["Developers"], "DevOps": ["Developers"], "Kubernetes": ["Developers"],
    "Backend": ["Developers"], "Frontend": ["Developers", "Designers"], "Mobile": ["Developers"], "Cybersecurity": ["Security Engineers"],
    "Startup": ["Founders", "Product Managers"], "Product": ["Product Managers"], "Robotics": ["Researchers"],
}
CAREERS = {
    "Artificial Intelligence": ["AI Engineer"], "Machine Learning": ["ML Engineer", "AI Engineer"], "LLMs": ["AI Engineer"], "Generative AI": ["AI Engineer"],
    "Data Science": ["Data Scientist"], "Cloud": ["Cloud Engineer"], "DevOps": ["DevOps Engineer"], "Kubernetes": ["DevOps Engineer", "Cloud Engineer"],
    "Backend": ["Software Engineer"], "Frontend": ["Software Engineer"], "Mobile": ["Software Engineer"], "Cybersecurity": ["Cybersecurity Engineer"],
    "Startup": ["Founder"], "Product": ["Product Manager"], "Robotics": ["Software Engineer"], "IoT": ["Software Engineer"],
}
BEGINNER = r"\b(beginner|intro(duction)?|101|getting started|basics|fundamentals|no experience|for beginners)\b"
ADVANCED = r"\b(advanced|deep ?dive|expert|internals|in[- ]depth|masterclass)\b"
LEGAL = r"\b(llc|inc|inc\.|ltd|ltd\.|pvt|private|limited|corporation|corp|co|company|foundation|technologies|technology|labs|systems)\b"
COMMUNITY_PATTERNS = {
    "Google Developer Groups": r"\bgdg\b|google developer group", "CNCF": r"\bcncf\b|cloud native", "FOSS United": r"foss ?united",
    "PyData": r"\bpydata\b", "DevOps Days": r"devops ?days", "Women Who Code": r"women who code",
}
PROVIDER_COMMUNITY = {"gdg": "Google Developer Groups", "cncf": "CNCF", "fossunited": "FOSS United", "hasgeek": "Hasgeek"}
ORGANISATIONS = {
    "google": "Google", "microsoft": "Microsoft", "amazon": "Amazon", "aws": "Amazon", "meta": "Meta", "nvidia": "NVIDIA", "ibm": "IBM", "oracle": "Oracle",
    "adobe": "Adobe", "github": "GitHub", "gitlab": "GitLab", "red hat": "Red Hat", "vmware": "VMware", "intel": "Intel", "atlassian": "Atlassian",
    "postman": "Postman", "mongodb": "MongoDB", "hugging face": "Hugging Face", "razorpay": "Razorpay", "flipkart": "Flipkart", "swiggy": "Swiggy",
    "zoho": "Zoho", "freshworks": "Freshworks",
}


def literal_map(d: dict) -> Column:
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return F.create_map(*chain.from_iterable((F.lit(k), lit(v)) for k, v in d.items()))


def normalize_city(c: Column) -> Column:
    """Canonical name of a known alias, else the trimmed input."""
    return F.coalesce(F.try_element_at(literal_map(CITIES), F.lower(F.trim(c))), F.trim(c))


def detect_city(*texts: Column) -> Column:
    """First text that names a city; in it the longest alias wins, wherever it stands."""
    aliases = sorted(CITIES, key=len, reverse=True)
    return F.coalesce(*[F.coalesce(*[F.when(F.lower(t).rlike(rf"\b{a}\b"), F.lit(CITIES[a])) for a in aliases]) for t in texts])


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def normalize_name(c: Column) -> Column:
    """Without legal suffixes and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), LEGAL, " "), "[^a-z0-9]+", " "))


def variants(pattern: str) -> list[tuple[str, bool, bool]] | None:
    """The literals that a pattern of optional characters and small classes stands for, with whether a word
    border must be on their left and right. None for a pattern that has more in it."""
    out = []
    for part in pattern.split("|"):
        left, right = part.startswith(r"\b"), part.endswith(r"\b")
        atoms = re.findall(r"(\[[^\]^]+\]|\\[.+]|[a-z0-9 /.-])(\??)", core := part.removeprefix(r"\b").removesuffix(r"\b"))
        if "".join(x + y for x, y in atoms) != core or any(x == "." for x, _ in atoms):
            return None
        made = [""]
        for atom, optional in atoms:
            letters = list(atom[1:-1]) if atom[0] == "[" else [atom.removeprefix("\\")]
            made = [m + x for m in made for x in letters + [""] * bool(optional)]
        out += [(m, left, right) for m in made]
    return out


_BORDER = r"[^\p{L}\p{N}_]"


def labels(text: Column, table: dict[str, str]) -> Column:
    """Names whose pattern is found, in table order (X05). The text is lower-cased and cut into words once; whole words
    are looked up among these, other literals are searched for, and only what no literal says is left to a regular expression."""
    forms = {n: variants(p) for n, p in table.items()}
    whole = lambda v: v[1] and v[2] and v[0].isalnum()
    every = sorted({v[0] for vs in forms.values() for v in vs or () if whole(v)})

    def said(low: Column, words: Column, name: str) -> Column:
        if forms[name] is None:
            return low.rlike(table[name])
        tests = []
        for v, left, right in forms[name]:
            if whole((v, left, right)):
                tests.append(F.array_contains(words, v))
            elif left or right:
                exact = (rf"(^|{_BORDER})" if left else "") + re.escape(v) + (rf"($|{_BORDER})" if right else "")
                tests.append(F.contains(low, F.lit(v)) & low.rlike(exact))
            elif not any(o in v and o != v for o, *_ in forms[name] if not _[0] and not _[1]):
                tests.append(F.contains(low, F.lit(v)))
        return reduce(lambda a, b: a | b, tests)

    def named(low: Column) -> Column:
        words = F.array_intersect(F.split(low, f"{_BORDER}+"), F.array(*[F.lit(w) for w in every])) if every else F.array()
        return F.transform(F.array(words), lambda w: F.array_compact(F.array(*[F.when(said(low, w, n), F.lit(n)) for n in table])))[0]

    return F.transform(F.array(F.lower(text)), named)[0]


def difficulty(text: Column, category: Column) -> Column:
    """Advanced before beginner before what the category suggests."""
    return F.when(text.rlike(f"(?i){ADVANCED}"), "advanced").when(text.rlike(f"(?i){BEGINNER}"), "beginner").when(category.isin("workshop", "hackathon"), "beginner").otherwise("intermediate")


def _from_topics(topics: Column, table: dict) -> Column:
    return F.flatten(F.transform(topics, lambda t: F.coalesce(F.try_element_at(literal_map(table), t), F.array().cast("array<string>"))))


def skills(topics: Column, category: Column) -> Column:
    extra = F.array_compact(F.array(F.when(category.isin("conference", "meetup"), "Networking"), F.when(category.isin("workshop", "hackathon", "webinar"), "Hands-on Building")))
    return F.array_distinct(F.concat(_from_topics(topics, SKILLS), extra))


def audiences(topics: Column, category: Column, level: Column) -> Column:
    extra = F.concat(F.when(category == "hackathon", F.array(F.lit("Students"), F.lit("Developers"))).otherwise(F.array().cast("array<string>")), F.array_compact(F.array(F.when(level == "beginner", "Students"))))
    found = F.array_distinct(F.concat(_from_topics(topics, AUDIENCES), extra))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Developers")))


def careers(topics: Column) -> Column:
    return F.array_distinct(_from_topics(topics, CAREERS))


def summary(category: Column, city: Column, topics: Column, technologies: Column, people: Column, level: Column) -> Column:
    part = lambda lead, a, n: F.when(F.size(a) > 0, F.concat(F.lit(lead), F.array_join(F.slice(a, 1, n), ", "))).otherwise("")
    return F.concat(F.lit("A "), level, F.lit("-level "), category, part(" on ", topics, 3), part(" featuring ", technologies, 3), part(", aimed at ", people, 2), F.when(F.coalesce(city, F.lit("")) != "", F.concat(F.lit(", in "), city)).otherwise(""), F.lit("."))


def series_name(title: Column, city: Column) -> Column:
    """Title without year, ordinal, edition words and its own city; null under three characters."""
    t = F.regexp_replace(title, r"\b(19|20)\d{2}\b", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\b\d{1,2}(st|nd|rd|th)\b", ""), r"(?i)\b(annual|edition|season|vol|volume)\b", "")
    quoted = F.concat(F.lit(r"(?i)\b\Q"), city, F.lit(r"\E\b"))
    t = F.when(F.coalesce(city, F.lit("")) != "", F.regexp_replace(t, quoted, F.lit(""))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ \-–—:|,]+|[ \-–—:|,]+$", "")
    return F.when(F.length(t) >= 3, t)


def venue(location: Column, city: Column) -> Column:
    v = F.trim(F.split(location, ",")[0])
    return F.when((F.length(v) >= 3) & ~F.lower(v).isin("online", "virtual") & ~F.coalesce(F.lower(v) == F.lower(city), F.lit(False)), v)


def communities(text: Column, provider: Column) -> Column:
    own = F.array_compact(F.array(F.try_element_at(literal_map(PROVIDER_COMMUNITY), provider)))
    return F.array_distinct(F.concat(own, labels(text, COMMUNITY_PATTERNS)))


def organisations(text: Column) -> Column:
    return F.array_distinct(F.transform(labels(text, {k: rf"\b{k}\b" for k in ORGANISATIONS}), lambda k: F.element_at(literal_map(ORGANISATIONS), k)))


# Forms of dates.
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
#: In order of precedence (not of place in the text): ISO, month day year, day month year, day/month/year, month year.
DATE_PATTERNS = [
    r"\b\d{4}-\d{2}-\d{2}\b",
    rf"(?i)\b(?:{_MONTHS})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b",
    rf"(?i)\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})\.?,?\s+\d{{4}}\b",
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    rf"(?i)\b(?:{_MONTHS})\.?\s+\d{{4}}\b",
]


def find_dates(text: Column) -> Column:
    """Distinct date strings, by pattern precedence."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(0)) for p in DATE_PATTERNS]))


def strip_tags(html: Column) -> Column:
    """Without scripts, styles and tags; common entities decoded, spaces squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.regexp_replace(t, entity, char)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def mode(text: Column) -> Column:
    """online / hybrid / in-person by ordered signals."""
    return F.when(text.rlike(r"(?i)\bhybrid\b"), "hybrid").when(text.rlike(r"(?i)\b(online|virtual|webinar|remote|zoom|google meet)\b"), "online").when(text.rlike(r"(?i)\b(in[- ]person|on[- ]?site|venue|offline)\b"), "in-person")


def category(title: Column, default: Column) -> Column:
    """Only a default of meetup is refined by the title's words."""
    t = F.lower(title)
    refined = F.when(t.rlike(r"hackathon|\bhack\b"), "hackathon").when(t.rlike(r"workshop|bootcamp|hands[- ]on"), "workshop").when(t.rlike("webinar"), "webinar").when(t.rlike(r"conference|summit|\bconf\b"), "conference")
    return F.when(default == "meetup", F.coalesce(refined, default)).otherwise(default)


# What a generic record's words make of it, the first that is found.
REFINED = {
    "ai": r"\bai\b|\ba\.i\.|artificial intelligence|machine learning|\bml\b|deep learning|generative ai|gen ?ai|\bgenai\b|\bllms?\b|large language models?|\bgpt\b|chatgpt|neural network|computer vision|\bnlp\b|data science|\bmlops\b|hugging ?face|diffusion model|transformers?",
    "startup": r"\bstart[ -]?ups?\b|\bfounders?\b|\bentrepreneurs?\b|\bvc\b|venture capital|\bpitch(es)?\b|demo day|\bincubators?\b|\baccelerators?\b|angel investors?|seed funding|fundraising",
    "hackathon": r"\bhack[ae]thons?\b|\bhack[ -]?day\b", "workshop": r"\bworkshops?\b|\bhands[ -]on\b|\bbootcamps?\b|\bmasterclass", "webinar": r"\bwebinars?\b",
    "conference": r"\bconferences?\b|\bsummits?\b|\bdevfest\b|\bconventions?\b",
}


def refined_category(title: Column, description: Column, given: Column) -> Column:
    """A meetup becomes what its title and description say; categories that a source has chosen stay."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(description, F.lit(""))))
    found = F.coalesce(*[F.when(text.rlike(p), F.lit(k)) for k, p in REFINED.items()], given)
    return F.when(given == "meetup", found).otherwise(given)


def words(text: Column) -> Column:
    """Lower-cased words of an index: letters and numerals of any alphabet."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
