"""Similar pairs, greedy clusters, names and organisers against the sequential rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import dedup, graph, matching, similar
from tests.test_operators import frame, row

rng = random.Random(7)
WORDS = ["rust", "python", "meetup", "devfest", "summit", "cloud", "native", "day", "pune", "ai", "2026", "hack", "night", "conference"]


def variants(n):
    out = []
    while len(out) < n:
        base = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", " "])
                w = w or ["a"]
            out.append(" ".join("".join(w).split()))
    return out[:n]


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for a in variants(40):
        for b in variants(5):
            assert matching.lcs(a, b) == plain(a, b)


@pytest.mark.parametrize(("least", "tile"), [(0.755, 7), (0.85, 512), (0.92, 20)])
def test_tiles_miss_nothing(spark, monkeypatch, least, tile):
    monkeypatch.setattr(matching, "TILE", tile)
    s = variants(150) + ["", "", "a", "ab"]
    df = spark.createDataFrame([(i, "b" if i % 3 else "c", x, " ".join(sorted(x.split(" ")))) for i, x in enumerate(s)], "id long, block string, s string, w string")
    got = sorted((min(r), max(r)) for r in matching.by_tiles(df, "block", ["s", "w"], least).collect())
    rows = df.collect()
    want = [(a.id, b.id) for a in rows for b in rows if a.id < b.id and a.block == b.block and max(matching.indel(a.s, b.s), matching.indel(a.w, b.w)) >= least]
    assert got == sorted(want)


@pytest.mark.parametrize("least", [0.85, 0.92, 0.95])
def test_index_misses_nothing(spark, least):
    s = variants(200) + ["", "", "a", "ab", "abc", "abcd", "abc", "abcde"]
    df = spark.createDataFrame([(i, "b" if i % 3 else None, x) for i, x in enumerate(s)], "id long, block string, s string")
    got = sorted((r.x, r.y) for r in matching.by_index(df, "block", "s", least).collect())
    rows = df.collect()
    assert got == [(a.id, b.id) for a in rows for b in rows if a.id < b.id and a.block == b.block and matching.indel(a.s, b.s) >= least]


def test_index_needs_shared_grams(spark):
    with pytest.raises(ValueError, match="by_tiles"):
        matching.by_index(spark.createDataFrame([(1, "b", "s")], "id long, block string, s string"), "block", "s", 0.7)


def greedy(rows):
    """Each record into the first cluster with a member like it, date by date, in order."""
    out = {}
    groups: dict = {}
    for r in sorted(rows, key=lambda r: r.ord):
        clusters = groups.setdefault(r.start_date, [])

        def like(m, r=r):
            if r._city and m._city and r._city != m._city:
                return False
            url = 0.0 if not r._url or not m._url else 1.0 if r._url == m._url else matching.indel(r._url, m._url)
            title = max(matching.indel(r._title, m._title), matching.indel(" ".join(sorted(r._title.split())), " ".join(sorted(m._title.split()))))
            return url >= 0.95 or min(1.0, title + 0.1 * url) >= 0.85

        g = next((g for g in clusters if any(like(m) for m in g)), None)
        if g is None:
            clusters.append(g := [])
        g.append(r)
        out[r.ord] = g[0].ord
    return out


@pytest.mark.parametrize("tile", [5, 512])
def test_greedy_clusters(spark, monkeypatch, tile):
    monkeypatch.setattr(matching, "TILE", tile)
    s = variants(160)
    s += [rng.choice(s) for _ in range(60)]  # copies
    rng.shuffle(s)
    rows = [row(f"k{i}", t, url=f"https://x.example.com/{rng.choice('abc')}{rng.randint(0, 40) if i % 2 else i}", start_date=dt.date(2026, 9, 1 + i % 2), city=rng.choice([None, "Pune", "Bangalore", "bengaluru"])) for i, t in enumerate(s)]
    df = frame(spark, *rows).withColumn("ord", F.regexp_replace("key", "k", "").cast("long"))
    got = {r.ord: r.cluster for r in dedup.clusters(df, "ord").collect()}
    assert got == greedy(dedup.keyed(df).collect()) and len(set(got.values())) < len(got)


def test_copies_join_earlier_clusters(spark):
    """A copy follows the first cluster that has a member like it, not its twin."""
    titles = ["aaaaaaaaaa bbbbbbbbbb", "aaaaaaaaaa bbbbcccccc", "aaaaaaaaaa bbbbbbbccc", "aaaaaaaaaa bbbbcccccc"]
    df = frame(spark, *[row(f"k{i}", t, url=f"https://{i}{i}{i}.example.org/{'qwertzuiop'[i] * 9}") for i, t in enumerate(titles)]).withColumn("ord", F.regexp_replace("key", "k", "").cast("long"))
    got = {r.ord: r.cluster for r in dedup.clusters(df, "ord").collect()}
    assert got == greedy(dedup.keyed(df).collect())
    assert got[1] == 1 and got[3] == 0


def test_first_reachable(spark):
    for n in (1, 60):
        edges = [(i, j) for i in range(1, n) for j in range(i) if rng.random() < 0.05] + [(n, n - 1)] + [(1000 + i, 999 + i) for i in range(1, 40)]
        want: dict = {}
        for i in sorted({i for i, _ in edges}):
            want[i] = min(want.get(j, j) for k, j in edges if k == i)
        got = {r.id: r.first for r in matching.first_reachable(spark.createDataFrame(edges, "id long, to long")).collect()}
        assert got == want


def test_cross_source(spark):
    old = frame(spark, row("a", "Rust Night Pune", city="Pune"), row("b", "Cloud Native Day", city=None), row("w", "Summit of all things", status="withdrawn"))
    new = frame(spark, row("n1", "Rust  night, Pune!", city="Pune"), row("n2", "Rust night Pune", city="Delhi"), row("n3", "Cloud-Native Days", city="Delhi"), row("n4", "Summit of all things"), row("n5", "Something else entirely", url="https://x.example.com/b"), row("b", "Cloud Native Day", city=None)).withColumn("url", F.concat(F.lit("https://other.example.net/"), F.sha1("key")))
    got = {r.key for r in dedup.resolve(new.withColumn("ord", F.monotonically_increasing_id()), old, "ord").collect()}
    assert got == {"n2", "n4", "n5", "b"}  # b repeats only itself


# --- names ------------------------------------------------------------------------------------


def sequential(rows, aliases, threshold=0.92):
    seen: dict = {}
    out = []
    for r in sorted(rows, key=lambda r: r.ord):
        known, here, n = aliases.get(r.type, {}), seen.setdefault(r.type, {}), r.norm
        hit = known.get(n) or next((known[a] for a in sorted(known, key=len, reverse=True) if f" {a} " in f" {n} "), None) or here.get(n)
        if hit is None and n:
            best, score = None, 0.0
            for other in here:
                x = matching.indel(" ".join(sorted(n.split())), " ".join(sorted(other.split())))
                if x > score:
                    best, score = other, x
            hit = here[best] if score >= threshold else n.replace(" ", "-")
        if n:
            here.setdefault(n, hit)
        out.append((r.ord, hit if n else None))
    return dict(out)


def test_names_follow_the_sequential_resolver(spark):
    names = [x for x in variants(250) if x] + ["Google LLC", "google developer group pune", "GDG", "", "Google Developers Group Pune", "!!"]
    rng.shuffle(names)
    aliases = {"organization": {"google": "google", "google developer group": "gdg", "gdg": "gdg"}}
    df = spark.createDataFrame([(rng.choice(["organization", "community"]), x, i) for i, x in enumerate(names)], "type string, raw string, ord long")
    from eventloom.functions.text import normalize_name

    want = sequential(df.withColumn("norm", normalize_name(F.col("raw"))).collect(), aliases)
    got = {r.ord: r.id for r in graph.resolve_names(df, aliases).collect()}
    assert got == want


# --- organisers -------------------------------------------------------------------------------


def profile(i, **kw):
    return (i, kw.get("key", f"k{i}"), kw.get("chapter"), kw.get("university"), kw.get("city"), kw.get("venue"), kw.get("series"), kw.get("technologies"), kw.get("sponsors"))


SCHEMA = "id long, key string, chapter string, university string, city string, venue string, series array<string>, technologies array<string>, sponsors array<string>"


def score(a, b):
    eq = lambda i: float(bool(a[i] and b[i] and a[i].lower() == b[i].lower()))

    def jac(i):
        x, y = {v.lower() for v in a[i] or []}, {v.lower() for v in b[i] or []}
        return len(x & y) / len(x | y) if x and y else 0.0

    return round(0.30 * eq(1) + 0.18 * eq(2) + 0.10 * eq(3) + 0.10 * eq(4) + 0.06 * eq(5) + 0.14 * jac(6) + 0.08 * jac(7) + 0.04 * jac(8), 4)


@pytest.mark.parametrize(("threshold", "crowd"), [(0.5, 64), (0.5, 1), (0.2, 64), (0.3, 2), (0.62, 1)])
def test_similar_organisers(spark, monkeypatch, threshold, crowd):
    monkeypatch.setattr(similar, "CROWD", crowd)
    pick = lambda xs: rng.choice([*xs, None])
    some = lambda xs: pick([rng.sample(xs, k) for k in range(4)])
    rows = [profile(i, key=f"k{i % 50}", chapter=pick(["gdg", "GDG", "acm"]), university=pick(["IIT", "muj"]), city=pick(["Pune", "pune", "Goa"]), venue=pick(["h1", "h2", "h3"]), series=some(["DevFest", "devfest", "PyCon", "Jam"]), technologies=some(["Go", "Rust", "AI", "K8s"]), sponsors=some(["x", "y", "z"])) for i in range(90)]
    rows += [profile(100 + i, **{"chapter": "gdg", "city": "Pune", "series": ["DevFest"], "technologies": ["AI"], "key": "same"}) for i in range(10)]  # one class
    df = spark.createDataFrame(rows, SCHEMA)
    member = {r.id: r["class"] for r in similar.classes(df)[1].collect()}
    assert len({member[100 + i] for i in range(10)}) == 1
    got = {(r.a, r.b): r.total for r in similar.similar(df, threshold).collect()}
    reps = [r for r in rows if member[r[0]] == r[0]]
    want = {(a[0], b[0]): score(a, b) for a in reps for b in reps if a[0] < b[0] and score(a, b) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want)


def test_similar_organisers_of_one_family(spark):
    """Two chapters of one family with one series are alike at a low threshold, and share the series."""
    df = spark.createDataFrame([profile(1, chapter="gdg", series=["DevFest"], city="Delhi"), profile(2, chapter="gdg", series=["DevFest"], city="Mumbai"), profile(3, chapter="ieee")], SCHEMA)
    got = [(r.a, r.b, r.total, r.shared_series) for r in similar.similar(df, 0.2).collect()]
    assert got == [(1, 2, 0.32, True)]
    plan = similar.similar(df, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
