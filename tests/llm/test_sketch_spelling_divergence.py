"""Bottom-k near-dedup, spelling variants and source divergence: brute force on planted tables, and their SQL."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import bottomk, common, divergence, jaccard_join, queries, spelling
from tests.llm.test_text_operators import LOW, WORD

DIR = "/root/testdata/sf0.001"


def docs(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(*r, "x", [3], 7, "y", 1.5) for r in rows], "doc_id long, text string, lang string, source string, term string, tokens array<int>, key int, word string, p double")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    letters = "abcdeéßàzo"
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 11))) for _ in range(150)]
    vocab += [w + rng.choice(letters) for w in vocab[:40]] + [w[:3] + rng.choice(letters) + w[4:] for w in vocab[:60]]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    langs, sources = ["en", "fr", None], ["a", "b", "c", "ä", None]
    own = lambda: (rng.choice(langs), rng.choices(sources, [5, 2, 1, 1, 1])[0])
    out = [(i, text(rng.randint(1, 150)), *own()) for i in range(60)]
    base = text(220).split()
    for i in range(25):  # near copies, from nearly equal to below the threshold
        w = list(base)
        for _ in range(i):
            w[rng.randrange(len(w))] = f"changed{i}"
        out.append((100 + i, " ".join(w), *own()))
    line = text(9)
    out += [(200 + i, f"{line} {vocab[i]} {vocab[i + 1]}", *own()) for i in range(30)]
    out += [(300, None, "en", "a"), (301, "", "en", "b"), (302, " \n 12 .. ", "xx", "only"), (303, "One", "en", None), (304, "one", None, "a"), (305, "ONE Two", "en", "a"), (306, out[3][1], "en", "c"), (306, out[3][1], "en", "c"), (307, out[5][1].upper(), "en", "a"), (None, "nobody here at all", "fr", "a"), (None, "nobody here at all", "fr", "a"), (308, "ab " * 5000, "en", "a"), (309, text(4000), "fr", "b"), (310, "a" * 3000 + " " + "a" * 2999 + " " + "a" * 3000 + " " + "a" * 2999, "en", "b"), (311, "Wörter×über÷Maßen İſK Ωmega 漢字 \U0001f600smile", "de", "a")]
    return out


# --- bottom-k near-dedup --------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(LOW))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)].append(r[0])
    out = []
    for k, r in enumerate(rows):
        c = (min(least[root(k)]) if least[root(k)] else None) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), c, r[0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "short", "tokens", "columns"), [(64, 64, 150_000, 2048), (16, 64, 150_000, 2048), (64, 2, 150_000, 100), (64, 1, 900, 50)])
def test_near_duplicates(spark, corpus, monkeypatch, k, short, tokens, columns):
    """Small sketches, and lists that go by centres and tiles or are paired, give the same."""
    monkeypatch.setattr(bottomk, "K", k)
    monkeypatch.setattr(bottomk, "RISK", 24 if k == 64 else 12)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", short)
    monkeypatch.setattr(bottomk, "TILE_TOKENS", tokens)
    monkeypatch.setattr(bottomk, "COLUMNS", columns)
    monkeypatch.setattr(jaccard_join, "LOOKUPS", 5)
    assert rows_of(bottomk.near_duplicates(docs(spark, corpus))) == brute_components(corpus, 2, 80)


def test_shared_bounds_the_risk():
    from math import comb

    for k, percent in ((64, 80), (128, 80), (32, 90)):
        m = bottomk.shared(k, percent)
        size, good = 1000, 10 * percent  # values of a union, and of an intersection
        missed = sum(comb(good, x) * comb(size - good, k - x) for x in range(max(0, k - size + good), m)) / comb(size, k)
        assert 0 < m < k and missed < 2**-bottomk.RISK


def test_union_sketch_estimates():
    rng = np.random.default_rng(1)
    all_ = np.unique(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    a, b = np.sort(all_[:2700]), np.sort(all_[300:])
    both, size = bottomk.estimate(a[: bottomk.K], b[: bottomk.K])
    assert size == bottomk.K
    smallest = all_[: bottomk.K]  # np.unique sorts
    assert both == sum(x in set(a) and x in set(b) for x in smallest)


def test_near_duplicates_of_nothing(spark):
    assert bottomk.near_duplicates(docs(spark, [])).collect() == []
    assert [tuple(r) for r in bottomk.near_duplicates(docs(spark, [(5, None, "a", "b")])).collect()] == [(5, 0, 5, True)]


# --- spelling variants ----------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_spelling(rows):
    n: Counter = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]

    form, out = {}, []
    for w in words:
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
        out.append((w, len(others)))

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), words[w], k, words.get(form[w])) for w, k in out), key=repr)


def test_spelling_variants(spark, corpus):
    assert rows_of(spelling.spelling_variants(docs(spark, corpus))) == brute_spelling(corpus)


def test_spelling_forms_chain(spark):
    """A form may have a form: roots follow to the last; ties go to the smaller word; Latin-1 letters are letters, others are not."""
    many = {"abcdefgh": 1200, "abcdefgx": 100, "abcdefxx": 8, "abcdexxx": 2, "zzzzzzza": 30, "zzzzzzzb": 30, "zzzzzzzz": 3, "größenwahn": 40, "grössenwahn": 3, "größenwah": 4}
    rows = [(10_000 + k, " ".join([w] * min(97, n - at)), "en", "s") for k, (w, n) in enumerate(many.items()) for at in range(0, n, 97)]
    want = brute_spelling(rows)
    assert rows_of(spelling.spelling_variants(docs(spark, rows))) == want
    assert {w: (f, r) for w, f, r, *_ in want}["abcdexxx"][1] in ("abcdexxx", "abcdefgh")


def test_deletion_keys_match_strings():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    code, offs = common.flat(pa.array([w.encode("latin-1") for w in words], pa.binary()))
    whole, less = spelling.deletion_keys(code, offs)
    at = {}
    for k, w in enumerate(words):
        at.setdefault(w, set()).add(int(whole[k]))
        for i in range(len(w)):
            at.setdefault(w[:i] + w[i + 1 :], set()).add(int(less[offs[k] + i]))
    assert all(len(x) == 1 for x in at.values()) and len({x for s in at.values() for x in s}) == len(at)


def test_equal_keys_of_different_strings(spark, corpus, monkeypatch):
    """With keys of few values nearly all collide; strings tell them apart."""
    keys = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda c, o: tuple(x % np.uint64(50) for x in keys(c, o)))
    words = [f"{a}{b}ellowing" for a in "bfmxyz" for b in "aeiou"] + ["bellowing", "bellowings", "fellowin"]
    rows = [(k, " ".join(words[k % 7 :]), "en", "s") for k in range(12)]
    t = pa.table({"word": [r for r in sorted(set(words))], "wid": range(len(set(words))), "n": [12] * len(set(words))})
    batch = t.combine_chunks().to_batches()[0]
    got = pa.Table.from_batches(list(spelling._keys(iter([batch]))))
    got = got.sort_by([("key", "ascending"), ("pos", "ascending"), ("wid", "ascending")])
    members = pa.Table.from_batches(list(spelling._groups(iter(got.combine_chunks().to_batches()))))
    members = members.append_column("word", t.column("word").take(members.column("wid"))).append_column("n", t.column("n").take(members.column("wid"))).sort_by([("key", "ascending"), ("rel", "ascending")])
    near = pa.Table.from_batches(list(spelling._near(iter(members.combine_chunks().to_batches()))))
    count = Counter()
    for r in near.to_pylist():
        count[t.column("word")[r["wid"]].as_py()] += r["near"]
    brute = {w: k for w, _, _, _, k, _ in brute_spelling([(k, " ".join(sorted(set(words))), "en", "s") for k in range(1000, 1003)]) if w in set(words)}
    assert {w: count[w] for w in brute} == brute and rows


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(docs(spark, [])).collect() == []
    assert spelling.spelling_variants(docs(spark, [(1, None, "a", "b"), (2, "", "a", "b")])).collect() == []


# --- source divergence ----------------------------------------------------------------

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def brute_divergence(rows, min_docs, top):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        c = Counter(TERM.findall((text or "").translate(LOW)))
        counts[lang or "", source or ""].update(c)
        seen[lang or ""].update(c.keys())
    out = []
    for (lang, source), c in counts.items():
        kept = [t for t, k in seen[lang].items() if k >= min_docs]
        whole = sum((counts[g] for g in counts if g[0] == lang), Counter())

        def p_of(x, kept=kept):
            n = sum(x[t] for t in kept)
            return {t: 1 + 10**9 * (x[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = p_of(c), p_of(whole)
        parts = {"pair": [(s, sum(abs(p[t] - o[t]) for t in kept)) for (g, s), x in counts.items() if g == lang and s != source for o in [p_of(x)]]}
        parts["term"] = [(t, p[t] - q[t]) for t in kept if c[t] and p[t] > q[t]]
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(items[: top if part == "term" else None], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("min_docs", "top", "tile", "rows"), [(5, 50, 256, 4096), (2, 3, 2, 20), (3, 10, 1, 50), (10_000, 50, 256, 4096)])
def test_divergence(spark, corpus, monkeypatch, min_docs, top, tile, rows):
    """Several tiles, tasks and rounds; nothing kept at all."""
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TASK_ROWS", rows)
    monkeypatch.setattr(divergence, "FIRST", 2)
    monkeypatch.setattr(divergence, "GROWTH", 3)
    got = rows_of(divergence.divergence(docs(spark, corpus), min_docs, top))
    assert got == brute_divergence(corpus, min_docs, top)


def test_divergence_of_many_sources(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(0, 30))), "en", f"s{k % 23}") for k in range(200)]
    assert rows_of(divergence.divergence(docs(spark, rows), 30, 50)) == brute_divergence(rows, 30, 50)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(docs(spark, [])).collect() == []
    assert divergence.divergence(docs(spark, [(1, None, None, None)])).collect() == []


def test_pieces(monkeypatch):
    monkeypatch.setattr(common, "PIECE", 7)
    for text in (b"", b"   ", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa b", b"abc def ghi jklmnop qrstuvw xyz", b"x" * 100):
        assert [w for p in common.pieces(text, bytes(range(256))) for w in p] == text.split()


# --- their SQL ------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.select(*names)) == sorted(want.fetchall(), key=repr)
