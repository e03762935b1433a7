"""Spelling variant grouping by rolling-hash deletions.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point makes
one of the other. Each word gets the keys of the strings that it leaves when one code point is deleted: with the
prefix sums of a polynomial (c_0 + c_1 B + c_2 B^2 ...) all of them come from one vectorised pass,

    key(deletion at i) = prefix(i) + (total - prefix(i + 1)) / B      modulo two primes, with the length

and a word of a million letters costs a million numbers, not a million strings. Keys are partitioned and
sorted; a key holds the word that it is the whole of and the deletions of others:

* the whole word and each word with such a deletion are an insertion apart,
* deletions at one place of words of one length are a replacement apart.

Both groups are bounded by length times alphabet, whatever the table. Their members' strings are fetched then, and compared: equal
keys of different strings are told apart. Counts of near words and the best of them are summed
up from the groups, without pairs. Roots follow the forms by doubling steps.

Defined results: null and empty texts have no words; a null doc_id is hashed as an empty one; repeated rows
count as often as they occur; very long texts are cut into words piece by piece; of near words with the same n
the smallest in code-point order is the form; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U64, blocks, flat, mix, pieces, prepare, stage, unstage

#: Code points and occurrences of a word, at least; how much more frequent a form is.
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 7, 2, 10
#: Of the hashes of occurrences, those that this divides lose a code point.
LOSS = 31
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Primes and bases of the two polynomials.
MODULI = ((2147483647, 48271), (2147483629, 69621))

#: Letters in Latin-1, one byte a code point; a character outside becomes '?', which is none.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word, after losses."""
    held: Counter = Counter()

    def out():
        rows = list(held.items())
        held.clear()
        for k in range(0, len(rows), 50_000):
            word, n = zip(*rows[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in word], pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            own: Counter = Counter()
            for part in pieces(text.encode("latin-1", "replace"), _LETTERS):
                own.update(part)
            for w, n in own.items():
                if len(w) < MIN_LENGTH:
                    continue
                h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                if h % LOSS == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1 :]
                    if len(w) < MIN_LENGTH:
                        continue
                held[w] += n
            if len(held) > HELD_WORDS:
                yield from out()
    yield from out()


_known: dict[int, np.ndarray] = {}


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base^0.. modulo prime, at least n, by doubling."""
    got = _known.get(prime, np.ones(1, U64))
    while len(got) < n:
        got = np.concatenate([got, got * U64(pow(base, len(got), prime)) % U64(prime)])
    _known[prime] = got
    return got


def deletion_keys(code: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words themselves, and of every word without each of its code points."""
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(code)) - offs[row]
    whole, less = np.zeros(len(size), U64), np.zeros(len(code), U64)
    for prime, base in MODULI:
        p = U64(prime)
        term = (code.astype(U64) + U64(1)) * _powers(prime, base, int(size.max(initial=1)))[pos] % p
        total = np.zeros(len(code) + 1, U64)
        np.cumsum(term, out=total[1:])
        all_ = (total[offs[1:]] - total[offs[:-1]]) % p
        before = (total[:-1] - total[offs[row]]) % p
        after = (all_[row] + p + p - before - term) % p
        whole = (whole << U64(31)) | all_
        less = (less << U64(31)) | (before + after * U64(pow(base, -1, prime))) % p
    key = lambda h, n: mix(h ^ (n.astype(U64) << U64(40)))
    return key(whole, size), key(less, size[row] - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, pos (-1: the whole word), wid."""
    for b in batches:
        words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
        code, offs = flat(pa.array(words, pa.binary()))
        wid = b.column("wid").to_numpy()
        for i, j in blocks(offs):
            o = offs[i : j + 1] - offs[i]
            whole, less = deletion_keys(code[offs[i] : offs[j]], o)
            row = np.repeat(np.arange(j - i), np.diff(o))
            pos = np.concatenate([np.full(j - i, -1), np.arange(len(row)) - o[row]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([whole, less]).view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(np.concatenate([wid[i:j], wid[i:j][row]]))], names=["key", "pos", "wid"])


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, which are sorted by key, in tables that hold all rows of each of their keys."""
    carry = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if carry is None else pa.concat_tables([carry, t]).combine_chunks()
        key = t.column("key").to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        last = int(new[-1]) if len(new) else 0
        carry = t.slice(last)
        if last:
            yield t.slice(0, last)
    if carry is not None and carry.num_rows:
        yield carry


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, rel, pos, wid: members of groups that may be near by their keys. rel is the place of a replacement, or -1 for a
    word with those that an insertion makes of it, each once. Rows are sorted by key, pos, wid."""
    for t in _by_key(batches):
        key, pos, wid = (t.column(c).to_numpy() for c in ("key", "pos", "wid"))
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        wholes = np.add.reduceat(pos < 0, begin)
        length = np.diff(np.append(begin, n))
        star = np.flatnonzero(((wholes > 0) & (length > wholes))[run])
        o = star[np.lexsort((pos[star], wid[star], run[star]))]
        once = np.ones(len(o), bool)
        once[1:] = (wid[o][1:] != wid[o][:-1]) | (run[o][1:] != run[o][:-1])
        o = o[once | (pos[o] < 0)]
        same = np.zeros(n, bool)
        same[1:] = ~new[1:] & (pos[1:] == pos[:-1]) & (pos[1:] >= 0)
        same[:-1] |= same[1:]
        r = np.flatnonzero(same)
        at = np.concatenate([o, r])
        rel = np.concatenate([np.full(len(o), -1), pos[r]]).astype(np.int32)
        for k in range(0, len(at), 100_000):
            x = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(rel[k : k + 100_000]), pa.array(pos[x]), pa.array(wid[x])], names=["key", "rel", "pos", "wid"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """wid, near, best_n, best: of each member of a group whose strings are equal indeed, how many others it has and the best of them."""
    order = lambda m: (-m[1], m[2])
    for t in _by_key(batches):
        groups: dict = {}
        for key, rel, pos, wid, word, n in zip(*(t.column(c).to_pylist() for c in ("key", "rel", "pos", "wid", "word", "n")), strict=True):
            left = word if pos < 0 else word[:pos] + word[pos + 1 :]
            whole, less = groups.setdefault((key, rel, left), ([], []))
            (whole if pos < 0 else less).append((wid, n, word))
        rows = []
        for (_, rel, _), (whole, less) in groups.items():
            if rel < 0 and whole and less:
                u, best = whole[0], min(less, key=order)
                rows.append((u[0], len(less), best[1], best[2]))
                rows += [(v[0], 1, u[1], u[2]) for v in less]
            elif rel >= 0 and len(less) > 1:
                one, two = sorted(less, key=order)[:2]
                rows += [(m[0], len(less) - 1, *(two if m is one else one)[1:]) for m in less]
        for k in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[k : k + 50_000], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["wid", "near", "best_n", "best"])


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: what the last of its forms is, found by doubling steps."""
    at = stage(forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while at.filter("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, at = at, stage(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unstage(old)
    return at.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    spark = docs.sparkSession
    prepare(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), docs["text"]).filter(docs["text"].isNotNull())
    counted = src.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    words = stage(counted.select("word", "n", F.monotonically_increasing_id().alias("wid")), "spelling-words")
    keys = words.select("word", "wid").mapInArrow(_keys, "key long, pos int, wid long").repartition(n_parts, "key").sortWithinPartitions("key", "pos", "wid")
    groups = stage(keys.mapInArrow(_groups, "key long, rel int, pos int, wid long"), "spelling-groups")
    members = groups.join(words, "wid").repartition(n_parts, "key").sortWithinPartitions("key", "rel")
    near = members.mapInArrow(_near, "wid long, near long, best_n long, best string").groupBy("wid").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    is_form = -F.col("top.n") >= FORM_FACTOR * F.col("n")
    forms = words.join(near, "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("top.best")).alias("form"), F.when(is_form, -F.col("top.n")).alias("form_n"))
    forms = stage(forms, "spelling-forms")
    unstage(groups, words)
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
with recursive crc as (select list_transform(range(256), lambda i:
        list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as tbl),
    runs as (select coalesce(doc_id::varchar, '') as doc,
        unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
    per as (select doc, run, count(*) as k from runs where length(run) >= 7 group by all),
    octets as (select *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda ch:
        if(unicode(ch) < 128, [unicode(ch)], [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)]))) as bytes from per),
    hashed as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes::bigint[]), lambda c, x:
        xor(c >> 8, tbl[(xor(c, x) & 255) + 1]))) as h from octets, crc),
    lost as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from hashed),
    words as (select word, sum(k)::bigint as n from lost where length(word) >= 7 group by word having sum(k) >= 2),
    less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from (select *, unnest(range(1, length(word) + 1)) as i from words)),
    inserted as (select distinct l.word as big, w.word as small, l.n as bn, w.n as sn from less l join words w on w.word = l.s),
    near as (select big as word, small as other, sn as m from inserted union all select small, big, bn from inserted
        union all select a.word, b.word, b.n from less a join less b on a.s = b.s and a.i = b.i and a.word <> b.word),
    best as (select word, count(*) as n_near, arg_min(other, {{'a': -m, 'b': encode(other)}}) as other, max(m) as m from near group by word),
    forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 10 * w.n then other end as form,
        case when m >= 10 * w.n then m end as form_n from words w left join best using (word)),
    walk as (select word, word as last, form as next from forms
        union all select w.word, w.next, f.form from walk w join forms f on f.word = w.next)
select word, form, last as root, n, n_near, form_n from forms join walk using (word) where next is null"""
