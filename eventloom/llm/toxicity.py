"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the presence of words and word beginnings. While it is fitted, identity
terms in all labelled sentences of the sample are swapped for other terms of the same kind, and the
squared change of the sentence's logit is added to the loss, so that naming a group does not
move a score by itself.

Fitted on a bounded, hash-ordered sample of labelled rows (TRAIN_ROWS, of at most quality.TRAIN_BYTES); features are the
at most KEPT words and beginnings that stand out in the sample's toxic texts.
Scoring reads every whole text.

Defined results: as for the quality classifier; the empty text has the score of the bias.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.common import U64, blocks, flat, lower_az, prepare, span_hash
from eventloom.llm.quality import MIN_LABELS, sample

TRAIN_ROWS, KEPT, LEAST, THRESHOLD = 6000, 3000, 4, 0.5
#: Weight of the squared score change of a swapped sentence.
PENALTY = 1.0
#: A feature's texts must be toxic RATIO times as often as all (or half as often innocent, where many are toxic), by SURE standard deviations.
RATIO, SURE = 3.0, 4.0
#: Lengths of word beginnings that are features besides the whole word.
HEADS = (4, 5, 6, 7)
# Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY = {
    "gender": "women men woman man girls boys female male femmes hommes frauen männer mujeres hombres".split(),
    "religion": "muslims christians jews hindus buddhists atheists muslim christian jewish hindu musulmans chrétiens juifs muslime christen juden musulmanes cristianos judíos".split(),
    "origin": "immigrants refugees foreigners africans asians europeans mexicans immigrés réfugiés ausländer flüchtlinge inmigrantes refugiados".split(),
    "colour": "black white brown noirs blancs schwarze weiße negros blancos".split(),
    "orientation": "gay straight lesbian bisexual queer transgender".split(),
    "ability": "disabled deaf blind autistic".split(),
}
_NEXT = {t: ts[(i + 1) % len(ts)] for ts in IDENTITY.values() for i, t in enumerate(ts)}
_TERM = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit key of each word (run of letters; bytes from 128 count as letters) and of its beginnings."""
    low = lower_az(data)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    inner = offs[(offs > 0) & (offs < len(low))]
    before[inner], after[inner - 1] = False, False
    s, e = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(s, offs)))
    rows, keys = [row], span_hash(low, s, e)
    for n in HEADS:
        ok = e - s > n
        rows.append(row[ok])
        keys.append(span_hash(low, s[ok], s[ok] + n)[0] ^ U64(n))
    return np.concatenate(rows), np.concatenate(keys)


def presence(rows: np.ndarray, keys: np.ndarray, vocabulary: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs. sieve: bits of the keys, to drop most before the search."""
    ok = sieve[(keys >> U64(44)).astype(np.int64)]
    rows, keys = rows[ok], keys[ok]
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    ok = vocabulary[at] == keys
    pair = np.unique(rows[ok] * len(vocabulary) + at[ok])
    return pair // len(vocabulary), pair % len(vocabulary)


def _sieve(vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(vocabulary >> U64(44)).astype(np.int64)] = True
    return out


def swapped(texts: list[str]) -> tuple[list[str], list[str]]:
    """The distinct sentences with identity terms, in lower case, and the same with each term swapped for the next."""
    found: dict[str, None] = {}
    for t in texts:
        for m in _SENTENCE.finditer(t):
            low = m[0].lower()
            if _TERM.search(low):
                found[low] = None
    return list(found), [_TERM.sub(lambda x: _NEXT[x[0]], s) for s in found]


def fit(texts: pa.Array, label: np.ndarray) -> dict:
    share = float(label.mean()) if len(label) else 0.5
    if len(label) < MIN_LABELS or share in (0.0, 1.0):
        return {"share": share}
    n = len(label)
    data, offs = flat(texts)
    rows, keys = [], []
    for i, j in blocks(offs, 1 << 20):
        a, b = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rows.append(a[new] + i)
        keys.append(b[new])
    r, keys = np.concatenate(rows), np.concatenate(keys)
    uniq, c = np.unique(keys, return_inverse=True)
    df = np.bincount(c, minlength=len(uniq))
    pos = np.bincount(c, label[r], minlength=len(uniq))
    # How far above its share each feature stands in toxic texts, in standard deviations. Weights
    # stay at or above 0: ordinary words are no evidence against, else long texts outvote one insult.
    gain = (pos - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
    gain[(df < LEAST) | (pos < min(RATIO * share, (1 + share) / 2) * df)] = 0
    terms = pa.array(sorted(_NEXT))
    _, own = features(*flat(terms))  # identity terms are always features, so that the penalty reaches them
    chosen = np.unique(np.concatenate([uniq[[i for i in np.argsort(-gain, kind="stable")[:KEPT] if gain[i] >= SURE]], own]))
    sieve = _sieve(chosen)
    r, c = presence(r, keys, chosen, sieve)
    sentences, others = swapped(texts.to_pylist())
    sentences += terms.to_pylist()  # and each term alone against the next
    others += [_NEXT[x] for x in terms.to_pylist()]
    ar, ac = presence(*features(*flat(pa.array(sentences, pa.string()))), chosen, sieve)
    sr, sc = presence(*features(*flat(pa.array(others, pa.string()))), chosen, sieve)
    w, bias = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    m, v, gb = np.zeros(len(chosen)), np.zeros(len(chosen)), 0.0
    weight = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
    for step in range(1, 301):
        z = np.bincount(r, w[c], minlength=n) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - label) / n
        grad = np.bincount(c, g[r], minlength=len(w)) + 1e-4 * w
        gb = g.sum()
        change = np.bincount(sr, w[sc], minlength=len(others)) - np.bincount(ar, w[ac], minlength=len(others))
        d = 2 * PENALTY * change / len(others)
        grad += np.bincount(sc, d[sr], minlength=len(w)) - np.bincount(ac, d[ar], minlength=len(w))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w = np.maximum(w, 0)
        bias -= 0.5 * gb
    return {"keys": chosen, "w": w, "bias": bias}


def score(data: np.ndarray, offs: np.ndarray, model: dict) -> np.ndarray:
    n = len(offs) - 1
    if "w" not in model:
        return np.full(n, model["share"])
    sieve = _sieve(model["keys"])
    z = np.full(n, float(model["bias"]))
    for i, j in blocks(offs):
        if offs[j] > offs[i]:
            r, c = presence(*features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), model["keys"], sieve)
            z[i:j] += np.bincount(r, model["w"][c], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(*flat(b.column(1)), model.value), pa.float64())], names=["doc_id", "score"])


def toxicity_model(docs: DataFrame, labels: DataFrame, fold: int = 5, left_out: int = 0, rows: int = TRAIN_ROWS) -> dict:
    prepare(docs.sparkSession)
    return fit(*sample(docs, labels, "toxic", fold, left_out, rows))


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every text."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # KEPT features
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(partial(_score, model=shipped), "doc_id long, score double")
