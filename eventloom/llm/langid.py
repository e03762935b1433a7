"""Language ID: blended-spectrum string kernel, Nyström landmarks, kernel ridge regression.

The kernel of two texts is the number of byte n-grams (ORDERS, case folded for A-Z) that both
have, over the root of the product of their numbers. A bounded sample of texts gives landmarks; each
text's kernel values with the landmarks, whitened by the landmarks' own kernel matrix, are its
features, and one ridge regression for each language against the rest scores them. n-grams are
hashed to WIDTH presence bits, so a batch of texts is one 0/1 matrix and scoring is two matrix
products.

Fitted on the first TRAIN_ROWS rows outside the fold by a hash of doc_id (a documented bound).

Defined results: lang_pred is `und` with score 0.0 where the text is null or has no letter, or
where nothing could be learned; rows with a null lang or text or doc_id are not learned from; a
tie goes to the language that comes first in order of name; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, crc_mod, flat, lower_az, prepare

TRAIN_ROWS, LANDMARKS, RIDGE, SHARPNESS = 3000, 160, 0.1, 4.0
ORDERS, WIDTH = (1, 2, 3), 4096
#: Texts of more bytes are not learned from, so that the sample's size in bytes is bounded too.
TRAIN_BYTES = 1 << 15
ROWS = 64
_LETTER = re.compile(r"[^\W\d_]")


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """0/1 matrix of the rows' hashed n-grams."""
    n = len(offs) - 1
    out = np.zeros(n * WIDTH, np.float32)
    if len(data):
        low = lower_az(data).astype(np.uint32)
        row = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(offs))
        left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(low))  # bytes up to the row's end
        v = np.zeros(len(low), np.uint32)
        for k in range(max(ORDERS)):
            m = len(low) - k
            v = v[:m] * np.uint32(257) + low[k:] + np.uint32(1)
            if k + 1 in ORDERS:
                ok = left[:m] > k
                h = ((v + np.uint32(k * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
                out[row[:m][ok] + h[ok].astype(np.int64)] = 1
    return out.reshape(n, WIDTH)


def kernel(p: np.ndarray, size: np.ndarray, q: np.ndarray, qsize: np.ndarray) -> np.ndarray:
    return (p @ q.T) / np.sqrt(np.maximum(size, 1)[:, None] * np.maximum(qsize, 1)[None, :])


def features(data: np.ndarray, offs: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offs) - 1, len(marks)), np.float32)
    size = marks.sum(1)
    for i, j in blocks(offs, 1 << 20):
        for a in range(i, j, ROWS):
            z = min(a + ROWS, j)
            p = presence(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a])
            out[a:z] = kernel(p, p.sum(1), marks, size)
    return out


def fit(texts: pa.Array, lang: list[str]) -> dict | None:
    names = sorted(set(lang))
    if not names:
        return None
    data, offs = flat(texts)
    by = [[i for i, x in enumerate(lang) if x == n] for n in names]
    picked = sorted(i for own in by for i in own[: max(1, LANDMARKS // len(names))])
    sub = pa.array([texts[i].as_py() for i in picked], pa.string())
    marks = np.concatenate([presence(*flat(sub.slice(a, ROWS))) for a in range(0, len(sub), ROWS)])
    k = kernel(marks, marks.sum(1), marks, marks.sum(1)).astype(np.float64)
    value, vector = np.linalg.eigh(k)
    ok = value > 1e-4
    white = vector[:, ok] / np.sqrt(value[ok])
    x = features(data, offs, marks) @ white
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.where(np.array(lang)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    w = np.linalg.solve(x.T @ x + RIDGE * np.eye(x.shape[1]), x.T @ y)
    return {"names": names, "marks": marks.astype(np.float32), "map": (white @ w[:-1]).astype(np.float32), "bias": w[-1]}


def predict(texts: pa.Array, model: dict | None) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    if model is None:
        return ["und"] * n, np.zeros(n)
    data, offs = flat(texts)
    z = features(data, offs, model["marks"]) @ model["map"] + model["bias"]
    e = np.exp(SHARPNESS * (z - z.max(1, keepdims=True)))
    best, score = z.argmax(1), e.max(1) / e.sum(1)
    low = data | 32
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (data < 128))])
    plain = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
    out = [model["names"][i] for i in best]
    for i in np.flatnonzero(~plain):
        t = texts[int(i)].as_py()
        if not t or not _LETTER.search(t):
            out[i], score[i] = "und", 0.0
    return out, score


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, score = predict(b.column(1), model.value)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def language_model(docs: DataFrame, fold: int = 4, left_out: int = 2, rows: int = TRAIN_ROWS) -> dict | None:
    spark = docs.sparkSession
    prepare(spark)
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"].alias("lang")).filter(f"doc_id is not null and text is not null and lang is not null and octet_length(text) <= {TRAIN_BYTES}")
    # The hash order picks ids first, so the texts of the sample alone come to the driver.
    picked = ids.select("doc_id").filter(crc_mod("doc_id", fold) != left_out).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    one = F.min(F.struct("text", "lang")).alias("x")  # of several rows of one doc_id, the first in order
    got = ids.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "x.text", "x.lang").toArrow().sort_by("doc_id")
    texts = pa.array(got.column("text").to_pylist(), pa.string())
    return fit(texts, got.column("lang").to_pylist())


def language(docs: DataFrame, model: dict | None, fold: int = 4, left_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every text."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS x WIDTH
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(partial(_predict, model=shipped), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", fold) == left_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
