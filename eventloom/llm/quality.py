"""Quality classifier: random-indexing word vectors, pooled per document, a two-layer
network in numpy and temperature-calibrated probabilities.

Each word counts twice: as a bucket of its lower-cased bytes and as a shape (capitals, symbols,
numerals, length, same as the word before). Every bucket and shape has a sparse random ternary
index vector; the index vectors of the neighbours are summed into context vectors over the
training texts, and a document is the mean of its words' vectors. All of that is a product of a
count matrix with a fixed table, so scoring is numpy over Arrow batches, whatever the table's size.

The model is fitted on a bounded, hash-ordered sample of labelled rows (TRAIN_ROWS). Scoring
reads every whole text.

Defined results: a null text scores as the empty text; null labels and labels outside 0/1 are
not learned from; a label row repeated for a doc_id counts once (smallest label); with fewer than
MIN_LABELS usable labels, or without both classes among them, nothing is learned: every score is the
share of label 1 (0.5 without any), and quality_filter keeps all rows; a null doc_id is never
learned from and has held_out false; only doc_id and text are read, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import U64, blocks, crc_mod, flat, lower_az, prepare, span_hash, words

#: Labelled rows that the model is fitted on: the first by a hash of doc_id. A documented bound.
TRAIN_ROWS = 4000
#: Texts of more bytes are not learned from, so that the sample's size in bytes is bounded too.
TRAIN_BYTES = 1 << 15
#: Labelled texts below which no model is fitted.
MIN_LABELS = 20
BUCKETS, SHAPES, DIM, HIDDEN, SEED = 4096, 288, 64, 32, 7
THRESHOLD = 0.7


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of each word, and the first word of each row."""
    s, e, first = words(data, offs)
    h = span_hash(lower_az(data), s, e)[0]
    bucket = (h % U64(BUCKETS)).astype(np.int64)
    run = lambda m: np.concatenate([[0], np.cumsum(m, dtype=np.int64)])
    upper = run((data >= 65) & (data <= 90))
    digit = run((data >= 48) & (data <= 57))
    symbol = run(((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127)))
    n = e - s
    u, d, y = upper[e] - upper[s], digit[e] - digit[s], symbol[e] - symbol[s]
    caps = np.where(u == 0, 0, np.where((u > 1) & (2 * u > n - y), 2, 1))
    nums = np.where(d == 0, 0, np.where(2 * d > n, 2, 1))
    same = np.zeros(len(s), np.int64)
    if len(s) > 1:
        same[1:] = h[1:] == h[:-1]
    shape = (((caps * 4 + np.minimum(y, 3)) * 3 + nums) * 4 + np.minimum(n // 4, 3)) * 2 + same
    return bucket, shape, first


def counts(bucket: np.ndarray, shape: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of buckets and shapes among each row's words."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    total = np.maximum(np.diff(first), 1)[:, None].astype(np.float32)
    b = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    y = np.bincount(row * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES).astype(np.float32)
    return b / total, y / total


def index_vectors(n: int, rng: np.random.Generator) -> np.ndarray:
    out = np.zeros((n, DIM), np.float32)
    for _ in range(4):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def neighbours(index: np.ndarray, ids: np.ndarray, first: np.ndarray, total: np.ndarray) -> None:
    """Add to total the index vectors of the two words on either side, within a row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for gap in (1, 2):
        ok = row[gap:] == row[:-gap]
        a, b = ids[:-gap][ok], ids[gap:][ok]
        for x, y in ((a, b), (b, a)):
            for d in range(DIM):
                total[:, d] += np.bincount(x, index[y, d], minlength=len(index)).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.zeros((len(offs) - 1, 2 * DIM), np.float32)
    for i, j in blocks(offs, 1 << 19):
        for a in range(i, j, 128):  # rows of one count matrix
            z = min(a + 128, j)
            b, y = counts(*tokens(data[offs[a] : offs[z]], offs[a : z + 1] - offs[a]))
            out[a:z, :DIM], out[a:z, DIM:] = b @ tables[0], y @ tables[1]
    return out


def fit(texts: pa.Array, label: np.ndarray) -> dict:
    """Two layers by Adam on four fifths of the sample, then one temperature on the rest."""
    share = float(label.mean()) if len(label) else 0.5
    if len(label) < MIN_LABELS or share in (0.0, 1.0):
        return {"share": share}
    rng = np.random.default_rng(SEED)
    data, offs = flat(texts)
    index = [index_vectors(n, rng) for n in (BUCKETS, SHAPES)]
    near = [np.zeros_like(x) for x in index]
    for i, j in blocks(offs):
        bucket, shape, first = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        for x, total, ids in zip(index, near, (bucket, shape), strict=True):
            neighbours(x, ids, first, total)
    tables = tuple(_unit(x) + 0.5 * _unit(t) for x, t in zip(index, near, strict=True))
    x = pooled(data, offs, tables)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    order = rng.permutation(len(x))
    held, kept = order[: len(x) // 5], order[len(x) // 5 :]
    w1 = rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM, HIDDEN)).astype(np.float32)
    p = [w1, np.zeros(HIDDEN, np.float32), rng.normal(0, 0.2, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(40):
        for at in np.array_split(rng.permutation(kept), max(1, len(kept) // 64)):
            step += 1
            a, t = x[at], label[at]
            h = np.tanh(a @ p[0] + p[1])
            g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t).astype(np.float32) / len(at)
            gh = np.outer(g, p[2]) * (1 - h * h)
            for k, d in enumerate((a.T @ gh + 1e-4 * p[0], gh.sum(0), h.T @ g + 1e-4 * p[2], g.sum(keepdims=True))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    z = np.tanh(x[held] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - label[held] * z / t))
    return {"tables": tables, "mean": mean, "scale": scale, "net": p, "temperature": min(np.geomspace(0.25, 8, 41), key=loss)}


def score(data: np.ndarray, offs: np.ndarray, model: dict) -> np.ndarray:
    if "net" not in model:
        return np.full(len(offs) - 1, model["share"])
    p = model["net"]
    x = (pooled(data, offs, model["tables"]) - model["mean"]) / model["scale"]
    z = (np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60).astype(np.float64)))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, left_out: int, rows: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of the first `rows` labelled rows outside the fold, by a hash of doc_id. Only those come
    to the driver, one text of at most TRAIN_BYTES for each doc_id (of several, the first in order)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    known = known.filter(crc_mod("doc_id", fold) != left_out).groupBy("doc_id").agg(F.min("y").alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    short = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    got = short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow()
    got = got.take(pa.compute.sort_indices(got, sort_keys=[("doc_id", "ascending")])) if got.num_rows else got
    texts = got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string())
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    return texts, got.column("y").to_numpy().astype(np.float32) if got.num_rows else np.zeros(0, np.float32)


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(*flat(b.column(1)), model.value), pa.float64())], names=["doc_id", "score"])


def quality_model(docs: DataFrame, labels: DataFrame, fold: int = 4, left_out: int = 2, rows: int = TRAIN_ROWS) -> dict:
    prepare(docs.sparkSession)
    return fit(*sample(docs, labels, "quality", fold, left_out, rows))


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every text."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and DIM
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(partial(_score, model=shipped), "doc_id long, score double")


def _keep(batches: Iterator[pa.RecordBatch], model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(score(*flat(b.column(at)), model.value) >= threshold))


def quality_filter(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least the threshold, with all their columns, in one pass;
    all rows where the model has learned nothing."""
    if "net" not in model:
        return docs
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep, model=shipped, at=docs.columns.index("text"), threshold=threshold), docs.schema)


def predictions(scored: DataFrame, fold: int, left_out: int, threshold: float) -> DataFrame:
    held = F.coalesce(crc_mod("doc_id", fold) == left_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
