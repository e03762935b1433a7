"""Shared pieces of the text operators: session set-up, staging of intermediate
tables, and vectorised splitting and hashing of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.staging import shared_dir

#: Bounds of one Arrow batch handed to Python: memory of a worker follows these, not the table.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that the numpy kernels look at together (one longer text is taken alone).
BLOCK_BYTES = 1 << 19
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the Python workers and bound their batches.

    The package's own sources are sent with addPyFile, so executors need no shared
    folder for code. Called by every operator that runs Python on executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_eventloom_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / "eventloom_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(str(out))
    sc._eventloom_sent = True


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and a lost executor costs no recomputation.

    Shuffle files of what has been written have no reader left; Spark removes them once the driver has collected its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._eventloom_path = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Remove staged tables whose last reader has been staged itself."""
    for df in staged:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._eventloom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


# --- text columns as byte arrays ------------------------------------------------------


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES):
    """(first row, last row + 1) of runs of rows of at most limit bytes, or one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def pieces(data: bytes, separated: bytes) -> Iterator[list[bytes]]:
    """The words of data by the 256 letters of separated (32 between words), about PIECE bytes at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE
        part = data[at:end].translate(separated)
        while end < len(data) and not part.endswith(b" "):  # on to the end of the last word
            more = data[end : end + PIECE].translate(separated)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


def lower_az(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows, and the first word of each row (rows + 1)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
    before[1:], after[:-1] = w[:-1], w[1:]
    inner = offs[(offs > 0) & (offs < len(w))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


# --- hashing --------------------------------------------------------------------------

_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Masks of the first 0..8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_MOST = (1 << 64) - 1
#: Spans of up to so many bytes are hashed eight bytes a step; with a longer one, so many pieces of eight bytes at a time.
SPAN_BYTES, SPAN_PIECES = 256, 1 << 16
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverses modulo 2^64, at least n of each."""
    got = _pow.get(base)
    if got is None or len(got[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, base, U64), np.full(m, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        got = _pow[base] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return got


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: tuple[int, ...] = (_P,)) -> list[np.ndarray]:
    """One 64-bit hash of data[start:end] (bytes) for each span and key.

    Each eight bytes are mixed with their place in the span before they are summed, so no
    arrangement of letters cancels, as it would in a polynomial modulo a power of two."""
    size = ends - starts
    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", pad, 0, (1,))  # the eight bytes from each place on
    out = [np.zeros(len(starts), U64) for _ in keys]
    longest = int(size.max(initial=0))
    if longest <= SPAN_BYTES:  # the next eight bytes of every span that has so many
        alive = np.arange(len(starts))
        for o in range(0, longest, 8):
            alive = alive[size[alive] > o]
            piece = eight[starts[alive] + o] & _FIRST[np.minimum(size[alive] - o, 8)]
            for x, key in zip(out, keys, strict=True):
                x[alive] += mix(piece ^ U64((o // 8 + 1) * key & _MOST))
    else:  # all pieces of all spans, SPAN_PIECES at a time
        edge = np.concatenate([[0], np.cumsum(-(-size // 8))])
        for a in range(0, int(edge[-1]), SPAN_PIECES):
            at = np.arange(a, min(a + SPAN_PIECES, int(edge[-1])))
            row = np.searchsorted(edge, at, "right") - 1
            k = at - edge[row]
            piece = eight[starts[row] + 8 * k] & _FIRST[np.minimum(size[row] - 8 * k, 8)]
            for x, key in zip(out, keys, strict=True):
                np.add.at(x, row, mix(piece ^ (k + 1).astype(U64) * U64(key)))
    return [mix(x + size.astype(U64)) for x in out]


def gram_hash(units: np.ndarray, k: int, base: int = _Q) -> np.ndarray:
    """Hash of each run of k units (64-bit values), for every start at which k units are left."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = _powers(base, len(units) + 1)
    total = np.zeros(len(units) + 1, U64)
    np.cumsum(units * up[: len(units)], out=total[1:])
    return mix((total[k:] - total[: n]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (blockwise running minima from both sides)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def strings(col: pa.Array) -> list[str]:
    return ["" if x is None else x for x in col.to_pylist()]
