"""Helpers shared by the training-data operators: kept tables, Arrow text chunks, word hashing.

Python workers read texts straight from Arrow buffers (UTF-8 bytes and offsets),
so per-character work is numpy over whole chunks of rows, never row-at-a-time.
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plaudit.session import DEFAULTS, checkpoint_dir

#: Rows per Arrow batch sent to Python: bounds what a worker holds of very long texts.
ARROW_ROWS = 256
#: Bytes of text that one numpy pass works on (a longer text is a pass of its own).
CHUNK_BYTES = 1 << 20
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LEAST_ID = -(1 << 63)


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: send few rows at a time to Python, unless the cluster names a size of its own (one that is neither
    Spark's nor this library's default)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) in ("10000", DEFAULTS[key]):
        spark.conf.set(key, str(ARROW_ROWS))


class Kept:
    """Intermediate tables of one operator under the shared ``spark.checkpoint.dir``.

    ``keep`` writes a table and reads it back, which cuts the lineage: a lost
    executor re-reads files. ``drop`` deletes a table that no later step reads."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/plaudit-tables/{owner}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.base}/{name}"
        df.write.parquet(path)
        # nothing reads the finished job's shuffle files any more; a collection lets Spark's cleaner delete them now
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def id_key(doc_id: Column) -> Column:
    """A sort and join key for ids: null is the smallest."""
    return F.coalesce(doc_id, F.lit(LEAST_ID))


def row_hash(*columns: Column) -> Column:
    """64 bits of the values; which ones are null counts (``xxhash64`` skips nulls)."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def once(df: DataFrame, replace: bool = False, **columns: Column) -> DataFrame:
    """Add (or ``replace``) columns whose expressions run once per row. As plain projections they may be merged into
    the lambdas that read them and run once per element; a one-element generator is not."""
    for name, column in columns.items():
        before = [c for c in df.columns if c != name] if replace else ["*"]
        df = df.select(*before, F.explode(F.array(column)).alias(name))
    return df


def arrow_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows of a Python worker as one Arrow batch of the schema."""
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(arrow), arrow)], schema=arrow)


# ---- Arrow text -----------------------------------------------------------------------------

def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets from 0) for runs of rows; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    _, offsets, data = col.buffers()
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(offsets, wide, n + 1, col.offset * np.dtype(wide).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, raw[offs[row]:offs[end]], offs[row:end + 1] - offs[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD_BYTE = ~_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of each word; words never cross texts."""
    word = WORD_BYTE[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


# ---- 64-bit hashing -------------------------------------------------------------------------

_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("p", _P), ("inv", pow(_P, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[key] = np.cumprod(out, dtype=np.uint64)
    return _POWERS["p"], _POWERS["inv"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with ``span_hash`` of any [start, end) from two look-ups."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), whatever their place; the length is mixed in."""
    _, inv = _powers(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def runs_of(hashes: np.ndarray, text_no: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of k consecutive words of one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, text_no.dtype)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n])
    inside = text_no[:n] == text_no[k - 1:]
    return out[inside], text_no[:n][inside]


# ---- bitmaps of ids -------------------------------------------------------------------------

#: Bits of the hash that places an id in a bitmap.
FILTER_BITS = 25


def bit_of(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (4 MB) that holds all ids, and few others: texts are picked where they are read, without a shuffle."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            at = bit_of(batch.column("id").to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["bits"])

    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in ids.select("id").repartition(16).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return out


def id_picker(rows: DataFrame, column: str, wanted, inside: bool = True) -> DataFrame:
    """The rows whose ``column`` is in the bitmap (or not in it), picked where they are read: the few that a join needs, or all but the few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bit_of(batch.column(column).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(((wanted.value[at >> 3] >> (at & 7)) & 1 == 1) == inside))

    return rows.mapInArrow(run, rows.schema)
