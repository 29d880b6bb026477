"""Suffix-array dedup: a distributed difference-cover algorithm over what can repeat.

Every ``length``-byte window has an anchor, the least hash of the short substrings in
it, so equal windows have equal anchors at equal places, and the windows that share an
anchor are a run, a block. That reduces the text without losing a repeat:

1. Blocks with equal bytes (equal fingerprints under an equal anchor) hold equal windows
   one by one: all but the first block are repeats. An anchor that only such blocks have
   is settled; so is an anchor that stands once.
2. What is left, different blocks with one anchor, gets the difference-cover suffix sort
   (cover {1, 2} modulo 3): sampled tuples are sorted and named, names recurse in pairs
   until they cover the window but for four bytes, the remaining suffixes are merged by
   their first bytes and the name of the next sampled suffix, and neighbours with equal
   prefixes are repeats of the first one. Anchors are dealt over tasks; one with
   very many blocks is split, and what stands first in each split meets again by its
   fingerprint.

Documents come in order of doc_id (null first), then of a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plaudit.llm.common import Kept, id_key, prefix_hash, small_batches, span_hash, text_chunks

#: Bytes hashed for an anchor, blocks of one anchor in a split, bytes that one suffix sort takes, windows of a long text looked at together.
ANCHOR, SPLIT_BLOCKS, SORT_BYTES, PART_WINDOWS = 32, 4096, 4 << 20, 1 << 24
#: Bits of a window's place in what is looked at together: PART_WINDOWS and more.
_PLACE_BITS = 28


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def blocks(data: np.ndarray, offs: np.ndarray, length: int, size: int):
    """(text number, anchor hash, fingerprint, start, windows) of all blocks of a chunk of texts; starts count from the chunk's begin."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - size + 1)
    gram = span_hash(prefix, at, at + size)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    anchor = (sliding_min((gram & ~low) | at.astype(np.uint64), length - size + 1) & low).astype(np.int64)
    fits = np.zeros(len(anchor) + 1, np.int64)
    text_len = np.diff(offs)
    long_ = text_len >= length
    np.add.at(fits, offs[:-1][long_], 1)
    np.add.at(fits, offs[1:][long_] - length + 1, -1)
    fits = np.cumsum(fits[:-1]) > 0
    head = fits.copy()
    head[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1])
    starts = np.flatnonzero(head)
    # a block ends where the next one starts or where the text's last window stands
    text = np.searchsorted(offs, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), offs[text + 1] - length + 1)
    return text, gram[anchor[starts]], span_hash(prefix, starts, ends + length - 1), starts, ends - starts


def parts(data: np.ndarray, offs: np.ndarray, length: int):
    """(begin, bytes, offsets) to look for blocks in: the chunk itself, or a long text in parts that overlap by a window but for a byte.

    A part's border may end a block early; its windows are the same."""
    if len(offs) > 2 or len(data) <= PART_WINDOWS + length:
        yield 0, data, offs
        return
    for begin in range(0, len(data) - length + 1, PART_WINDOWS):
        end = min(begin + PART_WINDOWS + length - 1, len(data))
        yield begin, data[begin:end], np.array([0, end - begin])


def repeats_of(pieces: list[bytes], windows: np.ndarray, length: int) -> np.ndarray:
    """Difference-cover suffix sort of the pieces one after the other: for each window (piece by piece, ``windows`` of each)
    the number of the first equal window."""
    text = np.frombuffer(b"".join(pieces) + bytes(length + 6), np.uint8).astype(np.uint64)
    # sampled positions are 1 and 2 modulo 3; number 2 * (p // 3) + p % 3 - 1
    rows = len(text) // 3 - 2
    p = (np.arange(rows)[:, None] * 3 + np.array([1, 2])).ravel()
    word = np.zeros(len(p), np.uint64)
    for j in range(6):
        word = word << np.uint64(8) | text[p + j]
    name = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    have, most = 6, 3 * ((length - 2) // 3)
    while have < most:
        step = min(have, most - have)
        other = np.zeros_like(name)
        shift = 2 * (step // 3)
        other[:-shift] = name[shift:]
        name = np.unique(name << np.uint64(32) | other, return_inverse=True)[1].astype(np.uint64)
        have += step
    sizes = np.array([len(x) for x in pieces])
    begins = np.cumsum(sizes) - sizes
    first = np.cumsum(windows) - windows
    place = np.arange(int(windows.sum())) + np.repeat(begins - first, windows)
    out = np.arange(len(place))
    for d in range(3):
        # suffixes whose d-th next one is sampled; any two suffixes share such a d
        mine = np.flatnonzero((place + d) % 3 != 0)
        at = place[mine]
        key = name[2 * ((at + d) // 3) + (at + d) % 3 - 1]
        around = [at + j for j in range(d)] + [at + j for j in range(d + most, length)]
        for x in around:
            key = key << np.uint64(8) | text[x]
        _, lead, back = np.unique(key, return_index=True, return_inverse=True)
        out[mine] = np.minimum(out[mine], mine[lead[back]])
    return out


def covered(starts: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the windows that start in [start, start + count)."""
    out: list[list[int]] = []
    order = np.argsort(starts, kind="stable")
    for s, n in zip(starts[order].tolist(), counts[order].tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + length - 1)
        else:
            out.append([s, s + n + length - 1])
    return [(a, b) for a, b in out]


#: A block's row is narrow, as there are many: ``print`` is 48 bits of fingerprint and 16 of the number of windows.
#: ``h`` (64 bits of the text's hash, which order and tell apart texts that share an id) is there only if ids are shared.
BLOCKS = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "print", "id", "start", "h")])
PIECES = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("split", T.LongType()), T.StructField("splits", T.LongType()), T.StructField("id", T.LongType()), T.StructField("h", T.LongType()),
                       T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("bytes", T.BinaryType())])
SORTED = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()),
                       T.StructField("anchor", T.LongType()), T.StructField("print", T.LongType())])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _blocks(rows: DataFrame, length: int, size: int, shared: bool) -> DataFrame:
    schema = T.StructType(BLOCKS.fields[:5 if shared else 4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h"))
            for row, end, chunk, offsets in text_chunks(batch.column("text")):
                for begin, data, offs in parts(chunk, offsets, length):
                    text, anchor, print_, start, windows = blocks(data, offs, length, size)
                    print_ = (print_ & ~np.uint64(0xFFFF) | windows.astype(np.uint64)).view(np.int64)
                    columns = (anchor.view(np.int64), print_, ids[row:end][text], begin + start - offs[text], hs[row:end][text])
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns[:len(schema)]], schema.names)

    return rows.mapInArrow(run, schema)


def _pieces(rows: DataFrame, length: int) -> DataFrame:
    """The bytes of every open block of rows (id, h, text, open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in PIECES.names]
            for one, h, text, open_ in zip(batch.column("id").to_pylist(), batch.column("h").to_pylist(), batch.column("text").to_pylist(), batch.column("open").to_pylist()):
                raw = text.encode("utf-8")
                for b in open_:
                    s, n = b["start"], b["windows"]
                    for column, value in zip(out, (b["anchor"], (one ^ h) % b["splits"], b["splits"], one, h, s, n, raw[s:s + n + length - 1])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], PIECES.names)

    return rows.mapInArrow(run, PIECES)


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """Runs of windows that repeat inside their anchor's split (anchor null); of split anchors also every window that came first, with its fingerprint."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        rows = [r for _, r in sorted({r[3:6]: r for r in rows}.items())]  # a repeated row's pieces are one
        windows = np.array([r[6] for r in rows])
        lead = repeats_of([r[7] for r in rows], windows, length)
        again = lead != np.arange(len(lead))
        owner = np.repeat(np.arange(len(rows)), windows)
        place = np.arange(len(lead)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.array([r[5] for r in rows]), windows)
        head = again.copy()
        head[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(head)
        change = np.flatnonzero(np.diff(np.append(np.where(again, owner + 1, 0), 0)))
        ends = change[np.searchsorted(change, starts)] + 1
        ids, hs = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
        split = np.array([r[2] > 1 for r in rows])
        first = np.flatnonzero(~again & split[owner])
        body = np.frombuffer(b"".join([r[7] for r in rows]), np.uint8)
        at = first + (length - 1) * owner[first]  # each piece before it has length - 1 bytes more than windows
        print_ = span_hash(prefix_hash(body), at, at + length).view(np.int64) if len(first) else np.zeros(0, np.int64)
        anchors = np.array([r[0] for r in rows], np.int64)
        both = np.concatenate([starts, first])
        return pa.RecordBatch.from_arrays([
            pa.array(ids[owner[both]]), pa.array(hs[owner[both]]), pa.array(place[both].astype(np.int32)),
            pa.array(np.concatenate([ends - starts, np.ones(len(first), np.int64)]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(len(starts), np.int64), anchors[owner[first]]]), mask=np.arange(len(both)) < len(starts)),
            pa.array(np.concatenate([np.zeros(len(starts), np.int64), print_]), mask=np.arange(len(both)) < len(starts))], SORTED.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SORT_BYTES and row[:2] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[7]), row[:2]
        if held:
            yield settle(held)

    return pieces.mapInArrow(run, SORTED)


def _finished(rows: DataFrame, length: int, schema: T.StructType) -> DataFrame:
    """Spans and digest of every text of rows (doc_id, id, h, text, again, open); a text with open blocks is sent on, undecided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("text", "again", "open")]
            out: list[list] = [[] for _ in range(5)]
            for text, again, open_ in zip(*cols):
                raw = (text or "").encode("utf-8")
                if open_:
                    for column, value in zip(out, (len(raw), None, None, None, text)):
                        column.append(value)
                    continue
                spans = covered(np.array([a["start"] for a in again or []], np.int64), np.array([a["windows"] for a in again or []], np.int64), length)
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                for column, value in zip(out, (len(raw), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], digest.hexdigest(), None)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "id", "h")] + [pa.array(c, k) for c, k in zip(out, kinds)] + [batch.column(c) for c in ("again", "open")], schema.names)

    return rows.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 100, kept: Kept | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal [start, end) byte runs to remove), kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte is removed if a ``length``-byte string covers it that also starts earlier: in a smaller doc_id, or earlier in
    the same text. A null text is empty; texts shorter than ``length`` lose nothing. Rows with a null doc_id come before
    all others; rows that share an id are ordered by a hash of their text; rows equal in id and text are one document (none
    is an earlier copy of the other, and each is returned). Other columns are not read; an empty table gives no rows."""
    if not 8 <= length < 1 << 16:
        raise ValueError("length must be 8 at least and below 65536")
    spark = docs.sparkSession
    small_batches(spark)
    kept = kept or Kept(spark, "suffix")
    size = min(ANCHOR, length // 2)
    id_ = id_key(F.col("doc_id").cast("long"))
    shared = not docs.groupBy(id_).count().where("count > 1").isEmpty()
    h = F.coalesce(F.xxhash64("text"), F.lit(0)) if shared else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_.alias("id"), h.alias("h"), "text")
    place = ["id", "h", "start"] if shared else ["id", "start"]
    same, anchor = Window.partitionBy("anchor", "print").orderBy(*place), Window.partitionBy("anchor")
    # rows equal in id and text have equal blocks: rank() lets all of them be first
    found = _blocks(rows, length, size, shared).withColumn("again", F.rank().over(same) > 1)
    found = found.withColumn("differ", F.min("print").over(anchor) != F.max("print").over(anchor))
    found = found.withColumn("splits", F.ceil(F.count(F.when(~F.col("again"), 1)).over(anchor) / SPLIT_BLOCKS).cast("long")).where("again or differ")
    start, windows = F.col("start").cast("int").alias("start"), F.col("print").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("windows")
    info = found.groupBy("id", *(["h"] if shared else [])).agg(
        F.collect_set(F.when(F.col("again"), F.struct(start, windows))).alias("again"), F.collect_set(F.when(~F.col("again"), F.struct(start, windows, "anchor", "splits"))).alias("open"))
    info = kept.keep(info, "info")
    joined = rows.join(info, place[:-1], "left").select("doc_id", "id", "h", "text", "again", "open")
    types = {f.name: f.dataType for f in joined.schema}
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("id", T.LongType()), ("h", T.LongType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("spans", SPANS),
                                                             ("kept_sha256", T.StringType()), ("text", T.StringType()), ("again", types["again"]), ("open", types["open"]))])
    first = kept.keep(_finished(joined, length, schema), "first")
    kept.drop("info")
    waiting = first.where("n_removed is null")

    pieces = _pieces(waiting.select("id", "h", "text", "open"), length)
    pieces = pieces.repartition("anchor", "split").sortWithinPartitions("anchor", "split")
    done = kept.keep(_sorted(pieces, length), "sorted")
    met = done.where("anchor is not null").withColumn("n", F.row_number().over(Window.partitionBy("anchor", "print").orderBy("id", "h", "start"))).where("n > 1").drop("n")
    late = done.where("anchor is null").unionByName(met).groupBy("id", "h").agg(F.collect_list(F.struct("start", "windows")).alias("late"))
    rest = waiting.join(late, ["id", "h"], "left").withColumn("again", F.concat("again", F.coalesce("late", F.array().cast(types["again"])))).withColumn("open", F.array().cast(types["open"]))
    rest = _finished(rest.select("doc_id", "id", "h", "text", "again", "open"), length, schema)
    return first.where("n_removed is not null").unionByName(rest).select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256")
