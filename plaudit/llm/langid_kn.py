"""Language identification with interpolated Kneser-Ney character models.

Symbols are case-folded code points of letters and marks, whatever the script; runs of other
characters are one blank. Grams of up to three symbols are exact in 63 bits, those of four are
64-bit hashes. Grams are counted over all training texts by Spark; what reaches the driver and the
workers are the distinct grams of each language, which grow with its vocabulary and far slower
than the corpus. The smoothed models are sorted arrays of gram hashes with log probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.llm.common import Kept, is_held_out, mix64, small_batches, text_chunks

BITS, ORDER = 21, 4
#: Distinct grams that a counting task gathers before it merges them, and passes them on if half of them are left.
GATHER = 1 << 21
#: Texts longer than this many symbols gain no more certainty in the posterior.
POSTERIOR_SYMBOLS = 40
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to symbol: the case-folded code point of a letter or mark, 0 for other characters."""
    if not _FOLD:
        table = np.zeros(0x110000, np.int64)
        for code in range(0x110000):
            char = chr(code)
            if unicodedata.category(char)[0] in "LM":
                folded = char.casefold()
                table[code] = ord((folded if len(folded) == 1 else char.lower())[0])
        _FOLD.append(table)
    return _FOLD[0]


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; marks alone (variation selectors, keycaps) are none."""
    if len(_FOLD) < 2:
        fold_table()
        _FOLD.append(np.array([unicodedata.category(chr(code))[0] == "L" for code in range(0x110000)]))
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upto = np.concatenate([[0], np.cumsum(_FOLD[1][codes])])
    return np.diff(upto[np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]]) > 0


def long_hash(left: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """64 bits of the four symbols ``left`` and then ``gram``."""
    return mix64(mix64(gram.view(np.uint64)) + left.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of all texts the one three places before it and the packed three that end with it, their hash, and the offsets of each text's symbols.

    Runs of other characters are one blank; a text starts after blanks; each symbol closes a gram."""
    fold = fold_table()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    symbol = fold[codes]
    before = np.zeros_like(symbol)
    before[1:] = symbol[:-1]
    before[starts[:-1][starts[:-1] < len(symbol)]] = 0
    stay = (symbol | before) != 0
    offs = np.concatenate([[0], np.cumsum(stay)])[starts]
    symbol = symbol[stay]
    back = [symbol]
    first = offs[:-1][offs[:-1] < offs[1:]]
    for _ in range(1, ORDER):
        shifted = np.zeros_like(symbol)
        shifted[1:] = back[-1][:-1]
        shifted[first] = 0
        back.append(shifted)
    gram = back[2] << (2 * BITS) | back[1] << BITS | back[0]
    return back[3], gram, long_hash(back[3], gram), offs


@dataclass
class Model:
    """One language: for each order, sorted hashes of seen grams with log probabilities, and of contexts with back-off weights; ``floor`` is the log probability of any symbol before data."""

    seen: list[tuple[np.ndarray, np.ndarray]]
    back_off: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    def logs(self, left: np.ndarray, gram: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log probability of each gram: its own, or that of the shorter gram times the context's weight."""
        out, todo, weight = np.empty(len(gram)), np.arange(len(gram)), np.zeros(len(gram))
        for n in range(ORDER, 0, -1):
            keys = hashes[todo] if n == ORDER else gram[todo] & ((1 << (BITS * n)) - 1)
            place, hit = find(self.seen[n - 1][0], keys)
            out[todo[hit]] = weight[hit] + self.seen[n - 1][1][place[hit]]
            todo, weight, keys = todo[~hit], weight[~hit], keys[~hit]
            context = left[todo] << (2 * BITS) | gram[todo] >> BITS if n == ORDER else keys >> BITS
            place, hit = find(self.back_off[n - 1][0], context)
            weight[hit] += self.back_off[n - 1][1][place[hit]]
        out[todo] = weight + self.floor
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of ``wanted`` in the sorted ``keys``, and whether it is there."""
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def kneser_ney(left: np.ndarray, gram: np.ndarray, counts: np.ndarray, symbols: int) -> Model:
    """Interpolated Kneser-Ney from the counts of the longest grams; shorter orders count distinct left neighbours.

    ``symbols`` (of all languages, and one for any other) share the probability that no order gives away."""
    levels = [(long_hash(left, gram), left << (2 * BITS) | gram >> BITS, gram, counts.astype(float))]
    for n in range(ORDER - 1, 0, -1):
        keys, of = np.unique(levels[-1][2], return_counts=True)
        levels.append((keys, keys >> BITS, keys & ((1 << (BITS * (n - 1))) - 1), of.astype(float)))
    lower, known, seen, back_off = np.full(1, 1.0 / symbols), np.zeros(1, np.int64), [], []
    for keys, contexts, shorter, c in reversed(levels):
        once, twice = float((c == 1).sum()), float((c == 2).sum())
        discount = once / (once + 2 * twice) if once else 0.5
        names, of, kinds = np.unique(contexts, return_inverse=True, return_counts=True)
        total = np.bincount(of, c)
        weight = discount * kinds / total
        p = np.maximum(c - discount, 0) / total[of] + weight[of] * lower[np.searchsorted(known, shorter)]
        order = np.argsort(keys)
        known, lower = keys[order], p[order]
        seen.append((known, np.log(lower).astype(np.float32)))
        back_off.append((names, np.log(weight).astype(np.float32)))
    return Model(seen, back_off, float(-np.log(symbols)))


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("left", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def runs(hashes: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where runs of equal hashes (and ``also``) begin in it.

    Upper bits and place are sorted as one number, which is far faster than an indirect sort; two hashes that share the
    upper bits may alternate, so one hash can have several runs."""
    bits = np.uint64(max(len(hashes).bit_length(), 1))
    keys = (hashes.view(np.uint64) >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    keys.sort()
    order = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.ones(len(order), bool)
    begins[1:] = False
    for values in (hashes, *also):
        values = values[order]
        begins[1:] |= values[1:] != values[:-1]
    return order, np.flatnonzero(begins)


def summed(lang: np.ndarray, left: np.ndarray, gram: np.ndarray, hashes: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """lang, left, gram, hash and count (sum of ``n``), one row per run of equal grams of a language."""
    order, at = runs(hashes + lang * np.int64(0x5851F42D4C957F2D), lang)
    count = np.diff(np.append(at, len(order))) if n is None or not len(at) else np.add.reduceat(n[order], at)
    first = order[at]
    return [lang[first], left[first], gram[first], hashes[first], count.astype(np.int64)]


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, left, gram, n) over every text of ``train`` (lang, text); summed per task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        parts: list[list[np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            lang, left, gram, _, n = parts[0]
            for i in range(0, len(n), 1 << 16):
                of = pa.DictionaryArray.from_arrays(pa.array(lang[i:i + (1 << 16)]), pa.array(list(names), pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([of, *[pa.array(c[i:i + (1 << 16)], pa.int64()) for c in (left, gram, n)]], COUNTS.names)

        def merge() -> None:
            parts[:] = [summed(*(np.concatenate(c) for c in zip(*parts)))]

        for batch in batches:
            langs = np.array([names.setdefault(lang, len(names)) for lang in batch.column("lang").to_pylist()], np.int64)
            for row, end, data, offs in text_chunks(batch.column("text")):
                left, gram, hashes, at = grams(data, offs)
                parts.append(summed(np.repeat(langs[row:end], np.diff(at)), left, gram, hashes))
            if sum(len(part[0]) for part in parts) > GATHER:
                merge()
                if len(parts[0][0]) > GATHER // 2:
                    yield from rows()
                    parts.clear()
        if parts:
            merge()
            yield from rows()

    return train.mapInArrow(count, COUNTS).groupBy("lang", "left", "gram").agg(F.sum("n").alias("n"))


def train_models(train: DataFrame) -> dict[str, Model]:
    """A model per language of ``train``; one row per distinct gram of a language reaches the driver."""
    got = count_grams(train).toArrow()
    coded = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    of, (left, gram, n) = coded.indices.to_numpy(zero_copy_only=False), (got.column(c).to_numpy() for c in ("left", "gram", "n"))
    symbols = len(np.unique(gram & ((1 << BITS) - 1))) + 1
    return {lang: kneser_ney(left[of == i], gram[of == i], n[of == i], symbols) for i, lang in sorted(enumerate(coded.dictionary.to_pylist()), key=lambda x: x[1])}


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang", T.StringType()),
                       T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType())])


def score_texts(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Lowest cross-entropy per symbol (ties: first language by name) with a posterior, for rows (doc_id, held_out, lang, text)."""
    shared, names = docs.sparkSession.sparkContext.broadcast(models), sorted(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            best, sure, cross = [], [], []
            for row, end, data, offs in text_chunks(batch.column("text")):
                left, gram, hashes, at = grams(data, offs)
                n = np.diff(at)
                order, begin = runs(hashes)
                of, first = np.empty(len(order), np.int64), order[begin]
                of[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
                left, gram, hashes = left[first], gram[first], hashes[first]
                full = np.flatnonzero(n)
                h = np.zeros((end - row, len(names)))
                for k, name in enumerate(names):
                    if len(full):
                        h[full, k] = -np.add.reduceat(own[name].logs(left, gram, hashes)[of], at[:-1][full], dtype=np.float64) / n[full]
                if not names:
                    best += ["und"] * (end - row)
                    sure += [0.0] * (end - row)
                    cross += [None] * (end - row)
                    continue
                k = h.argmin(1)
                low = h[np.arange(len(h)), k]
                odds = np.exp(-(h - low[:, None]) * np.minimum(n, POSTERIOR_SYMBOLS)[:, None]).sum(1)
                n = np.where(has_letter(data, offs), n, 0)
                best += [names[i] if m else "und" for i, m in zip(k, n)]
                sure += [float(1 / o) if m else 0.0 for o, m in zip(odds, n)]
                cross += [float(x) if m else None for x, m in zip(low, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), batch.column("lang"), pa.array(best, pa.string()),
                                              pa.array(sure, pa.float64()), pa.array(cross, pa.float64())], SCORED.names)

    return docs.mapInArrow(score, SCORED)


def identify_languages(docs: DataFrame, deviations: float = 4.0, kept: Kept | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row of ``docs`` (doc_id, text, lang).

    Learns from rows that are not held out (crc32 rule) and have a lang; a null or letterless text, or a
    corpus without training rows, gives ``und``, score 0 and is rejected. ``rejected`` is calibrated on all
    training rows: a cross-entropy more than ``deviations`` standard deviations above the mean of the
    training texts of that predicted language. Repeated rows count and are scored each; a null doc_id is not
    held out; other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = kept or Kept(spark, "langid")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    models = train_models(rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text"))
    scored = kept.keep(score_texts(rows, models), "scored")
    usual = scored.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred"))).groupBy("lang_pred").agg(
        (F.avg("cross_entropy") + deviations * F.coalesce(F.stddev_pop("cross_entropy"), F.lit(0.0))).alias("most"))
    out = scored.join(usual, "lang_pred", "left")
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy",
                      F.coalesce(F.col("cross_entropy") > F.col("most"), F.col("cross_entropy").isNull()).alias("rejected"))
