"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of consecutive words. Every passage is encoded (surface
shares and hashed words); a gated attention network, learned from document labels only,
weighs the passages, and a linear head scores the weighted representation. Training
uses a bounded sample of labelled rows; scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.llm.common import is_held_out, prefix_hash, row_hash, runs_of, small_batches, span_hash, text_chunks, word_bounds

PASSAGE_WORDS = 64
HASHED = 32
#: Labelled documents per class that training may use (all their passages count), and passages that one training step holds at a time.
SAMPLE_PER_CLASS, STEP_PASSAGES = 2000, 1 << 15

_CLASSES = ("A-Z", "a-z", "0-9", "#*$%&|<>", "!?", ".,;:", "other ASCII", "beyond ASCII")


def _class_table() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[128:] = 7
    table[65:91], table[97:123], table[48:58] = 0, 1, 2
    for k, chars in ((3, b"#*$%&|<>"), (4, b"!?"), (5, b".,;:")):
        table[list(chars)] = k
    return table


CLASS_OF = _class_table()
FEATURES = len(_CLASSES) + 7 + HASHED


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


def encode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features [passages, FEATURES] and the offsets of each text's passages; a text without words has one passage of zeros."""
    starts, ends, text = word_bounds(data, offs)
    n_words = np.bincount(text, minlength=len(offs) - 1)
    n_pass = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    at = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((at[-1], FEATURES), np.float32)
    if not len(starts):
        return x, at
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    place = np.arange(len(starts)) - first_word[text]
    passage = at[text] + place // PASSAGE_WORDS
    words = np.bincount(passage, minlength=at[-1]).astype(float)
    some = np.maximum(words, 1)
    length = ends - starts
    chars = np.maximum(np.bincount(passage, length, at[-1]), 1)
    heads = np.flatnonzero(place % PASSAGE_WORDS == 0)
    tails = np.append(heads[1:], len(starts)) - 1
    for k in range(len(_CLASSES)):
        upto = np.concatenate([[0], np.cumsum(CLASS_OF[data] == k, dtype=np.int64)])
        x[passage[heads], k] = (upto[ends[tails]] - upto[starts[heads]]) / chars[passage[heads]]
    hashes = span_hash(prefix_hash(data), starts, ends)
    salt = passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    triple, of = runs_of(hashes, text, 3)
    again = np.zeros(len(starts), bool)
    again[first_word[of] + (np.arange(len(of)) - np.searchsorted(of, of))] = _seen_before(triple ^ (of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    first = CLASS_OF[data[starts]]
    k = len(_CLASSES)
    x[:, k] = np.log1p(words) / 5
    x[:, k + 1] = chars / some / 10
    x[:, k + 2] = np.bincount(passage, _seen_before(hashes ^ salt), at[-1]) / some
    x[:, k + 3] = np.bincount(passage, same, at[-1]) / some
    x[:, k + 4] = np.bincount(passage, again, at[-1]) / some
    x[:, k + 5] = np.bincount(passage, first == 0, at[-1]) / some
    x[:, k + 6] = np.bincount(passage, length <= 2, at[-1]) / some
    slot = passage * HASHED + (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    x[:, k + 7:] = np.bincount(slot, minlength=at[-1] * HASHED).reshape(-1, HASHED) / some[:, None]
    return x, at


@dataclass
class AttentionMIL:
    """Parameters: standardisation, gated attention (V, U, w), linear head (c, b)."""

    mean: np.ndarray
    scale: np.ndarray
    V: np.ndarray
    U: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def attend(self, x: np.ndarray, at: np.ndarray):
        t, s = np.tanh(x @ self.V), 1 / (1 + np.exp(-(x @ self.U)))
        e = (t * s) @ self.w
        n = np.diff(at)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, at[:-1]), n)
        return t, s, a, np.add.reduceat(a[:, None] * x, at[:-1], axis=0)

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.attend((x - self.mean) / self.scale, at)[3]
        return 1 / (1 + np.exp(-np.clip(z @ self.c + self.b, -40, 40)))


def train(x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, hidden: int = 16, steps: int = 250, rate: float = 0.03,
          decay: float = 1e-3, seed: int = 7) -> AttentionMIL:
    """Full-batch Adam on the weighted logistic loss of the bags."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    d, n = x.shape[1], np.diff(at)
    prior = float((weight * y).sum() / weight.sum())
    m = AttentionMIL(mean, scale, rng.normal(0, 0.1, (d, hidden)), rng.normal(0, 0.1, (d, hidden)), rng.normal(0, 0.1, hidden), np.zeros(d), float(np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    first = {k: 0.0 for k in "VUwcb"}
    second = dict(first)
    total = weight.sum()
    # whole bags, up to STEP_PASSAGES passages together; a longer bag is a part of its own
    cuts = [0]
    while cuts[-1] < len(n):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + STEP_PASSAGES, "right")) - 1))
    for step in range(1, steps + 1):
        grads = {"V": decay * m.V, "U": decay * m.U, "w": decay * m.w, "c": decay * m.c, "b": 0.0}
        for i, j in zip(cuts[:-1], cuts[1:]):
            bags, own = x[at[i]:at[j]], at[i:j + 1] - at[i]
            t, s, a, z = m.attend(bags, own)
            p = 1 / (1 + np.exp(-np.clip(z @ m.c + m.b, -40, 40)))
            out = weight[i:j] * (p - y[i:j]) / total
            back = np.repeat(out, n[i:j]) * (bags @ m.c)
            e = a * (back - np.repeat(np.add.reduceat(a * back, own[:-1]), n[i:j]))
            gate = e[:, None] * m.w
            for k, g in (("V", bags.T @ (gate * s * (1 - t * t))), ("U", bags.T @ (gate * t * s * (1 - s))), ("w", (t * s).T @ e), ("c", z.T @ out), ("b", out.sum())):
                grads[k] = grads[k] + g
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            setattr(m, k, getattr(m, k) - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8))
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> AttentionMIL | None:
    """Learn from at most ``per_class`` labelled, not held-out documents of each class (by hash of the id).

    Ids with labels of both kinds count as good if most are. Of rows that share an id the one with the least hash of its text is
    learned from, so at most 2 * ``per_class`` texts reach the driver, as features. No labelled rows of either class: no model."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    sample = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offs in text_chunks(batch.column("text")):
                x, at = encode(data, offs)
                for a, b in zip(at[:-1], at[1:]):
                    out.append(x[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(out, pa.binary())], schema.names)

    # at most 2 * per_class ids are broadcast, and as many bags come back; a task folds an id's rows before the shuffle
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", row_hash(F.col("text"))).alias("text"))
    got = one.mapInArrow(passages, schema).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in got.column("x").to_pylist()]
    y = got.column("y").to_numpy()[order].astype(float)
    if len(set(y)) < 2:
        return None
    bags = [bags[i] for i in order]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    share = {c: sizes[c] / max((y == c).sum(), 1) for c in (0, 1)}
    return train(np.concatenate(bags), at, y, np.where(y == 1, share[1], share[0]))


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("passages", T.LongType())])


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0-1), passages for every row of ``docs`` (doc_id, text); labels (doc_id, quality) are only learned from.

    A null or empty text is one passage of zeros and gets that passage's score; without labels of both
    classes every score is 0.5. Repeated rows are scored each; a null doc_id is not held out and never
    learned from; other columns are not read; an empty table gives no rows. Scoring is narrow (no shuffle)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, offs in text_chunks(batch.column("text")):
                x, at = encode(data, offs)
                scores.append(model.score(x, at) if model else np.full(len(at) - 1, 0.5))
                sizes.append(np.diff(at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(np.concatenate(scores)), pa.array(np.concatenate(sizes))], SCORES.names)

    rows = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores ``least`` or more; rows are filtered where they are read."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            good = [np.zeros(0, bool)]
            for _, _, data, offs in text_chunks(batch.column("text")):
                x, at = encode(data, offs)
                good.append(model.score(x, at) >= least if model else np.full(len(at) - 1, 0.5 >= least))
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(run, docs.schema)
