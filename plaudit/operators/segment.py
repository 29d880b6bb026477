"""Word segmentation of text without blanks (T5): a unigram lexicon learned by expectation-maximisation, Viterbi paths.

A text's pieces are runs without blanks; equal pieces are segmented once and count as often as they stand. Each round, tasks add
up the expected counts of lexicon entries over all segmentations of their pieces (forward and backward sums) and
Spark sums them by entry; entries whose expected count stays small leave the lexicon, single characters never do.
The lexicon is bounded by ``max_words``, so it may be sent to every task.

Tasks work on many pieces at once: the pieces' first characters, then their second ones and so on are one numpy step each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.session import materialize

MAX_CHARS, MAX_WORDS, ROUNDS = 8, 50_000, 4
#: Characters of a piece segmented together (cut there, a word may be split), and of the pieces that one numpy pass takes.
SPAN, PASS_CHARS = 4096, 1 << 18
#: Characters of distinct pieces that a task goes through at most; their substrings are sorted together.
TASK_CHARS = 1 << 22
#: Segmented spans that a task remembers, and entries of a trie's table of steps (a larger one is searched instead).
MEMO, TABLE = 1 << 18, 1 << 24
_COUNTED = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.DoubleType())])


def pieces(df: DataFrame, text: Column, pattern: str = r"\P{L}+") -> DataFrame:
    """(piece, n): the distinct lower-case runs of ``text`` between what ``pattern`` matches, and how often each stands."""
    runs = df.select(F.explode(F.array_remove(F.split(F.lower(text), pattern), "")).alias("piece"))
    return runs.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def log_lexicon(counts: dict[str, float]) -> dict[str, float]:
    total = sum(counts.values())
    return {w: math.log(c / total) for w, c in counts.items() if c > 0}


def unknown(lexicon: dict[str, float]) -> float:
    """Log probability of a character that the lexicon lacks: below that of any entry."""
    return min(lexicon.values(), default=0.0) - 2.0


class Trie:
    """A lexicon as arrays: node 0 is the root, a step (node, character) leads to a node, a node that ends a word has its log probability."""

    def __init__(self, lexicon: dict[str, float], most: int = MAX_CHARS):
        nodes: dict[str, int] = {"": 0}
        for word in lexicon:
            if len(word) <= most:
                for end in range(1, len(word) + 1):
                    nodes.setdefault(word[:end], len(nodes))
        self.most, self.floor = most, unknown(lexicon)
        self.words = list(nodes)
        self.log = np.array([lexicon.get(w, -math.inf) for w in nodes])
        self.chars = np.unique(np.array([ord(w[-1]) for w in self.words[1:]], np.int64))
        wide = len(self.chars) + 1  # number 0 is a character that no entry has
        step = np.array([nodes[w[:-1]] * wide for w in self.words[1:]], np.int64) + self._number(np.array([ord(w[-1]) for w in self.words[1:]], np.int64))
        order = np.argsort(step)
        self.step, self.to = step[order], (order + 1).astype(np.int32)
        self.table = None

    def __getstate__(self):
        return {**self.__dict__, "table": None}  # made again where it is used

    def _number(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.chars):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, 0)

    def _next(self, nodes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The nodes that steps lead to, -1 for none."""
        wide = len(self.chars) + 1
        key = nodes * wide + numbers
        if len(self.words) * wide <= TABLE:
            if self.table is None:
                self.table = np.full(len(self.words) * wide, -1, np.int32)
                self.table[self.step] = self.to
            return self.table[key]
        at = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
        return np.where(self.step[at] == key, self.to[at], -1)

    def arcs(self, codes: np.ndarray) -> np.ndarray:
        """[length - 1, begin]: the node of the entry or prefix of that length that begins there, or -1. A code of 0 ends a text."""
        out = np.full((self.most, len(codes)), -1, np.int32)
        numbers = np.append(self._number(codes), np.zeros(self.most, np.int64))
        alive, node = np.flatnonzero(numbers[:len(codes)]), np.zeros(len(codes), np.int64)
        node = node[alive]
        for k in range(self.most):
            to = self._next(node, numbers[alive + k])
            found = to >= 0
            alive, node = alive[found], to[found].astype(np.int64)
            out[k, alive] = node
        return out


class _Steps:
    """Texts side by side: step t holds the t-th characters of all texts that have one, longest texts first."""

    def __init__(self, texts: list[str], trie: Trie):
        self.order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.codes = np.frombuffer("\0".join([*self.texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.steps = int(self.sizes[0]) if len(texts) else 0
        # texts that have a t-th character, and where their step begins
        self.many = np.searchsorted(-self.sizes, -np.arange(self.steps), "left")
        self.at = np.cumsum(self.many) - self.many
        self.place = np.concatenate([begins[:m] + t for t, m in enumerate(self.many)] or [np.zeros(0, np.int64)])
        self.trie = trie
        self.nodes = trie.arcs(self.codes)[:, self.place]
        self.log = np.where(self.nodes >= 0, trie.log[self.nodes], -math.inf)
        self.log[0] = np.where(np.isneginf(self.log[0]), trie.floor, self.log[0])

    def _into(self, t: int, score: np.ndarray) -> np.ndarray:
        """[length, text]: score of the arcs that end with step t, longest first; ``score`` is that of ends."""
        m, lengths = self.many[t], range(min(self.trie.most, t + 1), 0, -1)
        out = np.empty((len(lengths), m))
        for row, k in enumerate(lengths):
            begin = self.at[t - k + 1]
            out[row] = self.log[k - 1, begin:begin + m]
            if t >= k:
                out[row] += score[self.at[t - k]:self.at[t - k] + m]
        return out

    def paths(self) -> list[list[str]]:
        """The most probable segmentation of each text as given; of equal ones that whose words, from the end, are longest."""
        score, back = np.empty(len(self.place)), np.empty(len(self.place), np.int64)
        for t in range(self.steps):
            into, here = self._into(t, score), slice(self.at[t], self.at[t] + self.many[t])
            best = into.argmax(axis=0)
            score[here], back[here] = into[best, np.arange(self.many[t])], len(into) - best
        out: list[list[str]] = [[] for _ in self.texts]
        sizes = np.zeros(len(self.codes), np.int64)
        sizes[self.place] = back
        sizes, begin = sizes.tolist(), 0
        for i, text in zip(self.order, self.texts):
            words, n = out[i], len(text)
            while n:
                size = sizes[begin + n - 1]
                words.append(text[n - size:n])
                n -= size
            words.reverse()
            begin += len(text) + 1
        return out

    def expected(self, times: list[float]) -> dict[str, float]:
        """Expected count of each entry over all segmentations of the texts, a text counted ``times``."""
        most, n = self.trie.most, len(self.place)
        score, weight = np.empty(n), np.zeros((most, n))
        for t in range(self.steps):
            into, here = self._into(t, score), slice(self.at[t], self.at[t] + self.many[t])
            top = into.max(axis=0)
            into = np.exp(into - top)
            total = into.sum(axis=0)
            score[here] = top + np.log(total)
            weight[:len(into), here] = (into / total)[::-1]
        # the share of all paths through each end, from the last one
        ahead, share = np.zeros(n), np.zeros((most, n))
        times = np.array([times[i] for i in self.order], np.float64)
        full = np.flatnonzero(self.sizes)
        ahead[self.at[self.sizes[full] - 1] + full] = times[full]
        for t in range(self.steps - 1, -1, -1):
            m, mine = self.many[t], ahead[self.at[t]:self.at[t] + self.many[t]]
            for k in range(1, min(most, t + 1) + 1):
                part = mine * weight[k - 1, self.at[t]:self.at[t] + m]
                share[k - 1, self.at[t - k + 1]:self.at[t - k + 1] + m] = part
                if t >= k:
                    ahead[self.at[t - k]:self.at[t - k] + m] += part
        known = self.nodes >= 0
        counts = np.bincount(self.nodes[known], share[known], minlength=len(self.trie.words))
        out = {self.trie.words[i]: float(counts[i]) for i in np.flatnonzero(counts)}
        missing = np.flatnonzero(~known[0])
        codes, which = np.unique(self.codes[self.place[missing]], return_inverse=True)
        for code, c in zip(codes.tolist(), np.bincount(which, share[0, missing], minlength=len(codes)).tolist()):
            if c:
                out[chr(code)] = c
        return out


def best_path(text: str, lexicon: dict[str, float], most: int = MAX_CHARS) -> list[str]:
    """The most probable segmentation; of equal ones that whose words, from the end, are longest."""
    return _Steps([text], Trie(lexicon, most)).paths()[0]


def expected(text: str, lexicon: dict[str, float], most: int = MAX_CHARS) -> dict[str, float]:
    """Expected count of each entry over all segmentations of a text."""
    return _Steps([text], Trie(lexicon, most)).expected([1.0])


def substrings(texts: list[str], times: list[float], most: int = MAX_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, counts) of all substrings of up to ``most`` characters, by length: the texts' suffixes are sorted to that depth."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    weight = np.repeat(np.array(times, np.float64), [len(t) + 1 for t in texts])
    chars, number = np.unique(codes, return_inverse=True)
    number = np.append(number if not len(chars) or chars[0] == 0 else number + 1, np.zeros(most, np.int64)).astype(np.uint64)
    bits = max(1, len(chars).bit_length())
    each = 64 // bits
    keys = []
    for begin in range(0, most, each):
        key = np.zeros(len(codes), np.uint64)
        for k in range(begin, min(begin + each, most)):
            key = key << np.uint64(bits) | number[k:k + len(codes)]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    weight, codes = weight[order], np.append(codes, np.zeros(most, np.uint32))
    head, inside = np.zeros(len(order), bool), np.ones(len(order), bool)
    head[:1] = True
    picked = []
    for k in range(most):
        char = codes[order + k]
        inside &= char != 0
        head[1:] |= char[1:] != char[:-1]
        begins = np.flatnonzero(head)
        if not len(begins):
            return
        counts, there = np.add.reduceat(weight, begins), inside[begins]
        picked = order[begins[there]]
        if not len(picked):
            return
        words = np.ascontiguousarray(codes[picked[:, None] + np.arange(k + 1)]).view(f"<U{k + 1}").ravel()
        yield words, counts[there]


def _spans(text: str) -> list[str]:
    return [text[i:i + SPAN] for i in range(0, len(text), SPAN)]


def _passes(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[str], list[float]]]:
    """Spans of pieces and how often each stands, about ``chars`` characters at a time."""
    spans, times, size = [], [], 0
    for batch in batches:
        for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist()):
            for span in _spans(piece):
                spans.append(span)
                times.append(float(n))
                size += len(span)
                if size >= chars:
                    yield spans, times
                    spans, times, size = [], [], 0
    if spans:
        yield spans, times


def _counted(words, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.float64())], _COUNTED.names)


def _substring_counts(runs: DataFrame, most: int) -> DataFrame:
    """(word, n) of all substrings of the pieces. A task sends each of its own once, so they are dealt before they are summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans, times in _passes(batches, TASK_CHARS):
            for words, counts in substrings(spans, times, most):
                yield _counted(words, counts)

    return runs.select("piece", "n").mapInArrow(run, _COUNTED).repartition("word").groupBy("word").agg(F.sum("n").alias("n"))


def _expected_counts(runs: DataFrame, lexicon: dict[str, float], most: int) -> DataFrame:
    """(word, n) of the lexicon's entries, expected over the pieces."""
    shared = runs.sparkSession.sparkContext.broadcast(Trie(lexicon, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}  # the lexicon bounds it
        for spans, times in _passes(batches, PASS_CHARS):
            for word, c in _Steps(spans, shared.value).expected(times).items():
                held[word] = held.get(word, 0.0) + c
        yield _counted(list(held), list(held.values()))

    return runs.select("piece", "n").mapInArrow(run, _COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def spread(df: DataFrame, chars: int, *by: str) -> DataFrame:
    """Rows dealt over tasks by characters: the work is in Python and grows with them, not with the bytes that size a partition."""
    return df.repartition(max(math.ceil(chars / TASK_CHARS), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / (1 << 16))), 1), *by)


def learn_lexicon(df: DataFrame, text: Column, rounds: int = ROUNDS, most: int = MAX_CHARS, max_words: int = MAX_WORDS, least: float = 2.0,
                  pattern: str = r"\P{L}+") -> dict[str, float]:
    """Log probabilities of at most ``max_words`` words of up to ``most`` characters (and every single character among them).

    Starts from the counts of all substrings; of longer ones those that stand ``least`` times or more and weigh most (count times
    length) are kept, and each round the entries whose expected count falls below ``least`` leave."""
    runs = materialize(pieces(df, text, pattern))
    runs = spread(runs, runs.agg(F.sum(F.length("piece"))).first()[0] or 0, "piece")

    def kept(counted: DataFrame) -> dict[str, float]:
        single = F.length("word") == 1
        rows = counted.where(single | (F.col("n") >= least)).orderBy(single.desc(), (F.col("n") * F.length("word")).desc(), "word").limit(max_words)
        return {r.word: r.n for r in rows.collect()}  # bounded by max_words

    lexicon = log_lexicon(kept(_substring_counts(runs, most)))
    for _ in range(rounds):
        lexicon = log_lexicon(kept(_expected_counts(runs, lexicon, most)))
    return lexicon


class _Letters(dict):
    """Lower case of letters, a blank for every other character, for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = c.lower() if c.isalpha() else " "
        return out


def segmenter(spark, lexicon: dict[str, float], most: int = MAX_CHARS):
    """A Column function (array of words) for ``tokenizer=`` arguments: Viterbi paths inside Arrow batches, the lexicon read once a task."""
    shared = spark.sparkContext.broadcast(Trie(lexicon, most))

    @F.pandas_udf("array<string>")
    def words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie, memo, letters = shared.value, {}, _Letters()
        for series in texts:
            rows = [[span for piece in (text or "").translate(letters).split() for span in _spans(piece)] for text in series]
            if len(memo) > MEMO:
                memo.clear()
            new = list(dict.fromkeys(span for row in rows for span in row if span not in memo))
            while new:
                size = np.cumsum([len(span) for span in new])
                end = int(np.searchsorted(size, PASS_CHARS)) + 1
                memo.update(zip(new[:end], _Steps(new[:end], trie).paths()))
                new = new[end:]
            yield pd.Series([[word for span in row for word in memo[span]] for row in rows], dtype=object)

    return words
