"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text and folded to distinct texts with a multiplicity (partial folding
before the shuffle, so a text of many copies costs one row a task). Workers tokenise the distinct texts by both
tokenizers and align them by byte offsets, in blocks of texts. A block lists its distinct id pairs once, with
how many documents hold each; Spark sums these over blocks, joins the corpus-wide counts back to the blocks'
lists, and each block settles its texts. The measures are joined to doc_ids by a SHA-256 of the text."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.llm.common import Kept, arrow_batch

#: Bytes of text in one block (a longer text is a block of its own): bounds a block's rows and lists.
BLOCK_BYTES = 4 << 20
#: Longer texts are given to the tokenizers in parts cut where no token of either can cross.
PART_CHARS = 1 << 16

_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
#: Characters on whose classes all regular-expression libraries agree.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u017f\u2010-\u2027]*")


def _unicode_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Both tokenizers and the bytes of their tokens. ``a_path`` is a byte-level BPE of the tokenizers library, ``b_path`` a
    sentencepiece model. Where A's ids follow its merges, the same vocabulary as ranks gives the same ids several times
    faster; texts with characters whose class may depend on the library's Unicode version are left to A's own library."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _unicode_bytes()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [model["vocab"]["".join(m)] for m in pairs]
        self.ranked = None
        if merged == sorted(merged) and merged[0] > max(model["vocab"][c] for c in byte_of):
            ranks = {a_bytes[i]: i for i in model["vocab"].values() if i <= merged[-1]}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a_bytes, b_bytes
        self.lengths = np.array([len(t) for t in a_bytes]), np.array([len(t) for t in b_bytes])
        # a space between letters may be cut if no piece goes over it
        self.cuts = not any(re.search(r".[^▁]▁|[^▁]▁", p) for p in pieces)
        na, nb = len(a_bytes), len(b_bytes)
        self.shift = nb
        # decimal ids with what follows them: "," inside a side, "|" after A's last, ";" after B's last
        self.ends, self.b_words = (na, nb), 2 * na
        self.words = [f"{i}{after}" for n, afters in ((na, ",|"), (nb, ",;")) for after in afters for i in range(n)]

    def parts(self, text: str) -> list[str]:
        """The text after its added space, cut before spaces that no token crosses; each part lacks its leading space."""
        if not self.cuts or len(text) <= PART_CHARS:
            return [text]
        out, begin = [], 0
        while len(text) - begin > PART_CHARS and (cut := _CUT.search(text, begin + PART_CHARS)):
            out.append(text[begin:cut.start()])
            begin = cut.end()
        return [*out, text[begin:]]

    def encode_a(self, text: str) -> list[int]:
        if self.ranked and _PLAIN.fullmatch(text):
            return self.ranked.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by A and by B of space + text; None if a side's tokens don't give back these bytes (or the text is empty)."""
        cut = [self.parts(t) for t in texts]
        flat = [p for parts in cut for p in parts]
        a_ids = [self.encode_a(" " + p) for p in flat]
        b_ids = self.b.encode(flat, num_threads=1) if flat else []
        out, begin = [], 0
        for text, parts in zip(texts, cut):
            end = begin + len(parts)
            a, b = (ids[begin] if len(parts) == 1 else [i for part in ids[begin:end] for i in part] for ids in (a_ids, b_ids))
            begin, wanted = end, b" " + text.encode()
            fits = text and all(b"".join(map(table.__getitem__, ids)) == wanted for table, ids in zip(self.bytes, (a, b)))
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if fits else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, str]:
        """Number of groups, the packed id pair of each link, digest of the groups.

        The union of both sides' token ends cuts the bytes into segments; each lies in one token of either side, and
        two tokens overlap in exactly one segment, so the segments are the links. Ends that both sides have close a group."""
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        side = np.zeros(ends_a[-1] + 1, np.uint8)
        side[ends_a] = 1
        side[ends_b] += 2
        side = side[side > 0]  # one entry a segment: which sides end there
        through_a, through_b = np.cumsum(side & 1, dtype=np.int64), np.cumsum(side >> 1, dtype=np.int64)
        links = a[through_a - (side & 1)] * self.shift + b[through_b - (side >> 1)]
        shared = side == 3
        group = np.cumsum(shared, dtype=np.int64) - shared
        group_a, group_b, to_a, to_b = group[side & 1 > 0], group[side >> 1 > 0], through_a[shared], through_b[shared]
        a_words, b_words, written = a.copy(), b + self.b_words, np.empty(len(a) + len(b), np.int64)
        a_words[to_a - 1] += self.ends[0]
        b_words[to_b - 1] += self.ends[1]
        written[np.arange(len(a)) + np.append(0, to_b[:-1])[group_a]] = a_words
        written[np.arange(len(b)) + to_a[group_b]] = b_words
        text = "".join(map(self.words.__getitem__, written.tolist()))[:-1]
        return len(to_a), links, hashlib.sha256(text.encode()).hexdigest()


_LOADED: dict[tuple[str, str], Aligner] = {}


def load(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Aligner(a_path, b_path)
    return _LOADED[a_path, b_path]


_LONGS, _INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
#: One block: per text key, n_a, n_b, n_groups, digest; the distinct pairs of each text (as places in ``pairs``, texts one after
#: another, ``sizes`` of them a text) and how often each is linked in it; the block's distinct pairs and the documents that hold each.
BLOCKS = T.StructType([
    T.StructField("keys", T.ArrayType(T.BinaryType())), T.StructField("n_a", _LONGS), T.StructField("n_b", _LONGS), T.StructField("n_groups", _LONGS),
    T.StructField("groups_sha256", T.ArrayType(T.StringType())), T.StructField("sizes", _INTS), T.StructField("places", _INTS), T.StructField("times", _INTS),
    T.StructField("pairs", _LONGS), T.StructField("documents", _LONGS)])
MEASURES = T.StructType([T.StructField("key", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])


def text_blocks(texts: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of distinct texts (key, text, documents), tokenised and aligned. Texts without tokens (see ``Aligner.encode``) are left out."""

    def block(aligner: Aligner, held: list[tuple[bytes, str, int]]) -> tuple | None:
        rows, links, weights = [], [], []
        for (key, _, documents), ids in zip(held, aligner.encode([t for _, t, _ in held])):
            if ids is None:
                continue
            groups, pairs, digest = aligner.align(*ids)
            distinct, times = np.unique(pairs, return_counts=True)
            rows.append((key, len(ids[0]), len(ids[1]), groups, digest, len(distinct)))
            links.append((distinct, times))
            weights.append(documents)
        if not rows:
            return None
        keys, n_a, n_b, n_groups, digests, sizes = zip(*rows)
        pairs, places = np.unique(np.concatenate([p for p, _ in links]), return_inverse=True)
        documents = np.zeros(len(pairs), np.int64)
        np.add.at(documents, places, np.repeat(np.array(weights, np.int64), sizes))
        return keys, n_a, n_b, n_groups, digests, sizes, places.astype(np.int32), np.concatenate([t for _, t in links]).astype(np.int32), pairs, documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = load(a_path, b_path), [], 0
        for batch in batches:
            for row in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("documents").to_pylist()):
                held.append(row)
                size += len(row[1].encode())
                if size >= block_bytes:
                    if out := block(aligner, held):
                        yield arrow_batch([out], BLOCKS)
                    held, size = [], 0
        if held and (out := block(aligner, held)):
            yield arrow_batch([out], BLOCKS)

    return texts.select("key", "text", "documents").mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame, shift: int) -> DataFrame:
    """(pair, count, best): documents that hold each pair of ids linked, and whether no pair of the same A id is held by more."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "documents")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.documents").alias("count"))
    a = F.floor(F.col("pair") / shift)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The measures of each text of a block, whose pairs stand with their corpus-wide counts (``found``)."""
    for batch in batches:
        for r in range(len(batch)):
            one = {name: batch.column(name)[r].values for name in batch.schema.names if name != "block"}
            found = one["found"]
            order = np.argsort(found.field("pair").to_numpy())
            count = found.field("count").to_numpy()[order]
            best = found.field("best").to_numpy(zero_copy_only=False)[order]
            places, times, sizes = one["places"].to_numpy(), one["times"].to_numpy().astype(np.int64), one["sizes"].to_numpy()
            begins = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(v, begins) for v in (times, times * best[places], times * count[places])]
            yield pa.RecordBatch.from_arrays([one["keys"].cast(pa.binary()), one["n_a"], one["n_b"], one["n_groups"], *(pa.array(s, pa.int64()) for s in sums), one["groups_sha256"]], MEASURES.names)


def align_documents(docs: DataFrame, a_path: str, b_path: str, kept: Kept, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    A null or empty text, and one that a tokenizer doesn't give back byte for byte, has zeros and an empty digest; it adds to
    no count. Repeated rows count as a document each, also with a null or shared doc_id. Other columns are not read; an
    empty table gives no rows. The paths are files that every worker has."""
    shift = load(a_path, b_path).shift
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif("text", F.lit("")).alias("text"))
    texts = rows.where("text is not null").groupBy("text").agg(F.count("*").alias("documents"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "documents")
    blocks = kept.keep(text_blocks(texts, a_path, b_path, block_bytes).select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    counts = kept.keep(pair_counts(blocks, shift), "counts")
    asked = blocks.select("block", F.explode("pairs").alias("pair")).join(counts, "pair")
    found = asked.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    settled = blocks.select("block", *(c for c in BLOCKS.names if c not in ("pairs", "documents"))).join(found, "block")
    measures = kept.keep(settled.mapInArrow(_settle, MEASURES), "measures")
    kept.drop("blocks", "counts")
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    keyed = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"))
    return keyed.join(measures, "key", "left").select("doc_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
