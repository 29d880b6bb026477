"""Byte-level BPE encoding and decoding, exact and linear in the length of a piece.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton finds the
longest token at every place. Encoding takes the longest token, steps back to shorter
ones where two neighbours would have merged otherwise, and marks places from which no
way leads on, so each place is tried a bounded number of times. Two tokens may stand
side by side exactly if BPE would not merge across their border; that test follows
the merges of both tokens downwards and is memoised.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plaudit.llm.common import small_batches

#: Pieces and neighbour pairs a worker remembers; a full memory is emptied, which costs time only.
MEMO_PIECES, MEMO_PAIRS = 200_000, 400_000


class ByteBPE:
    """The ranks of a ``.tiktoken`` file with their merges.

    A token's merge is its split into the two tokens that lower ranks leave of it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        self.rank = {}
        for raw, rank in ranks.items():
            self.token[rank] = raw
            self.rank[raw.decode("latin-1")] = rank
        self.length = [len(t) for t in self.token]
        self.left, self.right = list(range(size)), list(range(size))
        self.merge: dict[tuple[int, int], int] = {}
        reachable = ahocorasick.Automaton()
        self.shorter = [-1] * size
        for rank in sorted(ranks.values()):
            raw = self.token[rank]
            if len(raw) > 1:
                parts = self._merged([ranks[raw[i:i + 1]] for i in range(len(raw))], rank)
                if len(parts) != 2:
                    continue  # merges never make this token; only a whole piece can be it
                self.left[rank], self.right[rank] = parts
                self.merge[parts[0], parts[1]] = rank
            reachable.add_word(raw.decode("latin-1"), rank)
        reachable.make_automaton()
        self.automaton = reachable
        for text, rank in self.rank.items():
            for n in range(len(text) - 1, 0, -1):
                if (one := self.rank.get(text[:n], -1)) >= 0 and (n == 1 or self.left[one] != one):
                    self.shorter[rank] = one
                    break
        self.pairs: dict[int, bool] = {}
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.lengths = np.array(self.length, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def _merged(self, parts: list[int], below: int) -> list[int]:
        """Plain BPE with the merges of lower rank."""
        while len(parts) > 1:
            best = min((self.merge.get(p, below), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] >= below:
                break
            parts[best[1]:best[1] + 2] = [best[0]]
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b apart when their bytes stand side by side."""
        merge, left, right = self.merge, self.left, self.right
        limit = len(self.token)
        while True:
            if merge.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:  # a single byte: go on with the other side
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_piece(self, text: str) -> list[int]:
        """Ids of one piece; ``text`` holds its bytes as Latin-1 characters."""
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [0] * n
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token  # ends rise, so the last one stays
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        dead, out, place, token, last = bytearray(n + 1), [], 0, longest[0], -1
        while True:
            end = place + length[token]
            fits = not dead[end]
            if fits and last >= 0:
                key = last << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.neighbours(last, token)
            if fits:
                out.append(token)
                if end == n:
                    return out
                place, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[place] = 1
                token = out.pop()
                place -= length[token]
                last = out[-1] if out else -1

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered from one table of all tokens."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.begins[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


class Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers, filled on demand."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        ids = np.array(self.bpe.encode_piece(text), "<u4").tobytes()
        if len(self) > MEMO_PIECES:
            self.clear()
        self[piece] = ids
        return ids


_LOADED: dict[tuple[str, str], Pieces] = {}


def load(path: str, pattern: str) -> Pieces:
    """The tokenizer of this worker process, built once."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[path, pattern] = Pieces(ByteBPE(ranks, pattern))
    return _LOADED[path, pattern]


def encode_texts(texts: Iterable[str], pieces: Pieces) -> Iterator[np.ndarray]:
    split = pieces.bpe.pattern.findall
    for text in texts:
        yield np.frombuffer(b"".join([pieces[p] for p in split(text)]), "<u4")


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, only with ``keep_ids``), ids_sha256, decoded_sha256 of every whole text.

    A null or empty text has no tokens. Repeated rows are encoded each; a null doc_id stays null; other
    columns are not read; an empty table gives no rows. ``path`` is a file every worker has. Narrow: no shuffle."""
    small_batches(docs.sparkSession)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([f for f in fields if keep_ids or f.name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path, pattern)
        for batch in batches:
            counts, all_ids, hashed, decoded = [], [], [], []
            for ids in encode_texts((t or "" for t in batch.column("text").to_pylist()), pieces):
                counts.append(len(ids))
                if keep_ids:
                    all_ids.append(ids.astype(np.int32))
                hashed.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(pieces.bpe.decode(ids)).hexdigest())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                columns.insert(2, pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
