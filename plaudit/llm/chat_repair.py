"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Conversations are dealt by id, sorted by turn and streamed. The edits of one conversation are the paths of a DAG whose
nodes are (rows left, state of the role machine). A path's weight is one integer: its high digits are the cost, its low
digits are the audit letters, one place a letter from the left, padded with zeros at the end. So one ordinary integer
minimum a node decides cost and ties alike, and the least weight spells the audit out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaudit.llm.common import arrow_batch, small_batches

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # on top, for a truncated row that stays


#: Letters in ASCII order; their place is the digit, 0 is the padding.
LETTERS = " DIKR"
DIGIT = {letter: i for i, letter in enumerate(LETTERS)}
BITS = 3
#: Role machine of ``(s?(ua)+)?``: what may follow in each state. ``start`` and ``a`` may end.
MOVES = {"start": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ENDS = ("start", "a")
ROLE = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple[str, str | None]], costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, audit) of the least edits of rows given as (role initial, first fault).

    Weights are built from the last row back. An edit before a rest of the path puts its letter at the first place and moves
    the rest's letters one place on; ``places`` is never exceeded, as nothing needs more than two inserts at one point."""
    places = 3 * len(rows) + 2
    low = BITS * places
    letters = (1 << low) - 1
    none = 1 << (low + (12 * len(rows) + 64).bit_length() + 1)  # above any weight

    def before(letter: str, cost: int, rest: int) -> int:
        if rest >= none:
            return none
        return (((rest >> low) + cost) << low) | (DIGIT[letter] << (low - BITS)) | ((rest & letters) >> BITS)

    def with_inserts(best: dict[str, int]) -> dict[str, int]:
        for _ in MOVES:  # an insert leads on within one point; no cheapest path returns to a state there
            best = {s: min([w, *(before("I", costs.insert, best[to]) for r, to in MOVES[s].items() if r in ROLE)]) for s, w in best.items()}
        return best

    best = with_inserts({s: 0 if s in ENDS else none for s in MOVES})
    for initial, fault in reversed(rows):
        extra = costs.truncated if fault == TRUNCATED else 0
        now = {}
        for state, moves in MOVES.items():
            ways = [before("D", costs.delete, best[state])]
            if fault not in (BLANK, DUPLICATE):
                if initial in moves:
                    ways.append(before("K", costs.keep + extra, best[moves[initial]]))
                ways += [before("R", costs.rerole + extra, best[to]) for role, to in moves.items() if role in ROLE]
            now[state] = min(ways)
        best = with_inserts(now)
    weight = best["start"]
    audit = "".join(LETTERS[weight >> (low - BITS * (i + 1)) & (1 << BITS) - 1] for i in range(places))
    return weight >> low, audit.rstrip(" ")


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits."""
    out, left, wanted = [], iter(rows), "u"
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        role = role if letter == "K" else ROLE[wanted]
        out.append((role, text))
        wanted = "a" if role[:1] == "u" else "u"
    return out


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """First fault of each row: blank, duplicate (role and text seen earlier), truncated (ends without ``.``, ``!`` or ``?``)."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(_SPACE)[-1:]
        mark = hashlib.sha256(f"{role}\0{text}".encode()).digest()
        out.append(BLANK if not end else DUPLICATE if mark in seen else None if end in ".!?" else TRUNCATED)
        seen.add(mark)
    return out


def damage_kind(conv_id: Column, turn: Column) -> Column:
    """0 to 19 by crc32 of ``conv_id:turn``; a null is one space."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return F.crc32(F.concat(text(conv_id), F.lit(":"), text(turn)).cast("binary")) % 20


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage. A dropped row stays with ``gone`` and no text, so that its conversation is known."""
    kind = damage_kind(F.col("conv_id"), F.col("turn"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                       T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
REPAIRED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turns, rows as (role, text)) of each conversation, from rows that come sorted."""
    now, turns, rows = None, [], []
    for batch in batches:
        for conv, turn, role, text, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
            if now != (conv,):
                if now:
                    yield now[0], turns, rows
                now, turns, rows = (conv,), [], []
            if not gone:
                turns.append(turn)
                rows.append((role, text))
    if now:
        yield now[0], turns, rows


def _sorted(rows: DataFrame) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, position, role, text of the repaired conversations (rows as ``damaged`` gives them; see ``repair_digest``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, _, said in _conversations(batches):
            _, audit = cheapest([(role[:1], fault) for (role, _), fault in zip(said, faults(said))], costs)
            yield arrow_batch([(conv, i, role, text) for i, (role, text) in enumerate(repaired(said, audit))], REPAIRED)

    return _sorted(rows).mapInArrow(run, REPAIRED)


def repair_digest(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: faults, gaps, illegal neighbours, cost and audit of the cheapest edits, digest of the repaired rows.

    Rows go by turn (null first), then role and text; ties and repeated rows all stay, in that order. Rows without conv_id
    are one conversation. A null role or text is one space: a blank text is deleted, and a role that starts with none of
    s, u, a can't be kept. A conversation whose rows are all gone has zeros, an empty audit and the digest of an empty
    string. Other columns are not read; an empty table gives no rows. One conversation is one task: its digest and its DP run
    in turn order; the worker holds its rows, and integers of 9 bits a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, turns, said in _conversations(batches):
            found = faults(said)
            initials = [role[:1] for role, _ in said]
            cost, audit = cheapest(list(zip(initials, found)), costs)
            known = {t for t in turns if t is not None}
            gaps = max(known) - min(known) + 1 - len(known) if known else 0
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            text = "\n".join(f"{role}:{text}" for role, text in repaired(said, audit))
            out.append((conv, gaps, *(found.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
            if len(out) >= 1024:
                yield arrow_batch(out, DIGEST)
                out = []
        yield arrow_batch(out, DIGEST)

    return _sorted(rows).mapInArrow(run, DIGEST)
