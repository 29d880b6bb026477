"""Chat formatting: a finite-state machine over roles and a declarative template.

Conversations are dealt by id and sorted by turn, then streamed: a Python worker
holds one Arrow batch and the state of one conversation, however long that is.
The operator's output is text segments, each with a loss flag; joined in order
they are the training text. ``read_back`` parses that text again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """How turns are written. ``header`` takes the role; ``escaped`` characters get ``escape`` before
    them inside roles and texts, which keeps every control string out of texts. ``loss_roles``
    are the roles whose text is learned. ``moves`` are the allowed turns after each state
    (``start`` before the first); ``ends`` are the states in which a conversation may stop."""

    header: str = "### {role}: "
    footer: str = "</turn>\n"
    escape: str = "\\"
    escaped: str = "\\#<:"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def quote(self, text: str) -> str:
        return re.sub("([" + re.escape(self.escaped) + "])", lambda m: self.escape + m[1], text)

    def unquote(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of one turn with their loss flags."""
        before, after = self.header.split("{role}")
        return [(before + self.quote(role) + after, False), (self.quote(text), role in self.loss_roles), (self.footer, False)]

    def parser(self) -> re.Pattern:
        """Matches one written turn: role and text, still quoted."""
        before, after = self.header.split("{role}")
        body = "((?:" + re.escape(self.escape) + ".|[^" + re.escape(self.escaped) + "])*)"
        return re.compile(re.escape(before) + body + re.escape(after) + body + re.escape(self.footer), re.S)


DEFAULT = Template()
SEGMENTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn_no", T.LongType()), T.StructField("part", T.IntegerType()),
    T.StructField("segment", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("order_ok", T.BooleanType())])
READ = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("order_ok", T.BooleanType())])


def _ids(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column.tolist()]


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Segments (conv_id, turn_no from 0, part 0-2, segment, loss, order_ok) of every conversation.

    Rows go by turn (null first), then role and text; ties and repeated rows all stay, in that order. A
    null text or role is empty; rows without conv_id form one conversation. ``order_ok`` says whether the
    machine allowed all turns so far, and on a conversation's last turn, whether it may end there is
    decided by ``read_back``. No turn is left out, however the machine judges it. Other columns are not
    read. An empty table gives no segments. Each conversation's segments are in one partition, in order."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, number, fine = (), "start", 0, True
        for batch in batches:
            out = []
            for conv, role, text in zip(_ids(batch["conv_id"]), batch["role"], batch["text"]):
                if now != (conv,):
                    now, state, number, fine = (conv,), "start", 0, True
                fine = fine and role in template.moves.get(state, ())
                state = role
                out += [(conv, number, part, segment, loss, fine) for part, (segment, loss) in enumerate(template.turn(role, text))]
                number += 1
            frame = pd.DataFrame(out, columns=SEGMENTS.names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return rows.mapInPandas(write, SEGMENTS)


def read_back(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation, parsed from the written text alone (segments in order, as ``format_chats`` leaves them).

    The text under the loss flags is read with the flags: loss_sha256 is over it, unescaped."""
    parser = template.parser()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s = (), None

        def closed() -> tuple:
            if s["rest"]:
                raise ValueError(f"conversation {now[0]}: text that is no turn: {s['rest'][:80]!r}")
            return (now[0], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["fine"] and s["role"] in template.ends)

        for batch in batches:
            out = []
            for conv, segment, loss, fine in zip(_ids(batch["conv_id"]), batch["segment"], batch["loss"], batch["order_ok"]):
                if now != (conv,):
                    if s:
                        out.append(closed())
                    now, s = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rest": "", "fine": True, "role": ""}
                s["chars"] += len(segment)
                s["fine"] = bool(fine)
                if loss:
                    plain = template.unquote(segment)
                    s["loss"].update(_utf8(plain))
                    s["loss_chars"] += len(plain)
                s["rest"] += segment
                if segment == template.footer and (m := parser.fullmatch(s["rest"])):
                    s["role"] = template.unquote(m[1])
                    s["turns"].update(_utf8(f"{s['role']}\n{template.unquote(m[2])}\n"))
                    s["n"], s["rest"] = s["n"] + 1, ""
            yield _frame(out)
        if s:
            yield _frame([closed()])

    def _frame(out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=READ.names)
        return frame.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})

    return segments.mapInPandas(read, READ)
