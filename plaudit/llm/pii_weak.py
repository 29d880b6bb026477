"""Personal data by weak supervision, in DataFrame and Spark ML functions only.

Candidates are the matches of the fixed base patterns and wider ones: values given to a key, and long
digit runs. Labelers vote on each candidate: format (regex), gazetteer, context, variety of
characters, and edges. Expectation-maximisation over the counted vote patterns of all candidates
estimates the labelers' reliabilities; a logistic span classifier is trained on the posteriors, with features of the
span (shares of digits and letters, separators, length) and of its context (word before, neighbours) besides the votes.
Base matches always stay; the classifier adds others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.llm.common import Kept, once
from plaudit.llm.weak_supervision import fit_votes

# Base patterns. Possessive repeats and a look at what stands before a run's first character keep the
# leftmost matches of the plain patterns, without recursion or a second try inside a run:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+  (13 digits at least)              phone \+[0-9][\x20().0-9-]+[0-9]
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){12}(?:[\x20-]?+[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
#: Wider candidates: a value that a key is given, and digit runs of 9 to 12 digits.
SECRET = r"[A-Za-z](?<![A-Za-z0-9_][A-Za-z])[A-Za-z0-9_]{1,30}+\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{12,}+"
SECRET_VALUE = r"[=:]\x20?[\x22\x27]?([A-Za-z0-9+/_-]+)$"
NUMBER = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){8,11}+(?![\x20-]?[0-9])"
KINDS = (*BASE, "secret", "number")
SURFACE = ("digits", "letters", "separators", "word", "beside")
CONTEXT_BUCKETS = 16
LABELERS = ["v_format", "v_gazetteer", "v_context", "v_variety", "v_edges"]

# Gazetteers and cue words (fixed values).
TOP_DOMAINS = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pl|pt|br|mx|ru|cn|jp|in|au"
SECRET_KEYS = "password|passwd|pwd|pass|passphrase|token|access_token|auth_token|secret|client_secret|api_key|apikey|key|secret_key|private_key|auth|bearer|credential|credentials"
PLAIN_KEYS = "http|https|ftp|mailto|url|href|version|time|date|page|width|height|class|style|title|id"
CUES = {
    "email": "mail|e-mail|contact|write|correo|courriel", "ip": "ip|host|server|address|login|adresse", "card": "card|visa|credit|mastercard|tarjeta|carte|karte",
    "phone": "phone|tel|call|fax|mobile|telefon|teléfono", "secret": "login|secret|credential|password|token|key", "number": "account|ssn|passport|iban|phone|tel|card",
}
PLAIN_CUES = "version|page|isbn|issn|section|figure|year|total|price"


#: Spans that one running sum goes over, and characters in a chunk of a text: what is looked up among many is looked up in two steps.
SLICE, CHUNK = 256, 1024
SPANS_TYPE = "array<struct<start:bigint,end:bigint,match:string>>"


def sliced(array: Column) -> Column:
    """An array column cut into slices; appending to a running result then costs a slice, not all that stands before."""
    last = F.greatest(F.ceil(F.size(array) / SLICE) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.slice(array, (i * SLICE + 1).cast("int"), SLICE))


def before_each(slices: Column, value, zero: Column, join) -> Column:
    """For each slice what ``join`` makes of ``zero`` and the ``value`` of all slices before it."""
    kind = "array<bigint>"
    return F.aggregate(slices, F.struct(zero.alias("at"), F.array().cast(kind).alias("out")),
                       lambda s, x: F.struct(join(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def with_matches(rows: DataFrame, text: Column, patterns: dict[str, tuple[Column, str]]) -> DataFrame:
    """Add ``__found``: for each of ``patterns`` (where to look, pattern) all matches with start and end in code points, left to right.

    Lengths of gaps and matches are added up inside slices, then over slices, so the work is linear in a text's matches."""
    def pairs(where: Column, pattern: str) -> Column:
        found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        none = F.array().cast("array<struct<match:string,gap:bigint>>")
        return F.when(where, F.filter(F.arrays_zip(found.alias("match"), gaps.alias("gap")), lambda x: x["match"].isNotNull())).otherwise(none)

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS_TYPE).alias("out"))
    rows = once(rows, __found=F.array(*[pairs(*p) for p in patterns.values()]))
    rows = once(rows, __found=F.transform("__found", sliced), replace=True)
    rows = once(rows, __found=F.transform("__found", lambda kind: F.transform(kind, lambda one: F.aggregate(one, start, add))), replace=True)
    rows = once(rows, __at=F.transform("__found", lambda kind: before_each(kind, lambda x: x["at"], F.lit(0).cast("long"), lambda a, b: a + b)))
    moved = lambda one, at: F.transform(one["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["match"].alias("match")))
    rows = once(rows, __found=F.zip_with("__found", "__at", lambda kind, at: F.flatten(F.zip_with(kind, at, moved))), replace=True)
    return rows.drop("__at")


def chunks(text: Column) -> Column:
    """The text in chunks, for ``piece``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(cut: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text in chunks; only the chunks they lie in are gone through."""
    first = F.floor(start / CHUNK)
    near = F.array_join(F.slice(cut, (first + 1).cast("int"), (F.floor(F.greatest(end - 1, start) / CHUNK) - first + 1).cast("int")), "")
    return F.when(end > start, F.substr(near, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def blocks_of(spans: Column) -> Column:
    """Spans (start, end) sorted and sliced, each slice with its least start and greatest end, for ``meets``."""
    return F.transform(sliced(spans), lambda one: F.struct(F.array_min(F.transform(one, lambda x: x["start"])).alias("low"), F.array_max(F.transform(one, lambda x: x["end"])).alias("high"), one.alias("spans")))


def meets(blocks: str, w: Column) -> Column:
    over = lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])
    return F.exists(blocks, lambda one: (one["low"] < w["end"]) & (w["start"] < one["high"]) & F.exists(one["spans"], over))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """The check digit of a string of digits is right."""
    total = F.aggregate(F.split(F.reverse(number), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda s, d: F.struct(
        (s["sum"] + F.when(s["i"] % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise(
            F.coalesce(d.try_cast("int"), F.lit(0)) * 2 - F.when(F.coalesce(d.try_cast("int"), F.lit(0)) > 4, 9).otherwise(0))).alias("sum"), (s["i"] + 1).alias("i")), lambda s: s["sum"])
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """What a base match must satisfy besides its pattern."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(digits(match))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(match))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def annotated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (their columns kept) with ``__base`` (kind, start, end, match), and ``__wide`` candidates; no shuffle."""
    out = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    text = F.col("__text")
    digit = text.rlike("[0-9]")
    where = {"email": F.instr(text, "@") > 0, "phone": text.rlike(r"\+[0-9]"), "secret": text.rlike(r"[=:]\x20?[\x22\x27]?[A-Za-z0-9+/_-]{12}")}
    patterns = {**PATTERNS, "secret": SECRET, "number": NUMBER}
    out = with_matches(out, text, {kind: (where.get(kind, digit), patterns[kind]) for kind in KINDS})
    found = {kind: F.col("__found")[i] for i, kind in enumerate(KINDS)}
    tagged = lambda spans, kind: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"], x["end"], x["match"]))
    base = F.concat(*[tagged(F.filter(found[kind], lambda x: valid(kind, x["match"])), kind) for kind in BASE])  # noqa: B023
    value = lambda x: F.regexp_extract(x["match"], SECRET_VALUE, 1)
    secrets = F.transform(found["secret"], lambda x: F.struct(F.lit("secret").alias("kind"), (x["end"] - F.length(value(x))).alias("start"), x["end"].alias("end"), x["match"].alias("match")))
    out = once(out, __base=base, __near=F.concat(secrets, tagged(found["number"], "number"))).drop("__found")
    places = lambda spans: F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], x["end"])))
    out = once(out, __places=places("__base"))
    out = once(out, __blocks=blocks_of(F.col("__places")))
    out = once(out, __free=F.when(F.size("__near") > 0, F.filter("__near", lambda w: ~meets("__blocks", w))).otherwise(F.col("__near"))).drop("__blocks", "__places")
    # a number inside a secret is part of it
    out = once(out, __places=places(F.filter("__free", lambda b: b["kind"] == "secret")))
    out = once(out, __blocks=blocks_of(F.col("__places")))
    out = once(out, __wide=F.when(F.size("__free") > 1, F.filter("__free", lambda w: (w["kind"] == "secret") | ~meets("__blocks", w))).otherwise(F.col("__free")))
    return out.drop("__near", "__free", "__places", "__blocks")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _labels(c: Column) -> list[Column]:
    """The labelers' votes on one candidate (kind, start, end, match) with what stands ``before`` it and at its ``edge``."""
    kind, match, before, edge = c["kind"], c["match"], c["before"], c["edge"]
    value = F.when(kind == "secret", F.regexp_extract(match, SECRET_VALUE, 1)).otherwise(match)
    key = F.lower(F.regexp_extract(match, "^[A-Za-z0-9_]+", 0))
    of = lambda **by: F.coalesce(*[F.when(kind == k, v) for k, v in by.items()], F.lit(0))
    number, sure, never = digits(match), F.lit(True), F.lit(False)
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & before.rlike(rf"(?i)\b(?:{words})\b"))
    return [
        of(email=_vote(match.rlike(r"^[A-Za-z0-9][^@]*@[A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z]$"), never), ip=_vote(sure, match.rlike(r"^0|\.0[0-9]")), card=_vote(sure, never), phone=_vote(sure, never),
           secret=_vote(value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16), ~value.rlike("[0-9]")), number=_vote(never, sure)),
        of(email=_vote(F.lower(match).rlike(rf"\.(?:{TOP_DOMAINS})$"), never), ip=_vote(sure, match.rlike(r"^(?:0|127|255)\.")), card=_vote(number.rlike("^[3-6]"), ~number.rlike("^[2-6]")), phone=_vote(number.rlike("^[1-9]"), never),
           secret=_vote(key.rlike(rf"(?:^|_)(?:{SECRET_KEYS})$"), key.rlike(rf"^(?:{PLAIN_KEYS})$")), number=_vote(never, number.rlike("^(?:0|1[0-9]{9}$)"))),
        _vote(cue, before.rlike(rf"(?i)\b(?:{PLAIN_CUES})\b")),
        _vote(F.size(F.array_distinct(F.split(value, ""))) >= 6, F.size(F.array_distinct(F.split(value, ""))) <= 2),
        _vote(~edge.rlike("[A-Za-z0-9_]"), edge.rlike("[0-9_]")),
    ]


def _surface(c: Column) -> list[Column]:
    """Quarters of digits and of letters in the span, whether it holds separators, a bucket of the word before it (0: none), what
    stands beside it (2: a letter or digit, 1: another character, 0: a blank or nothing)."""
    share = lambda pattern: F.floor(4 * F.length(F.regexp_replace(c["match"], pattern, "")) / F.greatest(F.length(c["match"]), F.lit(1))).cast("int")
    word = F.regexp_extract(F.lower(c["before"]), r"(\p{L}+)\P{L}*$", 1)
    bucket = F.when(F.length(word) > 0, F.crc32(word.cast("binary")) % CONTEXT_BUCKETS + 1).otherwise(0).cast("int")
    beside = F.when(c["edge"].rlike(r"[\p{L}\p{N}]"), 2).when(c["edge"].rlike(r"\S"), 1).otherwise(0)
    return [share("[^0-9]"), share("[^A-Za-z]"), c["match"].rlike(r"[\x20.()-]").cast("int"), bucket, beside]


def candidates(rows: DataFrame) -> DataFrame:
    """``annotated`` rows with ``__votes``: each candidate (base first) with its votes, size class and surface features."""
    def around(c: Column) -> Column:
        start, end = c["start"], c["end"]
        before = piece(F.col("__chunks"), F.greatest(start - 40, F.lit(0)), start)
        edge = F.concat(piece(F.col("__chunks"), F.greatest(start - 1, F.lit(0)), start), piece(F.col("__chunks"), end, end + 1))
        return F.struct(c["kind"].alias("kind"), start.alias("start"), end.alias("end"), c["match"].alias("match"), before.alias("before"), edge.alias("edge"))

    def judged(c: Column) -> Column:
        size = F.least(F.floor(F.log2((c["end"] - c["start"]).cast("double"))), F.lit(12)).cast("int")
        fields = [v.alias(n) for v, n in zip((*_labels(c), *_surface(c)), (*LABELERS, *SURFACE))]
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), size.alias("size"), *fields)

    both = F.concat("__base", "__wide")
    kind = "array<struct<kind:string,start:bigint,end:bigint,size:int," + ",".join(f"{v}:int" for v in (*LABELERS, *SURFACE)) + ">>"
    rows = once(rows, __chunks=F.when(F.size(both) > 0, chunks(F.col("__text"))).otherwise(F.array().cast("array<string>")))
    rows = once(rows, __around=F.transform(both, around))
    rows = once(rows, __votes=F.when(F.size("__around") > 0, F.transform("__around", judged).cast(kind)).otherwise(F.array().cast(kind)))
    return rows.drop("__around")


def features(c) -> list[Column]:
    """What the span classifier sees of a candidate: votes, kind, length, and surface of the span and its context."""
    flags = [F.when(c["kind"] == k, 1.0).otherwise(0.0) for k in KINDS]
    words = [F.when(c["word"] == i, 1.0).otherwise(0.0) for i in range(1, CONTEXT_BUCKETS + 1)]
    plain = [c[name].cast("double") for name in (*LABELERS, "size", "digits", "letters", "separators", "beside")]
    return [*plain, *flags, *words]


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic weights of ``features``."""

    bias: float
    weights: tuple[float, ...]

    def accepts(self, c: Column) -> Column:
        z = F.lit(self.bias)
        for weight, feature in zip(self.weights, features(c)):
            z = z + F.lit(weight) * feature
        return z >= 0


def fit(found: DataFrame, kept: Kept) -> SpanClassifier | None:
    """Learn from the ``__votes`` of all texts. Equal candidates are counted, so what is learned from is small; no candidates: None."""
    given = ["kind", "size", *LABELERS, *SURFACE]
    counted = kept.keep(found.select(F.explode("__votes").alias("c")).select("c.*").groupBy(*given).agg(F.count("*").alias("n")), "counted")
    votes = counted.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))
    votes = votes.sparkSession.createDataFrame(votes.collect(), votes.schema)  # at most 6 * 3^5 rows, read several times
    if votes.isEmpty():
        return None
    model = fit_votes(votes, LABELERS, "kind")
    p = 1 / (1 + F.exp(-model.log_odds([F.col(v) for v in LABELERS], F.col("kind"))))
    weighed = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("p") * F.col("n")).alias("w")), F.struct(F.lit(0.0).alias("label"), ((1 - F.col("p")) * F.col("n")).alias("w"))))
    row = {name: F.col(name) for name in given}
    inputs = [f.alias(f"f{i}") for i, f in enumerate(features(row))]
    soft = counted.withColumn("p", p).select(*inputs, weighed.alias("s")).select("*", "s.label", "s.w")
    data = VectorAssembler(inputCols=[f"f{i}" for i in range(len(inputs))], outputCol="x").transform(soft)
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1e-3, maxIter=60).fit(data)
    kept.drop("counted")
    return SpanClassifier(float(lr.intercept), tuple(float(x) for x in lr.coefficients))


def spans(model: SpanClassifier | None) -> Column:
    """All spans (kind, start, end) of a ``candidates`` row, by kind as listed, then start: every base match, and what the classifier adds."""
    rank = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)])
    at = F.size("__base")
    tagged = F.transform("__votes", lambda c, i: F.struct(rank(c["kind"]).alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
                                                          ((i < at) | (model.accepts(c) if model else F.lit(False))).alias("stay")))
    return F.sort_array(F.filter(tagged, lambda c: c["stay"]))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, kept: Kept) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs`` (doc_id, text).

    A null or empty text has no spans. Repeated rows are searched (and counted) each; a null doc_id stays null; other
    columns are not read; an empty table gives no rows. Narrow but for the count of vote patterns."""
    found = candidates(annotated(docs.select("doc_id", "text"))).select("doc_id", "__base", "__votes")
    found = kept.keep(found.withColumn("__base", F.transform("__base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))), "candidates")
    model = fit(found, kept)
    count = lambda kind: F.size(F.filter("__base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(F.col("__base")).cast("binary"), 256).alias("base_sha256"), written(spans(model)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets (overlaps: the first span's kind); n_chars follows where there is one.

    Texts without spans are unchanged, null texts stay null, all columns and rows are kept."""
    model = fit(candidates(annotated(docs.select("text"))).select("__votes"), Kept(docs.sparkSession, "redact"))
    rows = candidates(annotated(docs))
    found = F.sort_array(F.transform(spans(model), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    rows = once(rows, __spans=found)
    rows = once(rows, __slices=sliced(F.col("__spans")))
    highest = lambda one: F.coalesce(F.array_max(F.transform(one, lambda x: x["end"])), F.lit(0).cast("long"))
    rows = once(rows, __from=before_each(F.col("__slices"), highest, F.lit(0).cast("long"), F.greatest))

    def replaced(one: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
        add = lambda s, c: F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.when(c["start"] >= s["at"], F.concat(s["out"], F.array(
            piece(F.col("__chunks"), s["at"], c["start"]), F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))))).otherwise(s["out"]).alias("out"))
        return F.aggregate(one, start, add, lambda s: s["out"])

    rows = once(rows, __pieces=F.flatten(F.zip_with("__slices", "__from", replaced)))
    rest = piece(F.col("__chunks"), highest(F.col("__spans")), F.length("__text").cast("long"))
    text = F.when(F.size("__spans") > 0, F.concat(F.array_join("__pieces", ""), rest)).otherwise(F.col("text"))
    rows = rows.withColumn("__new", text)
    columns = [F.col("__new").alias(c) if c == "text" else F.when(F.size("__spans") > 0, F.length("__new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*columns)
