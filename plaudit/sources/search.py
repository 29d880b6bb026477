"""App lookup by part of a name (A5): an inverted index of character grams with a rarest-gram probe.

Names are folded (lower case) and equal names are one, with their smallest appid. A term of up to three characters is itself a
gram, and the index keeps each gram's best name beside its list, so no list is read for it. A longer term is looked up
by the rarest of its three-character grams, and only that list's names are checked with ``contains``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions.vectors import computed
from plaudit.session import materialize

GRAM = 3


def grams(c: Column, n: int) -> Column:
    """The distinct substrings of ``n`` code points."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass
class NameIndex:
    """``names`` (folded, name, appid), ``best`` (gram of 1 to 3 characters, name, appid), ``lists`` (gram of 3, folded), ``sizes`` (gram, n)."""

    names: DataFrame
    best: DataFrame
    lists: DataFrame
    sizes: DataFrame


def build_index(apps: DataFrame) -> NameIndex:
    """Index (appid, name). Apps without a name are left out. First hit: shortest name, then smallest appid."""
    first = F.min(F.struct(F.length("name").alias("n"), "appid", "name"))
    names = apps.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("folded")).agg(first.alias("f"))
    names = materialize(names.select("folded", "f.n", "f.appid", "f.name"))
    each = names.select("folded", F.struct("n", "appid", "name").alias("f"), F.explode(F.concat(*[grams(F.col("folded"), k) for k in range(1, GRAM + 1)])).alias("gram"))
    best = each.groupBy("gram").agg(F.min("f").alias("f")).select("gram", "f.appid", "f.name")
    lists = names.select("folded", F.explode(grams(F.col("folded"), GRAM)).alias("gram"))
    lists = materialize(lists)
    return NameIndex(names.select("folded", "n", "appid", "name"), materialize(best), lists, materialize(lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n_names"))))


def probes(terms: DataFrame, index: NameIndex, term_col: str = "term") -> DataFrame:
    """(term, folded term, gram, n_names): for each distinct term of more than three characters its rarest gram; a term with a gram that no name has is left out."""
    long = terms.select(term_col).distinct().select(term_col, F.lower(term_col).alias("_t")).where(F.length("_t") > GRAM)
    long = computed(long, "_grams", grams(F.col("_t"), GRAM))
    per = long.select(term_col, "_t", F.size("_grams").alias("_k"), F.explode("_grams").alias("gram")).join(index.sizes, "gram")
    found = per.groupBy(term_col, "_t", "_k").agg(F.count(F.lit(1)).alias("_have"), F.min(F.struct("n_names", "gram")).alias("_r"))
    return found.where("_have = _k").select(term_col, "_t", F.col("_r.gram").alias("gram"), F.col("_r.n_names").alias("n_names"))


def search_apps(terms: DataFrame, index: NameIndex, term_col: str = "term") -> DataFrame:
    """A5: (term, appid, name) of the first app whose name contains the term, in any case, for every distinct term.

    Hits are ranked by length of the name, then appid. A null or empty term, and one without a hit, has a null appid."""
    asked = terms.select(term_col).distinct()
    short = asked.where(F.length(term_col).between(1, GRAM)).select(term_col, F.lower(term_col).alias("gram")).join(index.best, "gram").select(term_col, "appid", "name")
    near = probes(terms, index, term_col).join(index.lists, "gram").where(F.contains("folded", F.col("_t"))).select(term_col, "folded")
    near = near.join(index.names, "folded").groupBy(term_col).agg(F.min(F.struct("n", "appid", "name")).alias("f")).select(term_col, "f.appid", "f.name")
    return asked.join(short.unionByName(near), term_col, "left").select(term_col, "appid", "name")
