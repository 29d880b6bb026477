"""N-gram Jaccard join: multiple-global-order prefix filtering, then exact verification, then components.

Texts with equal shingle sets are one class and never paired. Two classes can reach the
threshold only if their prefixes (the first few shingles) share a shingle, and that holds
under every global order of shingles. The first order makes the posting lists; prefixes
under the other orders must overlap too before sets are compared.

Pairs inside a list are not listed at once. First each class meets only its leader, the list's oldest
class of like size. Classes that pass the filters with one leader and are still of several components
are compared in blocks of bounded size: the filters of all orders are intersected as matrices,
and what passes is verified exactly through the differences from the leader,
(x ^ l) ^ (y ^ l) = x ^ y, which are short for near copies; a task sends on links only. Other pairs
across components in one list are filtered and verified one by one. No link between components is lost.

Orders put shingles of over-full hash buckets last: their counts come from all texts in a
table of fixed size, so a passage that many texts share is in no long text's prefix.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plaudit.llm.common import LOWER, Kept, bit_of, id_filter, id_key, id_picker, mix64, prefix_hash, row_hash, runs_of, small_batches, span_hash, text_chunks, word_bounds
from plaudit.llm.graph import components, forest

#: 4 million hash buckets count shingles, in 64 slices.
COUNT_BITS, SLICE = 22, 1 << 16
#: Classes of one leader that a task compares at a time, and shingles in one column block.
BLOCK_MEMBERS = 1024
#: Seeds of the global orders; the first one makes the lists.
ORDERS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (A-Z lower-cased); fewer words are one shingle."""
    data = LOWER[data]
    starts, ends, text = word_bounds(data, offs)
    hashes = span_hash(prefix_hash(data), starts, ends)
    run, of = runs_of(hashes, text, k)
    n_words = np.bincount(text, minlength=len(offs) - 1)
    cut = np.searchsorted(of, np.arange(len(offs)))
    first = np.concatenate([[0], np.cumsum(n_words)])
    out = []
    for t, n in enumerate(n_words.tolist()):
        if n >= k:
            out.append(np.unique(run[cut[t]:cut[t + 1]]))
        elif n:
            short = hashes[first[t]:first[t] + n]
            out.append(runs_of(short, np.zeros(n, np.int64), n)[0] + np.uint64(n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> int:
    """64 bits of the set, whatever the order."""
    both = np.array([np.add.reduce(mix64(shingles)), np.bitwise_xor.reduce(mix64(shingles ^ np.uint64(ORDERS[0])))], np.uint64)
    return int((mix64(both[:1] + np.uint64(len(shingles))) ^ mix64(mix64(both[1:]))).view(np.int64)[0])


def prefix(shingles: np.ndarray, order: int, classes: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(n * threshold) + 1 shingles under a global order, in that order: over-full buckets last, else by hash, then by value."""
    n = len(shingles)
    p = n - (percent * n + 99) // 100 + 1
    place = (classes[shingles >> np.uint64(64 - COUNT_BITS)].astype(np.uint64) << np.uint64(58)) | (mix64(shingles ^ np.uint64(order)) >> np.uint64(6))
    return shingles[np.argsort(place, kind="stable")[:p]]


FIRST = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()),
                      T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])
SLICES = T.StructType(FIRST.fields[3:])
ORDER_COLUMNS = [f"order{k}" for k in range(len(ORDERS))]
PREFIXES = T.StructType([T.StructField(c, T.LongType()) for c in ("sig", "id", "n")] + [T.StructField(c, T.ArrayType(T.LongType() if c == ORDER_COLUMNS[0] else T.IntegerType())) for c in ORDER_COLUMNS])
SETS = T.StructType([T.StructField("sig", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])


def _read(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        for row, end, data, offs in text_chunks(batch.column("text")):
            yield ids[row:end], shingle_sets(data, offs, k)


def _sizes(rows: DataFrame, k: int) -> DataFrame:
    """Per text its set's size and signature; per task how many set members fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.uint32)
        for ids, sets in _read(batches, k):
            np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()),
                                              pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], FIRST.names)
        slices = [zlib.compress(total[i:i + SLICE].tobytes(), 1) for i in range(0, len(total), SLICE)]
        none = pa.nulls(len(slices), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(range(len(slices)), pa.int32()), pa.array(slices, pa.binary())], FIRST.names)

    return rows.mapInArrow(run, FIRST)


def frequency_classes(counted: DataFrame) -> np.ndarray:
    """Class of each bucket: 0 up to one deviation above the mean, then one more for each quarter of a doubling. 4 MB, whatever the input.

    Any order of shingles is valid; this one puts a shingle that even a few more texts share than usual behind most others."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for one, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[one] = sums.get(one, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in sums.values()], pa.binary())], SLICES.names)

    # slices are dealt over tasks and summed batch by batch; the summed slices come back one by one
    counts = np.zeros(1 << COUNT_BITS, np.uint32)
    for row in counted.select("slice", "counts").repartition("slice").mapInArrow(add, SLICES).toLocalIterator():
        summed = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
        counts[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] += np.minimum(summed, 0xFFFFFFFF).astype(np.uint32)
    mean = counts.mean(dtype=np.float64)
    classes = np.zeros(1 << COUNT_BITS, np.uint8)
    for i in range(0, len(counts), SLICE):
        over = (counts[i:i + SLICE] - mean) / (np.sqrt(mean) + 0.5)
        classes[i:i + SLICE] = np.where(over <= 1, 0, np.minimum(np.ceil(2 * np.log2(np.maximum(over, 1.01)) * 2), 60))
    return classes


def _longs(arrays) -> pa.Array:
    return pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def _ints(arrays) -> pa.Array:
    """32 bits of each shingle: equal shingles stay equal, and a chance match only costs a comparison of sets."""
    return pa.array([x.astype(np.uint32).view(np.int32) for x in arrays], pa.list_(pa.int32()))


def _prefixes(rows: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """Prefixes under every order, once per class and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _read(batches, k):
            mine: dict[int, tuple[int, np.ndarray]] = {}
            for one, shingles in zip(ids.tolist(), sets):
                if len(shingles):
                    sig = signature(shingles)
                    mine[sig] = (min(one, mine[sig][0]) if sig in mine else one, shingles)
            yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int64()), pa.array([i for i, _ in mine.values()], pa.int64()), pa.array([len(s) for _, s in mine.values()], pa.int64()),
                                              *[(_ints if at else _longs)(prefix(s, order, classes.value, percent) for _, s in mine.values()) for at, order in enumerate(ORDERS)]], PREFIXES.names)

    return rows.mapInArrow(run, PREFIXES)


def _sets(rows: DataFrame, k: int, wanted) -> DataFrame:
    """Whole sets of the texts whose id is in the bitmap; a text that is there by chance is never paired."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = bit_of(batch.column("id").to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7)) & 1 == 1))

        for _, sets in _read(picked(), k):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _longs(sets)], SETS.names)

    return rows.mapInArrow(run, SETS)


def _joined(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``side`` (by sig) for both."""
    for s in "ab":
        pairs = pairs.join(side.select(F.col("sig").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in side.columns if c != "sig"]), s)
    return pairs


def _verified(pairs: DataFrame, rows: DataFrame, prefixes: DataFrame, k: int, percent: int, kept: Kept, name: str) -> DataFrame:
    """a, b, difference (of the sets), linked of the pairs whose prefixes overlap under every order; only their texts' whole sets are built and compared."""
    passes = F.lit(True)
    for order in ORDER_COLUMNS[1:]:
        passes = passes & F.arrays_overlap(f"{order}_a", f"{order}_b")
    context = rows.sparkSession.sparkContext
    pairs = kept.keep(pairs, f"{name}_pairs")
    both_ends = lambda of: of.select(F.col("a").alias("sig")).unionByName(of.select(F.col("b").alias("sig"))).distinct()
    some = context.broadcast(id_filter(both_ends(pairs).select(F.col("sig").alias("id"))))
    few = id_picker(prefixes.select("sig", *ORDER_COLUMNS[1:]), "sig", some)
    near = kept.keep(_joined(pairs, few).where(passes).select("a", "b"), f"{name}_near")
    wanted = context.broadcast(id_filter(prefixes.select("sig", "id").join(both_ends(near), "sig", "left_semi").select("id")))
    # one shuffle by class serves both ends
    both = _joined(near, _sets(rows, k, wanted).dropDuplicates(["sig"])).withColumn("difference", F.concat(F.array_except("shingles_a", "shingles_b"), F.array_except("shingles_b", "shingles_a")))
    both = both.withColumn("common", (F.col("n_a") + F.col("n_b") - F.size("difference")) / 2)
    similar = 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    out = kept.keep(both.select("a", "b", "difference", similar.alias("linked")), name)
    kept.drop(f"{name}_near", f"{name}_pairs")
    return out


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, [left, right]; members are gone through in column blocks of bounded size."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])) for lists in (left, right)]
    shared = np.intersect1d(sides[0][0], sides[1][0])
    at = []
    for values, row in sides:
        place = np.searchsorted(shared, values)
        hit = place < len(shared)
        hit[hit] = shared[place[hit]] == values[hit]
        at.append((place[hit], row[hit]))
    for first in range(0, len(shared), BLOCK_MEMBERS):
        parts = []
        for (place, row), n in zip(at, out.shape):
            part = np.zeros((n, BLOCK_MEMBERS), np.float32)
            mine = (place >= first) & (place < first + BLOCK_MEMBERS)
            part[row[mine], place[mine] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components, from ``left`` to ``right``, as links of their roots; only a spanning forest is sent on."""
    passes = left["root"].to_numpy()[:, None] != right["root"].to_numpy()
    for order in ORDER_COLUMNS:
        if not passes.any():
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        passes &= common(list(left[order]), list(right[order])) > 0
    i, j = np.nonzero(passes)
    if len(i):
        both = common(list(left["difference"]), list(right["difference"]))[i, j]
        size = [f["difference"].map(len).to_numpy() for f in (left, right)]
        n = left["n"].to_numpy()[i] + right["n"].to_numpy()[j]
        shared = (n - (size[0][i] + size[1][j] - 2 * both.astype(np.int64))) // 2
        stay = 100 * shared >= percent * (n - shared)
        i, j = i[stay], j[stay]
    a, b = forest(left["root"].to_numpy()[i], right["root"].to_numpy()[j])
    return pd.DataFrame({"a": a, "b": b})


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the roots of components among the members of each leader; every two blocks of members meet in one task."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # of two components, one at least is not the leader's
        other = rows["root"] != rows["leader_root"]
        if rows["x"].iat[0] == rows["y"].iat[0]:
            return _links(rows, rows[other], percent)
        first = rows["own"] == rows["x"]
        return pd.concat([_links(rows[first], rows[~first & other], percent), _links(rows[~first & ~other], rows[first & other], percent)])

    members = members.withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.withColumn("x", F.least("own", "with")).withColumn("y", F.greatest("own", "with")).drop("with", "blocks")
    return members.groupBy("leader", "x", "y").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, kept: Kept | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text): components of the graph of Jaccard links.

    Two rows link if 100 * intersection >= ``percent`` * union of their sets of k-word shingles. A null,
    empty or blank text has an empty set, links with nothing and is its own component. Rows with equal sets are linked,
    repeated rows included. A null doc_id counts as the smallest id, and a component whose smallest id is null has a
    null component_id. Other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = kept or Kept(spark, "ngram")
    # two sets whose first common shingle has m shingles behind it in the one, and more in the other, share m at most (itself counted)
    fits = lambda n, m, behind_n, behind_m: (100 + percent) * F.least(behind_n, behind_m) >= percent * (n + m)
    rows = docs.select(id_key(F.col("doc_id").cast("long")).alias("id"), "text")
    first = kept.keep(_sizes(rows, k), "sizes")
    texts = kept.keep(first.where("slice is null").select("id", "n", "sig"), "texts")
    classes = spark.sparkContext.broadcast(frequency_classes(first.where("slice is not null")))
    kept.drop("sizes")
    # posting lists of the first order: one row per class, only lists of two classes or more
    prefixes = _prefixes(rows, k, percent, classes).groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ORDER_COLUMNS])
    prefixes = kept.keep(prefixes, "prefixes")
    lists = prefixes.select("sig", "id", "n", F.posexplode(ORDER_COLUMNS[0]).alias("at", "token")).withColumn("behind", F.col("n") - F.col("at")).drop("at")
    lists = lists.withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1").drop("many")
    alike = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    lists = lists.withColumn("alike", alike).withColumn("lead", F.min(F.struct("id", "sig", "n", "behind")).over(Window.partitionBy("token", "alike")))
    lists = lists.select("token", "sig", "n", "behind", F.col("lead.sig").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.behind").alias("leader_behind"))
    lists = kept.keep(lists, "lists")
    pairs = lists.where((F.col("sig") != F.col("leader")) & fits(*[F.col(c) for c in ("n", "leader_n", "behind", "leader_behind")])).select(F.col("sig").alias("a"), F.col("leader").alias("b")).distinct()
    stars = _verified(pairs, rows, prefixes, k, percent, kept, "stars")
    links = kept.keep(stars.where("linked").select("a", "b"), "links")
    roots = kept.keep(components(links, kept, "round1_"), "roots").withColumnRenamed("node", "sig")
    kept.drop(*[name for name in kept.paths if name.startswith("round1_")])

    # classes that passed with one leader and are still of several components
    members = stars.select(F.col("b").alias("leader"), F.col("a").alias("sig"), "difference")
    members = members.unionByName(members.select("leader").distinct().select("leader", F.col("leader").alias("sig"), F.array().cast("array<bigint>").alias("difference")))
    members = members.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    sizes = members.groupBy("leader").agg(F.max(F.when(F.col("sig") == F.col("leader"), F.col("root"))).alias("leader_root"), F.min("root").alias("low"), F.max("root").alias("high"),
                                          F.ceil(F.count("*") / BLOCK_MEMBERS).alias("blocks"))
    sizes = kept.keep(sizes.where("low != high").select("leader", "leader_root", "blocks"), "leaders")
    members = kept.keep(members.join(sizes, "leader"), "members")
    some = spark.sparkContext.broadcast(id_filter(members.select(F.col("sig").alias("id")).distinct()))
    members = members.join(id_picker(prefixes.select("sig", "n", *ORDER_COLUMNS), "sig", some), "sig")
    # several leaders report the same components
    across = kept.keep(_across(members, percent).distinct(), "across")
    kept.drop("leaders", "members")

    # other pairs across components in one list
    met = stars.select(F.col("a").alias("sig"), F.col("b").alias("leader"), F.lit(True).alias("met"))
    open_ = lists.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    whole = Window.partitionBy("token")
    open_ = open_.withColumn("differ", F.min("root").over(whole) != F.max("root").over(whole)).where("differ")
    open_ = open_.join(met, ["sig", "leader"], "left").select("token", "sig", "n", "behind", "root", "leader", (F.coalesce("met", F.lit(False)) | (F.col("sig") == F.col("leader"))).alias("met"))
    open_ = kept.keep(open_, "open")
    kept.drop("lists", "stars", "roots")
    side = lambda s: open_.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("sig", "n", "behind", "root", "leader", "met")])
    done = (F.col("leader_a") == F.col("leader_b")) & ((F.col("met_a") & F.col("met_b")) | (F.col("sig_a") == F.col("leader_a")) | (F.col("sig_b") == F.col("leader_b")))
    pairs = side("a").join(side("b"), "token").where((F.col("root_a") < F.col("root_b")) & fits(*[F.col(c) for c in ("n_a", "n_b", "behind_a", "behind_b")]) & ~done)
    pairs = pairs.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")).distinct()
    more = _verified(pairs, rows, prefixes, k, percent, kept, "more").where("linked").select("a", "b")
    kept.drop("open", "prefixes")
    roots = components(links.unionByName(across).unionByName(more), kept, "round2_")
    kept.drop("links", "across", "more")

    owners = texts.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"))
    owners = owners.join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = owners.groupBy("root").agg(F.min("id").alias("least"))
    owners = owners.join(least, "root").select(F.col("sig").alias("of"), "least")
    out = texts.join(owners, (F.col("sig") == F.col("of")) & (F.col("n") > 0), "left")
    back = lambda c: F.when(c != F.lit(-(1 << 63)), c)
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("least", "id")).alias("component_id"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, kept: Kept | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) that lead a group of ``near_duplicates``: of each group the row with the smallest id, null first.

    Rows are told apart by a hash of id and text, so ids may be null or shared: rows whose texts are not linked never stand
    for each other. Of a group's rows with the smallest id the smallest hash stays, and of rows equal in id and text the
    one with the smallest hash of all columns. A row without words is a group of its own, repeated or not."""
    kept = kept or Kept(docs.sparkSession, "groups")
    id_ = id_key(F.col("doc_id").cast("long"))
    rows = docs.withColumn("__key", row_hash(id_, F.col("text")))
    own = Kept(docs.sparkSession, "ngram")
    found = near_duplicates(rows.select(F.col("__key").alias("doc_id"), "text"), k, percent, own)
    found = found.select(id_key(F.col("doc_id")).alias("__key"), (F.col("n_shingles") > 0).alias("words"), id_key(F.col("component_id")).alias("group")).distinct()
    found = found.join(rows.groupBy("__key").agg(F.min(id_).alias("id"), F.count("*").alias("__rows")), "__key")
    lead = found.where("words").groupBy("group").agg(F.min(F.struct("id", "__key", "__rows")).alias("lead")).select("lead.__key", "lead.__rows")
    stay = kept.keep(lead.unionByName(found.where("not words").select("__key", F.lit(1).cast("long").alias("__rows"))), "stay")
    # texts are not shuffled: a bitmap holds the keys of rows that go or that several rows share, and few others; only what it
    # holds is joined, all else stays
    open_ = found.select("__key").join(stay.where("__rows = 1"), "__key", "left_anti")
    doubtful = docs.sparkSession.sparkContext.broadcast(id_filter(open_.select(F.col("__key").alias("id"))))
    own.drop(*own.paths)
    asked = id_picker(rows, "__key", doubtful)
    out = id_picker(rows, "__key", doubtful, inside=False).unionByName(asked.join(stay.where("__rows = 1"), "__key", "left_semi").select(*rows.columns)).select(*docs.columns)
    if not stay.where("__rows > 1").isEmpty():
        columns = [F.col(c) for c in docs.columns]
        several = asked.join(stay.where("__rows > 1"), "__key", "left_semi")
        out = out.unionByName(several.groupBy("__key").agg(F.min_by(F.struct(*columns), row_hash(*columns)).alias("__row")).select("__row.*"))
    return out
