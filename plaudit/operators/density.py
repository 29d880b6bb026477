"""Density clustering (M3): neighbour counts, core points, components of core points, border points, outliers.

Points are put on a lattice of ``eps / steps`` and folded: equal lattice points are one point with a weight, so copies
and dense places cost no pairs, and a cell of side eps holds at most ``steps ** dims`` points however many rows fall into it.
All distances are integers, so results are exact and the same everywhere. The lattice is dealt in blocks of ``SIDE`` along each
axis, each with the points up to eps around it; inside a block neighbours are looked up in an array of the block, one
shift of it at a time, so a point costs at most the lattice points of a ball, however many points there are and no pair is a row. Core
points of one small cell are all neighbours, so only cells are linked, and components run over cells."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema as to_arrow

from plaudit.session import materialize

#: Lattice points along eps.
STEPS = 8
OUTLIER = -1
#: Lattice points along a block, as a power of two; points that a task takes (a full block may hold more).
SIDE_BITS, TASK_POINTS = 5, 1 << 13
#: Places of a block's array, and pairs compared together where points are few or the array would be larger.
PLACES, PAIRS = 1 << 22, 1 << 22
_LONG = (1 << 63) - 1


def lattice_point(vector: Column, eps: float, steps: int = STEPS) -> Column:
    """The nearest lattice point, as whole numbers."""
    return F.transform(vector, lambda x: F.floor(x * (steps / eps) + 0.5).cast("bigint"))


def _cells(at: str, side: int) -> Column:
    return F.transform(at, lambda x: F.floor(x / side).cast("bigint"))


def _ball(dims: int, reach: int) -> np.ndarray:
    """All whole-number shifts of length ``reach`` at most."""
    line = np.arange(-reach, reach + 1)
    shifts = np.stack(np.meshgrid(*[line] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    return shifts[(shifts * shifts).sum(axis=1) <= reach * reach]


def neighbours(a: np.ndarray, b: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``a``, row of ``b``, squared distance) of all points at most ``reach`` apart, in parts. ``b`` has no point twice.

    Points are rows of small whole numbers: the places of a block. Few points are compared with each other; more are looked up in an
    array of the block, shift by shift."""
    if not len(a) or not len(b):
        return
    dims = a.shape[1]
    low = np.minimum(a.min(axis=0), b.min(axis=0)) - reach
    shape = [int(n) for n in np.maximum(a.max(axis=0), b.max(axis=0)) + reach + 1 - low]
    if math.prod(shape) > PLACES or len(a) * len(b) <= math.prod(shape):
        some = max(1, PAIRS // len(b))
        for begin in range(0, len(a), some):
            d2 = sum((a[begin:begin + some, None, k] - b[None, :, k]) ** 2 for k in range(dims))
            i, j = np.nonzero(d2 <= reach * reach)
            yield begin + i, j, d2[i, j]
        return
    held = np.full(math.prod(shape), -1, np.int32)
    held[np.ravel_multi_index(tuple((b - low).T), shape)] = np.arange(len(b))
    at, steps = np.ravel_multi_index(tuple((a - low).T), shape), np.array([math.prod(shape[k + 1:]) for k in range(dims)])
    for shift in _ball(dims, reach):
        j = held[at + int(shift @ steps)]
        i = np.flatnonzero(j >= 0)
        yield i, j[i], np.full(len(i), int(shift @ shift))


def _blockwise(left: DataFrame, right: DataFrame, keys: list[str], dims: int, reach: int, value: str, fields: list[T.StructField], compute) -> DataFrame:
    """Rows of ``compute`` for each block of the lattice, with the columns ``keys`` and ``fields``.

    ``left`` and ``right`` have ``keys``, ``at`` and ``value``. ``compute(table, places, a, b)`` gets the rows (an Arrow table) of the block's left
    points ``a`` and of the right points ``b`` in the block or up to ``reach`` from it; ``places`` counts from the block's begin. It gives rows of the
    table and columns that belong to them. Points of one side are distinct."""
    n = left.count() + right.count()
    axes = [f"_b{k}" for k in range(dims)]
    own = left.select(*keys, "at", value, F.lit(True).alias("_left"), *[F.shiftright(F.get("at", F.lit(k)), SIDE_BITS).alias(b) for k, b in enumerate(axes)])
    around = right.select(*keys, "at", value, F.lit(False).alias("_left"))
    for k, b in enumerate(axes):
        x = F.get("at", F.lit(k))
        first, last = (F.greatest(x, F.lit(reach - _LONG - 1)) - reach), (F.least(x, F.lit(_LONG - reach)) + reach)
        around = around.withColumn(b, F.explode(F.sequence(F.shiftright(first, SIDE_BITS), F.shiftright(last, SIDE_BITS))))
    tasks = -(-n // TASK_POINTS) or 1
    both = own.unionByName(around).withColumn("_task", F.pmod(F.xxhash64(*keys, *axes), F.lit(tasks)).cast("int"))
    schema = T.StructType([*(left.schema[k] for k in keys), *fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        marks = [np.unique(table.column(k).to_numpy(zero_copy_only=False), return_inverse=True)[1] for k in keys]
        blocks = [table.column(b).to_numpy() for b in axes]
        is_left = table.column("_left").to_numpy(zero_copy_only=False)
        at = table.column("at").combine_chunks()
        # counted from the block's begin
        places = at.flatten().to_numpy().reshape(-1, dims) - (np.column_stack(blocks) << SIDE_BITS)
        order = np.lexsort([~is_left, *marks, *blocks])
        change = np.zeros(len(order), bool)
        change[:1] = True
        for x in (*marks, *blocks):
            change[1:] |= x[order][1:] != x[order][:-1]
        begins = np.flatnonzero(change)
        parts = []
        for begin, end in zip(begins, np.append(begins[1:], len(order))):
            rows = order[begin:end]
            n_left = int(is_left[rows].sum())
            if 0 < n_left < len(rows):
                parts += compute(table, places, rows[:n_left], rows[n_left:])
        kinds = [f.type for f in table.select(keys).schema]
        if not parts:
            return to_arrow(schema).empty_table()
        rows = np.concatenate([r for r, _ in parts])
        held = table.select(keys).take(pa.array(rows))
        columns = [pa.concat_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in column]) for column in zip(*[c for _, c in parts])]
        return pa.table([*(c.cast(k) for c, k in zip(held.columns, kinds)), *columns], names=schema.names).cast(to_arrow(schema))

    return both.repartition(tasks, "_task").groupBy("_task").applyInArrow(run, schema)


def _sums(table: pa.Table, places: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int):
    """The weight around each left point."""
    weight, out = table.column("value").to_numpy(), np.zeros(len(a), np.int64)
    weight = weight[b]
    for i, j, _ in neighbours(places[a], places[b], reach):
        out += np.bincount(i, weight[j], minlength=len(a)).astype(np.int64)
    return [(a, [table.column("at").combine_chunks().take(pa.array(a)), out])]


def _links(table: pa.Table, places: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int):
    """The distinct pairs of different values of neighbours."""
    value = table.column("value").combine_chunks()
    codes = value.dictionary_encode()
    number = codes.indices.fill_null(-1).to_numpy()
    seen = []
    local, back = np.unique(number[np.concatenate([a, b])], return_inverse=True)
    na, nb = back[:len(a)], back[len(a):]
    table_of = np.zeros((len(local), len(local)), bool) if len(local) ** 2 <= PLACES else None
    for i, j, _ in neighbours(places[a], places[b], reach):
        if table_of is not None:
            table_of[na[i], nb[j]] = True
        else:
            seen.append(np.unique(na[i] * len(local) + nb[j]))
    pairs = np.argwhere(table_of) if table_of is not None else np.array(np.divmod(np.unique(np.concatenate(seen or [np.zeros(0, np.int64)])), len(local))).T
    pairs = pairs[(pairs[:, 0] != pairs[:, 1]) & (local[pairs] >= 0).all(axis=1)]
    words = codes.dictionary
    return [(np.full(len(pairs), a[0]), [words.take(pa.array(local[pairs[:, 0]])), words.take(pa.array(local[pairs[:, 1]]))])] if len(pairs) else []


def _nearest(table: pa.Table, places: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int):
    """Each left point with the right points nearest to it."""
    found = [(i, j, d2) for i, j, d2 in neighbours(places[a], places[b], reach) if len(i)]
    if not found:
        return []
    i, j, d2 = (np.concatenate(x) for x in zip(*found))
    least = np.full(len(a), reach * reach + 1)
    np.minimum.at(least, i, d2)
    best = d2 == least[i]
    i, j, d2 = i[best], j[best], d2[best]
    return [(a[i], [table.column("at").combine_chunks().take(pa.array(a[i])), d2.astype(np.int64), table.column("value").combine_chunks().take(pa.array(b[j]))])]


def connect(edges: DataFrame, nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, label): the smallest node of each node's component. ``edges`` (group, a, b) stand in both directions.

    Each round a node takes the least label around it, the node that was its label takes the least that its followers saw,
    and labels are followed one step; so rounds grow with the logarithm of a component's width. Each round is written (``materialize``)."""
    edges = materialize(edges.distinct())
    labels = materialize(nodes.select(*group, "node", F.col("node").alias("label")))
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), [*group, "b"]).groupBy(*group, F.col("a").alias("node")).agg(F.min("label").alias("_seen"))
        low = labels.join(seen, [*group, "node"], "left").select(*group, "node", "label", F.least("label", F.coalesce("_seen", "label")).alias("_low"))
        hook = low.groupBy(*group, F.col("label").alias("node")).agg(F.min("_low").alias("_hook"))
        step = low.join(hook, [*group, "node"], "left").select(*group, "node", F.col("label").alias("_old"), F.least("_low", F.coalesce("_hook", "_low")).alias("label"))
        step = materialize(step)
        jump = step.select(*group, F.col("node").alias("label"), F.col("label").alias("_next"))
        new = step.join(jump, [*group, "label"], "left").select(*group, "node", F.least("label", F.coalesce("_next", "label")).alias("label"), "_old")
        new = materialize(new)
        labels = new.drop("_old")
        if new.where("label < _old").isEmpty():
            return labels


def density_clusters(points: DataFrame, id_col: str, vector_col: str, dims: int, eps: float, min_points: int, group_cols: Sequence[str] = (),
                     min_size: int = 1, steps: int = STEPS) -> DataFrame:
    """(group, id, topic_id) for every row of ``points``: clusters 0.. by size (ties: smallest core id), -1 for outliers.

    A point is core if ``min_points`` rows (itself included) lie within eps of it; core points within eps of one another are one
    cluster; a point with a core point within eps joins the nearest one's (ties: the cluster with the smallest core id); others, and clusters of
    fewer than ``min_size`` rows, are outliers, as are rows whose vector is null, too short or not finite. Ids must be unique in a group."""
    g = list(group_cols)
    # nulls in a group column are a group
    keys = [f"_g{i}" for i in range(len(g))] or ["_g0"]
    key = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in g] or [F.lit("")]
    fine = lambda v: (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = points.select(*g, *[c.alias(k) for c, k in zip(key, keys)], F.col(id_col).alias("_id"), F.when(fine(F.col(vector_col)), lattice_point(F.col(vector_col), eps, steps)).alias("at"))
    rows = materialize(rows)
    lattice = materialize(rows.where("at is not null").groupBy(*keys, "at").agg(F.count(F.lit(1)).alias("weight"), F.min("_id").alias("first")))
    long = T.LongType()
    around = lambda left, right, value, fields, compute: _blockwise(
        left.withColumnRenamed(value, "value"), right.withColumnRenamed(value, "value"), keys, dims, steps, "value", fields, lambda *x: compute(*x, steps))

    every = lattice.select(*keys, "at", "weight")
    density = around(every, every, "weight", [lattice.schema["at"], T.StructField("near", long)], _sums)
    # points of one cell of this side are within eps of one another
    side = math.isqrt(steps * steps // dims) + 1
    core = lattice.join(density.where(F.col("near") >= min_points).drop("near"), [*keys, "at"]).withColumn("cell", _cells("at", side))
    cells = core.groupBy(*keys, "cell").agg(F.min("first").alias("node"))
    core = materialize(core.join(cells, [*keys, "cell"]).select(*keys, "at", "node"))
    node = core.schema["node"].dataType
    edges = around(core, core, "node", [T.StructField("a", node), T.StructField("b", node)], _links)
    labels = connect(edges, core.select(*keys, "node").distinct(), keys)
    core = materialize(core.join(labels, [*keys, "node"]).select(*keys, "at", "label"))
    border = materialize(lattice.join(core, [*keys, "at"], "left_anti").select(*keys, "at", F.lit(None).cast(node).alias("label")))
    border = around(border, core, "label", [lattice.schema["at"], T.StructField("d2", long), T.StructField("label", node)], _nearest)
    border = border.groupBy(*keys, "at").agg(F.min(F.struct("d2", "label")).alias("_n"))
    placed = core.unionByName(border.select(*keys, "at", F.col("_n.label").alias("label")))
    sized = lattice.join(placed, [*keys, "at"]).groupBy(*keys, "label").agg(F.sum("weight").alias("size"))
    # one row a cluster that is large enough
    by_size = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "label")
    ranked = sized.where(F.col("size") >= min_size).withColumn("topic_id", (F.row_number().over(by_size) - 1).cast("int")).select(*keys, "label", "topic_id")
    topics = placed.join(ranked, [*keys, "label"]).select(*keys, "at", "topic_id")
    out = rows.join(topics, [*keys, "at"], "left")
    return out.select(*g, F.col("_id").alias(id_col), F.coalesce("topic_id", F.lit(OUTLIER)).alias("topic_id"))
