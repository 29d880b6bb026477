"""Session construction and cluster-level settings.

On a cluster the session already exists; ``get_session`` only fills in
settings that are unset, so cluster configuration always wins.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on; applied only where the session leaves them unset.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # one hot app may hold a third of all rows: split skewed partitions early
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "plaudit", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    for k, v in DEFAULTS.items():
        if k == "spark.ui.enabled":
            continue  # static conf; only meaningful at builder time
        try:
            current = spark.conf.get(k, None)
        except Exception:  # pragma: no cover - conf access on exotic sessions
            current = None
        if current is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A local session (tests) that names none gets a scratch folder; on a cluster each executor would write to its
    own disk, so there an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="plaudit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "plaudit-tables", name)


def materialize(df, how: str | None = "table", rows_per_file: int | None = None):
    """Compute a DataFrame that several branches of a plan read, once.

    ``table``: write it as Parquet under the shared ``spark.checkpoint.dir``
    and read it back: computed once, lineage cut (a lost executor re-reads the
    files), and later reads get column pruning and filter push-down.
    With ``rows_per_file``, a task starts another file after so many rows.
    ``checkpoint``: reliable RDD checkpoint (computes the plan twice unless
    persisted, so ``table`` is the default).
    ``persist``: memory-and-disk cache (recomputed from lineage on loss).
    ``None``: leave the plan as is."""
    if how is None:
        return df
    if how == "table":
        import uuid
        path = scratch_path(df.sparkSession, uuid.uuid4().hex)
        writer = df.write.mode("overwrite")
        if rows_per_file is not None:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(path)
        return df.sparkSession.read.parquet(path)
    if how == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "checkpoint":
        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    raise ValueError(f"unknown materialisation {how!r}")

