"""A keyed table of hash buckets under a manifest (A11, S1, S2): a batch rewrites only the buckets it touches.

Layout: ``data/v=<version>/bucket=<b>/`` holds a bucket as of the version that last wrote it; ``manifest/v=<version>.json`` says
for every bucket which version holds it, and appears by a rename. A version is what its manifest says, so a crash before the manifest is written
leaves the table as it was, and a replayed batch (same version) starts from the version before it. Old bucket
files go once none of the last ``keep`` manifests names them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class KeyedTable:
    """``keys`` deal rows to ``buckets``; ``schema`` is the rows' own. All batches of a table must use the same of both."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS, keep: int = 2):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.keep = spark, path, schema, keys, buckets, keep

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder, fs = self._folder(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json"))

    def _manifest(self, version: int | None) -> dict[int, int]:
        """Bucket to the version that holds it: at most ``buckets`` entries."""
        if version is None:
            return {}
        file, fs = self._folder(f"{self.path}/manifest/v={version}.json")
        opened = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()
        return {int(b): int(v) for b, v in json.loads(text).items()}

    def _commit(self, version: int, held: dict[int, int]) -> None:
        file, fs = self._folder(f"{self.path}/manifest/v={version}.json")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        fs.delete(file, False)  # a replayed version
        if not fs.rename(draft, file):
            raise OSError(f"could not commit version {version} of {self.path}")

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(held.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest (or a given) version."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        return self._rows(self._manifest(version))

    def merge(self, batch: DataFrame, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write ``version``: in every bucket that ``batch`` touches, ``combine(old rows, new rows)``; other buckets stay where
        they are. Returns the touched buckets."""
        before = [v for v in self.versions() if v < version]
        held = self._manifest(before[-1] if before else None)
        rows = batch.select(*self.schema.names).withColumn("_bucket", self.bucket())
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if touched:
            old = self._rows({b: held[b] for b in touched if b in held})
            merged = combine(old, rows.drop("_bucket")).select(*self.schema.names)
            merged.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
            folder, fs = self._folder(f"{self.path}/data/v={version}")
            written = {int(s.getPath().getName()[7:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("bucket=")}
            held = {b: v for b, v in held.items() if b not in touched} | {b: version for b in written}
        self._commit(version, held)
        self._retire()
        return touched

    def _retire(self) -> None:
        """Delete manifests but the last ``keep``, and bucket files that none of those names."""
        versions = self.versions()
        stay = versions[-self.keep:]
        named = {(v, b) for x in stay for b, v in self._manifest(x).items()}
        newest = stay[-1] if stay else -1
        folder, fs = self._folder(f"{self.path}/data")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                version = int(status.getPath().getName()[2:])
                if version > newest:
                    continue  # not committed yet
                inside = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().startswith("bucket=")]
                gone = [p for p in inside if (version, int(p.getName()[7:])) not in named]
                if len(gone) == len(inside):
                    fs.delete(status.getPath(), True)
                else:
                    for p in gone:
                        fs.delete(p, True)
        for version in versions[:-self.keep]:
            fs.delete(path(f"{self.path}/manifest/v={version}.json"), False)

    def bytes_of(self, version: int) -> int:
        """Bytes that ``version`` wrote and that are still there."""
        folder, fs = self._folder(f"{self.path}/data/v={version}")
        return fs.getContentSummary(folder).getLength() if fs.exists(folder) else 0

