"""A table of documents in buckets of the hash of their path, changed bucket by bucket.

Every version is a list of (bucket, folder) behind an atomic pointer. An upsert or a
removal reads and writes the buckets that its paths fall into and names the
others as they were, so what it writes is in proportion to what it touches;
readers of an older version are not disturbed until ``vacuum``. A change that is
repeated after a failure gives the same table.

Take enough buckets that one has a few hundred megabytes; ``rebucket`` deals the table anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maintenance

#: Rows of a bucket that one file takes, about.
FILE_ROWS = 1 << 20


class Buckets:
    """The table in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        name = maintenance.current_name(spark, folder)
        rows = spark.read.parquet(f"{folder}/{name}").collect() if name else []  # one for each bucket
        self.parts = {r.bucket: r.name for r in rows if r.bucket >= 0 and r.name}
        self.buckets = next((-r.bucket for r in rows if r.bucket < 0), 0)
        self.schema = next((r.name for r in rows if r.bucket < 0), None)

    @classmethod
    def create(cls, docs: DataFrame, folder: str, buckets: int = 64) -> Buckets:
        """A table of the latest row of each path of ``docs``, in place of what ``folder`` has."""
        own = object.__new__(cls)
        own.spark, own.folder, own.parts, own.buckets = docs.sparkSession, folder, {}, buckets
        own.schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
        return own._written(maintenance.latest(docs), set())

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        chosen = [f"{self.folder}/{name}/bucket={b}" for b, name in sorted(self.parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], self.schema)

    def _written(self, rows: DataFrame, touched: set[int]) -> Buckets:
        """Write ``rows`` (of the touched buckets only) and publish them beside the untouched buckets."""
        name = maintenance.fresh_name()
        dealt = rows.withColumn("bucket", self._bucket(F.col("path")))
        dealt.repartition("bucket").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(f"{self.folder}/{name}")
        path, fs, _ = maintenance.folder_of(self.spark, f"{self.folder}/{name}")
        new = {int(n.split("=")[1]): name for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("bucket=")}
        kept = {b: n for b, n in self.parts.items() if b not in touched}
        listed = maintenance.fresh_name()
        rows = [(-self.buckets, self.schema), *sorted((kept | new).items())]
        self.spark.createDataFrame(rows, "bucket int, name string").coalesce(1).write.parquet(f"{self.folder}/{listed}")
        maintenance.point(self.spark, self.folder, listed)
        return Buckets(self.spark, self.folder)

    def apply(self, new: DataFrame, gone: DataFrame | None = None) -> Buckets:
        """Rows of ``new`` replace those of their path (and keep the old doc_id), paths of ``gone`` go; ``new`` wins where both have a path."""
        paths = new.select("path") if gone is None else new.select("path").unionByName(gone.select("path"))
        touched = {r[0] for r in paths.select(self._bucket(F.col("path"))).distinct().collect()}  # at most the number of buckets
        if not touched:
            return self
        old = self.read(touched)
        if gone is not None:
            dropped = gone.select("path").join(new.select("path"), "path", "left_anti")
            old = old.join(dropped, "path", "left_anti").select(old.columns)
        return self._written(maintenance.upsert(old, new.select(old.columns)), touched)

    def rebucket(self, buckets: int) -> Buckets:
        return Buckets.create(self.read(), self.folder, buckets)

    def vacuum(self) -> int:
        """Remove what only older versions name; how many folders. Only when nobody reads an older version."""
        return maintenance.vacuum(self.spark, self.folder, {maintenance.current_name(self.spark, self.folder), *self.parts.values()})
