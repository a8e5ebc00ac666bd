"""Continuous ingest: new document files are merged into a table in buckets, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.buckets import Buckets
from gleaner.operators.maintenance import latest


def follow(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, buckets: int = 64, removed: str = "removed") -> StreamingQuery:
    """Read Parquet files as they appear in ``source`` and upsert their rows by path into the table in ``folder``.

    A batch rewrites the buckets of its paths only. Of several rows of a path in a batch the latest counts; where
    the schema has a column ``removed`` and the row says so, the path goes. A batch that is repeated after a failure gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows, gone = latest(batch), None
        if removed in batch.columns:
            flag = F.coalesce(F.col(removed), F.lit(False))
            rows, gone = rows.where(~flag).drop(removed), rows.where(flag).select("path")
        own = Buckets(spark, folder)
        if own.buckets:
            own.apply(rows, gone)
        else:
            Buckets.create(rows, folder, buckets)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
