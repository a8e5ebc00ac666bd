"""Helpers shared by the training-data operators.

``materialize`` writes a DataFrame as Parquet below the folder named by
``spark.checkpoint.dir`` (shared by driver and executors) and reads it back:
lineage ends there, a lost executor costs a re-read instead of a recomputation,
and later joins see true sizes.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.shared import shared_dir

#: Bytes that separate words: space and \t \n \v \f \r (what bytes.split() uses).
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class _Made(threading.local):
    """Of each thread: the tables made inside each ``scratch``. Sent to an executor it arrives empty."""

    lists: tuple[list[DataFrame], ...] = ()

    def __reduce__(self):
        return _Made, ()


_made = _Made()


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``materialize`` makes inside are discarded at the end, but for those it is told to keep."""
    before = _made.lists
    _made.lists = (*before, [])
    try:
        yield
    finally:
        for df in _made.lists[-1]:
            discard(df)
        _made.lists = before


def materialize(df: DataFrame, label: str, keep: bool = False, partition: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (in directories by the column ``partition``, if given) and read it again; removed at the end of the ``scratch`` around it (``keep``: of the next one out) or of the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner/{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").partitionBy(*([partition] if partition else [])).parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    around = _made.lists[: -1 if keep else None]
    if around:
        around[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that no later plan reads."""
    path = getattr(df, "_gleaner_path", None)
    if path:
        p, fs = _path(df.sparkSession, path)
        fs.delete(p.getParent(), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One in so many of all rows makes a group hot.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` (one row for each ``key``, with its number of rows ``n``, of ``total`` together).

    Groups of a thousandth of all rows or more, of which there are a thousand at most, are
    broadcast, so that no task gets a hot group's rows; the others are joined by exchange.
    """
    hot = F.broadcast(groups.where(F.col("n") * HOT >= total))
    rest = groups.where(F.col("n") * HOT < total)
    others = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(rest, key))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, even inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


#: Steps in which a sample is made smaller until its bytes fit.
STEPS = 1000


def bounded_sample(rows: DataFrame, key: str, share: Column, max_bytes: int) -> DataFrame:
    """Rows (with ``key`` and text) whose hash of ``key`` lies below ``share``, or below as large a part of it as keeps their texts within ``max_bytes``.

    Rows over a sixteenth of that are not drawn. Whether a row is drawn depends on its key, its size and these bounds.
    """
    unit = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    size = F.octet_length("text").cast("long")
    near = rows.where((unit < share) & (size <= max_bytes // 16))
    bins = near.groupBy(F.floor(unit / share * STEPS).cast("int").alias("bin")).agg(F.sum(size).alias("bytes")).collect()  # at most STEPS rows
    kept, total = STEPS, 0
    for r in sorted(bins):
        total += r.bytes
        if total > max_bytes:
            kept = r.bin
            break
    return near.where(unit / share < kept / STEPS)


def held_out(key: Column, n: int, remainder: int) -> Column:
    """Whether a row is kept from learning: its id's remainder says so, or it has no id."""
    return F.coalesce(crc_mod(key, n) == remainder, F.lit(True))


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``n``."""
    return F.crc32(c.cast("string")) % F.lit(n)
