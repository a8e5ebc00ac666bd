"""The folder that driver and executors share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode without that setting a folder of this user."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"/tmp/checkpoints/gleaner-{os.getuid()}"
    os.makedirs(base, exist_ok=True)
    return f"file://{base}"


def until_exit(spark: SparkSession, folder: str) -> str:
    """Have ``folder`` removed when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where; removed at the end of the application, or by ``remove``."""
    folder = until_exit(spark, f"{shared_dir(spark)}/gleaner/{uuid.uuid4().hex}")
    df.write.parquet(f"{folder}/{label}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{label}"), folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def together(*tasks: Callable[[], object]) -> list:
    """What the tasks give; their jobs run side by side, and the first error of one is raised when all have ended."""
    out: list = [None] * len(tasks)
    wrong: list[Exception] = []

    def one(i: int) -> None:
        try:
            out[i] = tasks[i]()
        except Exception as e:  # told below, in the caller's thread
            wrong.append(e)

    threads = [InheritableThread(target=one, args=(i,)) for i in range(len(tasks))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if wrong:
        raise wrong[0]
    return out
