"""Keeping derived tables current: differences, upserts, removals, resume plans, staleness, the skipped ledger.

Tables are immutable snapshots; each operator returns the next one, built by
joins on the document key, and ``publish`` swaps it in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unchanged_removed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """What needs reading: rows of ``listing`` whose (path, mtime, size) is not known."""
    return listing.join(known.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by path, but keep the old doc_id; of several new rows of a path the latest counts."""
    new = latest(new)
    ids = old.groupBy("path").agg(F.min("doc_id").alias("old_id"))
    kept = old.join(new.select("path"), "path", "left_anti")
    taken = new.join(ids, "path", "left").withColumn("doc_id", F.coalesce("old_id", "doc_id")).select(old.columns)
    return kept.select(old.columns).unionByName(taken)


def latest(rows: DataFrame) -> DataFrame:
    """One row of each path: that with the largest mtime (if there is one), then of the largest other values."""
    rest = [c for c in rows.columns if c not in ("path", "mtime")]
    order = F.struct(*([F.col("mtime")] if "mtime" in rows.columns else []), *map(F.col, rest))
    return rows.groupBy("path").agg(F.max(order).alias("r")).select(*(F.col("path") if c == "path" else F.col(f"r.{c}").alias(c) for c in rows.columns))


def prune_missing(docs: DataFrame, listing: DataFrame) -> DataFrame:
    return docs.join(listing.select("path"), "path", "left_semi").select(docs.columns)


def remove_under(docs: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, dry run: number and first five paths removed). A root removes itself and what lies below, not names it begins."""
    below = F.lit(False)
    for r in roots:
        below |= (F.col("path") == r.rstrip("/")) | F.col("path").startswith(r.rstrip("/") + "/")
    gone = docs.where(below)
    first = gone.select("path").orderBy("path").limit(5).agg(F.array_sort(F.collect_list("path")).alias("sample"))
    counted = gone.agg(F.count("*").alias("n_removed"))
    report = counted.withColumn("one", F.lit(1)).join(first.withColumn("one", F.lit(1)), "one").drop("one")
    return docs.where(~below), report


def resume_plan(current: DataFrame, stored: DataFrame, policy: str) -> DataFrame:
    """What to do with each document's vectors: keep, embed (new or changed fingerprint or policy) or drop.

    current: doc_id, fingerprint; stored: doc_id, fingerprint, policy. Plans are per
    document, so one edit never repeats its neighbours' work.
    """
    c, s = current.alias("c"), stored.alias("s")
    same = (F.col("c.fingerprint") == F.col("s.fingerprint")) & (F.col("s.policy") == policy)
    action = F.when(F.col("c.doc_id").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "keep").otherwise("embed")
    return c.join(s, F.col("c.doc_id") == F.col("s.doc_id"), "full_outer").select(F.coalesce("c.doc_id", "s.doc_id").alias("doc_id"), action.alias("action"))


def staleness(docs: DataFrame, recorded: dict, tolerance: float = 1.0) -> DataFrame:
    """Count, largest id and sum of mtimes against the recorded ones."""
    now = docs.agg(F.count("*").alias("doc_count"), F.max("doc_id").alias("doc_max_id"), F.round(F.sum("mtime"), 3).alias("doc_mtime_sum"))
    drift = (F.col("doc_count") != recorded["doc_count"]) | (F.col("doc_max_id") != recorded["doc_max_id"]) | (F.abs(F.col("doc_mtime_sum") - recorded["doc_mtime_sum"]) > tolerance)
    return now.withColumn("stale", F.coalesce(drift, F.lit(True)))


def prune_ledger(ledger: DataFrame, listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Skipped files that still exist and have not been indexed since."""
    return ledger.join(listing.select("path"), "path", "left_semi").join(docs.select("path"), "path", "left_anti")


def ledger_by_reason(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy(F.desc("n"), "reason")


def ledger_largest(ledger: DataFrame, limit: int = 12) -> DataFrame:
    return ledger.select("path", "size", "reason").orderBy(F.desc("size"), "path").limit(limit)


def roots(docs: DataFrame) -> DataFrame:
    """Documents by the first four parts of their path."""
    return docs.groupBy(F.array_join(F.slice(F.split("path", "/"), 1, 4), "/").alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root")


def fresh_name() -> str:
    return uuid.uuid4().hex


def folder_of(spark: SparkSession, folder: str):
    """(path, its file system, the driver's JVM)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def _files(spark: SparkSession, folder: str):
    return folder_of(spark, f"{folder}/_versions")


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    path, fs, _ = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted((int(n.split("-")[0]), n.split("-", 1)[1]) for n in names if n[0] != ".")


def point(spark: SparkSession, folder: str, name: str) -> None:
    """Make ``name`` the current snapshot: a new numbered pointer is moved into place, older ones stay for those who read them."""
    path, fs, jvm = _files(spark, folder)
    number = max((n for n, _ in _versions(spark, folder)), default=0) + 1
    draft = jvm.org.apache.hadoop.fs.Path(path, f".{fresh_name()}")
    fs.mkdirs(path)
    fs.create(draft).close()
    if not fs.rename(draft, jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}-{name}")):
        raise RuntimeError(f"another writer published version {number} of {folder}")


def current_name(spark: SparkSession, folder: str) -> str | None:
    return max(_versions(spark, folder), default=(0, None))[1]


def publish(df: DataFrame, folder: str) -> str:
    """Write a snapshot, then point ``folder`` at it; readers of the old one are not disturbed."""
    name = fresh_name()
    df.write.parquet(f"{folder}/{name}")
    point(df.sparkSession, folder, name)
    return name


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The snapshot that ``folder`` points at; none before the first one."""
    name = current_name(spark, folder)
    return None if name is None else spark.read.parquet(f"{folder}/{name}")


def vacuum(spark: SparkSession, folder: str, keep: set[str]) -> int:
    """Remove the folders in ``folder`` that are not named in ``keep``, and all pointers but the newest; how many folders."""
    versions, fs, jvm = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(versions.getParent())]
    gone = [n for n in names if n not in keep and not n.startswith("_")]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(versions.getParent(), n), True)
    for number, name in _versions(spark, folder)[:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(versions, f"{number:012d}-{name}"), True)
    return len(gone)


def drop_documents(vectors: DataFrame, plan: DataFrame) -> DataFrame:
    """The vector rows whose document the plan (doc_id, action) keeps."""
    return vectors.join(plan.where("action = 'keep'").select("doc_id"), "doc_id", "left_semi")


def prune_orphans(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """The vector rows whose document still exists."""
    return vectors.join(docs.select("doc_id"), "doc_id", "left_semi")


def index_status(current: DataFrame, stored: DataFrame, policy: str) -> DataFrame:
    """One row: documents to keep, embed and drop by the resume plan, and whether the vectors are fresh."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).alias(f"n_{a}")
    return resume_plan(current, stored, policy).agg(n("keep"), n("embed"), n("drop")).withColumn("fresh", (F.col("n_embed") == 0) & (F.col("n_drop") == 0))


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The key-value table with one key replaced (values are JSON text)."""
    return meta.where(F.col("key") != key).unionByName(meta.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def needs_rebuild(meta: DataFrame, current_format: int) -> DataFrame:
    """Whether the recorded index format (0 if none) is older than the current one."""
    return meta.where("key = 'index_format'").agg(F.coalesce(F.max(F.try_to_number("value", F.lit("999999999")).cast("int")), F.lit(0)).alias("found")).withColumn("rebuild", F.col("found") < current_format)
