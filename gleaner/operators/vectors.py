"""Chunk vectors in shards, kept current by carrying out the resume plan.

``refresh`` compares the documents with what the store has, by fingerprint and
policy, and embeds what is new or changed, part by part of the hash of doc_ids. A part is
written to a folder named by its content (the documents, their fingerprints
and the policy), and then a new list of shards is published. If a run is killed,
the next one passes over the documents whose part was published, and a part that
was written whole but not published is taken as it is: no document is embedded twice.

Of several shards with a document the newest counts; documents that are gone are
named in the list's own table. ``compact`` rewrites the shards without what no longer
counts. Readers keep the list they began with.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import embed
from gleaner.functions import text as X

from . import maintenance
from .search import vector

SCHEMA = "doc_id long, off int, embedding array<double>, fingerprint string, policy string"


class VectorStore:
    """The store in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        name = maintenance.current_name(spark, folder)
        rows = spark.read.parquet(f"{folder}/{name}").orderBy("number").collect() if name else []  # one for each shard
        self.shards = [(r.number, r.name, r.kind) for r in rows]

    def _read(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA if kind == "vectors" else "doc_id long").parquet(f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        """The vector rows that count (SCHEMA)."""
        out = self.spark.createDataFrame([], SCHEMA)
        for number, name, kind in self.shards:
            if kind == "vectors":
                newer = [self._read(n, k).select("doc_id") for m, n, k in self.shards if m > number]
                own = self._read(name, kind)
                for ids in newer[:1]:
                    for other in newer[1:]:
                        ids = ids.unionByName(other)
                    own = own.join(ids.distinct(), "doc_id", "left_anti").select(own.columns)
                out = out.unionByName(own)
        return out

    def documents(self) -> DataFrame:
        """doc_id, fingerprint, policy of the documents that the store has."""
        return self.rows().select("doc_id", "fingerprint", "policy").distinct()

    def search(self, query: list[float], limit: int = 5) -> DataFrame:
        return vector(self.rows().where("off >= 0"), query, limit)

    def status(self, docs: DataFrame) -> DataFrame:
        """One row: documents to keep, embed and drop, and whether the store is fresh."""
        return maintenance.index_status(_marks(docs), self.documents(), embed.policy_version())

    def _publish(self, shards: list[tuple[int, str, str]]) -> VectorStore:
        name = maintenance.fresh_name()
        self.spark.createDataFrame(shards, "number int, name string, kind string").coalesce(1).write.parquet(f"{self.folder}/{name}")
        maintenance.point(self.spark, self.folder, name)
        return VectorStore(self.spark, self.folder)

    def _with(self, name: str, kind: str) -> VectorStore:
        rest = [s for s in self.shards if s[1] != name]
        return self._publish([*rest, (max((n for n, _, _ in self.shards), default=0) + 1, name, kind)])

    def _whole(self, name: str) -> bool:
        path, fs, jvm = maintenance.folder_of(self.spark, f"{self.folder}/{name}")
        return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))

    def refresh(self, docs: DataFrame, embedder: embed.Embedder = embed.hashing_embedder, parts: int = 16) -> VectorStore:
        """Embed what is new or changed in ``docs`` (path, text, mtime, doc_id), part by part, each published when it is written; leave out what is gone."""
        own = self
        policy = embed.policy_version()
        plan = maintenance.resume_plan(_marks(docs), own.documents(), policy)
        if (gone := plan.where("action = 'drop'").select("doc_id")).head(1):
            name = f"gone-{maintenance.fresh_name()}"
            gone.write.parquet(f"{own.folder}/{name}")
            own = own._with(name, "gone")
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
        todo = plan.where("action = 'embed'").join(_marks(docs), "doc_id").select("doc_id", "fingerprint", part.alias("part"))
        # What a part holds, told by sums that need no order: its rows, and two hashes of them.
        sums = [F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "fingerprint").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("fingerprint", "doc_id")).alias("b")]
        for r in todo.groupBy("part").agg(*sums).orderBy("part").collect():  # one for each part
            name = f"shard-{hashlib.sha256(f'{policy} {parts} {r.part} {r.n} {r.a} {r.b}'.encode()).hexdigest()[:32]}"
            if not own._whole(name):
                chosen = docs.join(todo.where(F.col("part") == r.part).select("doc_id"), "doc_id", "left_semi")
                embed.chunk_vectors(chosen, embedder).write.mode("overwrite").parquet(f"{own.folder}/{name}")
            own = own._with(name, "vectors")
        return own

    def compact(self) -> VectorStore:
        """One shard of what counts."""
        name = f"shard-{maintenance.fresh_name()}"
        self.rows().write.parquet(f"{self.folder}/{name}")
        return self._publish([(1, name, "vectors")])

    def vacuum(self) -> int:
        """Remove the folders that the list does not name (also what an interrupted run left); how many."""
        return maintenance.vacuum(self.spark, self.folder, {maintenance.current_name(self.spark, self.folder), *(n for _, n, _ in self.shards)})


def _marks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", X.fingerprint(F.col("mtime"), F.col("text")).alias("fingerprint"))
