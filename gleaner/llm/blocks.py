"""Blocks of documents and the exchange of packed questions and answers between them.

A block is a bounded run of rows, written once with its own random number, so
that every later pass over it sees the same rows in the same order whatever
happens to the executor that made it. Blocks ask questions of hash buckets:
``ask`` yields (bucket, payload), the rows of a bucket meet in one task, and
``answer`` gives one payload back per question. A block emits at most one row
per bucket, with all its keys in one binary, so the rows of an exchange are few
and a key that every block holds arrives once per block, not once per document.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Bytes of text in a block, but for a longer document, which has one of its own.
BLOCK_BYTES = 2 << 20
#: Blocks or buckets, one after the other, of a task at most, about.
TASK_GROUPS = 16
#: Ask: numbered payloads of each bucket. Answer: one payload for each question of a bucket.
Ask = Callable[..., Iterator[tuple[int, bytes]]]
Answer = Callable[[list[bytes]], list[bytes]]


def squeeze(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed binary; each is stored byte plane by byte plane, which suits sorted numbers."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a), ord(a.dtype.kind)))], "<i8")
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return squeeze(head.tobytes() + planes, 1)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = unsqueeze(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 1 + 3 * n)[1:].reshape(n, 3)
    out, at = [], 8 * (1 + 3 * n)
    for size, length, kind in head.tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<{chr(kind)}{size}"))
        at += size * length
    return out


def pack_keys(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted 64-bit keys."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def unpack_keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def lean() -> None:
    """Have a worker's C library hand large freed arrays back to the system at once, where it can; smaller ones are used again."""
    import ctypes

    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD, fixed
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def make_blocks(rows: DataFrame, encode: Callable[[list[tuple]], bytes], columns: list[str], size_of: Callable[[tuple], int], label: str, most: int = BLOCK_BYTES) -> DataFrame:
    """Written table (block, data) of the rows' columns, encoded block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        rng = np.random.default_rng()

        def one(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(rng.integers(0, 1 << 63))], pa.int64()), pa.array([encode(held)], pa.binary())], ["block", "data"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                n = size_of(row)
                if held and size + n > most:
                    yield one(held)
                    held, size = [], 0
                held.append(row)
                size += n
        if held:
            yield one(held)

    return materialize(rows.select(*columns).mapInArrow(run, "block long, data binary"), label)


def task_count(spark: SparkSession, groups: int) -> int:
    """Tasks for so many blocks or buckets: those of the session, and more where one would get over TASK_GROUPS."""
    return max(shuffle_partitions(spark), -(-groups // TASK_GROUPS))


def exchange(blocks: DataFrame, earlier: list[DataFrame], ask: Ask, answer: Answer, label: str, groups: int = 1) -> DataFrame:
    """Written table (block, bucket, data): the answers to each block's questions. ``ask`` gets the block's data and its earlier answers; groups: blocks or buckets, whichever are more."""
    n = task_count(blocks.sparkSession, groups)

    def questions(block: int, data: bytes, known: list[dict[int, bytes]]) -> Iterator[tuple]:
        for bucket, payload in ask(data, known):
            yield block, bucket, payload

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for bucket, rows in _groups(batches, "bucket"):
            found = answer([r["data"] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(found, pa.binary())], ["block", "bucket", "data"])

    asked = per_block(blocks, earlier, questions, "block long, bucket long, data binary", groups)
    out = materialize(asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(reduce, "block long, bucket long, data binary"), label)
    del asked
    release(blocks.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished exchanges now rather than at its driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with an equal key."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def per_block(blocks: DataFrame, earlier: list[DataFrame], make: Callable[[int, bytes, list[dict[int, bytes]]], Iterator[tuple]], schema: str, groups: int = 1) -> DataFrame:
    """Rows that ``make`` yields for each block, given its data and, for each earlier exchange, its answers by bucket."""
    types = [f.type for f in pa_schema(schema)]
    names = [f.name for f in pa_schema(schema)]

    def send(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for row in batch.to_pylist():
                yield from send(make(row["block"], row["data"], []))

    steps = len(earlier)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for block, rows in _groups(batches, "block"):
            known: list[dict[int, bytes]] = [{} for _ in range(steps)]
            for r in rows[1:]:
                known[r["step"] - 1][r["bucket"]] = r["data"]
            yield from send(make(block, rows[0]["data"], known))

    if not earlier:
        return blocks.mapInArrow(alone, schema)
    every = blocks.select("block", F.lit(0).alias("step"), F.lit(0).cast("long").alias("bucket"), "data")
    for i, answers in enumerate(earlier):
        every = every.unionByName(answers.select("block", F.lit(i + 1).alias("step"), "bucket", "data"))
    n = task_count(blocks.sparkSession, groups)
    return every.repartition(n, "block").sortWithinPartitions("block", "step", "bucket").mapInArrow(met, schema)


def pa_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def scaled(total: int, block: int, bucket: int, row: int) -> float:
    """By how much blocks and buckets are to be larger, so that a block's row for a bucket stands for at least ``row`` bytes of text.

    1 up to block * bucket / row bytes in all; then the square root of what is more, so that rows, and memory squared, grow with the input.
    """
    return max(1.0, (total * row / (block * bucket)) ** 0.5)


def bucket_count(total: int, per_bucket: int) -> int:
    return max(1, -(-total // per_bucket))
