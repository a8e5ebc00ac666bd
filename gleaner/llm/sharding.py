"""Sharding by best-fit-decreasing bin packing.

Documents of equal texts form a group that no shard boundary cuts. Groups enter,
heaviest first, the shard with the least remaining room that takes them; rooms
are kept in a balanced tree. With ``capacity`` as many shards are opened as that
needs; with ``shards`` the smallest capacity is looked for with which the groups
fit into so many. A group at least as heavy as the mean of the shards left (or
heavier than ``capacity``) gets a shard of its own; nothing else can be done with
it, and the others then share what is left evenly.

The driver sees the histogram of weights only. Weights are a group's bytes rounded up
to ``WEIGHT_BITS`` significant bits, so that it has about a million bins at most,
whatever the input, and a shard's bytes are known to a part in 32,768. Groups of one
weight are told apart by their rank, and every placement is a range of ranks.
Ranks and slots are counts of hash buckets and row numbers within a bucket, so no
task holds a shard or a weight whole. Groups with a thousandth of all rows or more,
a thousand at most, are broadcast; so no join moves a hot group's rows to one task.

Defined cases: a null text is an empty one; a null or repeated doc_id is a row like any
other; equal texts lie in one shard however many and long they are; texts are told
apart by SHA-256; groups of equal weight are ranked by that; slots follow the rows'
order in the input; shards may stay empty where there are fewer groups; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, join_groups, materialize, scratch
from .packing import counts_before

#: Significant bits of a weight, and rows in a bucket (about).
WEIGHT_BITS, BUCKET_ROWS = 16, 1000
#: Bytes that a document takes beside its text.
OVERHEAD = 8


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key):
        self.key, self.level, self.left, self.right = key, 1, None, None


def _level(t: _Node | None) -> int:
    return t.level if t else 0


def _skew(t: _Node | None) -> _Node | None:
    if t and t.left and t.left.level == t.level:
        top = t.left
        t.left, top.right = top.right, t
        return top
    return t


def _split(t: _Node | None) -> _Node | None:
    if t and t.right and t.right.right and t.level == t.right.right.level:
        top = t.right
        t.right, top.left = top.left, t
        top.level += 1
        return top
    return t


def _insert(t: _Node | None, key) -> _Node:
    if t is None:
        return _Node(key)
    if key < t.key:
        t.left = _insert(t.left, key)
    else:
        t.right = _insert(t.right, key)
    return _split(_skew(t))


def _delete(t: _Node | None, key) -> _Node | None:
    if t is None:
        return None
    if key < t.key:
        t.left = _delete(t.left, key)
    elif t.key < key:
        t.right = _delete(t.right, key)
    elif t.left is None:
        return t.right
    elif t.right is None:
        return t.left
    else:
        heir = t.right
        while heir.left:
            heir = heir.left
        t.key, t.right = heir.key, _delete(t.right, heir.key)
    low = min(_level(t.left), _level(t.right)) + 1
    if low < t.level:
        t.level = low
        if t.right and low < t.right.level:
            t.right.level = low
    t = _skew(t)
    t.right = _skew(t.right)
    if t.right:
        t.right.right = _skew(t.right.right)
    t = _split(t)
    t.right = _split(t.right)
    return t


class Rooms:
    """Shards by remaining room, in a balanced (AA) tree."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, room: int, shard: int) -> None:
        self.root = _insert(self.root, (room, shard))

    def remove(self, room: int, shard: int) -> None:
        self.root = _delete(self.root, (room, shard))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """(room, shard) of the least room that takes ``size``."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


#: weight, first rank, shard, groups.
Placement = tuple[int, int, int, int]


def best_fit(weights: list[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0, ranks: dict[int, int] | None = None) -> list[Placement] | None:
    """Placements of (weight, groups), heaviest first, into shards numbered from ``first``; none if more than ``most`` shards are needed.

    ``ranks``: groups of a weight that are placed already.
    """
    rooms, opened, out = Rooms(), 0, []
    for weight, count in weights:
        rank, left = (ranks or {}).get(weight, 0), count
        while left:
            found = rooms.tightest(weight)
            if found is None:
                if opened == most:
                    return None
                room, shard = max(capacity, weight), first + opened
                opened += 1
            else:
                room, shard = found
                rooms.remove(room, shard)
            n = min(left, room // weight)
            out.append((weight, rank, shard, n))
            rank, left = rank + n, left - n
            if room > n * weight:
                rooms.add(room - n * weight, shard)
    return out


def even_fit(weights: list[tuple[int, int]], shards: int) -> list[Placement]:
    """Placements of (weight, groups), heaviest first, into so many shards, by the smallest capacity found."""
    rest = [list(x) for x in weights]
    total, out, own, ranks = sum(w * n for w, n in weights), [], 0, {}
    while rest and own < shards - 1 and rest[0][0] * (shards - own) >= total:
        weight = rest[0][0]
        out.append((weight, ranks.get(weight, 0), own, 1))
        ranks[weight] = ranks.get(weight, 0) + 1
        total, own = total - weight, own + 1
        rest[0][1] -= 1
        if not rest[0][1]:
            del rest[0]
    if not rest:
        return out
    left, bins = [tuple(x) for x in rest], shards - own
    low = max(-(-total // bins), rest[0][0])
    high = low + rest[0][0]  # enough: a group that fits nowhere would mean that every shard holds more than the mean
    while low < high:
        middle = (low + high) // 2
        if best_fit(left, middle, bins) is None:
            low = middle + 1
        else:
            high = middle
    return out + (best_fit(left, high, bins, own, ranks) or [])


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + OVERHEAD


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def placed_groups(rows: DataFrame, shards: int | None, capacity: int | None) -> DataFrame:
    """key, n, shard of every group of ``rows`` (key, size)."""
    spark = rows.sparkSession
    grouped = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    shift = f"greatest(0, length(bin(bytes)) - {WEIGHT_BITS})"
    weight = F.expr(f"shiftleft(shiftright(bytes + shiftleft(1L, {shift}) - 1, {shift}), {shift})")
    groups = materialize(grouped.select("key", "n", weight.alias("weight")), "groups")
    histogram = sorted(((r.weight, r.n) for r in groups.groupBy("weight").agg(F.count("*").alias("n")).collect()), reverse=True)  # about a million bins at most
    found = even_fit(histogram, shards) if capacity is None else best_fit(histogram, capacity)
    cols = np.array(sorted(found), np.int64).reshape(-1, 4).T
    sent = spark.sparkContext.broadcast((cols[0], cols[1], cols[2]))
    buckets = -(-max((n for _, n in histogram), default=1) // BUCKET_ROWS)
    spread = groups.withColumnRenamed("weight", "length").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    before = counts_before(spread.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("key")) - 1
    ranked = spread.withColumn("own", own).join(before, ["length", "bucket"]).select("key", "n", "length", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, rank, shard = sent.value
        starts = np.searchsorted(weight, weight, "left")  # of each placement's weight
        for batch in batches:
            w, r = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(weight, w, "right") - 1
            low = starts[at]
            while (low < at).any():  # the last placement of the weight that begins at the rank or before
                middle = (low + at + 1) // 2
                fits = rank[middle] <= r
                low, at = np.where(fits, middle, low), np.where(fits, at, middle - 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(shard[low].astype(np.int32))], ["key", "n", "shard"])

    return ranked.mapInArrow(place, "key binary, n long, shard int")


def assign_shards(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document: evenly over ``shards``, or into as few as ``capacity`` bytes allow."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    measured = docs.select("doc_id", _size(text).alias("size"), F.crc32(text).alias("text_crc32"), _key(text).alias("key"), F.monotonically_increasing_id().alias("row"))
    with scratch():
        rows = materialize(measured, "sized_rows")
        groups = materialize(placed_groups(rows, shards, capacity), "placed_groups")
        total = rows.count()
        sharded = materialize(join_groups(rows, groups, "key", total).drop("key", "n"), "sharded_rows", keep=True)
        buckets = max(1, -(-total // BUCKET_ROWS))
        spread = sharded.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
        counts = spread.groupBy(F.col("shard").alias("length"), "bucket").agg(F.count("*").alias("n"))
        before = materialize(counts_before(counts).withColumnRenamed("length", "shard"), "slot_offsets", keep=True)
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")) - 1
    slot = (F.col("before") + F.col("own")).alias("slot")
    return spread.withColumn("own", own).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", slot)


def write_shards(docs: DataFrame, folder: str, shards: int | None = 24, capacity: int | None = None, files: int = 8) -> None:
    """Write ``docs``, all columns, below ``folder``: a directory ``shard=N`` for each shard, of about ``files`` files each."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    shard, salt = (fresh(docs, x) for x in ("shard", "salt"))
    with scratch():
        rows = materialize(docs.select(_size(text).alias("size"), _key(text).alias("key")), "sized_rows")
        groups = materialize(placed_groups(rows, shards, capacity), "placed_groups")
        every = F.struct(*docs.columns)
        keyed = docs.select(every.alias("row"), _key(text).alias("key"))
        both = join_groups(keyed, groups, "key", rows.count()).select("row.*", F.col("shard").alias(shard))
        dealt = both.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files)))
        dealt.repartition(shard, salt).drop(salt).write.partitionBy(shard).parquet(folder)
