"""Near-duplicate groups of documents by SimHash with bit-sliced comparison.

Fingerprints of ``BITS`` bits are cut into ``BLOCKS`` blocks of bits. Two that
differ in at most ``RADIUS`` bits agree in ``BLOCKS - RADIUS`` whole blocks, so
each distinct fingerprint is dealt out once for each such choice of blocks, by
the bits chosen. Within a bucket fingerprints are stored in bit planes, 64 to a
machine word: one XOR gives a bit's difference to all 64, carry-save counters
add the planes up, and a block is abandoned once all its lanes are over the
radius. Every bucket hands on a spanning forest of its links, so the number of
links grows with the rows, and connected components over fingerprints give the
groups.

Copies share a fingerprint and count once. A bucket of more than
``BUCKET_ROWS`` distinct fingerprints is cut into parts by hash, and each pair of
parts is compared in a group of its own: no pair is lost and no task holds more
than two parts.

The joins that bring a group back to its rows run between plain exchanges; a
fingerprint that a third of the rows have (that of empty texts) is split there by
the session's skew handling (spark.sql.adaptive.skewJoin), and its other side is one row.

Defined cases: a null text or one without words has fingerprint zero and is
linked like any other; a very long text is hashed whole by one task; a null
doc_id is no component's smallest one unless it has no other; repeated rows come
back each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, scratch, shuffle_partitions
from .components import connected_components

BITS, BLOCKS, RADIUS, SHINGLE, SEED = 64, 5, 3, 3, 42
BUCKET_ROWS = 2048
#: Rows of a partition compared at a time, and (row, word) comparisons at a time.
AT_ONCE, TASKS = 1 << 16, 1 << 16
U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle of so many words; fewer words are one shingle."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash over the word shingles of a UTF-8 text."""
    return majority(shingles(text.lower().split() if text else [], shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "fp"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"doc_id {ids}, fp long")


def block_masks(bits: int = BITS, blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that a bucket has in common, one for each choice of blocks - radius blocks."""
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> None:
    """Join the rows a[i] and b[i] in ``root`` (each row's smallest row so far)."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, again := root[root]):
            root[:] = again


def links(run: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of equal ``run`` (sorted) whose fingerprints differ in at most ``radius`` bits."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(run)])
    many = sizes > 1
    starts, sizes = starts[many], sizes[many]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(starts, sizes) + place
    words = -(-sizes // 64)
    first_word = np.repeat(np.cumsum(words) - words, sizes)
    lane, word = (place % 64).astype(U), first_word + place // 64
    heads = np.flatnonzero(lane == 0)
    q = fps[rows]
    planes = np.stack([np.bitwise_or.reduceat(((q >> U(k)) & U(1)) << lane, heads) for k in range(BITS)])
    filled = np.bitwise_or.reduceat(U(1) << lane, heads)
    first_row = rows[heads]
    todo = np.repeat(words, sizes) - place // 64
    ends = np.cumsum(todo)
    root = np.arange(len(fps))
    # Counters begin so high that a lane overflows at radius + 1 differences.
    levels = radius.bit_length()
    spare = (1 << levels) - 1 - radius
    tasks = TASKS if radius <= RADIUS else TASKS // 8  # with a wide radius most lanes of a block can hit
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tasks, "right")))
        n = todo[at:upto]
        who = np.repeat(np.arange(at, upto), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        where = word[who] + step
        later = np.where(step == 0, ~((U(2) << lane[who]) - U(1)), ALL)
        over = ~(later & filled[where])
        bits, counters = q[who], [np.full(len(who), ALL if spare >> i & 1 else U(0)) for i in range(levels)]
        for k in range(BITS):
            if k % 8 == 0:
                alive = over != ALL
                if not alive.all():
                    who, where, over, bits, *counters = (x[alive] for x in (who, where, over, bits, *counters))
            if not len(who):
                break
            carry = planes[k][where] ^ (U(0) - ((bits >> U(k)) & U(1)))
            for c in counters:
                c ^= carry
                carry &= ~c
            over |= carry
        hit = ~over
        some = np.flatnonzero(hit)
        if len(some):
            lit = np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(lit)
            _forest(len(fps), rows[who[some[i]]], first_row[where[some[i]]] + j, root)
        at = upto
    moved = np.flatnonzero(root != np.arange(len(root)))
    return moved, root[moved]


def linked(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """(bucket, part, fp) rows sorted by bucket and part -> links (u, v) between fingerprints."""
    kept: list[tuple[np.ndarray, ...]] = []

    def emit(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        change = np.r_[False, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])]
        fps = cols[3].view(U)
        a, b = links(np.cumsum(change), fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(cols[3][a]), pa.array(cols[3][b])], ["u", "v"])

    for batch in batches:
        kept.append(tuple(batch.column(c).to_numpy() for c in ("choice", "bucket", "part", "fp")))
        if sum(len(x[0]) for x in kept) >= AT_ONCE:
            cols = tuple(map(np.concatenate, zip(*kept, strict=True)))
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            kept = [tuple(c[cut:] for c in cols)]
            if cut:
                yield emit(tuple(c[:cut] for c in cols))
    if kept:
        yield emit(tuple(map(np.concatenate, zip(*kept, strict=True))))


def salted(rows: DataFrame, own, parts) -> DataFrame:
    """Each row once for every pair of parts (``own`` of ``parts``) that its part is in, numbered by ``part``."""
    held = rows.withColumn("parts", F.greatest(parts, F.lit(1)).cast("long")).withColumn("own", F.pmod(own, F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(j, F.col("own")) * F.col("parts") + F.greatest(j, F.col("own")))
    return held.withColumn("part", F.explode(pairs))


def bucket_links(dealt: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect the fingerprints of each bucket (choice, bucket, fp) at most ``radius`` bits apart."""
    hot = materialize(dealt.groupBy("choice", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS), "hot_buckets")
    parts = F.ceil(F.coalesce("n", F.lit(0)) / BUCKET_ROWS)
    rows = salted(dealt.join(hot, ["choice", "bucket"], "left"), F.xxhash64("fp"), parts).select("choice", "bucket", "part", "fp")
    n = shuffle_partitions(dealt.sparkSession)
    return rows.repartition(n, "choice", "bucket", "part").sortWithinPartitions("choice", "bucket", "part").mapInArrow(lambda b: linked(b, radius), "u long, v long")


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all fingerprints (column fp, distinct) at most ``radius`` bits apart."""
    masks = block_masks(blocks=max(BLOCKS, radius + 2), radius=radius)
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for i, m in enumerate(masks)))
    return bucket_links(distinct.select("fp", F.explode(keys).alias("k")).select("k.choice", "k.bucket", "fp"), radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the group) for every row.

    With ``similarity`` documents are linked whose sets of shingles have at least that Jaccard similarity
    (``verified.py``), and ``radius`` only says how far apart the fingerprints of those compared can be.
    """
    if similarity is not None:
        from .verified import known_groups

        with scratch():
            prints, known, key = *known_groups(docs, radius, shingle, similarity), "node"
    else:
        prints, key = materialize(fingerprints(docs, shingle), "fingerprints"), "fp"
        with scratch():
            classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "fingerprint_classes")
            found = materialize(fingerprint_links(classes.select("fp"), radius), "fingerprint_links")
            known = components(classes, found, "fp")
    return join_groups(prints, known, key, prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components(classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key``, component_id, n: the least first_id of the classes (key, first_id, n) that the links ``found`` connect."""
    groups = materialize(connected_components(found), "fingerprint_groups")
    named = classes.join(groups.withColumnRenamed("node", key), key, "left")
    labelled = materialize(named.select(key, "first_id", F.col("n").alias("rows"), F.coalesce("component", key).alias("group")), "fingerprint_labels")
    least = labelled.groupBy("group").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    joined = join_groups(labelled, materialize(least, "fingerprint_least"), "group", labelled.count())
    return materialize(joined.select(key, "component_id", F.col("rows").alias("n")), "fingerprint_components", keep=True)
