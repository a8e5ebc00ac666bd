"""Packing documents into fixed-length sequences, shortest pack first over the length histogram.

A document's token ids (and one end id) are cut every ``length`` ids; the pieces
are packed. The driver sees only the histogram of piece lengths: lengths are
placed longest first, each into the shortest pack (a new one where that has no
room), with counts of equal patterns updated at once. The pattern slots
of a length are ranges of ranks, and every piece finds its slot by its rank
among the pieces of its length.

Ranks come from counts of hash buckets within a length and a row number within a
bucket, so a length shared by a third of all pieces is spread over many tasks.
The slot table has a size that depends on ``length`` alone, not on the rows: each
placement uses up a histogram bin or a pattern group, and a group is at most
``length`` pieces deep.

Words between white space are tokenized one by one and remembered, up to
``WORDS`` per worker; the tokenizer drops white space before anything else, so
this gives its ids for the whole text (texts with \\x1c-\\x1f, where Python's white
space differs, are encoded whole).

Defined cases: null and empty texts give one piece with the end id alone; a very
long text gives as many pieces as it needs, encoded whole by one task; pieces of
equal length are ranked by buckets of a number of their own, so that neither null or
repeated doc_ids nor repeated rows meet in one; repeated rows are packed each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch

END_ID = 1
#: Words a worker remembers.
WORDS = 500_000
#: Pieces of one length that one window partition ranks, about, and buckets whose counts one window partition adds up.
BUCKET_ROWS, BUCKETS = 500, 10_000
_ODD = re.compile("[\x1c-\x1f]")
_LATIN = re.compile("([a-zß-öø-ÿ]+)([.,]?)")


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit integers.

    Words of Latin letters, with or without a full stop or comma behind, go
    straight to the tokenizer's BPE model: its normalizer leaves them as they are
    but for case, and its pre-tokenizer cuts off the mark alone. Other words are
    encoded in full, many in one call, between zeros that tell them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.marks = {m: self._encode(m) for m in ".,"}
        self.zero = int(np.frombuffer(self._encode("0"), "<u4")[0])
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else self.spelled(word)[0][0])]).tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words not known yet; remembered while there is room."""
        new: dict[str, bytes] = {}
        rest = []
        for w in words:
            if m := _LATIN.fullmatch(w.lower()):
                bare, mark = m.groups()
                ids = self.known.get(bare) or new.get(bare)
                if ids is None:
                    ids = new[bare] = self._letters(bare)
                new[w] = ids + self.marks[mark] if mark else ids
            elif "0" in w or "<|" in w:
                new[w] = self._encode(w)
            else:
                rest.append(w)
        for a in range(0, len(rest), 512):
            part = rest[a : a + 512]
            data = self._encode(" 0 ".join(part))
            ends = [*(np.flatnonzero(np.frombuffer(data, "<u4") == self.zero) * 4).tolist(), len(data)]
            at = 0
            for w, end in zip(part, ends, strict=True):
                new[w] = data[at:end]
                at = end + 4
        if len(self.known) < WORDS:
            self.known.update(new)
        return new

    def ids(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._encode(text)
        words = text.split()
        ids = list(map(self.known.get, words))
        try:
            at = ids.index(None)
        except ValueError:
            return b"".join(ids)
        unknown = [at]
        try:
            while True:
                at = ids.index(None, at + 1)
                unknown.append(at)
        except ValueError:  # that was the last
            new = self._learn({words[i] for i in unknown})
        for i in unknown:
            ids[i] = new[words[i]]
        return b"".join(ids)


def pieces(docs: DataFrame, tokenizer_path: str, length: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = tokenizer.ids(text or "") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                rows += [(i, a, min(length, n - a), zlib.crc32(ids[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ids}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (times used, lengths): longest length first, each into the pattern with the most room, if that is enough."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(times: int, lengths: tuple[int, ...], room: int) -> None:
        if room == 0:
            done.append((times, lengths))
        else:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((times, lengths))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not rooms or rooms[-1] < size:  # new packs, each filled while it has room
                most = capacity // size
                for times, n in ((left // most, most), (1, left % most)):
                    if times and n:
                        put(times, (size,) * n, capacity - n * size)
                break
            room = rooms[-1]
            times, lengths = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[-1]
            used = min(times, left)
            if times > used:
                put(times - used, lengths, room)
            put(used, (*lengths, size), room - size)
            left -= used
    return done + [p for room in rooms for p in by_room[room]]


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length in turn its slots: first rank, first sequence, offset; sorted by (length, rank)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in patterns:
        at = 0
        for size in lengths:
            rows.append((size, taken.get(size, 0), sequence, at))
            taken[size] = taken.get(size, 0) + times
            at += size
        sequence += times
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), cols, strict=True))


def counts_before(counts: DataFrame) -> DataFrame:
    """length, bucket, before: rows of that length in the buckets before, from (length, bucket, n), in two levels of sums."""
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    known = materialize(counts.withColumn("lot", F.expr(f"bucket div {BUCKETS}")), "bucket_counts")
    lots = known.groupBy("length", "lot").agg(F.sum("n").alias("n"))
    lots = lots.select("length", "lot", F.coalesce(F.sum("n").over(upto("length", "lot")), F.lit(0)).alias("base"))
    inside = known.withColumn("own", F.coalesce(F.sum("n").over(upto("length", "lot", "bucket")), F.lit(0)))
    return inside.join(lots, ["length", "lot"]).select("length", "bucket", (F.col("base") + F.col("own")).alias("before"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, length).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    slots = spark.sparkContext.broadcast(slot_table(pack_histogram(histogram, length)))
    buckets = spark.createDataFrame([(k, -(-n // BUCKET_ROWS)) for k, n in histogram.items()], "length long, buckets long")
    spread = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("buckets")
    counts = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    with scratch():
        before = materialize(counts_before(counts), "rank_offsets", keep=True)
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1
    ranked = spread.withColumn("own", own).join(before, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        keys = (s["length"] << 44) | s["rank"]
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, (size << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(s["sequence"][k] + rank - s["rank"][k]), pa.array(s["offset"][k])], [*batch.schema.names[:5], "sequence_id", "offset"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {ids}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
