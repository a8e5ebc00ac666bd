"""Ranked lexical search over a tiered index.

A term's postings are dealt to tiers by their impact, the part of the score that
does not depend on the term's weight: the ``FIRST`` postings of highest impact (and
their equals) form the first tier, each further tier brings a term's postings to
``STEP`` times as many, and the last holds the rest. Beside the lists stands, for every
term and tier, the residual bound: the highest impact below that tier.

A round reads one more tier for the items still open. What a document has in the
tiers read bounds its score from below; that and the residual bounds of the terms it was not
seen with bound it from above. An item has its proof when even a document
seen nowhere stays below the 50th best lower bound: then no other document than those
whose upper bound reaches it can be among the best, and these are taken from the lists in
a second look. Items without proof fall through to the next tier by themselves; after
the last nothing is left unseen. The documents taken are scored exactly from their own terms.

Documents lie in blocks, and the lists of a block are scored by one task, for ``ITEMS``
items at a time, in arrays of fixed size; so postings are never joined with items
row by row, and a frequent term is spread over all blocks. Only terms that an item
has are indexed, of all documents and with counts over all of them. Items
are searched in parts of about ``PAIRS`` different terms, so that what is broadcast is
bounded; each part reads the documents once.

Defined cases: a null or empty text has no terms and is not counted; a very long one counts
whole (its terms are taken from 4 million bytes at a time with other texts, or from it alone);
rows and items are told apart by numbers of their own, so repeated or null ids are
rows like any other, a null doc_id after the others among equal scores, equal ids in any order; an item
without terms, or with none that a document has, gives no rows; neither do empty
tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, discard, materialize, scratch

#: What lies between terms.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a term in the first tier, and how many times as many a tier brings it to (a power of four).
FIRST, STEP = 1024, 4
#: Documents in a block, items scored at a time, different terms of items in a part, bytes of text split at a time.
BLOCK, ITEMS, PAIRS, BYTES = 16_384, 64, 200_000, 4 << 20
#: Impacts (below a million) are counted in bins of so many.
BIN_BITS = 10


def impact(tf: np.ndarray, n: np.ndarray, count: int, total: int) -> np.ndarray:
    """A posting's part of the score, from its frequency and its document's number of terms."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + (50 * n * count) // total))


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of about BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _forward(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """row, doc_id, n, terms, tfs of every document with a term: the item terms it holds (places in ``vocabulary``), and how often."""
    sent = docs.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in _slices(batch, "text"):
                split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("text"), "")), GAP)
                flat, ends = split.values, split.offsets.to_numpy()
                full = np.r_[0, np.cumsum(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))]
                n = (full[ends[1:]] - full[ends[:-1]]).astype(np.int64)
                term = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n)), np.diff(ends))[term >= 0]
                key, tf = np.unique(row * len(known) + term[term >= 0], return_counts=True)
                row, term = np.divmod(key, max(len(known), 1))
                offsets = pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(n), *lists], ["row", "doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    ids = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, f"row long, doc_id {ids}, n long, terms array<int>, tfs array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row place, n, term, tf of every posting of a batch of the forward table."""
    sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(batch.num_rows), sizes)
    term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    return at, batch.column("n").to_numpy()[at], term, tf


def _bins(forward: DataFrame, count: int, total: int) -> DataFrame:
    """term, bin, n, most: how many of a term's postings have an impact in a bin, and the highest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, term, tf = _flat(batch)
            if not len(term):
                continue
            v = impact(tf, n, count, total)
            key, own, times = np.unique((term << 20) | v, return_index=True, return_counts=True)
            v, term = v[own], key >> 20
            bins, first = np.unique((term << 20) | (v >> BIN_BITS), return_index=True)
            last = np.r_[first[1:], len(v)] - 1  # sorted by impact within a term
            sums = np.add.reduceat(times, first) if len(first) else times
            yield pa.RecordBatch.from_arrays([pa.array((bins >> 20).astype(np.int32)), pa.array((bins & 0xFFFFF).astype(np.int32)), pa.array(sums.astype(np.int64)), pa.array(v[last])], ["term", "bin", "n", "most"])

    counted = forward.select("n", "terms", "tfs").mapInArrow(run, "term int, bin int, n long, most long")
    return counted.groupBy("term", "bin").agg(F.sum("n").alias("n"), F.max("most").alias("most"))


class Tiers:
    """For each tier and term: the lowest bin in it or above, and the residual bound below it; and each term's documents."""

    def __init__(self, bins: DataFrame, terms: int):
        above = F.coalesce(F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step = STEP.bit_length() - 1
        tier = F.expr(f"(length(bin(above * {STEP} div {FIRST})) - 1) div {step}")  # 0 below FIRST, 1 below FIRST * STEP, ..
        dealt = bins.withColumn("above", above).withColumn("tier", tier.cast("int"))
        rows = dealt.groupBy("term", "tier").agg(F.min("bin").alias("low"), F.max("most").alias("most"), F.sum("n").alias("n")).toArrow()  # a few for each term
        term, tier, low, most, n = (rows[c].to_numpy() for c in ("term", "tier", "low", "most", "n"))
        self.depth = int(tier.max(initial=0)) + 1
        self.df = np.bincount(term, n, terms).astype(np.int64)
        lows = np.full((self.depth, terms), 1 << 20)
        tops = np.zeros((self.depth + 1, terms), np.int64)
        lows[tier, term], tops[tier, term] = low, most
        self.low = np.minimum.accumulate(lows)
        self.residual = np.maximum.accumulate(tops[::-1])[::-1][1:]  # of all tiers below


def tiers_of(lows: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """The tier of each posting, from the lowest bins of the tiers."""
    bins = impact >> BIN_BITS
    tier = np.zeros(len(term), np.int64)
    for low in lows[:-1]:
        tier += bins < low[term]
    return tier


def _lists(forward: DataFrame, tiers: Tiers, count: int, total: int) -> DataFrame:
    """tier, block, term, places, impacts: the inverted lists of each block, highest impact first, as arrays of 16 and 32 bits."""
    sent = forward.sparkSession.sparkContext.broadcast(tiers.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = sent.value
        for batch in batches:
            at, n, term, tf = _flat(batch)
            if not len(term):
                continue
            row = batch.column("row").to_numpy()[at]
            v = impact(tf, n, count, total)
            tier = tiers_of(lows, term, v)
            order = np.lexsort((-v, term, row // BLOCK, tier))
            keys = np.stack([tier, row // BLOCK, term])[:, order]
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)][: len(order)])
            offsets = np.r_[cuts, len(order)].astype(np.int64)
            packed = []
            for values, kind in ((row % BLOCK, "<u2"), (v, "<u4")):
                data = values[order].astype(kind)
                width = data.itemsize
                packed.append(pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer((offsets * width).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][cuts].astype(np.int32)), pa.array(keys[1][cuts]), pa.array(keys[2][cuts].astype(np.int32)), *packed], ["tier", "block", "term", "places", "impacts"])

    return forward.select("row", "n", "terms", "tfs").mapInArrow(run, "tier int, block long, term int, places binary, impacts binary")


class Items:
    """Terms and weights of the items of a part, sorted by item and term."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int):
        order = np.lexsort((term, item))
        self.item, self.term, self.weight, self.terms = item[order], term[order], weight[order], terms
        self.key = self.item * terms + self.term

    def unseen(self, residual: np.ndarray) -> np.ndarray:
        """The most that a document seen nowhere can score, for each item."""
        out = np.zeros(self.item.max() + 1, np.int64)
        np.add.at(out, self.item, self.weight * residual[self.term])
        return out


def _scored(lists: DataFrame, items: Items, chosen: np.ndarray, residual: np.ndarray, keep, schema: str) -> DataFrame:
    """What ``keep`` makes of the scores of the ``chosen`` items in each block: it gets an item, the block, the places seen, their scores so far, and the most they can reach."""
    own = np.isin(items.item, chosen)
    sent = lists.sparkSession.sparkContext.broadcast((chosen, items.item[own], items.term[own], items.weight[own], residual, items.unseen(residual)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        chosen, item, term, weight, residual, unseen = sent.value
        own = [(t, np.frombuffer(p, "<u2"), np.frombuffer(v, "<u4").astype(np.int64)) for t, p, v in zip(rows["term"].to_pylist(), rows["places"].to_pylist(), rows["impacts"].to_pylist(), strict=True)]
        found = []
        for a in range(0, len(chosen), ITEMS):
            part = chosen[a : a + ITEMS]
            inside = np.flatnonzero(np.isin(item, part))
            inside = inside[np.argsort(term[inside], kind="stable")]
            terms, place = term[inside], np.searchsorted(part, item[inside])
            low, high = np.zeros((len(part), BLOCK), np.int64), np.zeros((len(part), BLOCK), np.int64)
            for t, at, v in own:
                i, j = np.searchsorted(terms, [t, t + 1])
                for x in range(i, j):
                    w = weight[inside[x]]
                    low[place[x], at] += w * v
                    high[place[x], at] += w * (v - residual[t])
            for x, i in enumerate(part):
                seen = np.flatnonzero(low[x])
                found.append(keep(i, key[0].as_py(), seen, low[x, seen], high[x, seen] + unseen[i]))
        return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return lists.groupBy("block").applyInArrow(run, schema)


def _raised(lists: DataFrame, items: Items, left: np.ndarray, least: np.ndarray, residual: np.ndarray, k: int) -> np.ndarray:
    """For each item of ``left`` a score that ``k`` documents reach in the tiers read, or that they were known to reach before."""

    def best(i, block, seen, low, high):
        top = low if len(low) <= k else np.partition(low, -k)[-k:]
        return np.full(len(top), i), top

    found = _scored(lists, items, left, residual, best, "item long, low long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    rows = found.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("item", "low").toArrow()  # one for each item of the part
    out = least.copy()
    out[rows["item"].to_numpy()] = np.maximum(out[rows["item"].to_numpy()], rows["low"].to_numpy())
    return out


def _candidates(lists: DataFrame, items: Items, proved: np.ndarray, least: np.ndarray, residual: np.ndarray) -> DataFrame:
    """item, row: the documents that can reach the score that the item's best are known to reach."""
    sent = lists.sparkSession.sparkContext.broadcast(least)

    def near(i, block, seen, low, high):
        at = seen[high >= sent.value[i]]
        return np.full(len(at), i), block * BLOCK + at

    return _scored(lists, items, proved, residual, near, "item long, row long")


def _exact(forward: DataFrame, wanted: DataFrame, items: Items, count: int, total: int) -> DataFrame:
    """item, row, doc_id, score of the documents ``wanted`` (item, row), from their own terms."""
    sent = forward.sparkSession.sparkContext.broadcast((items.key, items.weight, items.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, weight, terms = sent.value
        for batch in batches:
            at, n, term, tf = _flat(batch)
            asked = batch.column("item").to_numpy()[at] * terms + term
            place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
            part = np.where(key[place] == asked, weight[place], 0) * impact(tf, n, count, total)
            score = np.zeros(batch.num_rows, np.int64)
            np.add.at(score, at, part)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("row"), batch.column("doc_id"), pa.array(score)], ["item", "row", "doc_id", "score"])

    ids = forward.schema["doc_id"].dataType.simpleString()
    return forward.join(wanted, "row").select("item", "row", "doc_id", "n", "terms", "tfs").mapInArrow(run, f"item long, row long, doc_id {ids}, score long")


def _search_part(docs: DataFrame, pairs: DataFrame, names: DataFrame, k: int) -> DataFrame | None:
    """item_id, rank, doc_id, score for the items of a part; ``pairs``: number and different terms of each (about PAIRS terms), ``names``: number and item_id."""
    asked = pairs.toArrow()
    numbers, words = asked["number"].to_numpy(), asked["terms"].combine_chunks()
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(numbers)), size)
    vocabulary = pc.unique(words.flatten())
    term = pc.index_in(words.flatten(), value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    with scratch():
        forward = materialize(_forward(docs, vocabulary.to_pylist()), "forward")
        count, total = forward.agg(F.count("*"), F.sum("n")).first()
        if not count:
            return None
        tiers = Tiers(_bins(forward, count, total), len(vocabulary))
        weight = np.floor(1000 * np.log((2 * count + 2) / (2 * tiers.df + 1))).astype(np.int64)
        items = Items(item, term, weight[term], len(vocabulary))
        lists = materialize(_lists(forward, tiers, count, total), "lists", partition="tier")
        spark, left, least = docs.sparkSession, np.arange(len(numbers)), np.zeros(len(numbers), np.int64)
        wanted = []
        for depth in range(tiers.depth):
            residual = tiers.residual[depth]
            needed = np.unique(items.term[np.isin(items.item, left)])
            terms = spark.createDataFrame(pa.table({"term": pa.array(needed.astype(np.int32))}))
            read = lists.where(F.col("tier") <= depth).join(F.broadcast(terms), "term", "left_semi")  # at most the terms of a part
            least = _raised(read, items, left, least, residual, k)
            proof = (items.unseen(residual) < least)[left] | (depth == tiers.depth - 1)
            if proof.any():
                wanted.append(materialize(_candidates(read, items, left[proof], least, residual), "candidates"))
            left = left[~proof]
            if not len(left):
                break
        every = wanted[0]
        for other in wanted[1:]:
            every = every.unionByName(other)
        scored = _exact(forward, every, items, count, total).where("score > 0")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        own = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(numbers))), "number": pa.array(numbers)}))
        named = ranked.join(F.broadcast(own), "item").join(names, "number")
        return materialize(named.select("item_id", "rank", "doc_id", "score"), "ranked", keep=True)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(ascii_lower(F.col("text").cast("string")), F.lit(""))
    terms = F.array_distinct(F.filter(F.split(text, GAP), lambda t: t != ""))
    asked = materialize(items.select("item_id", terms.alias("terms"), F.monotonically_increasing_id().alias("number")), "items")
    some = asked.where(F.size("terms") > 0)
    parts = -(-(some.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) // PAIRS)
    kinds = {f.name: f.dataType.simpleString() for f in (docs.schema["doc_id"], items.schema["item_id"])}
    out = spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    for n in range(parts):
        own = some.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == n)
        found = _search_part(docs, own.select("number", "terms"), asked.select("number", "item_id"), k)
        if found is not None:
            out = out.unionByName(found)
    discard(asked)
    return out
