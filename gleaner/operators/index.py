"""Search from written tables: keyword postings, trigram lists, names, and texts, in immutable segments.

A segment is written once and never changed:

- ``texts`` by place: the documents as they came, with their number of tokens. Places number
  them densely within a written file, whatever their doc_ids are.
- ``names`` by doc_id: the narrow columns, each with its place.
- ``postings``, and ``positions`` for phrases: a row for each term and some millions of neighbouring terms, by term among these.
  Documents are counted and their terms sorted where the texts lie, so no posting is ever exchanged; a query reads a small page of each such run.
- ``bases`` by place: the different file names, in lower case, and ``named`` by their place: the documents of each.
- ``grams`` (of texts) and ``base_grams`` (of file names) by trigram: for each trigram and lot of 65,536 places one list, as 16-bit
  distances or, where that is longer, as a bitmap; ``n`` is its length.
- ``gone``: doc_ids that the segment removes.

The index is the list of its segments, a small table behind an atomic pointer: a
reader has the old list or the new one. ``upsert`` writes the changed
documents into a segment of their own and touches no other; of several versions
of a doc_id the one in the newest segment counts, and a removed one counts no more. Segments
of like size are merged when there are ``FAN`` of them, so that there are few, and a document is
rewritten a logarithmic number of times. Rows without doc_id are never replaced.

A query reads the pages of its terms. An exact search reads the lengths of
its trigrams' lists first, then lists from the rarest on, and leaves
out those that would cost more than checking the texts they could rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.sources.shared import together

from . import fulltext, maintenance
from .search import keyword_by_postings, path, path_terms, top

#: Places whose lists share a row, candidates that are looked up by their places, and how many times as long as the rarest list another may be to be read.
LOT, LOOKED_UP, WORTH = 1 << 16, 2000, 64
#: Documents of a segment of the lowest level, and segments of a level before they are merged.
LEAST, FAN = 1000, 4
NARROW = ("doc_id", "path", "lang", "size", "mtime", "n_lines", "is_dir")
#: Bytes of text whose trigrams are grouped at a time, and terms of the texts whose trigrams share a file.
BYTES, TERMS = 4 << 20, 4 << 20


def trigrams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as one number of three code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def encode(places: np.ndarray) -> bytes:
    """Sorted places of a lot: 16-bit distances, or a bitmap where that is shorter."""
    if 2 * len(places) < LOT // 8:
        return np.diff(places, prepend=0).astype("<u2").tobytes()
    bits = np.zeros(LOT, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def decode(data: bytes) -> np.ndarray:
    if len(data) < LOT // 8:
        return np.cumsum(np.frombuffer(data, "<u2").astype(np.int64))
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


def intersect(lists: list[tuple[int, bytes]]) -> np.ndarray:
    """Places that all lists (length, data) of a lot hold, from the shortest on; a bitmap is only asked about what is left."""
    left = None
    for _, data in sorted(lists, key=lambda x: x[0]):
        if left is None:
            left = decode(data)
        elif len(data) < LOT // 8:
            left = left[np.isin(left, decode(data), assume_unique=True)]
        else:
            left = left[(np.frombuffer(data, np.uint8)[left >> 3] >> (7 - (left & 7)) & 1) > 0]
    return left


def gram_parts(texts: DataFrame) -> DataFrame:
    """gram, lot, places: the sorted 16-bit places of a trigram among some neighbouring texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts = batch.column("place").to_numpy(), batch.column("text")
            at = 0
            while at < len(texts):
                own, size, stop = [], 0, at
                while stop < len(texts) and size < BYTES:
                    text = texts[stop].as_py() or ""  # one at a time
                    own.append(trigrams(text))
                    size, stop = size + len(text), stop + 1
                place = np.repeat(places[at:stop], [len(x) for x in own])
                gram = np.concatenate(own)
                order = np.lexsort((place, gram))
                gram, place = gram[order], place[order]
                lot = place // LOT
                cuts = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (lot[1:] != lot[:-1])][: len(gram)])
                ends = (np.r_[cuts, len(gram)] * 2).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer((place % LOT).astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(gram[cuts]), pa.array(lot[cuts]), data], ["gram", "lot", "places"])
                at = stop

    return texts.select("place", "text").mapInArrow(run, "gram long, lot long, places binary")


def gram_lists(parts: DataFrame) -> DataFrame:
    """gram, lot, n, docs: the encoded list of each trigram and lot, from parts that lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: list[tuple[tuple[int, int], list[bytes]]]) -> pa.RecordBatch:
            whole = [np.sort(np.frombuffer(b"".join(p), "<u2")).astype(np.int64) for _, p in rows]  # at most LOT places
            keys = [pa.array([k[i] for k, _ in rows], pa.int64()) for i in range(2)]
            return pa.RecordBatch.from_arrays([*keys, pa.array([len(w) for w in whole], pa.int64()), pa.array([encode(w) for w in whole], pa.binary())], ["gram", "lot", "n", "docs"])

        open_: list[tuple[tuple[int, int], list[bytes]]] = []  # the last list, which the next batch may continue
        for batch in batches:
            gram, lot, places = (batch.column(c) for c in ("gram", "lot", "places"))
            for key, part in zip(zip(gram.to_pylist(), lot.to_pylist(), strict=True), places.to_pylist(), strict=True):
                if open_ and open_[-1][0] == key:
                    open_[-1][1].append(part)
                else:
                    open_.append((key, [part]))
            if len(open_) > 1:
                yield lists(open_[:-1])
                open_ = open_[-1:]
        if open_:
            yield lists(open_)

    return parts.mapInArrow(run, "gram long, lot long, n long, docs binary")


@dataclass(frozen=True)
class Segment:
    """Number (the newest is highest), folder name, documents."""

    number: int
    name: str
    docs: int

    @property
    def level(self) -> int:
        return max(0, int(math.log(max(self.docs, 1) / LEAST, FAN)) + 1) if self.docs > LEAST else 0


def merge_from(segments: list[Segment]) -> int | None:
    """Where the newest segments to be merged begin: FAN or more in a row that are of some level or below."""
    for level in sorted({s.level for s in segments}):
        tail = len(segments)
        while tail and segments[tail - 1].level <= level:
            tail -= 1
        if len(segments) - tail >= FAN:
            return tail
    return None


def _write_lists(texts: DataFrame, folder: str, files: int) -> None:
    """The lists of the trigrams of ``texts`` (place, text)."""
    dealt = gram_parts(texts).repartition(files, "gram", "lot").sortWithinPartitions("gram", "lot")
    gram_lists(dealt).write.parquet(folder)


def write_segment(docs: DataFrame, folder: str, gone: DataFrame | None = None) -> Segment:
    """Write the tables of ``docs`` below ``folder``; not part of the index before a list names it."""
    spark, name = docs.sparkSession, maintenance.fresh_name()
    own = f"{folder}/{name}"
    dl = F.coalesce(F.regexp_count("text", F.lit(X.fixed.TOKEN)), F.lit(0)).cast("long").alias("dl")
    words = F.coalesce(F.size(fulltext.terms_of(F.col("text"))), F.lit(0)).cast("long").alias("words")
    docs.select(F.monotonically_increasing_id().alias("place"), *NARROW, dl, words, "text").write.parquet(f"{own}/texts")
    texts = spark.read.parquet(f"{own}/texts")
    n, words = texts.agg(F.count("*"), F.coalesce(F.sum(F.greatest("dl", "words")), F.lit(0))).first()
    files = 1 + words // TERMS

    def names() -> None:
        by_id = texts.select("place", *NARROW, "dl", "words").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        by_id.write.parquet(f"{own}/names")
        every = spark.read.parquet(f"{own}/names")
        named = every.select(F.lower(X.base_name(F.col("path"))).alias("base"), "doc_id", "is_dir").where("base is not null")
        named.select("base").distinct().select(F.monotonically_increasing_id().alias("place"), F.col("base").alias("text")).write.parquet(f"{own}/bases")
        bases = spark.read.parquet(f"{own}/bases")
        _write_lists(bases, f"{own}/base_grams", 1 + n // TERMS)
        named.join(bases.withColumnRenamed("text", "base"), "base").repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{own}/named")

    def by_term(parts: DataFrame, table: str) -> None:
        parts.write.option("parquet.page.row.count.limit", fulltext.PAGE).parquet(f"{own}/{table}")

    removed = (gone if gone is not None else docs.limit(0)).select("doc_id")
    together(
        names, lambda: by_term(fulltext.posting_parts(texts, X.tokens(F.col("text"))), "postings"), lambda: by_term(fulltext.posting_parts(texts, fulltext.terms_of(F.col("text")), True), "positions"),
        lambda: _write_lists(texts, f"{own}/grams", files), lambda: removed.write.parquet(f"{own}/gone"),
    )
    return Segment(0, name, n)


class SearchIndex:
    """Reads the index in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/{maintenance.current_name(spark, folder)}").orderBy("number").collect()  # a few
        self.segments = [Segment(r.number, r.name, r.docs) for r in rows if r.name]
        self.n, tokens, words = next((r.docs, r.tokens, r.words) for r in rows if not r.name)
        self.avgdl, self.mean_words = (tokens / self.n, words / self.n) if self.n else (0.0, 0.0)

    @classmethod
    def write(cls, docs: DataFrame, folder: str) -> SearchIndex:
        """Build the index of ``docs`` in ``folder`` anew: one segment."""
        own = write_segment(docs, folder)
        return cls._publish(docs.sparkSession, folder, [own] if own.docs else [])

    @classmethod
    def _publish(cls, spark: SparkSession, folder: str, segments: list[Segment]) -> SearchIndex:
        """Point ``folder`` at a new list of segments, with the totals of the documents that count."""
        numbered = [Segment(i + 1, s.name, s.docs) for i, s in enumerate(segments)]
        own = object.__new__(cls)
        own.spark, own.folder, own.segments = spark, folder, numbered
        totals = own.names.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("dl", "words"))).first()
        name = maintenance.fresh_name()
        rows = [(0, "", *totals), *((s.number, s.name, s.docs, 0, 0) for s in numbered)]
        spark.createDataFrame(rows, "number int, name string, docs long, tokens long, words long").coalesce(1).write.parquet(f"{folder}/{name}")
        maintenance.point(spark, folder, name)
        return cls(spark, folder)

    def upsert(self, docs: DataFrame, gone: DataFrame | None = None) -> SearchIndex:
        """The index with ``docs`` (one row a doc_id) in place of what it has of them and without those of ``gone`` (doc_id): one new segment, and merges that are due."""
        new = write_segment(docs, self.folder, gone)
        segments = [*self.segments, Segment(self.segments[-1].number + 1 if self.segments else 1, new.name, new.docs)]
        out = self._publish(self.spark, self.folder, segments)
        while (start := merge_from(out.segments)) is not None:
            out = out._merged(start)
        return out

    def _merged(self, start: int) -> SearchIndex:
        """The segments from ``start`` on as one."""
        old, tail = self.segments[:start], self.segments[start:]
        live = reduce(DataFrame.unionByName, (self._live(self._read(s, "texts"), s) for s in tail))
        gone = None
        if old:  # what older segments hold stays removed
            ids = reduce(DataFrame.unionByName, (self._read(s, "gone") for s in tail)).distinct()
            gone = ids.join(live.select("doc_id"), "doc_id", "left_anti")
        return self._publish(self.spark, self.folder, [*old, write_segment(live, self.folder, gone)])

    def vacuum(self) -> int:
        """Remove the folders of segments and lists that the index no longer names; how many. Only when nobody reads an older list."""
        keep = {maintenance.current_name(self.spark, self.folder), *(s.name for s in self.segments)}
        return maintenance.vacuum(self.spark, self.folder, keep)

    def _read(self, s: Segment, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{s.name}/{table}")

    def _live(self, rows: DataFrame, s: Segment) -> DataFrame:
        """``rows`` of a segment whose doc_id no newer segment has or removes."""
        newer = [self._read(x, t).select("doc_id") for x in self.segments if x.number > s.number for t in ("names", "gone")]
        return rows.join(reduce(DataFrame.unionByName, newer), "doc_id", "left_anti") if newer else rows

    def _all(self, table: str, schema: str, keep=lambda rows: rows) -> DataFrame:
        if not self.segments:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, (self._live(keep(self._read(s, table)), s) for s in self.segments))

    @property
    def names(self) -> DataFrame:
        return self._all("names", "place long, doc_id long, path string, lang string, size long, mtime double, n_lines int, is_dir boolean, dl long, words long")

    @property
    def texts(self) -> DataFrame:
        return self._all("texts", "place long, doc_id long, text string", lambda t: t.select("place", "doc_id", "text"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, doc_id, tf, dl of the documents with these terms (all, if none are named)."""
        return self._all("postings", "term string, doc_id long, tf long, dl long", lambda t: fulltext.postings_of(t if terms is None else t.where(F.col("term").isin(terms))))

    def keyword(self, query: str, limit: int = 40, variant: str = "plain") -> DataFrame:
        import re

        terms = sorted({w.lower() for w in re.findall(X.fixed.TOKEN, query)})
        return keyword_by_postings(self.postings(terms), self.n, self.avgdl, query, limit, variant)

    def phrases(self, query: str, limit: int = 40) -> DataFrame:
        """As fulltext.phrase_search."""
        terms = sorted({t for p in fulltext.phrases_of(query) for t in p})
        hits = self._all("positions", "term string, doc_id long, words long, places array<int>", lambda t: fulltext.positions_of(t.where(F.col("term").isin(terms))))
        return fulltext.phrase_search(hits, self.n, self.mean_words, query, limit)

    def _places(self, s: Segment, grams: list[int], table: str = "grams") -> list[int] | DataFrame | None:
        """Places of a segment whose texts (or names) may hold all ``grams``: a list if they are few, or a table; none if there are none."""
        lists = self._read(s, table)
        sizes = {r.gram: r.n for r in lists.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return None
        rarest = min(sizes.values())
        chosen = [g for g in grams if sizes[g] <= WORTH * rarest]
        found = lists.where(F.col("gram").isin(chosen)).select("gram", "lot", "n", "docs")
        if rarest <= LOOKED_UP:  # so all lists read together have at most WORTH * LOOKED_UP places each
            by_lot: dict[int, list] = {}
            for r in found.collect():
                by_lot.setdefault(r.lot, []).append((r.n, bytes(r.docs)))
            return [lot * LOT + int(x) for lot, own in by_lot.items() if len(own) == len(chosen) for x in intersect(own)]
        count = len(chosen)

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            own = list(zip(rows["n"].to_pylist(), rows["docs"].to_pylist(), strict=True))
            places = intersect(own) if len(own) == count else np.zeros(0, np.int64)
            return pa.table({"place": pa.array(key[0].as_py() * LOT + places, pa.int64())})

        return found.groupBy("lot").applyInArrow(run, "place long")

    def exact(self, literal: str, limit: int = 40) -> DataFrame:
        """As search.exact, verified on the texts of the documents that may hold the literal by its trigrams."""
        grams = trigrams(literal).tolist()
        if not grams:
            return _counted(self.texts if len(literal) == 2 else self.texts.limit(0), literal, limit)
        parts = []
        for s in self.segments:
            places = self._places(s, grams)
            if places is None:
                continue
            texts = self._read(s, "texts").select("place", "doc_id", "text")
            near = texts.where(F.col("place").isin(places)) if isinstance(places, list) else texts.join(places, "place", "left_semi")
            parts.append(self._live(near.where(F.col("text").contains(literal)), s))
        return _counted(reduce(DataFrame.unionByName, parts) if parts else self.texts.limit(0), literal, limit)

    def path(self, query: str, limit: int = 40) -> DataFrame:
        """As search.path, from the different names that may hold a term; a term of two characters is looked for in all of them."""
        terms = path_terms(query)
        parts = [self.spark.createDataFrame([], "doc_id long, path string, is_dir boolean")]
        for s in self.segments:
            bases, named = self._read(s, "bases"), self._read(s, "named")
            for t in terms:
                grams = trigrams(t).tolist()
                places = self._places(s, grams, "base_grams") if grams else bases.where(F.col("text").contains(t)).select("place")
                if places is None:
                    continue
                chosen = [df.where(F.col("place").isin(places)) if isinstance(places, list) else df.join(places, "place", "left_semi") for df in (named, bases)]
                rows = chosen[0].join(chosen[1].where(F.col("text").contains(t)), "place").select("doc_id", F.col("text").alias("path"), "is_dir")
                parts.append(self._live(rows, s).select("doc_id", "path", "is_dir"))
        return path(reduce(DataFrame.unionByName, parts).distinct(), query, limit)

    def documents(self, ids: list[int]) -> DataFrame:
        """The documents of a list of ids, by pruned reads."""
        parts = []
        for s in self.segments:
            live = self._live(self._read(s, "names").where(F.col("doc_id").isin(ids)), s)
            places = [r.place for r in live.select("place").collect()]  # of the ids asked for
            if places:
                parts.append(self._read(s, "texts").where(F.col("place").isin(places)))
        return reduce(DataFrame.unionByName, parts) if parts else self.names.withColumn("text", F.lit(None).cast("string")).limit(0)


def _counted(texts: DataFrame, literal: str, limit: int) -> DataFrame:
    found = texts.where(F.col("text").contains(literal)).select("doc_id", X.occurrences(F.col("text"), literal).alias("score"), F.length("text").alias("n"))
    return top(found, F.desc("score"), F.asc("n"), F.asc("doc_id"), limit=limit).select("doc_id", "score")
