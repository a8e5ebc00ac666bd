"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

Benchmark items are cut into segments of ``SEGMENT`` characters, one every
``STRIDE`` (the last ends with the item). A segment of m characters that occurs
in a document with at most e edits shares at least m - q + 1 - q * e character
q-grams with it, on diagonals (place in the document minus place in the segment)
at most e apart. Shared q-grams are counted in overlapping bands, each of two
steps of 2^z > e diagonals; bands that reach the bound are verified by an
alignment confined to the band. e is ``EDITS`` of the segment, less for short
segments so that the bound stays above zero.

Text is compared in lower case with runs of white space as one space. Items with
fewer than ``LEAST`` characters leave the lemma no edits to speak of; they are
found as exact strings that are not part of a longer word.

Bounds: equal segments of all items are one; q-grams that many segments share
are left out where a segment's bound allows it (it then needs as many fewer);
occurrences are counted window by window of diagonals, ``AT_ONCE`` at a time. The
documents pass once per part of the benchmark: a part has at most ``PART_CHARS``
characters of segments, and an item longer than ``PIECE`` is searched in pieces
that overlap by a segment, so what is broadcast is bounded whatever the benchmark
holds. Documents are not shuffled; with several parts they are written once with
row numbers, and only what was found is brought together by them.

Defined cases: null and empty texts have no matches; very long texts are searched
whole (memory grows with the longest text alone); items null, empty or of white
space alone are not searched for; a null item_id is an id like any other; items
with equal ids are one item; an item found in several places of a document is
reported once, with the span from its first to its last matched segment of the
longest run (ties: fewest edits, then the first); repeated rows are reported
each; empty tables give no rows; other columns are ignored by ``contaminated`` and
kept by ``annotate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

Q, SEGMENT, STRIDE, LEAST, EDITS = 8, 100, 25, 24, 0.08
#: Characters of segments in a part, and of an item in a piece.
PART_CHARS, PIECE = 4_000_000, 16_384
#: Characters of documents searched at a time; a longer document is searched whole, in pieces of the hashing only.
BLOCK = 1 << 20
#: Occurrences of q-grams counted at a time, and alignments made at a time.
AT_ONCE, ALIGNED = 1 << 21, 2000
#: A q-gram of more segments is left out of those that have so much of their bound to spare.
HOT, SPARE = 64, 1
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Stands between texts (no character), so often that no match can span two texts and none's end is as far as the next text.
GAP, BETWEEN = 0x110000, SEGMENT
_SPACE = "[\\x09-\\x0D\\x20\\u00A0]+"


def normal(text: str) -> np.ndarray:
    """Characters of the compared form."""
    c = _lower(text)
    return np.where(_space(c), np.uint32(32), c)[_kept(c)]


def places(text: str) -> np.ndarray:
    """Where in ``text`` each character of the compared form is."""
    return np.flatnonzero(_kept(_lower(text)))


def _lower(text: str) -> np.ndarray:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(y if len(y := x.lower()) == 1 else x for x in text)
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")


def _space(c: np.ndarray) -> np.ndarray:
    return ((c >= 9) & (c <= 13)) | (c == 32) | (c == 0xA0)


def _kept(c: np.ndarray) -> np.ndarray:
    space = _space(c)
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return keep


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each place."""
    h = c.astype(np.uint64)
    for i, k in enumerate(_K):
        step = 1 << i
        if len(h) <= step:
            return h[:0]
        h = (h[:-step] * k) ^ (h[step:] + (h[:-step] >> np.uint64(31)))
    return h


def build(items: list[tuple]) -> dict:
    """Item ids, arrays of the distinct segments of (item_id, text) items, and of the short items: what is broadcast."""
    numbers: dict = {}
    own: dict[bytes, dict[int, None]] = {}
    short: dict[bytes, dict[int, None]] = {}
    for name, text in items:
        key = numbers.setdefault(name, len(numbers))
        c = normal(text.strip(" \t\n\v\f\r\xa0"))
        if 0 < len(c) < LEAST:
            short.setdefault(c.tobytes(), {})[key] = None
        elif len(c):
            for s in sorted({*range(0, max(1, len(c) - SEGMENT + 1), STRIDE), max(0, len(c) - SEGMENT)}):
                own.setdefault(c[s : s + SEGMENT].tobytes(), {})[key] = None
    return {"ids": list(numbers)} | _listed("seg", own) | _listed("short", short)


def _listed(name: str, strings: dict[bytes, dict[int, None]]) -> dict[str, np.ndarray]:
    """Strings of characters end to end, and the items that have each."""
    return {
        f"{name}_chars": np.frombuffer(b"".join(strings), np.uint32),
        f"{name}_size": np.array([len(x) // 4 for x in strings], np.int64),
        f"{name}_items": np.array([k for x in strings.values() for k in x], np.int64),
        f"{name}_item_n": np.array([len(x) for x in strings.values()], np.int64),
    }


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


class SegmentIndex:
    """The q-grams of a benchmark part, and each segment's bound. Built from plain arrays, where it is used."""

    def __init__(self, parts: dict):
        self.size, self.items, self.item_at = parts["seg_size"], parts["seg_items"], _starts(parts["seg_item_n"])
        cuts = np.cumsum(self.size)[:-1]
        self.chars = np.split(parts["seg_chars"], cuts) if len(self.size) else []
        self.edits = np.minimum((EDITS * self.size).astype(np.int64), (self.size - Q + 1 - 6) // Q)
        self.bound = self.size - Q + 1 - Q * self.edits
        self.shift = max(1, int(self.edits.max(initial=0)).bit_length())
        grams = [gram_hashes(x) for x in self.chars]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        n = np.array([len(g) for g in grams], np.int64)
        seg = np.repeat(np.arange(len(grams)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        _, of, freq = np.unique(flat, return_inverse=True, return_counts=True)
        hot = freq[of] > HOT
        n_hot = np.bincount(seg[hot], minlength=len(grams))
        spared = n_hot + SPARE <= self.bound
        self.bound = self.bound - np.where(spared, n_hot, 0)
        keep = ~(hot & spared[seg]) if len(flat) else hot
        flat, seg, place = flat[keep], seg[keep], place[keep]
        order = np.argsort(flat, kind="stable")
        self.seg, self.place = seg[order], place[order]
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.r_[first, len(flat)]
        self.bits = max(12, min(26, int(len(self.grams) * 16).bit_length()))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True
        self.short_size, self.short_items, self.short_at = parts["short_size"], parts["short_items"], _starts(parts["short_item_n"])
        self.short_chars = np.split(parts["short_chars"], np.cumsum(self.short_size)[:-1]) if len(self.short_size) else []
        self.short_hash = np.array([_running(x, len(x))[-1][0] for x in self.short_chars], np.uint64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _K[0]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _shared(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``c`` whose q-gram some segment has, and the q-gram's number."""
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(c) if len(self.grams) else 0, BLOCK):
            h = gram_hashes(c[a : a + BLOCK + Q - 1])
            at = np.flatnonzero(self.seen[self._slot(h)])
            k = np.searchsorted(self.grams, h[at])
            good = self.grams[np.minimum(k, len(self.grams) - 1)] == h[at]
            where.append(at[good] + a)
            which.append(k[good])
        return np.concatenate(where), np.concatenate(which)

    def bands(self, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segment, band) pairs over the text ``c`` that reach the segment's bound, window by window of bands."""
        at, k = self._shared(c)
        upto = _starts(self.first[k + 1] - self.first[k]) if len(k) else np.zeros(1, np.int64)
        offset, s = SEGMENT << 1, self.shift
        i, done = 0, -1
        while i < len(at):
            low = max(done + 1, int(at[i] - SEGMENT + offset) >> s)
            j = int(np.searchsorted(upto, upto[i] + AT_ONCE, "right")) - 1
            high = (int(at[-1]) + offset >> s) + 1 if j >= len(at) else max(low + 1, (int(at[min(j, len(at) - 1)]) - SEGMENT + offset >> s) - 1)
            # Bands low .. high - 1 are decided here; they need the counts of band ``high`` too.
            j = int(np.searchsorted(at, ((high + 1) << s) - offset + SEGMENT))
            yield from self._decided(at, k, i, j, low, high)
            done = high - 1
            i = int(np.searchsorted(at, (high << s) - offset))

    def _decided(self, at: np.ndarray, k: np.ndarray, i: int, j: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = self.first[k[i:j] + 1] - self.first[k[i:j]]
        upto, begin = np.cumsum(n), self.first[k[i:j]]
        for a in range(0, int(upto[-1]) if j > i else 0, AT_ONCE):
            row = np.arange(a, min(a + AT_ONCE, int(upto[-1])))
            own = np.searchsorted(upto, row, "right")
            occurrence = begin[own] + row - (upto[own] - n[own])
            band = (at[i + own] - self.place[occurrence] + (SEGMENT << 1)) >> self.shift
            inside = (band >= low) & (band <= high)
            one, m = np.unique((self.seg[occurrence[inside]] << 40) | band[inside], return_counts=True)
            if len(key):
                one, back = np.unique(np.concatenate([key, one]), return_inverse=True)
                m = np.bincount(back, np.concatenate([count, m]), len(one)).astype(np.int64)
            key, count = one, m
        if len(key):
            after = np.zeros(len(key), np.int64)
            after[:-1] = np.where(key[1:] == key[:-1] + 1, count[1:], 0)
            seg, band = key >> 40, key & ((1 << 40) - 1)
            enough = (count + after >= self.bound[seg]) & (band < high)
            if enough.any():
                yield seg[enough], band[enough]

    def verify(self, c: np.ndarray, seg: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits of each candidate inside its band, and where the match starts and ends in ``c``."""
        edits, start, end = (np.full(len(seg), GAP, np.int64) for _ in range(3))
        for m in np.unique(self.size[seg]):
            for e in np.unique(self.edits[seg[self.size[seg] == m]]):
                own = np.flatnonzero((self.size[seg] == m) & (self.edits[seg] == e))
                for part in np.array_split(own, -(-len(own) // ALIGNED)):
                    edits[part], start[part], end[part] = self._align(c, np.stack([self.chars[s] for s in seg[part]]), (band[part] << self.shift) - (SEGMENT << 1) - e, (2 << self.shift) + 2 * int(e) + 1)
        return edits, start, end

    @staticmethod
    def _align(c: np.ndarray, pattern: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``pattern`` against ``c`` on the diagonals low .. low + width - 1: cost, start, end (start and end are free)."""
        n, m = pattern.shape
        j = np.arange(width)
        scale = 1 << 20  # cost and the diagonal on which the path began, in one number
        row = np.broadcast_to(j, (n, width)).astype(np.int64)
        for i in range(m):
            at = low[:, None] + i + j
            letter = np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], GAP)
            new = row + scale * (letter != pattern[:, i : i + 1])
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + scale)
            row = np.minimum.accumulate(new - scale * j, axis=1) + scale * j
        best = row.argmin(axis=1)
        value = row[np.arange(n), best]
        return value // scale, low + value % scale, low + m + best

    def search(self, text: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text number, item, matched segments, edits, start, end) in the joined ``text``; firsts: where each text begins."""
        out: list[tuple[int, int, int, int, int, int]] = []
        if not len(text):
            return out
        hits = [(s[good], e[good], a[good], b[good]) for s, band in self.bands(text) for e, a, b in [self.verify(text, s, band)] for good in [e <= self.edits[s]]]
        if hits:
            seg, edits, start, end = map(np.concatenate, zip(*hits, strict=True))
            doc = np.searchsorted(firsts, end - 1, "right") - 1  # a start can lie before the text
            order = np.lexsort((edits, end, start, seg, doc))
            seg, edits, start, end, doc = (x[order] for x in (seg, edits, start, end, doc))
            cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                out += [(int(doc[a]), *x) for x in self._items(seg[a:b], edits[a:b], start[a:b], end[a:b])]
        return out + self._short(text, firsts)

    def _items(self, seg: np.ndarray, edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """For each item with a segment among the matches of one text (sorted by segment): its longest run."""
        cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True])
        of: dict[int, list[slice]] = {}
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            for item in self.items[self.item_at[seg[a]] : self.item_at[seg[a] + 1]].tolist():
                of.setdefault(item, []).append(slice(a, b))
        for item, own in sorted(of.items()):
            cols = [np.concatenate([x[s] for s in own]) for x in (seg, edits, start, end)]
            yield item, *self._longest(*cols)

    @staticmethod
    def _longest(seg: np.ndarray, edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, int]:
        """The run of overlapping matches with the most segments: segments, edits, start, end."""
        order = np.lexsort((seg, end, start))
        seg, edits, start, end = seg[order], edits[order], start[order], end[order]
        reach = np.maximum.accumulate(end)
        run = np.cumsum(np.r_[False, start[1:] > reach[:-1]])
        order = np.lexsort((edits, seg, run))  # one match of each segment and run: that of fewest edits
        one = order[np.r_[True, (seg[order][1:] != seg[order][:-1]) | (run[order][1:] != run[order][:-1])]]
        n, total = np.bincount(run[one]), np.bincount(run[one], edits[one]).astype(np.int64)
        best = int(np.lexsort((total, -n))[0])
        mine = run == best
        return int(n[best]), int(total[best]), int(start[mine][0]), int(end[mine].max())

    def _short(self, text: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """Short items as exact strings, not inside a longer word; the first place in each text."""
        out = []
        if not len(self.short_hash):
            return out
        for m, h in enumerate(_running(text, int(self.short_size.max())), 1):
            for k in np.flatnonzero(self.short_size == m).tolist():
                own = self.short_chars[k]
                at = np.flatnonzero(h == self.short_hash[k])
                at = at[[bool((text[x : x + m] == own).all()) and not self._inside(text, x, m) for x in at.tolist()]] if len(at) else at
                doc, first = np.unique(np.searchsorted(firsts, at, "right") - 1, return_index=True)
                for d, a in zip(doc.tolist(), at[first].tolist(), strict=True):
                    out += [(d, item, 1, 0, a, a + m) for item in self.short_items[self.short_at[k] : self.short_at[k + 1]].tolist()]
        return out

    @staticmethod
    def _inside(text: np.ndarray, a: int, m: int) -> bool:
        """Whether text[a:a + m] continues a word to the left or right."""
        word = lambda i: 0 <= i < len(text) and text[i] < GAP and chr(int(text[i])).isalnum()
        return (word(a) and word(a - 1)) or (word(a + m - 1) and word(a + m))


def _running(c: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the strings of 1, 2, .. ``most`` characters at each place."""
    out = []
    h = np.zeros(len(c), np.uint64)
    for m in range(1, min(most, len(c)) + 1):
        h = (h[: len(c) - m + 1] ^ c[m - 1 :]) * _K[0]
        h = h ^ (h >> np.uint64(29))
        out.append(h)
    return out


def _parts(benchmark: DataFrame) -> list[Callable[[], list[tuple]]]:
    """What reads the pieces (item_id, text) of each part of the benchmark."""
    text = F.regexp_replace(F.col("text").cast("string"), _SPACE, " ")
    items = benchmark.select("item_id", text.alias("text")).where("text is not null")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - SEGMENT - 1), F.lit(PIECE - SEGMENT))
    cut = items.select("item_id", "text", F.explode(starts).alias("at")).select("item_id", F.substring(F.col("text"), F.col("at") + 1, F.lit(PIECE)).alias("text")).distinct()
    cost = F.length("text") * F.lit(-(-SEGMENT // STRIDE) + 1)
    total = cut.agg(F.sum(cost)).first()[0] or 0
    n = max(1, -(-2 * total // PART_CHARS))
    while True:  # the hash may crowd a part
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        heaviest = cut.groupBy(part.alias("part")).agg(F.sum(cost).alias("c")).agg(F.max("c")).first()[0] or 0
        if heaviest <= max(PART_CHARS, PIECE * 8):
            break
        n *= 2
    return [lambda i=i: [(r.item_id, r.text) for r in cut.where(part == i).collect()] for i in range(n)]


def _apply(frame: DataFrame, name: str, parts: dict) -> DataFrame:
    """The matches of one part of the benchmark in the column ``name``, which is the last, behind the text."""
    shared = frame.sparkSession.sparkContext.broadcast(parts)  # plain data: executors need not have this package

    def flush(index: SegmentIndex, ids: list, rows: list[int], texts: list[str], found: list[list[dict]]) -> None:
        gap = np.full(BETWEEN, GAP, np.uint32)
        own = [normal(t) for t in texts]
        firsts = np.cumsum([0] + [len(c) + BETWEEN for c in own])[:-1]
        joined = np.concatenate([x for c in own for x in (c, gap)])
        where: dict[int, np.ndarray] = {}
        for k, item, n, edits, a, b in index.search(joined, firsts):
            if k not in where:
                where[k] = places(texts[k])
            at = where[k]
            a, b = max(0, a - firsts[k]), max(1, min(len(at), b - firsts[k]))
            found[rows[k]].append({"item_id": ids[item], "segments": n, "edits": edits, "start": int(at[a]), "end": int(at[b - 1]) + 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = SegmentIndex(shared.value), shared.value["ids"]
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            rows, texts, size = [], [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                if text:
                    rows.append(i)
                    texts.append(text)
                    size += len(text)
                if size >= BLOCK:
                    flush(index, ids, rows, texts, found)
                    rows, texts, size = [], [], 0
            if texts:
                flush(index, ids, rows, texts, found)
            last = pa.array(found, batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], last], batch.schema.names)

    return frame.mapInArrow(run, frame.schema)


def annotate(docs: DataFrame, benchmark: DataFrame, name: str = "contamination") -> DataFrame:
    """``docs`` with a new column ``name``: array of (item_id, segments, edits, start, end) found in its text."""
    text, kind = fresh(docs, "text_"), benchmark.schema["item_id"].dataType.simpleString()
    empty = F.lit(None).cast(f"array<struct<item_id:{kind},segments:long,edits:long,start:long,end:long>>")
    frame, parts = docs.withColumn(text, F.col("text").cast("string")), _parts(benchmark)
    if len(parts) == 1:
        return _apply(frame.withColumn(name, empty), name, build(parts[0]())).drop(text)
    row = fresh(frame, "row_")
    frame = materialize(frame.withColumn(row, F.monotonically_increasing_id()), "numbered_documents")
    each = [_apply(frame.select(row, text).withColumn(name, empty), name, build(part())).select(row, F.explode(name).alias("m")) for part in parts]
    better = F.struct(-F.col("m.segments"), F.col("m.edits"), F.col("m.start"))
    best = reduce(DataFrame.unionByName, each).groupBy(row, "m.item_id").agg(F.min_by("m", better).alias("m"))
    found = materialize(best.groupBy(row).agg(F.collect_list("m").alias(name)), "contaminated_rows")
    return frame.join(found, row, "left").select(*docs.columns, F.coalesce(name, F.array().cast(found.schema[name].dataType)).alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and benchmark item found in it: doc_id, item_id, segments, edits, start, end (code points)."""
    found = annotate(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("contamination").alias("m")).select("doc_id", "m.*")
