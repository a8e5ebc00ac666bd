"""Personal data: fixed formats seed contextual patterns that discover further identifiers.

1. Emails, ip addresses, card and phone numbers in fixed formats are the seeds.
2. Every seed and every other identifier-like string is an instance; the words
   around it (one before, two before, one on either side) are its patterns.
   Spark counts the pattern-instance graph once for each distinct pair.
3. Rounds of scoring: a pattern's confidence for a kind is the mean confidence of
   its instances, smoothed by one unknown instance. It is accepted at ``ACCEPT``
   confidence and ``SUPPORT`` distinct instances that are themselves confident
   (seeds, or discovered before), and keeps the confidence it was accepted with.
   An instance that is no seed takes the best confidence of its accepted
   patterns, if its characters suit the kind. The rounds end when none is new.
4. Strings that follow an accepted pattern, suit its kind and overlap no seed are
   added; the most specific pattern decides.

Only the graph is shuffled, not the texts; instances are told apart by a 64-bit
hash, so none is long. A hot pattern or instance is a combining aggregate; its
scores return through joins between plain exchanges. Up to ``PART`` accepted
patterns are broadcast; more are joined to the contexts of the documents' strings
by key, and what was found comes back by row number.

Formats are matched in time proportional to the text, however long a run of
letters or digits in it is.

Defined cases: null texts count as empty; repeated rows are found alike and do
not raise confidence; an empty table gives an empty result; other columns are
kept by ``annotate`` and ``redact``, whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fresh, materialize

KINDS = ("email", "ip", "card", "phone")
ACCEPT, SUPPORT, PART = 0.75, 5, 100_000
SPAN = "array<struct<kind:int,start:int,end:int>>"
# Fixed formats of the seeds. An address is what ends in LOCAL before an @, and DOMAIN behind it; an ip is four parts of a chain.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TELLTALE = re.compile(r"[0-9@]|\x20?[(\[]at[)\]]")
_NUMBER = re.compile(r"[+(]?[0-9][\x20().0-9/-]*[0-9]")
_HANDLE = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]+)*")
_SPELLED = re.compile(r"\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]+)*")
_CODE = re.compile(r"[A-Za-z0-9._%+@-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlap: each @ is looked at once, with the run of characters before it."""
    done, p = 0, text.find("@")
    while p >= 0:
        left = done + len(text[done:p].rstrip(LOCAL))
        m = DOMAIN.match(text, p + 1) if left < p else None
        if m:
            yield left, m.end()
        done = m.end() if m else p + 1
        p = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost runs of four numbers between dots, without overlap, whose numbers are at most 255."""
    for m in CHAIN.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, sorted; per kind leftmost and without overlap, failing matches dropped."""
    if not _TELLTALE.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(a, 1, b) for a, b in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def suits(value: str) -> list[bool]:
    """For each kind whether the string could be one."""
    digits = sum("0" <= c <= "9" for c in value)
    letters = sum(c.isalpha() for c in value)
    return ["@" in value or "at)" in value or "at]" in value, not letters and value.count(".") >= 2 and digits >= 4, not letters and digits >= 8, not letters and 6 <= digits <= 15]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like strings of at least five characters that overlap no seed, from left to right."""
    at, k = 0, 0
    while m := _TELLTALE.search(text, at):
        left = m.start()
        while left > at and (text[left - 1].isalnum() or text[left - 1] in "._%+-@"):
            left -= 1
        spelled = _SPELLED.match(text, m.start())
        if len(m.group()) > 1 and (left == m.start() or not spelled):  # (at) without an address around it
            at = m.end()
            continue
        best = max((x.end() for p in (_NUMBER, _HANDLE, _CODE) if (x := p.match(text, left))), default=m.end())
        if spelled:
            best = max(best, spelled.end())
        start = left - 1 if left > at and text[left - 1] in "+(" else left
        end = max(best, m.end())
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        j, clash = k, False
        while j < len(taken) and taken[j][0] < end:
            if taken[j][2] > start:
                clash, end = True, max(end, taken[j][2])
            j += 1
        if not clash and end - start >= 5:
            yield start, end
        at = max(end, m.end())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical contexts of text[start:end]."""
    before = text[max(0, start - 80) : start].lower().split()
    after = text[end : end + 40].lower().split()
    one = before[-1] if before else "^"
    two = before[-2] if len(before) > 1 else "^"
    return [f"1 {one}", f"2 {two} {one}", f"3 {one} _ {after[0] if after else '$'}"]


def graph(docs: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) pairs: seed (kind or -1), and whether the instance suits each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text in batch.column("text").to_pylist():
                if text and _TELLTALE.search(text):
                    found = seeds(text)
                    own = [(s, e, kind, [k == kind for k in range(len(KINDS))]) for s, kind, e in found]
                    own += [(s, e, -1, suits(text[s:e])) for s, e in candidates(text, found)]
                    for s, e, kind, fits in own:
                        name = xxhash.xxh64_intdigest(text[s:e].lower().encode("utf-8", "surrogatepass")) - (1 << 63)
                        rows |= {(p, name, kind, *fits) for p in patterns(text, s, e)}
            cols = list(zip(*sorted(rows), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), *[pa.bool_()] * 4), strict=True)], ["pattern", "instance", "seed", *KINDS])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "pattern string, instance long, seed int, " + ", ".join(f"{k} boolean" for k in KINDS))
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), *(F.max(k).alias(k) for k in KINDS))


def accepted_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, kind) of the patterns accepted in rounds over the pattern-instance graph."""
    edges = materialize(graph(docs), "pii_graph")
    scores = materialize(edges.groupBy("instance").agg(*(F.max((F.col("seed") == i).cast("double")).alias(f"s_{k}") for i, k in enumerate(KINDS))), "pii_instances")
    accepted = materialize(edges.select("pattern", *(F.lit(0.0).alias(f"a_{k}") for k in KINDS)).limit(0), "pii_patterns")
    while True:
        confident = [(F.sum(f"s_{k}") / (F.count("*") + 1)).alias(f"c_{k}") for k in KINDS]
        support = [F.sum((F.col(f"s_{k}") >= ACCEPT).cast("long")).alias(f"n_{k}") for k in KINDS]
        own = edges.join(scores, "instance").groupBy("pattern").agg(*confident, *support)
        now = lambda k: F.when((F.col(f"c_{k}") >= ACCEPT) & (F.col(f"n_{k}") >= SUPPORT), F.col(f"c_{k}")).otherwise(0.0)
        ranked = own.select("pattern", *(now(k).alias(f"c_{k}") for k in KINDS)).where(" or ".join(f"c_{k} > 0" for k in KINDS)).join(accepted, "pattern", "left")
        old = lambda k: F.coalesce(f"a_{k}", F.lit(0.0))
        kept = materialize(ranked.select("pattern", *(F.when(old(k) > 0, old(k)).otherwise(F.col(f"c_{k}")).alias(f"a_{k}") for k in KINDS), *(((old(k) == 0) & (F.col(f"c_{k}") > 0)).alias(f"new_{k}") for k in KINDS)), "pii_patterns")
        new = kept.where(" or ".join(f"new_{k}" for k in KINDS))
        discard(accepted)
        accepted = kept.select("pattern", *(f"a_{k}" for k in KINDS))
        accepted._gleaner_path = kept._gleaner_path
        if new.limit(1).count() == 0:
            break
        spread = edges.join(new, "pattern").groupBy("instance").agg(*(F.max(F.when(F.col(k) & (F.col("seed") < 0), F.col(f"a_{k}")).otherwise(0.0)).alias(f"p_{k}") for k in KINDS))
        better = scores.join(spread, "instance", "left").select("instance", *(F.greatest(f"s_{k}", F.coalesce(f"p_{k}", F.lit(0.0))).alias(f"s_{k}") for k in KINDS))
        before, scores = scores, materialize(better, "pii_instances")
        discard(before)
    best = F.array_max(F.array(*(F.struct(F.col(f"a_{k}").alias("a"), F.lit(-i).alias("i")) for i, k in enumerate(KINDS))))
    out = materialize(accepted.select("pattern", (-best["i"]).alias("kind")), "pii_accepted")
    for t in (edges, scores, accepted):
        discard(t)
    return out


def contexts(texts: DataFrame, row: str, text: str) -> DataFrame:
    """``row``, start, end, pattern, rank (higher: more specific) and the kinds it suits, of each identifier-like string that is no seed."""
    kinds = {"start": pa.int32(), "end": pa.int32(), "pattern": pa.string(), "rank": pa.int32(), "fits": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t and _TELLTALE.search(t):
                    for s, e in candidates(t, seeds(t)):
                        fits = [k for k, ok in enumerate(suits(t[s:e])) if ok]
                        if fits:
                            own = [(s, e, p, r, fits) for r, p in enumerate(patterns(t, s, e))]
                            at += [i] * len(own)
                            rows += own
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True))], [row, *kinds])

    return texts.select(row, text).mapInArrow(run, f"`{row}` long, start int, end int, pattern string, rank int, fits array<int>")


def _scan(docs: DataFrame, accepted: DataFrame, columns: list[T.StructField], make) -> DataFrame:
    """``docs`` with new columns: what ``make`` gives for each text (null counts as empty), its seeds and all its spans."""
    spark = docs.sparkSession
    text, extra = fresh(docs, "text_"), fresh(docs, "extra_")
    frame = docs.withColumn(text, F.col("text").cast("string"))
    known: dict[str, int] = {}
    if accepted.count() <= PART:
        known = {r.pattern: r.kind for r in accepted.collect()}
        frame = frame.withColumn(extra, F.lit(None).cast(SPAN))
    else:
        row = fresh(frame, "row_")
        frame = materialize(frame.withColumn(row, F.monotonically_increasing_id()), "numbered_documents")
        met = contexts(frame, row, text).join(accepted, "pattern").where(F.array_contains("fits", F.col("kind")))
        best = met.groupBy(row, "start", "end").agg(F.max_by("kind", "rank").alias("kind"))
        spans = materialize(best.groupBy(row).agg(F.collect_list(F.struct("kind", "start", "end")).alias(extra)), "discovered_spans")
        frame = frame.join(spans, row, "left").drop(row)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, more in zip(*(batch.column(batch.num_columns - i).to_pylist() for i in (2, 1)), strict=True):
                t = t or ""
                base = seeds(t)
                every = {*base, *((x["start"], x["kind"], x["end"]) for x in more or ())}
                if shared.value and _TELLTALE.search(t):
                    for s, e in candidates(t, base):
                        fits = suits(t[s:e])
                        kind = next((k for p in reversed(patterns(t, s, e)) if (k := shared.value.get(p)) is not None and fits[k]), None)
                        if kind is not None:
                            every.add((s, kind, e))
                out.append(make(t, base, sorted(every)))
            added = [pa.array([x[i] for x in out], k) for i, k in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *added], names)

    own = [f for f in frame.schema.fields if f.name not in (text, extra)]
    names = [f.name for f in (*own, *columns)]
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    types = [span if isinstance(f.dataType, T.ArrayType) else pa.string() for f in columns]
    ordered = frame.select(*(f"`{f.name}`" for f in own), text, extra)
    return ordered.mapInArrow(run, T.StructType([*own, *columns]))


def annotate(docs: DataFrame, accepted: DataFrame, base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with new columns ``base`` and ``spans``: arrays of kind (index in KINDS), start, end in code points, sorted by start and kind."""
    packed = lambda found: [{"kind": k, "start": s, "end": e} for s, k, e in found]
    span = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("kind", "start", "end")]))
    return _scan(docs, accepted, [T.StructField(base, span), T.StructField(spans, span)], lambda text, own, every: (packed(own), packed(every)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the fixed formats), base_sha256, spans."""
    found = annotate(docs.select("doc_id", "text"), accepted_patterns(docs))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans' kinds in brackets in their place (overlapping spans: that of the first)."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; a null text stays null."""
    clean = fresh(docs, "clean_")
    found = _scan(docs, accepted_patterns(docs), [T.StructField(clean, T.StringType())], lambda text, own, every: (replaced(text, every),))
    return found.withColumn("text", F.when(F.col("text").isNotNull(), F.col(clean))).drop(clean)
