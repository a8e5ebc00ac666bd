"""Retrieval: exact, regex, keyword, path, vector and metadata search, and fusion of their lists.

Every operator takes a DataFrame of documents and returns doc_id and score,
ranked before it is cut: ``top`` ends each with a total order, so equal scores
are resolved alike on any cluster. Texts are read where they lie; only ids,
scores and per-term numbers are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import fixed
from gleaner.functions import text as X
from gleaner.sources.shared import kept


def top(df: DataFrame, *order: Column, limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def exact(docs: DataFrame, literal: str, limit: int = 40) -> DataFrame:
    """Case-sensitive substring search, scored by the number of occurrences; shorter texts first among equals."""
    if len(literal) < 2:
        return docs.select("doc_id", F.lit(0).cast("long").alias("score")).limit(0)
    found = docs.where(F.col("text").contains(literal)).select("doc_id", X.occurrences(F.col("text"), literal).alias("score"), F.length("text").alias("n"))
    return top(found, F.desc("score"), F.asc("n"), F.asc("doc_id"), limit=limit).select("doc_id", "score")


def regex(docs: DataFrame, pattern: str, limit: int = 40) -> DataFrame:
    """Number of case-insensitive matches."""
    found = docs.select("doc_id", F.regexp_count("text", F.lit(f"(?i){pattern}")).cast("long").alias("score")).where("score > 0")
    return top(found, F.desc("score"), F.asc("doc_id"), limit=limit)


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df: each document gives each of its terms once, so one combining exchange counts them."""
    return docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf, dl: the inverted index (dl: the document's number of tokens)."""
    t = docs.select("doc_id", X.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").cast("long").alias("dl"))


def _idf(smooth: bool, df: Column, n: Column) -> Column:
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.log(1 + ratio) if smooth else F.when(F.log(ratio) > 0, F.log(ratio)).otherwise(1e-6)


def keyword(docs: DataFrame, query: str, limit: int = 40, variant: str = "plain") -> DataFrame:
    """BM25 in one read of the texts: it counts totals and writes the few numbers of documents with a term to the shared folder.

    ``plain``: k1 1.5, b 0.75, smoothed idf, each distinct term once. ``weighted``:
    k1 1.2, term frequencies times 1.5, idf at least 1e-6, repeated terms each.
    """
    import re

    found = [w.lower() for w in re.findall(fixed.TOKEN, query)]
    terms = sorted(set(found))
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    tf = lambda t: F.size(F.filter("t", lambda x: x == t)).cast("long")
    low, some = F.lower("text"), F.lit(False)
    for t in terms:
        some |= low.contains(t)
    toks = F.when(some, X.tokens(F.col("text"))).otherwise(F.array().cast("array<string>"))  # texts without a term are only counted
    counted = docs.select("doc_id", toks.alias("t"), F.regexp_count("text", F.lit(fixed.TOKEN)).cast("long").alias("dl"))
    counted = counted.select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), *(tf(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    seen = Observation()
    watched = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    counted, folder = kept(docs.sparkSession, watched.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))), "counted")
    totals = seen.get
    k1, weight, b = (1.5, 1.0, 0.75) if variant == "plain" else (1.2, 1.5, 0.75)
    parts = []
    for i, t in enumerate(terms):
        f = F.col(f"tf{i}") * weight
        idf = _idf(variant == "plain", F.lit(totals[f"df{i}"] or 0), F.lit(totals["n"]))
        times = 1 if variant == "plain" else found.count(t)
        parts.append(times * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(totals["avgdl"] or 1.0))))
    scored = counted.select("doc_id", reduce(lambda x, y: x + y, parts).alias("score")).where("score > 0")
    out = top(scored, F.desc(F.round("score", 9)), F.asc("doc_id"), limit=limit)
    out._folder = folder  # for those who collect at once
    return out


def keyword_by_postings(index: DataFrame, n: int, avgdl: float, query: str, limit: int = 40, variant: str = "plain") -> DataFrame:
    """The same ranking from a written index: only the query's terms are read."""
    import re

    found = [w.lower() for w in re.findall(fixed.TOKEN, query)]
    terms = sorted(set(found))
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most one row per query term
    k1, weight = (1.5, 1.0) if variant == "plain" else (1.2, 1.5)
    times = F.lit(1) if variant == "plain" or not terms else F.create_map(*(F.lit(x) for t in terms for x in (t, found.count(t))))[F.col("term")]
    tf, dl = F.col("tf") * weight, F.col("dl")
    one = times * _idf(variant == "plain", F.col("df"), F.lit(n)) * tf * (k1 + 1) / (tf + k1 * (0.25 + 0.75 * dl / F.lit(avgdl or 1.0)))
    scored = hits.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.sum(one).alias("score"))
    return top(scored, F.desc(F.round("score", 9)), F.asc("doc_id"), limit=limit)


def path_terms(query: str) -> list[str]:
    """What a path search looks for, in lower case."""
    import re

    return [t.lower() for t in re.findall(fixed.PATH_TERM, query) if t.lower() not in fixed.PATH_STOPWORDS]


def path(docs: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """Match of the file or directory name: whole name or stem 6 (12 for a directory), beginning 3, part 2; the best term counts."""
    terms = path_terms(query)
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    base = F.lower(X.base_name(F.col("path")))
    stem = F.when(F.instr(base, ".") > 0, F.regexp_replace(base, "\\.[^.]*$", "")).otherwise(base)
    one = lambda t: F.when((base == t) | (stem == t), F.when(F.col("is_dir"), 12.0).otherwise(6.0)).when(base.startswith(t), 3.0).when(base.contains(t), 2.0)
    score = F.greatest(*map(one, terms)) if len(terms) > 1 else one(terms[0])
    return top(docs.select("doc_id", score.alias("score")).where("score is not null"), F.desc("score"), F.asc("doc_id"), limit=limit)


def vector(chunks: DataFrame, query: list[float], limit: int = 5, key: str = "doc_id") -> DataFrame:
    """Best cosine of each document's unit-length chunk vectors (column embedding): one product for each Arrow batch, whose best row of each document goes on."""
    q = np.array(query, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            dots = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1) @ q if len(rows) else np.zeros(0)
            best = pa.table({"k": batch.column(0), "s": dots}).group_by("k").aggregate([("s", "max")])
            yield from best.select(["k", "s_max"]).rename_columns([key, "s"]).to_batches()

    kind = chunks.schema[key].dataType.simpleString()
    whole = chunks.where(F.size("embedding") == len(query)).select(key, "embedding")
    best = whole.mapInArrow(run, f"{key} {kind}, s double").groupBy(key).agg(F.max("s").alias("score"))
    return top(best, F.desc(F.round("score", 9)), F.asc(key), limit=limit)


def with_lines(docs: DataFrame, least: int, most: int) -> DataFrame:
    """Documents of so many lines, both ends included."""
    return docs.where(F.col("n_lines").between(least, most))


def by_id(docs: DataFrame, ids: list[int]) -> DataFrame:
    return docs.where(F.col("doc_id").isin(ids))


def metadata(docs: DataFrame, filters: dict, skipped: DataFrame | None = None, limit: int = 40) -> DataFrame:
    """Files by size, time and extension; then skipped files by size and extension, in one list (doc_id null, pos from 0)."""
    size = F.lit(True)
    if "min_bytes" in filters:
        size &= F.col("size") >= filters["min_bytes"]
    if "max_bytes" in filters:
        size &= F.col("size") <= filters["max_bytes"]
    if "ext" in filters:
        size &= F.lower("path").endswith(filters["ext"])
    time = F.lit(True)
    if "since" in filters:
        time &= F.col("mtime") >= filters["since"]
    if "until" in filters:
        time &= F.col("mtime") < filters["until"]
    lead = -F.col("size").cast("double") if "min_bytes" in filters else -F.col("mtime") if {"since", "until"} & set(filters) else F.lit(0.0)
    own = docs.where(~F.col("is_dir") & size & time).select("doc_id", "path", F.lit(0).alias("part"), lead.alias("lead"))
    own = own.orderBy("lead", "path").limit(limit)
    if skipped is not None:
        rest = skipped.where(size).select(F.lit(None).cast("long").alias("doc_id"), "path", F.lit(1).alias("part"), F.lit(0.0).alias("lead"))
        own = own.unionByName(rest.orderBy("path").limit(limit)).orderBy("part", "lead", "path").limit(limit)
    return own.select("doc_id", "path", F.lit(1.0).alias("score"), (F.row_number().over(Window.orderBy("part", "lead", "path")) - 1).alias("pos"))


def grep(ledger_texts: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Case-insensitive literal search of skipped files' contents (path, size, text), smallest first."""
    return top(ledger_texts.where(F.lower("text").contains(query.lower())).select("path", "size"), F.asc("size"), F.asc("path"), limit=limit)


def rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (backend, doc_id, pos from 0, weight): doc_id, score."""
    fused = lists.groupBy("doc_id").agg(F.sum(F.col("weight") / (k + F.col("pos") + 1)).alias("score"))
    return fused.orderBy(F.desc(F.round("score", 12)), "doc_id")


def ranked(hits: DataFrame, backend: str, weight: float = 1.0) -> DataFrame:
    """A backend's cut list as (backend, doc_id, pos, weight, score); the one task that numbers it reads ``limit`` rows."""
    order = Window.orderBy(F.desc(F.round("score", 9)), "doc_id")
    return hits.select(F.lit(backend).alias("backend"), "doc_id", (F.row_number().over(order) - 1).alias("pos"), F.lit(weight).alias("weight"), F.col("score").cast("double").alias("score"))


def explain_empty(docs: DataFrame, filters: dict) -> DataFrame:
    """For each filter alone, how many files pass it, and the largest file: why a filter search found nothing."""
    passes = {k: _passes(k, v) for k, v in filters.items() if k in ("min_bytes", "max_bytes", "since", "until", "ext")}
    files = docs.where(~F.col("is_dir"))
    return files.agg(F.count("*").alias("files"), F.max("size").alias("largest"), *(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(f"passes_{k}") for k, c in passes.items()))


def _passes(kind: str, value) -> Column:
    return {"min_bytes": F.col("size") >= value, "max_bytes": F.col("size") <= value, "since": F.col("mtime") >= value, "until": F.col("mtime") < value, "ext": F.lower("path").endswith(str(value))}[kind]
