"""The search engine: a query's plan, its lists, and the final table of hits.

The backends are DataFrames; each is cut to its limit by a distributed top-k
before the driver, which holds at most five lists of 400 keys, orders them. With
an index they read its tables; without one each scans the documents once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import graph, maintenance
from gleaner.operators import search as S
from gleaner.operators.index import SearchIndex
from gleaner.sources.shared import remove, together

from . import router

LEXICAL = ("exact", "keyword", "path", "meta")


class Engine:
    """``docs``: the document table.

    ``chunks`` and ``embed`` (query -> vector) switch vector search on, ``skipped`` is
    the ledger, ``index`` the written tables to search in place of the documents,
    ``ledger_texts`` (path, size, text of skipped files) what is searched when all
    else finds nothing, ``code`` the rows of graph.extract, and ``recorded`` the state
    of the documents (doc_count, doc_max_id, doc_mtime_sum) that the vectors were made of.
    """

    def __init__(self, docs: DataFrame, chunks: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None, skipped: DataFrame | None = None, index: SearchIndex | None = None, ledger_texts: DataFrame | None = None, code: DataFrame | None = None, recorded: dict | None = None):
        self.docs, self.chunks, self.embed, self.skipped = docs, chunks, embed, skipped
        self.index, self.ledger_texts, self.code, self.recorded = index, ledger_texts, code, recorded

    def _list(self, backend: str, query: str) -> list[tuple]:
        if backend == "exact":
            if not router.exact_applies(query):
                return []
            found = self.index.exact(router.literal(query), router.LIMIT) if self.index else S.exact(self.docs, router.literal(query), router.LIMIT)
        elif backend == "keyword":
            found = self.index.keyword(query, router.LIMIT) if self.index else S.keyword(self.docs, query, router.LIMIT)
        elif backend == "path":
            found = self.index.path(query, router.LIMIT) if self.index else S.path(self.docs, query, router.LIMIT)
        elif self.chunks is None or self.embed is None:
            return []
        else:
            found = S.vector(self.chunks, self.embed(query), router.SEMANTIC_LIMIT)
        rows = [(r.doc_id, float(r.score)) for r in found.collect()]
        if hasattr(found, "_folder"):
            remove(self.docs.sparkSession, found._folder)
        return rows

    def _all_lists(self, backends: list[str], query: str) -> dict[str, list[tuple]]:
        """The backends' lists; their jobs run side by side."""
        return dict(zip(backends, together(*(lambda b=b: self._list(b, query) for b in backends)), strict=True))

    def search(self, query: str, top_k: int = 25, now: datetime | None = None) -> tuple[DataFrame, dict]:
        """(hits, trace). hits: pos, doc_id, path, lang, n_lines, line_no, snippet, rrf_score, sources, lexical.

        Skipped files among the hits come beside the ``top_k`` documents. The trace has the plan, the lists' sizes,
        and, where the engine was given what it takes, ``graph`` (definitions and calls), ``vectors`` (staleness) and
        ``grep`` (skipped files that hold the query, looked for only if nothing else was found), as DataFrames.
        """
        plan = router.classify(query)
        lists = self._all_lists(sorted(plan["backends"], key=lambda b: b == "semantic"), query)
        broadened = not any(lists.values())
        if broadened:
            lists |= self._all_lists([b for b in ("exact", "keyword", "path", "semantic") if b not in lists], query)
        filters = router.parse(query, now)
        pure = bool(filters) and not router.has_text(filters)
        names: dict = {}
        if filters:
            rows = S.metadata(self.index.names if self.index else self.docs, filters, self.skipped).orderBy("pos").collect()
            lists["meta"] = [((r.doc_id if r.doc_id is not None else r.path), 1.0) for r in rows]
            names = {r.path: r.path for r in rows if r.doc_id is None}
            if pure and not rows:
                lists = {"meta": []}
        keys, score, ranked, lead = order_of(lists, plan["kind"], pure)
        order = cut(ranked, names, top_k)
        trace = {"plan": plan, "backend_counts": {b: len(own) for b, own in lists.items()}, "broadened": broadened, "meta": filters, "primary": lead}
        if filters and not lists["meta"]:
            trace["explain_empty"] = S.explain_empty(self.index.names if self.index else self.docs, filters).first().asDict()
        if not order and len(query) >= 4 and self.ledger_texts is not None:
            trace["grep"] = S.grep(self.ledger_texts, query)
        if self.code is not None and graph.names_in(query):
            trace["graph"] = graph.graph_search(graph.edges_of(self.code), graph.symbols_of(self.code), query)
        if self.recorded is not None:
            trace["vectors"] = maintenance.staleness(self.index.names if self.index else self.docs, self.recorded)
        return self._hits(query, order, names, keys, score), trace

    def _hits(self, query: str, order: list, names: dict, keys: dict[str, list], score: dict) -> DataFrame:
        rows = [(i, None if k in names else k, names.get(k), score[k], [b for b in keys if k in keys[b]]) for i, k in enumerate(order)]
        hits = self.docs.sparkSession.createDataFrame(rows, "pos int, doc_id long, skipped_path string, rrf_score double, sources array<string>")
        ids = [k for k in order if k not in names]
        docs = self.index.documents(ids) if self.index else S.by_id(self.docs, ids)
        own = docs.select("doc_id", "path", "lang", "n_lines", X.find_line(F.col("text"), router.literal(query)).alias("f"), X.snippet(F.col("text")).alias("s"))
        joined = F.broadcast(hits).join(own, "doc_id", "left")  # at most top_k documents and 40 skipped files
        lexical = F.arrays_overlap("sources", F.array(*map(F.lit, LEXICAL)))
        return joined.select(
            "pos", "doc_id", F.coalesce("path", "skipped_path").alias("path"), "lang", "n_lines", F.col("f.line_no").alias("line_no"),
            F.coalesce("f.line", "s").alias("snippet"), "rrf_score", "sources", lexical.alias("lexical"),
        ).orderBy("pos")

    def stats(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"))


def order_of(lists: dict[str, list[tuple]], kind: str, pure: bool) -> tuple[dict[str, list], dict, list, str | None]:
    """Of the backends' lists of (key, score): their keys, the fused score of each key, all keys in order, and the backend that leads."""
    best_path = max((s for _, s in lists.get("path", [])), default=0.0)
    keys = {b: [k for k, _ in own] for b, own in lists.items()}
    lead = router.primary(kind, keys, best_path, pure)
    score: dict = {}
    for b, own in keys.items():
        for i, k in enumerate(own):
            score[k] = score.get(k, 0.0) + router.weight(b, pure) / (60 + i + 1)
    return keys, score, router.interleave(keys, lead, pure), lead


def cut(order: list, names: dict, top_k: int) -> list:
    """The first ``top_k`` documents, with the skipped files before the last of them."""
    out, n = [], 0
    for k in order:
        if n == top_k:
            break
        out.append(k)
        n += k not in names
    return out


def rerank(hits: DataFrame, scored: DataFrame, first: int = 20) -> DataFrame:
    """The first hits in order of another scorer's ``rerank_score`` (doc_id, rerank_score), the others as they were."""
    joined = hits.join(scored, "doc_id", "left")
    head = F.col("pos") < first
    return joined.orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.coalesce("rerank_score", F.lit(float("-inf")))), "pos")


def scored(hits: DataFrame, scorer: Callable[[list[str]], list[float]], first: int = 20, chars: int = 1200) -> DataFrame:
    """doc_id, rerank_score of the first hits (pos, doc_id, text) by a scorer of passages; one it fails on has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                found = [float(x) for x in scorer([t or "" for t in batch.column("passage").to_pylist()])]
            except Exception:  # a model's failure leaves the order as it is
                found = [None] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "rerank_score"])

    kind = hits.schema["doc_id"].dataType.simpleString()
    return hits.where(F.col("pos") < first).select("doc_id", F.substring("text", 1, chars).alias("passage")).mapInArrow(run, f"doc_id {kind}, rerank_score double")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many hits changed their place, and how far at most (both: doc_id, pos)."""
    both = before.select("doc_id", F.col("pos").alias("a")).join(after.select("doc_id", F.col("pos").alias("b")), "doc_id")
    far = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count("*").alias("n"), F.count(F.when(far > 0, 1)).alias("moved"), F.coalesce(F.max(far), F.lit(0)).alias("farthest"))


def ordered(hits: DataFrame, order: list[int], most: int = 12, chars: int = 700) -> tuple[DataFrame, DataFrame]:
    """For a model that answers with an order: (what it may see of the first hits, all hits in its order).

    Hits with secrets are not shown to it. Shown ones come as ``order`` (doc_ids) says,
    then those it left out, then all others as they were.
    """
    clean = F.size(X.find_secrets(F.col("text"), 1)) == 0
    shown = hits.where((F.col("pos") < most) & clean).select("pos", "doc_id", F.substring("text", 1, chars).alias("passage")).orderBy("pos")
    place = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(order) for x in (k, i))), F.col("doc_id")), F.lit(len(order))) if order else F.lit(0)
    first = (F.col("pos") < most) & clean
    return shown, hits.orderBy(F.when(first, 0).otherwise(1), F.when(first, place).otherwise(0), "pos")


def context(hits: DataFrame, limit: int = 6, chars: int = 1200) -> DataFrame:
    """Passages for an answer: numbered, not blank, without secrets (hits: pos, doc_id, text)."""
    from pyspark.sql.window import Window

    clean = hits.where((F.trim("text") != "") & (F.size(X.find_secrets(F.col("text"), 1)) == 0))
    numbered = clean.orderBy("pos").limit(limit).withColumn("n", F.row_number().over(Window.orderBy("pos")))
    return numbered.select("n", "doc_id", F.substring("text", 1, chars).alias("passage"))
