"""From hits to what a reader gets: pages of grouped hits, numbered sources for an answer, and the check of its citations.

All for many queries at once: every table has a query_id. The language model is a
function that the application brings; it gets prompts in batches where Spark runs them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import fixed
from gleaner.functions import text as X

#: Hits on a page, sources of an answer, and characters of each.
PAGE, SOURCES, CHARS = 40, 6, 1200


def page(hits: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """Rows of a page (from 1) of each query's hits (query_id, pos, lexical, ..): ``match`` before ``meaning``, each row with its ``group``, ``place`` (from 1), ``total``, and ``left``, the hits on later pages.

    A query has its own list, of a few hundred hits; lists are numbered query by query.
    """
    group = F.when(F.coalesce("lexical", F.lit(False)), "match").otherwise("meaning")
    own = Window.partitionBy("query_id")
    placed = hits.withColumn("group", group).withColumn("place", F.row_number().over(own.orderBy("group", "pos"))).withColumn("total", F.count("*").over(own))
    left = F.greatest(F.col("total") - number * size, F.lit(0))
    return placed.where(F.col("place").between((number - 1) * size + 1, number * size)).withColumn("left", left)


def _judged(hits: DataFrame) -> DataFrame:
    """Hits that are not blank, with ``kinds``, the secrets in what would be sent, and ``before``, the clean hits up to each."""
    text = F.trim("text")
    shown = F.substring(text, 1, CHARS)
    some = hits.where(F.coalesce(text != "", F.lit(False))).withColumn("passage", shown)
    kinds = F.array_sort(F.array_distinct(F.transform(X.find_secrets(F.col("passage"), 1 << 20), lambda s: s["kind"])))
    order = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("kinds", kinds).withColumn("before", F.sum((F.size("kinds") == 0).cast("int")).over(order))


def sources(hits: DataFrame, most: int = SOURCES) -> DataFrame:
    """query_id, n, doc_id, path, passage: the first clean hits (query_id, pos, doc_id, path, text) of each query, numbered from 1."""
    return _judged(hits).where((F.size("kinds") == 0) & (F.col("before") <= most)).select("query_id", F.col("before").cast("int").alias("n"), "doc_id", "path", "passage")


def withheld(hits: DataFrame, most: int = SOURCES) -> DataFrame:
    """query_id, sent, blocked, kinds: what was sent for each query, and what was not because it holds secrets."""
    seen = _judged(hits).where((F.col("before") < most) | ((F.size("kinds") == 0) & (F.col("before") == most)))
    clean = F.size("kinds") == 0
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds"))))  # of at most a few hundred hits
    return seen.groupBy("query_id").agg(F.count(F.when(clean, 1)).alias("sent"), F.count(F.when(~clean, 1)).alias("blocked"), kinds.alias("kinds"))


def prompts(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """query_id, prompt for every query (query_id, query) that has sources."""
    entry = F.concat(F.lit("["), F.col("n"), F.lit("] "), F.coalesce("path", F.lit("")), F.lit("\n"), F.col("passage"))
    block = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", entry.alias("entry")))).alias("s")).select("query_id", F.array_join(F.transform("s", lambda x: x["entry"]), "\n\n").alias("block"))
    rules = f"Answer in at most three sentences, from these sources alone. Put the number of its source, as in [1], behind each sentence. If they hold no answer, write: {fixed.REFUSAL}"
    return queries.join(block, "query_id").select("query_id", F.concat_ws("\n\n", F.concat(F.lit("Question: "), "query"), F.concat(F.lit("Sources:\n"), "block"), F.lit(rules)).alias("prompt"))


def ask(queries: DataFrame, sources: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """query_id, answer, error for every query; one without sources is refused without asking, one that the model fails on has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                answers, errors = list(model(batch.column("prompt").to_pylist())), [None] * batch.num_rows
            except Exception as e:  # a model's failure is told, not thrown
                answers, errors = [""] * batch.num_rows, [f"{type(e).__name__}: {e}"[:160]] * batch.num_rows
            errors = [e or (None if (a or "").strip() else "no content") for a, e in zip(answers, errors, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([(a or "").strip() for a in answers], pa.string()), pa.array(errors, pa.string())], ["query_id", "answer", "error"])

    kind = queries.schema["query_id"].dataType.simpleString()
    answered = prompts(queries, sources).mapInArrow(run, f"query_id {kind}, answer string, error string")
    bare = queries.join(sources.select("query_id").distinct(), "query_id", "left_anti")
    return answered.unionByName(bare.select("query_id", F.lit(fixed.REFUSAL).alias("answer"), F.lit(None).cast("string").alias("error")))


def _refused(answer: Column) -> Column:
    """The refusal, possibly quoted and with more words behind it."""
    return F.startswith(F.regexp_replace(F.trim(answer), '^"+', ""), F.lit(fixed.REFUSAL[:30]))


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``answers`` (query_id, answer) with citations (n and path of each source named), invented (numbers of no source), refused, and uncited (an answer that names no source)."""
    known = sources.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "path"))).alias("known"))  # at most ``SOURCES`` a query
    numbers = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
    told = answers.join(known, "query_id", "left").withColumn("numbers", F.array_sort(F.array_distinct(F.coalesce(numbers, F.array().cast("array<int>")))))
    ours = F.coalesce(F.map_keys("known"), F.array().cast("array<int>"))
    citations = F.transform(F.array_intersect("numbers", ours), lambda n: F.struct(n.alias("n"), F.try_element_at("known", n).alias("path")))
    out = told.withColumn("citations", citations).withColumn("invented", F.array_except("numbers", ours)).withColumn("refused", F.coalesce(_refused(F.col("answer")), F.lit(False)))
    return out.withColumn("uncited", (F.size("citations") == 0) & ~F.col("refused")).drop("numbers", "known")
