"""Retrieval quality: known-item cases drawn from the documents, and measures over (case_id, wanted, doc_id, pos) rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.sources.shared import kept, remove


def paraphrases(pairs: DataFrame, stop: list[str], most: float = 0.34) -> DataFrame:
    """``pairs`` (query, text) with overlap, the share of the query's content words in the text; those over ``most`` are left out."""
    q, d = X.content_words(F.col("query"), stop), X.content_words(F.col("text"), stop)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(q, d)).cast("double"), F.size(q)), F.lit(0.0))
    return pairs.withColumn("overlap", share).where(F.col("overlap") <= most)


def recall_and_mrr(ranked: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """cases: case_id, wanted; ranked: case_id, doc_id, pos (from 0). A case not found counts 0."""
    r = ranked.join(cases, "case_id").where("doc_id = wanted").groupBy("case_id").agg(F.min("pos").alias("pos"))
    every = cases.join(r, "case_id", "left")
    return every.agg(
        F.count("*").alias("n_cases"),
        F.sum((F.coalesce("pos", F.lit(1 << 30)) < k).cast("long")).alias("found"),
        F.round(F.sum(F.coalesce(1.0 / (F.col("pos") + 1), F.lit(0.0))) / F.count("*"), 6).alias("mrr"),
    )


#: A sentence that can be a case, the words counted in it, and how many it must have.
SENTENCE, WORD, WORDS = r"[^.!?\n]{70,140}[.!?]", "[A-Za-z]{3,}", 8
#: Characters of sentences that were looked for at once, from which on no more documents are taken.
CHARS = 1 << 20


def _mark(*parts: Column) -> Column:
    """A seeded order that any engine can compute."""
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


#: What a text falls into, in one walk of it: up to the next end of a sentence or line, or of the text.
_PIECE = r"[^.!?\n]*+(?:[.!?\n]|\z)"


def sentences(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, place, phrase: what SENTENCE finds in the text, where it has enough words.

    SENTENCE itself looks at up to 140 characters from every character on; of a piece that ends a sentence it finds the last 141, if the piece has 71.
    """
    ends = F.filter(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0)), lambda x: (F.length(x) > 70) & ~x.endswith("\n") & F.right(x, F.lit(1)).isin(".", "!", "?"))
    each = docs.select(*(c for c in docs.columns if c != "text"), F.posexplode(F.transform(ends, lambda x: F.trim(F.right(x, F.lit(141))))).alias("place", "phrase"))
    return each.where(F.regexp_count("phrase", F.lit(WORD)) >= WORDS)


def single(docs: DataFrame, least: int = 20, most: int = 4000) -> DataFrame:
    """doc_id, hash of the sentences of documents of so many lines that no other document has as a sentence of its own; narrow rows only are exchanged."""
    each = sentences(docs.select("doc_id", "text", F.col("n_lines").between(least, most).alias("long"))).select("doc_id", F.xxhash64("phrase").alias("hash"), "long")
    return each.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.max("long").alias("long")).where("long AND NOT coalesce(doc_id < last, false)").select("doc_id", "hash")


def holders(docs: DataFrame, phrases: list[str]) -> dict[str, int]:
    """How many documents hold each phrase anywhere: one walk of every text for all of them."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, p in enumerate(sent.value):
            found.add_word(p, i)
        found.make_automaton()
        for batch in batches:
            met = [i for t in batch.column("text").to_pylist() for i in {i for _, i in found.iter(t or "")}]
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64())], ["phrase"])

    if not phrases:
        return {}
    counted = docs.select("text").mapInArrow(run, "phrase long").groupBy("phrase").agg(F.count("*").alias("n"))
    return {phrases[r.phrase]: r.n for r in counted.collect()}  # one row for each phrase asked about


def cases(docs: DataFrame, n: int = 24, seed: int = 7, least: int = 20, most: int = 4000) -> DataFrame:
    """case_id, wanted, phrase, words: ``n`` documents in seeded order, each with its first sentence that stands in no other document.

    A sentence that others have as a sentence goes at once, by counts of hashes, which are taken once; the rest is
    looked for in all texts, for a few documents at a time and then for more, until there are enough.
    """
    spark = docs.sparkSession
    own, folder = kept(spark, single(docs, least, most), "sentences")
    own = own.withColumn("mark", _mark(F.col("doc_id"), F.lit(seed)))
    found: list[tuple] = []
    after, step = "", 4 * n
    while len(found) < n:
        first = own.where(F.col("mark") > after).groupBy("mark", "doc_id").agg(F.collect_set("hash").alias("hashes")).orderBy("mark", "doc_id").limit(step)
        some = first.collect()  # hashes of the sentences of a few documents
        ids = [r.doc_id for r in some]
        theirs = docs.where(F.col("doc_id").isin([i for i in ids if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in ids)))
        theirs = sentences(theirs.where(F.col("n_lines").between(least, most)).select("doc_id", "text"))
        held: dict = {r.doc_id: (set(r.hashes), []) for r in some}
        for r in theirs.select("doc_id", "place", "phrase", F.xxhash64("phrase").alias("hash")).collect() if some else []:
            if r.hash in held[r.doc_id][0]:
                held[r.doc_id][1].append((r.place, r.phrase))
        phrases = sorted({phrase for _, each in held.values() for _, phrase in each})
        known = holders(docs, phrases)
        for r in some:
            unique = next((phrase for _, phrase in sorted(held[r.doc_id][1]) if known.get(phrase, 0) == 1), None)
            if unique is not None and len(found) < n:
                found.append((len(found), r.doc_id, unique, re.findall(WORD, unique)))
        if len(some) < step:
            break
        after, step = some[-1].mark, step if sum(map(len, phrases)) > CHARS else 4 * step
    remove(spark, folder)
    return spark.createDataFrame(found, "case_id long, wanted long, phrase string, words array<string>")


def with_query(cases: DataFrame, seed: int = 11) -> DataFrame:
    """``cases`` with a query: half of the words, at least three, in seeded order, none of the first three; cases of fewer words are left out."""
    tail = F.slice("words", 4, F.greatest(F.size("words") - 3, F.lit(0)))
    drawn = F.array_sort(F.transform(tail, lambda w, i: F.struct(_mark(F.col("wanted"), F.lit(seed), i), w.alias("word"))))
    few = F.slice(F.transform(drawn, lambda x: x["word"]), 1, F.greatest(F.lit(3), F.floor(F.size(tail) / 2).cast("int")))
    return cases.where(F.size("words") >= 6).withColumn("query", F.array_join(few, " "))

