"""Language identification: known words first, then ever shorter character n-grams.

A word that the training sample saw at least twice in all is scored by its log
frequency per language. Any other word is scored by its character n-grams of
length 5 if one of them is known, else of length 4, and so on down to single
letters; n-gram frequencies are counted over distinct words, which are the ones
that stand for unseen words. A document adds up its words' scores.

The model is fitted on a bounded sample of rows, chosen by a hash of doc_id: at
most about ``per_language`` of each language (fewer rows, a larger share), at most
about ``max_rows`` in all, and at most ``max_bytes`` of text; rows of over a
sixteenth of that are not drawn. Words and n-grams are counted and pruned in
Spark; a word is two bytes at least, so at most ``max_bytes / 4`` words seen twice
come to the driver, whatever the number of languages. Scores are kept by language
only where a language has the word, so their number is bounded alike, and the
model may be broadcast. Every row is scored over its whole text.

Defined cases: a null text or one without a letter gives ``und`` with score 0; a
text of which nothing is known gives the most frequent language; equal scores
take the alphabetically first language; without training rows every text with a
letter is ``und``; very long texts are scored whole; repeated rows are scored
alike; further input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, materialize

LONGEST = 5
#: Words that count in full towards the certainty of a score.
CERTAIN = 20
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]  # digits that are no decimals


class LanguageModel:
    """Log frequencies of words and n-grams by language.

    ``words`` and ``grams`` number their keys. ``starts``, ``langs_of`` and ``more``
    list, key by key, the languages that have it and by how much its log frequency
    exceeds that of an unseen one, which is ``unseen`` (a row for words and one for n-grams).
    """

    def __init__(self, langs: list[str], prior: np.ndarray, words: dict[str, int], grams: dict[str, int], unseen: np.ndarray, starts: np.ndarray, langs_of: np.ndarray, more: np.ndarray):
        self.langs, self.prior, self.words, self.grams = langs, prior, words, grams
        self.unseen, self.starts, self.langs_of, self.more = unseen, starts, langs_of, more

    def backed_off(self, word: str) -> list[int]:
        """Numbers of the longest n-grams of an unseen word that are known."""
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            if found := [g for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]:
                return found
        return []

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        words = words_of(text)
        keys = [r for r in map(self.words.get, words) if r is not None]
        n_words, n_grams, weight = len(keys), 0, [1.0] * len(keys)
        if n_words < len(words):
            known = self.words
            for w in words:
                if w not in known and (found := self.backed_off(w)):
                    keys += found
                    weight += [1 / len(found)] * len(found)
                    n_grams += 1
        k = np.array(keys, np.int64)
        n = self.starts[k + 1] - self.starts[k]
        at = np.repeat(self.starts[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total = n_words * self.unseen[0] + n_grams * self.unseen[1] + np.bincount(self.langs_of[at], self.more[at] * np.repeat(weight, n), len(self.langs))
        x = total * min(1.0, CERTAIN / max(n_words + n_grams, 1)) + self.prior
        best = int(np.argmax(x))
        return self.langs[best], float(1 / np.exp(x - x[best]).sum())


def _pruned(counts: DataFrame) -> tuple[dict[str, int], int, dict[str, list]]:
    """From (lang, key, n): totals by language, the number of keys, and the rows of keys seen twice in all."""
    both = counts.join(counts.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key"), "key")
    return {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}, counts.select("key").distinct().count(), both.toArrow().sort_by("key").to_pydict()


def fit(rows: DataFrame, per_language: int = 1200, max_rows: int = 20_000, max_bytes: int = 24 << 20) -> LanguageModel:
    """Learn from ``rows`` (doc_id, text, lang); see the module for the bounded sample."""
    rows = rows.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r.lang: r.n for r in counted.collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros(0), {}, {}, np.zeros((2, 0)), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    each = min(per_language, max_rows / len(langs))
    shared = rows.join(F.broadcast(counted), "lang")  # a row for each language
    picked = bounded_sample(shared, "doc_id", F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")), max_bytes).select("lang", "text")
    words = F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))
    of_words = materialize(picked.select("lang", F.explode(words).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")), "language_words")
    marked = F.concat(F.lit("^"), "key", F.lit("$"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n)))
    pieces = F.flatten(F.array(*(F.when(F.length(marked) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(1, LONGEST + 1))))
    of_grams = materialize(of_words.select("lang", F.explode(pieces).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")), "language_grams")
    keys, starts, langs_of, more, unseen = [], [np.zeros(1, np.int64)], [], [], []
    number = {k: i for i, k in enumerate(langs)}
    for table in (of_words, of_grams):
        sums, kinds, found = _pruned(table)
        logs = np.log(0.5 / (np.array([sums.get(k, 0) for k in langs]) + 0.5 * kinds + 1))
        own = np.array([number[k] for k in found["lang"]], np.int64)
        keys.append({k: i for i, k in enumerate(dict.fromkeys(found["key"]))})
        n = np.bincount(np.array([keys[-1][k] for k in found["key"]], np.int64), minlength=len(keys[-1]))
        starts.append(sum(map(len, langs_of)) + np.cumsum(n))
        langs_of.append(own)
        more.append(np.log(np.array(found["n"], float) + 0.5) - np.log(0.5))
        unseen.append(logs)
        discard(table)
    grams = {k: i + len(keys[0]) for k, i in keys[1].items()}
    prior = np.log(np.array([sizes[k] for k in langs]) / sum(sizes.values()))
    return LanguageModel(langs, prior, keys[0], grams, np.stack(unseen), np.concatenate(starts), np.concatenate(langs_of), np.concatenate(more))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain data: executors need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(**shared.value)
        for batch in batches:
            found = [m.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {ids}, lang_pred string, score double")
