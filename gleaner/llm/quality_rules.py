"""Quality rules with thresholds learned from mergeable quantile sketches.

Every document gets integer metrics. Per (lang, source) and metric a log-linear
histogram sketch is kept: a value keeps its ``SKETCH_BITS`` leading bits, so a
sketch has at most a few hundred bins, two sketches merge by adding bin counts,
and a quantile is off by less than 1/32 of its value. From the sketch quantiles
come two fences per group, and from the merged sketches those of its language; a
group of n documents uses (n * own + prior * language's) / (n + prior), so small
groups lean on their language without a switch. The fences are joined back to the
documents.

Only DataFrame expressions are used. Metrics are written once to the shared
folder (a few integers per document); the sketch aggregation combines on the
map side, so a source holding a third of all rows costs a few hundred rows per
task. The fence table is joined by an ordinary equi-join: Spark broadcasts it
only if its measured size is under the session's threshold, and otherwise its
skew handling splits the hot source.

Defined cases: a null text counts as empty (0 words, fails the base rule); null
lang or source form groups of their own; equal rows are judged alike; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialize, scratch, words_of

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 8
SKETCH_BITS = 6

#: The upper fence is q50 + FENCE * max(q50 - q10, spread): the clean part of a group sets its own scale.
FENCE = 4
RULES: dict[str, tuple[int | None, int | None]] = {
    # metric: (least spread above the median, least spread below it); None: no fence on that side
    "word_len": (40, 40),  # code points in words per 100 words
    "symbols": (20, None),  # symbol characters per 1000 words
    "dup_lines": (90, None),  # repeated lines per 1000 lines
    "repeats": (60, None),  # words in repeated windows per 1000 words
    "stutter": (25, None),  # words equal to the word before, per 1000 words
    "marks": (40, None),  # characters in words that are no letters, per 1000
}


def n_repeat_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur at least twice; windows compare by a 64-bit hash of word hashes."""

    def covered(pos: Column) -> Column:
        gap = lambda j: F.least(F.lit(WINDOW), F.get(pos, j) - F.get(pos, j - 1))
        return F.aggregate(F.sequence(F.lit(1), F.size(pos) - 1), F.lit(WINDOW), lambda acc, j: acc + gap(j))

    def repeated(pairs: Column) -> Column:
        same = lambda p, j: (F.get(pairs, j - 1)["h"] == p["h"]) | (F.get(pairs, j + 1)["h"] == p["h"])
        marked = F.transform(pairs, lambda p, j: F.when(F.coalesce(same(p, j), F.lit(False)), p["i"]))
        positions = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
        return let(positions, lambda pos: F.when(F.size(pos) > 1, covered(pos)).otherwise(F.lit(0)))

    def doubled(hashes: Column, step: int) -> Column:
        """Hashes of runs twice as long: each with the one ``step`` places on."""
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1 - step), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + step)))

    def windows(hashes: Column) -> Column:
        return let(doubled(hashes, 1), lambda two: let(doubled(two, 2), lambda four: doubled(four, 4)))

    def count(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(pairs, repeated))

    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(let(windows(hashes), count))


def n_stutter(hashes: Column) -> Column:
    return F.when(F.size(hashes) < 2, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.size(hashes) - 1), lambda i: F.get(hashes, i) == F.get(hashes, i - 1))))


def document_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the raw counts of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = lambda h: F.struct(F.size(h).cast("long").alias("n_words"), n_repeat_words(h).cast("long").alias("n_repeat_words"), n_stutter(h).cast("long").alias("n_stutter"))
    length = lambda c: F.length(c).cast("long")
    of_words = let(words_of(F.col("t")), lambda w: F.struct(length(F.array_join(w, "")).alias("word_chars"), let(F.transform(w, lambda x: F.xxhash64(x)), counts).alias("c")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return base.withColumns({"a": of_words, "b": line_counts}).select(
        "doc_id", "lang", "source", "a.c.n_words", "a.word_chars", (length("t") - length(F.regexp_replace("t", SYMBOLS, ""))).alias("n_symbols"),
        "b.n_dup_lines", "a.c.n_repeat_words", "a.c.n_stutter", "b.n_lines", length(F.regexp_replace("t", "[^\\p{L}]+", "")).alias("n_letters"),
    )


def with_rates(m: DataFrame) -> DataFrame:
    rate = lambda k, a, b: F.expr(f"({k} * ({a})) div greatest({b}, 1)")
    return m.withColumns(
        {
            "word_len": rate(100, "word_chars", "n_words"),
            "symbols": rate(1000, "n_symbols", "n_words"),
            "dup_lines": rate(1000, "n_dup_lines", "n_lines"),
            "repeats": rate(1000, "n_repeat_words", "n_words"),
            "stutter": rate(1000, "n_stutter", "n_words"),
            "marks": rate(1000, "word_chars - n_letters", "word_chars"),
        }
    )


def sketch(rates: DataFrame) -> DataFrame:
    """Bins (lang, source, metric, bin, n); adding n over groups merges sketches."""
    pairs = ", ".join(f"'{m}', {m}" for m in RULES)
    long = rates.selectExpr("lang", "source", f"stack({len(RULES)}, {pairs}) as (metric, v)")
    shift = f"greatest(0, length(bin(v)) - {SKETCH_BITS})"
    return long.withColumn("bin", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})")).groupBy("lang", "source", "metric", "bin").agg(F.count("*").alias("n"))


def fences(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and metric the number of documents and both fences, from sketch quantiles."""
    w = Window.partitionBy(*keys, "metric")
    ranked = bins.withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    q = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bin")))
    quantiles = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("n"), q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"))
    spread = lambda side: F.create_map(*(x for m, s in RULES.items() if s[side] is not None for x in (F.lit(m), F.lit(s[side]).cast("long"))))[F.col("metric")]
    hi = F.col("q50") + FENCE * F.greatest(F.col("q50") - F.col("q10"), spread(0))
    lo = F.when(spread(1).isNotNull(), F.col("q50") - FENCE * F.greatest(F.least(F.col("q90") - F.col("q50"), F.col("q50") - F.col("q10")), spread(1)))
    return quantiles.select(*keys, "metric", "n", hi.alias("hi"), lo.alias("lo"))


def _wide(f: DataFrame, keys: list[str]) -> DataFrame:
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return f.groupBy(*keys).agg(F.max("n").alias("n"), *(pick(m, c).alias(f"{m}_{c}") for m in RULES for c in ("hi", "lo")))


def thresholds(bins: DataFrame, prior: int) -> DataFrame:
    """One row per (lang, source): its own fences, drawn towards its language's with the weight of ``prior`` documents."""
    by_source = _wide(fences(bins, ["lang", "source"]), ["lang", "source"])
    merged = bins.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    by_lang = _wide(fences(merged, ["lang"]), ["lang"])
    names = [f"{m}_{c}" for m in RULES for c in ("hi", "lo")]
    a, b = by_source.alias("a"), by_lang.alias("b")
    real = lambda x: F.col(x).cast("double")
    use = lambda x: ((real("a.n") * real(f"a.{x}") + F.lit(float(prior)) * real(f"b.{x}")) / (real("a.n") + F.lit(float(prior)))).alias(x)
    return a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.lang", "a.source", *map(use, names))


def quality_rules(docs: DataFrame, prior: int = 30) -> DataFrame:
    """doc_id, lang, source, the counts, the rates, base_failed, outlier (metrics outside their fences) and kept."""
    m = materialize(with_rates(document_metrics(docs)), "quality_metrics")
    with scratch():
        limits = materialize(thresholds(materialize(sketch(m), "quality_sketch"), prior), "quality_thresholds", keep=True)
    d, t = m.alias("d"), limits.alias("t")
    same = F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    outside = lambda x: F.coalesce((F.col(x) > F.col(f"{x}_hi")) | F.coalesce(F.col(x) < F.col(f"{x}_lo"), F.lit(False)), F.lit(False))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    broken = F.filter(F.array(*(F.when(outside(x), F.lit(x)) for x in RULES)), lambda x: x.isNotNull())
    return d.join(t, same, "left").select("d.*", base.alias("base_failed"), broken.alias("outlier")).withColumn("kept", ~F.col("base_failed") & (F.size("outlier") == 0))
