"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, language_id, quality_model
from .common import held_out, table
from .decontaminate import contaminated
from .hard_negatives import hard_negatives
from .packing import pack
from .pii import find_pii
from .quality_rules import quality_rules
from .sharding import assign_shards
from .simhash import near_duplicates
from .sql import hard_negatives_sql, quality_rules_sql, ranked_search_sql, suffix_dedup_sql, url_filters_sql
from .suffix_dedup import digest, remove_repeats
from .tiered_search import ranked_search
from .url_filters import url_filters

#: The rules of the registered query (fixed values): verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 3, 1)
    net = quality_model.fit(docs, table(spark, sf_dir, "labels").where(~apart))
    out = quality_model.score(docs, net)
    return out.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"), URL_RULES)


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(F.col("doc_id"), 7, 2)).alias("learn"))
    out = katz.score(docs)
    return out.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = held_out(F.col("doc_id"), 5, 0)
    model = language_id.fit(docs.where(~apart))
    return language_id.identify(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(table(spark, sf_dir, "documents")))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """The other operators learn, hash, align or iterate; their tests hold them against brute force."""
    return {
        "op2_quality_rules": quality_rules_sql(), "op5_url_filters": url_filters_sql(URL_RULES), "op10_suffix_dedup": suffix_dedup_sql(),
        "op12_hard_negatives": hard_negatives_sql(), "op13_tiered_search": ranked_search_sql(),
    }
