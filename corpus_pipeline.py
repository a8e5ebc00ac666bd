"""From documents to packed training sequences.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``docs``, with the
rows and texts that the stage keeps. ``run`` writes and rereads what each stage
returns before the next one begins, in the folder all executors share, and then
removes what the stage and the one before had written there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import pii, quality_model
from gleaner.llm.common import discard, fresh, held_out, materialize, scratch, table
from gleaner.llm.decontaminate import annotate
from gleaner.llm.packing import pack
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.simhash import near_duplicates

#: SQL for the rows of ``run``: none, the stages learn, hash and align.
ORACLE_SQL = None
#: Near duplicates share this part of their shingles of so many words; their fingerprints are looked for within the radius.
NEAR_SHINGLE, NEAR_SIMILARITY, NEAR_RADIUS = 5, 0.8, 20


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte-level network, fitted on the labels outside the held-out third, gives at least one half."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    score = fresh(docs, "score_")
    return quality_model.with_score(docs, quality_model.fit(docs, labels), score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id (of equal or no doc_ids any one).

    Rows are told apart by a number of their own, written with them, so that
    null and repeated doc_ids are rows like any other.
    """
    row = fresh(docs, "row_")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered_rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))  # the smallest of a group stays
    groups = near_duplicates(numbered.select(key.alias("doc_id"), "text"), NEAR_RADIUS, NEAR_SHINGLE, NEAR_SIMILARITY)
    gone = materialize(groups.where("doc_id.row != component_id.row").select(F.col("doc_id.row").alias(row)), "dropped_rows")
    # The rows dropped grow with the input, so they are never broadcast: one exchange of the texts, at every size.
    return numbered.join(gone.hint("merge"), row, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose own text no benchmark item is found."""
    found = fresh(docs, "found_")
    return annotate(docs, table(spark, sf_dir, "benchmark"), found).where(F.size(found) == 0).drop(found)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_redaction", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            kept = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
