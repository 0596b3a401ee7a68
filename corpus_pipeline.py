"""The training-corpus pipeline: five stages, each over all that the one before kept.

``STAGES`` holds ``(name, function)``; a function takes ``(spark, docs, sf_dir)``.
Its result is written as Parquet and read again as the ``docs`` of the next. All
but the last return the columns of ``docs``; the last adds the probability that
each document was drawn with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm import decontamination, lz_dedup, mixing, ngram_join, toxicity
from peerscope.llm.texts import caller_rows, read_table
from peerscope.session import materialize, temporary_tables

#: A document at this score or above goes.
TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, trained on all labels, calls toxic."""
    model = toxicity.fit(toxicity.labelled_bags(docs, read_table(spark, sf_dir, "labels"), "toxic"))
    name = "toxicity" + "_" * max(len(c) for c in docs.columns)
    return toxicity.with_scores(docs, model, name).filter(F.col(name) < TOXIC_SCORE).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the lowest id; of rows that repeat id and text, one."""
    groups = materialize(ngram_join.near_duplicates(docs), "groups")
    lowest = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    kept = docs.join(lowest, docs["doc_id"].eqNullSafe(lowest["kept_id"]), "left_semi")
    if groups.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without words inside passages of 20 words or more that occur earlier; other texts stay as they are."""
    factored = lz_dedup.factor_documents(docs, rows=True)
    out = caller_rows(factored, docs.columns, F.col("kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark items make up a twentieth or more."""
    marked = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return caller_rows(marked.filter("NOT contaminated"), docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of source, language and topic."""
    drawn = mixing.mix(docs).filter("kept")
    # A caller's column of that name stays.
    free = "probability" + "_" * max([len(c) for c in docs.columns if c.rstrip("_") == "probability"], default=0)
    return drawn.select(
        *[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], F.col("probability").alias(free)
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", sample_mixture),
]

#: The first stage is a trained model, which SQL cannot state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way goes when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return docs
