"""A training-data pipeline over ``documents``: each stage calls one operator of ``larkmill.llm``.

A stage takes ``(spark, docs, sf_dir)`` and works on every document that the stages before
it kept; the caller writes its result as Parquet and reads it again as the next stage's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm import decontaminate, neardup, packing, secrets, toxicity
from larkmill.llm.common import discard, materialize, written
from larkmill.llm.queries import table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; those without an id are scored like the rest."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: the first of those with the least id, or one without an id if none has one.

    Rows are told apart by a key of their own, so repeated rows, rows without an id and different
    texts that share an id are compared like all others. Texts without words are no duplicates.
    """
    keyed = materialize(docs.withColumn("near_row", F.monotonically_increasing_id()), "near-keyed")
    classes = neardup.near_duplicates(keyed, doc_id="near_row").select(F.col("doc_id").alias("near_row"), "class_id")
    ranked = classes.join(keyed.select("near_row", "doc_id"), "near_row")
    least = ranked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "near_row")).alias("kept"))
    return keyed.join(least.select(F.col("kept.near_row").alias("near_row")), "near_row", "left_semi").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go, whatever their id; null texts contain none, rows that repeat are treated alike."""
    return decontaminate.kept(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, with or without an id, as often as it occurs."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces, with the place of each in a training sequence.

    Documents without an id are packed too; of pieces of one length, which have one place to
    choose from, the order is that of a hash.
    """
    return packing.digest(packing.pack(docs, with_ids=False))


STAGES = [
    ("toxicity", remove_toxic),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, before, docs)  # what the stage has written besides
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, sketches and token ids are beyond SQL.
ORACLE_SQL = None
