"""Corpus pipeline: quality, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept. All but the last return the columns of ``documents``; the last returns packed
pieces. ``run`` writes every stage's rows as Parquet in the shared checkpoint folder and
reads them back for the next one.

Null texts are empty documents, null keys are kept as they are, repeated rows go through
like any others, further columns are carried along, and an empty table gives empty
results in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainprep.llm import decontaminate, dedup, packing, pii, quality
from trainprep.llm.common import stored
from trainprep.llm.queries import quality_model
from trainprep.plans.registry import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, prefix="__")
    return scored.where(F.col("__predicted") == 1).select(*[f"`{c}`" for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars is the length of the text that is left.
    Texts without personal data are unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    clean = pii.sanitise(docs.select(row.alias("__row"), F.col("text").alias("__text")), text="__text")
    changed = {"text": F.col("sanitised"),
               "n_chars": F.when(F.col("sanitised") == F.col("__text"), F.col("__row.n_chars")).otherwise(
                   F.coalesce(F.length("sanitised").cast("long"), F.col("__row.n_chars")))}
    return clean.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens. The executors still hold
    what earlier stages took, so few words are kept."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), eos=1, capacity=4096, cache_words=50_000)


STAGES = [("quality_classifier", quality_stage), ("near_dedup", dedup_stage),
          ("decontamination", decontamination_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: A trained classifier and a tokenizer cannot be written in SQL; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
