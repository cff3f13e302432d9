"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import documents, unused
from factweave.llm.decontaminate import drop_contaminated
from factweave.llm.lines import dedup_lines
from factweave.llm.mixing import mix_sources
from factweave.llm.neardup import drop_similar
from factweave.llm.toxicity import NAMES, fit, held_out_rows, score_toxicity
from factweave.plans.staging import stage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels of four fifths, is under one half."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out_rows())
    names = unused(docs, *NAMES)
    return score_toxicity(docs, model, names=tuple(names)).where(F.col(names[0]) < 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one occurrence of each line; ``n_chars`` follows the text."""
    (count,) = unused(docs, "n_lines_removed")
    out = dedup_lines(docs, exact_words=1, count=count)
    return out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, Jaccard similarity of 0.8."""
    return drop_similar(docs, k=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document goes into the mix."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Learned scores, hashes other than MD5 and components have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; the result is that of the last.

    Nulls in any column, empty texts, repeated rows, no rows, and columns of any name are the operators' to handle:
    a row without a text is never toxic, has no lines, is like all others without words, and is not taken.
    """
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
