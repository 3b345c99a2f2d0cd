"""The training-corpus pipeline over documents: drop poor texts, keep one of each group of near copies, drop leaked
benchmark items, mask secrets, and mix the sources.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents; the last returns the mix: how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, near_dup, quality, secret_scan
from millrace.llm.common import materialize, table, temporaries


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), least=0.7)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, Jaccard 0.8 or more."""
    return near_dup.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars that of the masked text."""
    out = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's copies in a mix of the sources by weights 3, 1, 2, of 150 % of all words, at most 2 copies."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)


STAGES = [
    ("quality_classifier", good),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", uncontaminated),
    ("secret_scan", masked),
    ("mixing", mixed),
]

#: Training and signatures have no SQL form: tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage writes besides its result, and the result before it, go once it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporaries(spark) as written:
            docs = materialize(stage(spark, docs, sf_dir), name)
            result = written.pop()
            written += [before] if before else []
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
