"""A pipeline over ``documents``: toxicity, exact and near duplicates, mixing, tokens.

A stage only makes rows and deletes nothing, so several results of stages may be alive at once. :func:`run` writes each stage's rows,
and has a folder of its own for what a stage stores on the way, which goes when the stage's rows are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, exact, jaccard, mixing, toxicity
from strandlake.llm.common import remove, shared_dir, table, work_folder
from strandlake.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half; null and empty texts score as those without any word."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text but for white space; null counts as empty, of repeated rows one stays."""
    return exact.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; texts without words are one group.

    Groups are made by SimHash, links at two bits or fewer as in op2, and joined by what fingerprints cannot see: all pairs with a Jaccard
    similarity of 0.8 or more over five-word shingles, counted exactly.
    """
    return jaccard.keep_dissimilar(docs, fingerprints=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whole; rows without words are taken no times."""
    return mixing.mix_rows(docs, table(spark, sf_dir, "labels"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    path, pattern = vocabulary()
    coded = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("r", bpe.round_trip(F.col("text"), path, pattern))
    return coded.select("doc_id", bpe.id_count(F.col("r.ids")).alias("n_tokens"), F.col("r.ids").alias("ids"), (F.col("r.decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("shingle_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("byte_bpe", tokenise),
]

#: Fingerprints, the classifier and token ids are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; only the last stage's folder stays.

    Null and empty texts, null ids, repeated rows and empty tables pass every stage as its operator says; extra columns
    of ``documents`` are carried up to the last stage, whose columns are its own.
    """
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, step in STAGES:
        with work_folder(spark, f"{place}/{name}-work"):
            step(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, f"{place}/{before}")
        before = name
    return docs
