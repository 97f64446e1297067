"""Cleans a corpus of documents and turns it into token ids.

Each stage takes what the one before kept, as written to the shared folder and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm import bpe, decontaminate, near_dedup, quality, secrets
from waymark.llm.common import shared_dir


def _measured(docs: DataFrame) -> DataFrame:
    """After texts have changed: n_chars as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules or are depleted, and the boilerplate lines of the others.

    Null, empty and short texts fail for their length and go; a very long text is judged whole. Equal texts of a host have one
    verdict, and a line counts once for them; a null host is a host. Repeated rows stay repeated, all columns stay.
    An empty table gives an empty one.
    """
    return _measured(quality.apply(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group (five words, similarity 0.8).

    Texts without words are in no group and stay; a very long text is one set of shingles; one of fewer than five words is one
    shingle. Rows that repeat an id and text become one; of equal ids with different texts each is judged by its text.
    Rows without id go where their group has an id, else one stays for each text. All columns stay. An empty table gives an
    empty one.
    """
    return near_dedup.apply(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of test items out, and drops documents that are mostly made of them.

    Null and empty texts have no words and stay; a very long text is gone through whole. Items that are null or empty
    match nothing, equal ones count once by their id. Repeated rows and all columns stay. Empty tables change nothing.
    """
    return _measured(decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of secrets, each different text being scanned once and its findings kept in a ledger.

    Null and empty texts have none; a very long text is scanned whole; overlapping spans become one mask. Repeated rows and all
    columns stay. An empty table gives an empty one.
    """
    return _measured(secrets.redact(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, decoded again to see that nothing is lost; in the place of the text.

    A null or empty text has no ids; a very long one is encoded in pieces at safe boundaries. Repeated rows stay, and so do all
    columns but the text, and those named n_tokens, ids or raw. An empty table gives an empty one.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kept = [c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids", "raw")]
    out = bpe.round_trip(docs.select(*kept, "text"), path, pattern)
    same = F.col("raw") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    ids = F.when(same, F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("decoded text differs: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")))))
    return out.select(*kept, F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again. What each does with nulls,
    empty and very long texts, repeated rows, ties, empty tables and other columns is said there."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what this stage has read is not needed again
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs


#: Components of a graph over whole tables are too slow in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
