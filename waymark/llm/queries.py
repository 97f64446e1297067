"""The registered queries of this subpackage: thin projections of what its operators return."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm import bpe, common, decontaminate, licenses, maxent, near_dedup, quality, secrets, suffix_dedup, token_files, urls


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_maxent_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return maxent.score(docs, maxent.is_held_out(F.col("doc_id")))


def op2_line_frequency(spark: SparkSession, d: str) -> DataFrame:
    out = quality.judge(table(spark, d, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *quality.FIGURES, "base_failed", "kept", "removed_words")


def op3_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.groups(table(spark, d, "documents").select("doc_id", "text"), near_dedup.Settings(size=3, percent=85))


def op4_secret_ledger(spark: SparkSession, d: str) -> DataFrame:
    # A ledger of this run's own: every content is scanned once, written to it, and joined back from it. The kinds are those of
    # the SQL, where the span of a private key is the line before it; redact and the pipeline have all of it.
    found = secrets.find(table(spark, d, "documents").select("doc_id", "text"), kinds=secrets.KINDS)
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    base = [k.name for k in secrets.BASE]
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(of(*base)), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op5_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, path, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, d, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_license_join(spark: SparkSession, d: str) -> DataFrame:
    found = licenses.find(table(spark, d, "documents").select("doc_id", "text"))
    base, more = F.array_distinct(F.col("places.label")), F.col("blocks.label")
    word = lambda f: f(F.col("places.word")).cast("long")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        word(F.array_min).alias("first_word"),
        word(F.array_max).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_distinct(F.concat(base, more))).alias("labels"),
        "score",
    )


def op8_url_rules(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_perfect_hash_files(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4()}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    token_files.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    out = token_files.read(spark, folder)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select(F.col("key").alias("doc_id"), "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = decontaminate.find(docs, table(spark, d, "benchmark"))
    n = F.size("item_ids").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


QUERIES = {
    "op1_maxent_scores": op1_maxent_scores,
    "op2_line_frequency": op2_line_frequency,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_license_join": op7_license_join,
    "op8_url_rules": op8_url_rules,
    "op9_perfect_hash_files": op9_perfect_hash_files,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

SQL: dict[str, str] = {
    "op2_line_frequency": quality.sql(),
    "op3_minhash_near_dedup": near_dedup.sql(3, 85),
    "op4_secret_ledger": secrets.sql(),
    "op6_suffix_dedup": suffix_dedup.sql(),
    "op7_license_join": licenses.sql(),
    "op8_url_rules": urls.sql(),
    "op10_benchmark_decontamination": decontaminate.sql(),
}
