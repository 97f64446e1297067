"""Queries that have brute-force tests too, held against their SQL."""

import pytest

from tests.llm import cases
from tests.llm.test_suffix_dedup import mixed
from tests.oracle import compare
from waymark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op6_suffix_dedup", "op10_benchmark_decontamination"])
def test_against_sql(spark, tmp_path, name):
    import random

    compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")
    texts = mixed(random.Random(9), 60)
    docs = cases.odd(spark).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 50)), "doc_id long, text string"))
    items = spark.createDataFrame([(1, "a few words"), (2, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor"), (None, "ab"), (3, None)], "item_id long, text string")
    compare(spark, QUERIES[name], SQL[name], cases.write(spark, tmp_path, documents=docs, benchmark=items), ("documents", "benchmark"))
