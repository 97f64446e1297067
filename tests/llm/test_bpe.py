import hashlib
import random

import public_tokenizers as P
import pytest

from tests.llm import cases
from waymark.llm import bpe
from waymark.llm.queries import op5_byte_bpe

ARGS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
SMALL = "/root/testdata/sf0.001"


def expected(text):
    ids = bpe.encoding(*ARGS).encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def check(spark, d, docs):
    got = sorted(map(tuple, op5_byte_bpe(spark, d).collect()), key=repr)
    assert got == sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=repr)


def test_whole_table(spark):
    check(spark, SMALL, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_odd(spark, tmp_path):
    check(spark, cases.write(spark, tmp_path, documents=cases.odd(spark)), cases.odd(spark))
    assert op5_byte_bpe(spark, cases.write(spark, tmp_path, documents=cases.none(spark))).count() == 0
    out = bpe.encode(cases.odd(spark), *ARGS)
    assert out.columns == ["doc_id", "text", "source", "spans", "hash", "ids"]


def test_pieces_are_safe():
    enc, rng = bpe.encoding(*ARGS), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "'s", "é", "7", "!", "　", "'", "word"]) for _ in range(rng.randint(0, 60)))
        assert sum((enc.encode_ordinary(p) for p in bpe.pieces(text, 5)), []) == enc.encode_ordinary(text)


def test_decode_alone(spark):
    df = cases.odd(spark).select("text")
    assert all(bytes(r.raw) == (r.text or "").encode() for r in bpe.decode(bpe.encode(df, *ARGS), *ARGS).collect())


def test_unknown_id_fails(spark):
    with pytest.raises(Exception):  # noqa: B017
        bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>"), *ARGS).collect()
