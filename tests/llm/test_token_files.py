import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers as P
from tokenizers import Tokenizer

from tests.llm import cases
from waymark.llm import token_files as T
from waymark.llm.queries import op9_perfect_hash_files

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)  # as it is: nothing sets it otherwise


def expected(rows):
    start = 0
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        yield k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(map(tuple, op9_perfect_hash_files(spark, d).collect())) == list(expected(rows))


def test_odd(spark, tmp_path):
    docs = cases.odd(spark).where("doc_id is not null")
    got = sorted(map(tuple, op9_perfect_hash_files(spark, cases.write(spark, tmp_path / "a", documents=docs)).collect()))
    assert got == list(expected([(r.doc_id, r.text) for r in docs.collect()]))
    none = sorted(map(tuple, op9_perfect_hash_files(spark, cases.write(spark, tmp_path / "b", documents=cases.odd(spark).where("doc_id is null"))).collect()), key=str)
    assert {x[0] for x in none} == {None} and {x[1] for x in none} == {0, none[0][2], none[1][2]} & {x[1] for x in none}
    assert op9_perfect_hash_files(spark, cases.write(spark, tmp_path / "c", documents=cases.none(spark))).count() == 0
    # Rows without key come first, in any order, and then all others as the keys rise.
    all_ = sorted(map(tuple, op9_perfect_hash_files(spark, cases.write(spark, tmp_path / "d", documents=cases.odd(spark))).collect()), key=lambda r: r[1])
    assert [r[0] for r in all_] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert [r[1] for r in all_] == [sum(x[2] for x in all_[:i]) for i in range(12)]
    assert sorted((r[0] or 0, *r[2:]) for r in all_) == sorted((r.doc_id or 0, *x[2:]) for r in cases.odd(spark).collect() for x in expected([(r.doc_id, r.text)]))


def test_clashing_columns(spark, tmp_path):
    """Columns named like those of the files are not read."""
    docs = cases.odd(spark).where("doc_id is not null").selectExpr("*", "1 AS part", "'x' AS payload", "2 AS least", "3 AS start", "'k' AS keys")
    assert sorted(map(tuple, op9_perfect_hash_files(spark, cases.write(spark, tmp_path, documents=docs)).collect())) == list(expected([(r.doc_id, r.text) for r in docs.collect()]))


def test_shards_and_lookup(spark, tmp_path):
    docs = spark.createDataFrame([(i * 7, f"text no {i} " * (i % 5)) for i in range(300)], "doc_id long, text string").repartition(3)
    T.write(docs, str(tmp_path / "s"), PATH, 1, shard_bytes=500, part_bytes=(3000, 3000))
    assert spark.read.parquet(str(tmp_path / "s/shards")).count() > 10
    rows = {r.key: (r.start, bytes(r.ids)) for r in T.read(spark, str(tmp_path / "s")).collect()}
    assert [rows[k][0] for k in sorted(rows)] == [x[1] for x in expected([(r.doc_id, r.text) for r in docs.collect()])]
    got = {r.key: (r.start, bytes(r.ids)) for r in T.lookup(spark, str(tmp_path / "s"), [0, 7, 8, 700, 2093, 10**9, -5]).collect()}
    assert got == {k: rows[k] for k in (0, 7, 700, 2093)}
    assert T.lookup(spark, str(tmp_path / "s"), []).count() == 0
    every = {r.key: (r.start, bytes(r.ids)) for r in T.lookup(spark, str(tmp_path / "s"), range(2100)).collect()}
    assert every == rows


def test_lookup_reads_what_it_needs(spark, tmp_path):
    """Ranges are compared in the scan, the index is read without payloads, and each shard is a row group of its own."""
    folder = str(tmp_path / "s")
    T.write(spark.range(2000).selectExpr("id AS doc_id", "concat('text no ', id) AS text").repartition(3), folder, PATH, 1, shard_bytes=2000, part_bytes=(8000, 8000))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = T.places_of(spark, folder, np.array([5, 1700]))._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(least,5)" in plan and "GreaterThanOrEqual(most,1700)" in plan and "payload" not in plan, plan
    plan = T.lookup(spark, folder, [5])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(part," in plan and "EqualTo(no," in plan, plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for f in (tmp_path / "s/shards").glob("*.parquet"):
        meta = pq.read_metadata(f)
        assert meta.num_row_groups == meta.num_rows > 1


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 20_000):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64))
        h = T.PerfectHash.of(keys)
        assert sorted(h(keys)) == list(range(len(keys))) and len(h.bits) * 64 < 4 * n + 1000
        foreign = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, 1000, dtype=np.int64), keys)
        at = h(foreign)
        prints = np.zeros(max(len(keys), 1), dtype=np.uint32)
        prints[h(keys)] = T.prints_of(keys)
        assert ((at >= 0) & (prints[at] == T.prints_of(foreign))).sum() == 0


def test_pieces_equal_whole_texts():
    rng = np.random.default_rng(2)
    parts = ["Word", "word,", "ΣΑΣ", "ς.", "é", "é", "́x", "İ", "K", "don't", "'s", "...", "a.b", "a..", "1,", "|", "\x01", "\x1c", "\x85", " ", "\n", "\t", " ", "  ", "<|endoftext|>", "日本.", "😀!", "x" * 100, "ªİ,", "İ.", "µ,", "º$$$", "ß!!", "ʼN;", "ŉ.", "ǰ?", "é,'s", "word###", "#word"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.integers(0, 12))) for _ in range(2000)] + [None, ""]
    p = T.Pieces(PATH, 2)
    for i in range(0, len(texts), 300):
        for t, raw in zip(texts[i : i + 300], p.of(texts[i : i + 300]), strict=True):
            assert np.frombuffer(raw, "<u2").tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_special_tokens_as_the_library(spark, tmp_path):
    """Strings of special tokens in texts, against a tokenizer that nothing has set."""
    texts = ["a <|endoftext|> b", "Word<|endoftext|>word", "a <|ENDOFTEXT|> b <|endoftext |>", " <|endoftext|>\n<|startoftext|>x", "<|endoftext|><|endoftext|>", "é<|endoftext|>\u0301x ΑΣ<|endoftext|>Σ", "<|<|endoftext|>|>", "\x01<|startoftext|>\x01", "none"]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [320, 49407, 321]
    assert [np.frombuffer(x, "<u2").tolist() for x in T.Pieces(PATH, 2).of(texts)] == want
    d = cases.write(spark, tmp_path, documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op9_perfect_hash_files(spark, d).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 1], dtype="<u4").tobytes())) for i, x in enumerate(want)}
