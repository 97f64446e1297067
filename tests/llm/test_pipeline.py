import random

import public_tokenizers as P

import corpus_pipeline as C
from tests.llm import cases
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as near, shingles
from waymark.llm import bpe, quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    prose = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**7)) for _ in range(k))
    item = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(i, prose(rng.randint(30, 80))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(110 + i, rows[5 + i][1] + " tail") for i in range(5)]
    rows += [(120, prose(40) + "\n" + item + ".\n" + prose(40)), (121, item + " " + item.upper() + "! so"), (122, prose(30) + " token=abcdef0123456789 " + prose(30))]
    rows += [(130, "short"), (131, None), (132, ""), (133, "x y z w v u t s " * 20), (122, rows[-1][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], [(1, item)]


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus()
    d = cases.write(spark, tmp_path, documents=spark.createDataFrame(rows, DOCS), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns == (DOCS_COLUMNS if k < 4 else ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"])
    want = {i for i, t, *_ in rows if len((t or "").split()) >= 20 and i != 133}
    assert kept[0].keys() == want
    pairs = [(i, t) for i, t, *_ in rows if i in want and i != 122] + [(122, kept[0][122].text)]
    assert kept[1].keys() == {i for i, _, _, ok in near(pairs, 5, 80) if ok} == want - {100, 101, 102, 103, 104, 110, 111, 112, 113, 114}
    assert spark.read.parquet(f"{d}/1").count() == len(kept[1])
    found = {i: n for i, _, n, *_ in leaks([(i, r.text) for i, r in kept[1].items()], items)}
    assert {i for i, n in found.items() if n} == {120, 121} and kept[2].keys() == kept[1].keys() - {121}
    assert "quick" not in kept[2][120].text and all(kept[2][i].text == kept[1][i].text for i in kept[2].keys() - {120})
    assert all(r.n_chars == len(r.text) for k in range(4) for r in kept[k].values())
    assert "[SECRET]" in kept[3][122].text and "abcdef0123456789" not in kept[3][122].text
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {i: enc.decode(r.ids) for i, r in kept[4].items()} == {i: r.text for i, r in kept[3].items()}
    assert {i: r.ids for i, r in kept[4].items()} == {r.doc_id: r.ids for r in C.run(spark, d).collect()}


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_odd_and_empty(spark, tmp_path):
    more = [(i, t, None, None, None) for i, t in [(1, None), (2, ""), (None, "a b c d e f g h i j k l m n o p q r s t u v w x"), (None, None), (3, "word " * 9000 + "y" * 70_000)]]
    for name, df in (("odd", spark.createDataFrame(more, DOCS)), ("empty", spark.createDataFrame([], DOCS))):
        d = cases.write(spark, tmp_path / name, documents=df, benchmark=spark.createDataFrame([(None, None)], "item_id long, text string"))
        assert [r.doc_id for r in C.run(spark, d).collect()] == ([None] if name == "odd" else [])


def test_extra_columns_stay(spark, tmp_path):
    """Columns whose names the stages use themselves, through each stage and all of them."""
    more = ["1 AS n_words", "'x' AS kept", "2 AS n_hit", "3 AS spans", "4 AS blob", "5 AS node", "6 AS removed", "7 AS component_id", "8 AS item_ids", "true AS base_failed"]
    rows, items = corpus()
    plain, own = spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows, DOCS).selectExpr("*", *more)
    b = spark.createDataFrame(items, "item_id long, text string")
    d = cases.write(spark, tmp_path / "own", documents=own, benchmark=b)
    for _, stage in C.STAGES[:4]:
        out = stage(spark, own, d)
        assert out.columns == own.columns
        assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, stage(spark, plain, d).collect()))
    last = C.run(spark, d)
    assert last.columns == ["doc_id", "lang", "source", "n_chars", *(m.split(" AS ")[1] for m in more), "n_tokens", "ids"]
    e = cases.write(spark, tmp_path / "plain", documents=plain, benchmark=b)
    assert sorted(map(str, last.select("doc_id", "n_tokens", "ids").collect())) == sorted(map(str, C.run(spark, e).select("doc_id", "n_tokens", "ids").collect()))
    odd = cases.odd(spark)
    for f in (quality.apply, secrets.redact):
        assert f(odd).columns == odd.columns
    assert shingles("", 5) == set()
