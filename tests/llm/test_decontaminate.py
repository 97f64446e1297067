import hashlib
import random
import re

from tests.llm import cases
from waymark.llm import decontaminate as D
from waymark.llm.queries import op10_benchmark_decontamination

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=8):
    held = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            held.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    sizes = {len(x) for x in held}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := held.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= g
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


def check(spark, d):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    got = sorted(map(tuple, op10_benchmark_decontamination(spark, d).collect()), key=repr)
    assert got == sorted(brute(read("documents", "doc_id"), read("benchmark", "item_id")), key=repr)
    return got


def test_whole_table(spark):
    assert any(r[2] for r in check(spark, SMALL))


def test_odd(spark, tmp_path):
    items = [(1, "same text of a few"), (2, None), (3, ""), (4, "no"), (4, "no id"), (None, "日本語"), (5, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem"), (5, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem")]
    b = spark.createDataFrame(items, "item_id long, text string")
    check(spark, cases.write(spark, tmp_path, documents=cases.odd(spark), benchmark=b))
    check(spark, cases.write(spark, tmp_path, documents=cases.odd(spark), benchmark=b.limit(0)))
    check(spark, cases.write(spark, tmp_path, documents=cases.none(spark), benchmark=b))


def test_random_and_blocks(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, n)))
    docs, items = [(i, text(60)) for i in range(150)], [(i, text(14)) for i in range(20)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 25):
        got = sorted((r.doc_id, r.n_words, r.n_hit, len(r.item_ids)) for r in D.find(df, b, block_words=size).collect())
        assert got == sorted(x[:4] for x in brute(docs, items))
    for size, held in ((25, 2), (10, 3), (25, 100)):  # in turns
        out = D.find(df, b, block_words=size, held=held).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r.item_ids)) for r in out) == sorted(x[:4] for x in brute(docs, items))
        assert all(sum(len(words(r.text[x.start : x.end])) for x in r.spans) == r.n_hit for r in out)


def test_clashing_columns(spark):
    b = spark.createDataFrame([(1, "same text of a few")], "item_id long, text string")
    docs = cases.odd(spark).selectExpr("*", "1 AS item_ids", "'x' AS N_HIT", "2 AS n_words")
    out = D.find(docs, b)
    assert out.columns == ["doc_id", "text", "source", "ids", "hash", "n_words", "n_hit", "item_ids", "spans"]
    assert out.count() == 12 and out.where("n_hit > 0").count() == 3
    assert D.remove(docs, b).columns == docs.columns


def test_remove(spark):
    clean = "nothing of the kind stands here at all today"
    item = "One two; three four five six seven eight nine"
    rows = [(1, f"{clean}. {item}! {clean}", 5), (2, item, 5), (3, clean, 5), (4, None, 5), (5, "", 5)]
    out = D.remove(spark.createDataFrame(rows, "doc_id long, text string, n_words int"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(1, f"{clean}. ! {clean}", 5), (3, clean, 5), (4, None, 5), (5, "", 5)]
