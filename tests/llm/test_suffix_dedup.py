import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tests.llm import cases
from waymark.llm import suffix_dedup as S
from waymark.llm.queries import op6_suffix_dedup


def brute(rows, n=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in rows:
        for k in range(len(b) - n + 1 if i is not None else 0):
            w = b[k : k + n]
            first[w] = min(first.get(w, i), i)
    for i, b in rows:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - n + 1):
            f = first.get(b[k : k + n])
            if f is not None and (i is None or f < i):
                gone[k : k + n] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        yield i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def check(spark, d):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, op6_suffix_dedup(spark, d).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    return got


def test_whole_table(spark):
    assert any(r[2] for r in check(spark, "/root/testdata/sf0.01"))


def mixed(rng, n):
    """Texts that share passages with small changes, repeat themselves, and are copied."""
    pool = ["".join(rng.choice("ab cé\n") for _ in range(rng.randint(30, 140))) for _ in range(12)] + ["x" * 90, "ab" * 60, "=-" * 26]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            if rng.random() < 0.5 and p:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("abz") + p[k + 1 :]
            parts.append(p[rng.randint(0, 20) :])
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixed(spark, tmp_path, seed, monkeypatch):
    """In small pieces of everything, and with all anchors frequent or none."""
    rng = random.Random(seed)
    if seed > 1:
        monkeypatch.setattr(S.remove_repeats, "__defaults__", (*S.remove_repeats.__defaults__[:2], {2: 6, 3: 0}[seed]))
    if seed > 1:
        monkeypatch.setattr(S, "CHUNK_BYTES", (2000, 2000))
        monkeypatch.setattr(S, "PRINTS", 300)
        monkeypatch.setattr(S, "CONTEXTS", 50)
        monkeypatch.setattr(S, "WINDOWS", 100)
    texts = mixed(rng, 150)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[rng.randrange(150)]) for i in range(20)] + [(7, texts[7]), (7, texts[8]), (None, texts[9]), (None, texts[9] + "q")]
    rng.shuffle(rows)
    check(spark, cases.write(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))


def test_odd(spark, tmp_path):
    check(spark, cases.write(spark, tmp_path / "a", documents=cases.odd(spark)))
    assert op6_suffix_dedup(spark, cases.write(spark, tmp_path / "b", documents=cases.none(spark))).count() == 0


def test_one_phrase_in_all_surroundings(spark, tmp_path, monkeypatch):
    """A phrase of fewer than 50 bytes, and one of 49 with one more, in thousands of texts: no task gets all of it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    phrase = "this phrase of 34 bytes is common."
    rows = [(i, " ".join([*(word() for _ in range(20)), phrase, rng.choice("xyz") * 16, *(word() for _ in range(20))])) for i in range(3000)]
    sizes = []
    real = S.earlier
    monkeypatch.setattr(S, "earlier", lambda found: (sizes.append(found), real(found))[1])
    monkeypatch.setattr(S, "CHUNK_BYTES", (20_000, 20_000))
    monkeypatch.setattr(S, "CONTEXTS", 500)
    monkeypatch.setattr(S.remove_repeats, "__defaults__", (*S.remove_repeats.__defaults__[:2], 100))
    check(spark, cases.write(spark, tmp_path, documents=spark.createDataFrame(rows, "doc_id long, text string")))
    of = sizes[0].selectExpr("bucket", "octet_length(hash) / 8 AS n").groupBy("bucket").sum("n").toPandas()["sum(n)"]
    assert of.max() < of.sum() / 10


def test_repeated_rows(spark, tmp_path):
    """Rows of one text, without id or of one id, thousands of times: they go as one."""
    a, b, c = "no id and many times " * 5, "one id and many times " * 5, "both of them and more " * 5
    rows = [(None, a)] * 3000 + [(5, b)] * 3000 + [(None, c), (None, c), (9, c), (9, c), (7, b + "x"), (2**63 - 1, a), (None, a + "y"), (None, "short"), (3, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, cases.write(spark, tmp_path, documents=df))


def test_clashing_columns(spark):
    docs = cases.odd(spark).selectExpr("*", "1 AS d", "'x' AS chunk", "2 AS none", "3 AS __a", "'k' AS kept", "4 AS times")
    want = sorted(map(str, S.remove_repeats(cases.odd(spark)).collect()))
    assert sorted(map(str, S.remove_repeats(docs).collect())) == want


def test_equal_keys_of_different_bytes(monkeypatch):
    """Where hashes of contexts agree though their bytes do not, they get others."""
    real = S.Anchors.__init__

    def few(self, raw):
        real(self, raw)
        self.key = self.key % np.uint64(7)

    monkeypatch.setattr(S.Anchors, "__init__", few)
    texts = mixed(random.Random(1), 60)
    x = S.Chunk(pd.DataFrame({"text": texts, "d": range(60)}))
    bytes_ = [x.flat[a : a + n + S.LENGTH].tobytes() for a, n in zip(x.at.tolist(), x.more.tolist(), strict=True)]
    assert len({*zip(bytes_, x.key.tolist(), strict=True)}) == len({*bytes_}) == len({*x.key.tolist()}) > 20
    one = np.zeros(len(x.at), dtype=np.int64)
    assert [not u for u in S.unequal(x.flat, x.at, x.at[one], x.more + S.LENGTH, x.more[one] + S.LENGTH)] == [b == bytes_[0] for b in bytes_]


def test_quicksort():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 1), (1, 1), (2000, 3), (2000, 10**9), (500, 1)):
        run = np.sort(rng.integers(0, 9, n))
        v = rng.integers(0, kinds, n).astype(np.uint64)
        order, part = S._quicksort(v, run)
        pairs = [(int(run[i]), int(v[i])) for i in order]
        assert pairs == sorted(zip(run.tolist(), v.tolist(), strict=True)) and sorted(order.tolist()) == list(range(n))
        assert [part[i] != part[i - 1] for i in range(1, n)] == [pairs[i] != pairs[i - 1] for i in range(1, n)]


def test_sorted_runs():
    rng = np.random.default_rng(3)
    for shallow in (0, 1, 2, 5):
        words = rng.integers(0, 2, (500, 5)).astype(np.uint64)
        group = rng.integers(0, 6, 500)
        order, starts = S.sorted_runs(words, group, shallow)
        keys = [(int(group[i]), *map(int, words[i])) for i in order]
        assert sorted(order.tolist()) == list(range(500)) and starts.tolist() == [i for i in range(500) if i == 0 or keys[i] != keys[i - 1]]
        assert len({keys[i] for i in starts}) == len(starts)
