import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from waymark.llm import maxent as M
from waymark.llm.common import space_words
from waymark.llm.queries import op1_maxent_scores

D = "/root/testdata/sf0.01"


def base(rows):
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in [*space_words(t), "end"])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        w = [*space_words(t), "end"]
        yield i, out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)


def check(spark, d, rows):
    got = sorted(map(tuple, op1_maxent_scores(spark, d).collect()), key=repr)
    want = sorted(base(rows), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want], rtol=1e-9, atol=1e-9)
    assert all(math.isfinite(x[6]) and x[6] < 0 for x in got)
    return got


def test_whole_table_and_held_out_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    got = check(spark, D, rows)
    held = [x for x in got if x[1]]
    n, b, s = (sum(x[k] for x in held) for k in (2, 5, 6))
    print(f"held out, log10 a token: base {b / n:.4f}, model {s / n:.4f}")
    assert s / n > b / n + 0.05


def test_odd(spark, tmp_path):
    check(spark, cases.write(spark, tmp_path / "a", documents=cases.odd(spark)), [(r.doc_id, r.text) for r in cases.odd(spark).collect()])
    assert op1_maxent_scores(spark, cases.write(spark, tmp_path / "b", documents=cases.none(spark))).count() == 0
    held = cases.odd(spark).select("doc_id", "text")
    assert M.score(held, F.lit(True)).count() == 12  # nothing to learn from


@pytest.mark.parametrize("head", [1 << 18, 8])
def test_small_head_gives_the_same_base(spark, head):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(i % 40))) for i in range(200)] + [(3, "twice twice x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, M.score(df, M.is_held_out(F.col("doc_id")), M.Settings(head=head, vocabulary=4, fan_in=2)).collect()))
    want = sorted(base(rows))
    assert [x[:5] for x in got] == [x[:5] for x in want] and np.allclose([x[5] for x in got], [x[5] for x in want])


def test_token_ids():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "B", "é", ".", "ab", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\x00"]) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "x" * 600_000, " lead", "trail "]
    ids, sizes = M.token_ids(texts)
    words = [w for t in texts for w in [*space_words(t), "end"]]
    assert len(ids) == len(words) and sizes.tolist() == [len(space_words(t)) + 1 for t in texts]
    assert len({*zip(ids.tolist(), words, strict=True)}) == len({*ids.tolist()}) == len({*words})
    one = lambda w: int(M.token_ids([w])[0][0])
    assert one("xxing") % 64 == one("Ying.") % 64 == one("ring,\"") % 64


def test_sums():
    rng = np.random.default_rng(1)
    n = np.array([1, 8, 9, 2, 30, 7])
    start, g = np.cumsum(n) - n, rng.standard_normal((20, 3))
    at = rng.integers(0, 20, n.sum())
    assert np.allclose(M._sums(g, at, start, n), np.add.reduceat(g[at], start, axis=0))


def test_probabilities_sum_to_one(spark):
    """Over all words of the training texts, and one that was never seen for each class, after several contexts."""
    rows = [(" ".join(f"{'abc'[i % 3]}{(i + j) % 9}{'xyz'[i % 3]}" for j in range(30)),) for i in range(60)]
    df = spark.createDataFrame(rows, "text string")
    s = M.Settings(vocabulary=8, row_bits=10)
    counts = M.count_words(df, "text", s).cache()
    m = M.train(df, "text", counts, s, 1000)
    c = {r.h & (2**64 - 1): r.c for r in counts.collect()}
    for context in ([], [b"a1x"], [b"a1x", b"new"]):
        ids, total = np.array([M.token_ids([w.decode()])[0][0] for w in context], dtype=np.uint64), 0.0
        for k in [*c, *range(M.CLASSES)]:
            x = np.append(ids, np.uint64(k))
            rows_, before = m.features(x, np.array([0]))
            p = 10 ** m.class_logs(rows_[:, -1:], np.array([k & 63]))[0] * 10 ** m.words[before[-1], m.places(x)[1][-1]]
            total += p * ((c.get(k, 0) + 1) / 10 ** m.rest[k & 63] if m.places(x)[1][-1] >= s.vocabulary else 1)
        assert abs(total - 1) < 1e-4


def some(spark, n=400):
    rng = random.Random(12)
    words = [f"{a}{b}{c}" for a in "abcd" for b in "xyz" for c in ("ing", "ed", "s,", "")]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.1)), 47)] + ("Q" * (rng.random() < 0.02)) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + rows[:5], spark.createDataFrame(rows + rows[:5], "doc_id long, text string")


SMALL = M.Settings(head=20, vocabulary=8, row_bits=6, batch=64, piece_bytes=1500, piece_models=0, fan_in=3, chunks=4)


def test_partitions_change_no_score(spark):
    """Nor do batches: every layout gives the same scores."""
    _, df = some(spark)
    of = lambda x: sorted((r.doc_id, r.score, r.base_score) for r in M.score(x, M.is_held_out(F.col("doc_id")), SMALL).collect())
    want = of(df.repartition(1))
    for x in (df.repartition(4), df.repartition(16).orderBy("text"), df.repartition(3, "text")):
        got = of(x)
        assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1:] for x in got], [x[1:] for x in want], rtol=1e-12, atol=1e-9)


def test_score_by_hand(monkeypatch, spark):
    """Each token's class and word by the model's definition, one after the other, with the counts of all words."""
    rows, df = some(spark)
    held = []
    real = M.train
    monkeypatch.setattr(M, "train", lambda *a: held.append(real(*a)) or held[0])
    got = sorted((r.doc_id, r.score) for r in M.score(df, M.is_held_out(F.col("doc_id")), SMALL).collect())
    m, s = held[0], held[0].settings
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    hashed = lambda t: [int(x) for x in M.token_ids([t])[0]]
    counts = Counter(x for i, t in rows if not out(i) for x in hashed(t))
    vocabulary = {int(x): k for k, x in enumerate(m.head[: s.vocabulary])}
    assert len(m.head) < len(counts) and sorted(counts.values())[-len(m.head):] == sorted(m.head_counts.tolist())
    row = lambda x, k: (int(M.mix(np.array([(x * 7 + k) % 2**64], dtype=np.uint64))[0]) >> (64 - s.row_bits)) + (k << s.row_bits)
    mixed = lambda x: int(M.mix(np.array([x], dtype=np.uint64))[0])
    rest = [math.log10(1 + sum(c + 1 for w, c in counts.items() if w % 64 == k and w not in vocabulary)) for k in range(64)]
    want = []
    for i, t in rows:
        one, two, total = 0, 0, 0.0
        for w in hashed(t):
            z = (m.weights[row(one, 0)] + m.weights[row(two, 1)] + m.weights[row((mixed(two) + one) % 2**64, 2)] + m.bias).astype(float)
            total += (z[w % 64] - math.log(np.exp(z).sum())) / math.log(10)
            total += float(m.words[one % 64, vocabulary.get(w, s.vocabulary + w % 64)])
            if w not in vocabulary:
                total += math.log10(counts[w] + 1) - rest[w % 64]
            one, two = w, one
        want.append((i, total))
    want.sort()
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=1e-3)


def test_steps_by_hand():
    """A learner's weights after some steps, against gradients token by token."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aing", "bed", "cs", "d"]) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    s = M.Settings(vocabulary=4, row_bits=5, batch=50)
    rows = M.FEATURES << 5
    bias = np.linspace(-1, 1, 64).astype(np.float32)
    m = M.Model(s, np.arange(3, dtype=np.uint64), np.arange(3), 9, 3, bias, np.zeros(64), np.zeros((rows, 64), dtype=np.float32), np.zeros(rows, dtype=np.float32))
    own = M.Learner(m, 1)
    for i in range(0, 20, 3):  # in any portions
        own.feed(texts[i : i + 3])
    parts = list(own.result())
    ids, sizes = M.token_ids(texts)
    at, _ = m.features(ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    w, seen = np.zeros((rows, 64)), np.zeros(rows)
    for a in range(0, len(ids), 50):
        g = np.zeros((rows, 64))
        for k in range(a, min(a + 50, len(ids))):
            z = w[at[:, k]].sum(axis=0) + bias
            e = -np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            e[int(ids[k]) % 64] += 1
            for r in at[:, k]:
                g[r] += e
                seen[r] += 1
        w += g * (s.rate / np.sqrt(1 + seen))[:, None]
    assert np.allclose(own.m.weights, w, atol=1e-4) and (own.seen == seen).all()
    assert sum(n.sum() for kind, _, _, n, _ in parts if kind) == len(ids) and sum(n.sum() for kind, _, _, n, _ in parts if not kind) == 3 * len(ids)


def test_clashing_columns(spark):
    docs = cases.odd(spark).selectExpr("*", "1 AS score", "'x' AS piece", "2 AS held_out", "3 AS h", "'k' AS n_tokens")
    out = M.score(docs, M.is_held_out(F.col("doc_id")), M.Settings())
    assert out.columns == ["doc_id", "source", "ids", "spans", "hash", "piece", "h", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert out.count() == 12


def test_sizes_grow():
    sizes = [M.Settings().sized(n, n // 20) for n in (1000, 10**6, 10**8, 10**10, 10**13)]
    assert [s.row_bits for s in sizes] == [12, 12, 15, 17, 17] and [s.vocabulary for s in sizes] == [1 << 14, 1 << 14, 1 << 16, 1 << 16, 1 << 16]
    assert M.Settings(row_bits=3, vocabulary=5).sized(10**9, 10**9) == M.Settings(row_bits=3, vocabulary=5)
