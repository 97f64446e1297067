import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from waymark.llm import near_dedup as N
from waymark.llm.common import space_words
from waymark.llm.components import components
from waymark.llm.queries import op3_minhash_near_dedup
from waymark.llm.sketch import parities, shingle_sets, sketches


def shingles(text, size):
    w = space_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(rows, size, percent):
    """Rows as (id, text). Every pair that shares a shingle is compared."""
    sets = [shingles(t, size) for _, t in rows]
    first, parent = {}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            parent[i] = first.setdefault(frozenset(s), i)
            if parent[i] == i:
                for x in s:
                    held[x].append(i)
    for i, s in enumerate(sets):
        if s and first[frozenset(s)] == i:
            for j, n in Counter(j for x in s for j in held[x] if j < i).items():
                if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None and sets[i]:
            least[find(i)] = min(k, least.get(find(i), k))
    for i, (k, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else k
        yield k, len(sets[i]), c, c == k


def check(spark, df, settings):
    got = sorted(map(tuple, N.groups(df, settings).collect()), key=repr)
    want = sorted(brute([(r.doc_id, r.text) for r in df.collect()], settings.size, settings.percent), key=repr)
    assert got == want
    return got


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85))
    assert sorted(map(tuple, op3_minhash_near_dedup(spark, d).collect())) == want
    assert any(not r[3] for r in want)


def test_odd(spark):
    check(spark, cases.odd(spark), N.Settings())
    assert N.groups(cases.none(spark)).count() == 0 and N.apply(cases.none(spark)).count() == 0
    out = N.apply(cases.odd(spark))
    # Of two equal texts, one of them in two rows, one row stays; null, empty and blank texts are linked with nothing.
    assert out.columns == cases.odd(spark).columns
    assert sorted(out.select("doc_id").toPandas()["doc_id"].dropna()) == [1, 2, 3, 4, 5, 7, 8, 9] and out.where("doc_id is null").count() == 2


def near(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_chains_and_stars(spark, block):
    """Copies that are linked with a centre or their neighbours only, whose smallest member is none of these."""
    rng = random.Random(block)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        rows += [near(rng, base, rng.randint(2, 5)) for _ in range(40)] + [base]
        x = base
        for _ in range(15):
            x = near(rng, x, 3)
            rows.append(x)
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id long, text string").repartition(4)
    check(spark, df, N.Settings(block=block, wide=2 * block))


def test_short_sets_lose_no_link(monkeypatch, spark):
    """With ends of few bits nearly all sets seem alike: what they find is verified, and whole sets then settle the rest."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 500, 60)) for _ in range(50)] + [np.unique(np.r_[np.arange(60), rng.integers(0, 500, 4)]) for _ in range(6)]
    n, label = np.array([len(x) for x in sets]), np.arange(len(sets))
    want = {(i, j) for i in range(56) for j in range(i) if N.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j], 80)}
    exact = N._union(sets, n, label, sets, n, label, 80)
    assert {frozenset(x) for x in exact} <= {frozenset(x) for x in want} and len(exact) >= 5
    ends = [np.unique(x.astype(np.uint32) % 64) for x in sets]
    assert len(N._union(ends, n, label, ends, n, label, 80)) >= len(exact)
    real = N._sets
    monkeypatch.setattr(N, "_sets", lambda *a: real(*a).withColumn("short", N.F.lit(np.arange(3, dtype=np.uint32).tobytes())))
    test_chains_and_stars(spark, 1024)


def test_parities_lose_no_link():
    """Of sets of many sizes, with links and just not, and so few parities a step that several are needed."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[base[: (n := int(rng.integers(5, 400)))][rng.random(n) < 0.97], rng.integers(0, 2**63, int(rng.integers(0, 8))).astype(np.uint64)]) for _ in range(150)]
    n, label = np.array([len(x) for x in sets]), np.arange(150) // 2
    words = [parities(x) for x in sets]
    linked = np.array([[label[i] != label[j] and N.linked(len(np.intersect1d(sets[i], sets[j])), n[i], n[j], 80) for j in range(150)] for i in range(150)])
    for cells in (1 << 22, 500):
        ask, tell = N._near(words[:70], n[:70], label[:70], words, n, label, 80, cells)
        assert (ask >= linked[:70].any(axis=1)).all() and (tell >= linked[:70].any(axis=0)).all() and not ask.all()
    assert (N._folded(parities(base)[None], 4)[0] == np.packbits((np.bincount((base % 256).astype(int), minlength=256) & 1).astype(np.uint8), bitorder="little").view("<u8")).all()


def test_sets_of_one_hash(monkeypatch, spark):
    """Different sets whose first 64 bits are equal are not one."""
    real = N.set_ids
    monkeypatch.setattr(N, "set_ids", lambda sets: (real(sets)[0] % 2, real(sets)[1]))
    test_chains_and_stars(spark, 1024)
    check(spark, cases.odd(spark), N.Settings())


def test_clashing_columns(spark):
    docs = cases.odd(spark).selectExpr("*", "1 AS id", "'x' AS node", "2 AS n_shingles", "3 AS component_id", "'k' AS kept", "4 AS bands")
    check(spark, docs, N.Settings())
    assert N.apply(docs).columns == docs.columns and N.apply(docs).count() == 10


def test_tables_that_nobody_needs_go(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = {*os.listdir(folder)}
    N.groups(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), N.Settings(size=3, percent=85)).collect()
    assert len({*os.listdir(folder)} - before) == 2


def test_sketches():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 100, 5000)]
    assert not (sketches(sets, 128) == np.uint64(0xFFFFFFFFFFFFFFFF)).any()
    far = []
    for _ in range(200):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (80, 10, 10))
        x = sketches([np.unique(np.r_[both, a]), np.unique(np.r_[both, b])], 128)
        far.append((x[0] == x[1]).mean() - 0.8)
    assert abs(np.mean(far)) < 0.02 and np.std(far) < 1.2 * (0.8 * 0.2 / 128) ** 0.5
    assert len(shingle_sets(["a b", "A  b", "a b c d e f"], 5)[0]) == 1


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}
    for _ in range(100):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: c for x, c in parent.items() if any(a != b and x in (a, b) for a, b in links)}
