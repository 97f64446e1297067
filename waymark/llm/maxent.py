"""Hashed maximum-entropy language model.

A token's probability is that of its class given the words before it, times that of the word within the class:

* class: a softmax over weights of hashed features, which are the last word, the one before it (skip) and both
  together (n-gram); biases are the classes' frequencies;
* word within its class: a softmax over a weight for the word and one for the word after a class. Words beyond the
  vocabulary share one place in each class, and their counts tell them apart there.

A word's class comes from its ending, so every word has one, seen or not. Words are known by 58 bits of hash and 6 of class.
"""

from __future__ import annotations

import copy
import functools
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import cut, cut_rows, drop, lists, release, slices, with_columns
from waymark.llm.sketch import mix

CLASSES = 64
FEATURES = 3
_MARKS = b".,;:!?\"')"
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """How large the model is and how it learns. What is not given here follows from the corpus, and grows with it as far as
    workers can hold the model."""

    #: Words whose counts every task knows; the counts of all others come by a join.
    head: int = 1 << 18
    #: Words with a place of their own in their class: a 16th of all different words, as a power of two within VOCABULARY_BITS.
    vocabulary: int | None = None
    #: Weight rows of each kind of feature, as a power of two: four times the root of the number of tokens, within ROW_BITS.
    row_bits: int | None = None
    batch: int = 8192
    rate: float = 0.5
    #: Tokens that a task counts before it hands on their numbers.
    counted: int = 3_000_000
    #: Bytes of text that are learnt from in one go, at least; and as many times the model's bytes.
    piece_bytes: int = 2 << 20
    piece_models: int = 1
    #: Times at which what pieces have learnt is brought together.
    rounds: int = 3
    #: Parts of a gradient, and gradients added in one task.
    chunks: int = 32
    fan_in: int = 32
    smoothing: float = 2.0

    def sized(self, tokens: int, words: int) -> Settings:
        """With the sizes that follow from the numbers of tokens and of different words."""
        bits = lambda x, ends: min(max(x, ends[0]), ends[1])
        return replace(
            self,
            row_bits=self.row_bits if self.row_bits is not None else bits((tokens.bit_length() + 4) // 2, ROW_BITS),
            vocabulary=self.vocabulary if self.vocabulary is not None else 1 << bits(words.bit_length() - 4, VOCABULARY_BITS),
        )


#: The largest model has 3 * 2^17 rows of 64 weights (100 MB) and 2^16 words of 64 numbers (17 MB).
ROW_BITS, VOCABULARY_BITS = (12, 17), (14, 16)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_MARK = np.array([b in _MARKS for b in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts that are hashed at a time.
_BLOCK = 1 << 18


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far has bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=_U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 2 * _BLOCK)
            make = lambda b: np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(m, b, dtype=_U))])
            self.up, self.down = make(_U(_BASE)), make(_U(pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()
#: The end of a text; no word's bytes can be none.
END = mix(np.array([_BASE], dtype=_U))[0] >> _U(6) << _U(6)


def _block_ids(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = _LOWER[np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)]
    white = _WHITE[raw]
    turn = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        turn = np.concatenate([[0], turn])
    start, end = turn[::2], turn[1::2]
    # A word's hash is a sum over its bytes, the same wherever it stands, as a difference of sums up to a place.
    up, down = _powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum(_BYTE[raw] * down[: len(raw)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * up[start])
    # Its class: the last three bytes before up to two marks at its end.
    last = end - 1
    for _ in range(2):
        last -= _MARK[raw[last]] & (last > start)
    tail = raw[last].astype(_U)
    for k in (1, 2):
        tail = tail * _U(257) + np.where(last - k >= start, raw[np.maximum(last - k, 0)], 0).astype(_U)
    ids = h >> _U(6) << _U(6) | (mix(tail) >> _U(58))
    ends = np.cumsum([len(r) + 1 for r in raws])
    sizes = np.diff(np.searchsorted(start, ends), prepend=0)
    return np.insert(ids, np.cumsum(sizes), END), sizes + 1


def token_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and one end, and the number of tokens of each text."""
    out, block, size = [], [], 0
    for t in texts:
        block.append((t or "").encode())
        size += len(block[-1])
        if size >= _BLOCK:
            out.append(_block_ids(block))
            block, size = [], 0
    if block:
        out.append(_block_ids(block))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


class Table:
    """From hashes to places in a list of them, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.at = np.zeros(size + 64, dtype=_U), np.full(size + 64, -1, dtype=np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            if step >= 64:
                raise ValueError("hashes are not spread evenly")
            slot = self._slot(keys[left]) + step
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several at one place the last has it
            self.keys[slot[free]] = keys[left[free]]
            there = self.at[slot] == left
            left, step = left[~there], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, slot, left = np.full(len(keys), -1, dtype=np.int32), self._slot(keys), np.arange(len(keys))
        for step in range(self.steps):
            s = slot[left] + step
            at = self.at[s]
            hit = (at >= 0) & (self.keys[s] == keys[left])
            out[left[hit]] = at[hit]
            left = left[~hit & (at >= 0)]
        return out


def count_words(docs: DataFrame, text: str, s: Settings) -> DataFrame:
    """h, c: the tokens of all texts, counted in each task first."""

    def run(batches):
        held, n = [], 0
        for piece in chain.from_iterable(slices(b, text) for b in batches):
            held.append(token_ids(piece.column(text).to_pylist())[0])
            n += len(held[-1])
            if n > s.counted:
                yield from _counted(held)
                held, n = [], 0
        if held:
            yield from _counted(held)
        release()

    return docs.select(text).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _counted(held: list[np.ndarray]):
    h, c = np.unique(np.concatenate(held), return_counts=True)
    for i in range(0, len(h), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].view(np.int64)), pa.array(c[i : i + 50_000])], names=["h", "c"])


def head_of(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, at most size of them, by falling count.

    Words are counted by the logarithm of their count; from these few numbers comes the least count of the head.
    """
    level = F.floor(64 * F.log2("c"))
    have, least = 0, 1 << 62
    for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("l")).collect():
        if have + r["n"] > size:
            break
        have, least = have + r["n"], r["c"]
    rows = counts.where(F.col("c") >= least).toPandas()
    h, c = rows["h"].to_numpy(dtype=np.int64).view(_U), rows["c"].to_numpy(dtype=np.int64)
    order = np.lexsort((h, -c))
    return h[order], c[order]


@dataclass
class Model:
    """Everything that scoring needs."""

    settings: Settings
    head: np.ndarray
    head_counts: np.ndarray
    n: int
    v: int
    bias: np.ndarray
    rest: np.ndarray  # log10 of the mass that the words beyond the vocabulary share, by class
    weights: np.ndarray
    seen: np.ndarray  # how often a piece has seen each row's feature, on the whole
    words: np.ndarray | None = None  # log10 of a word in its class, by the class before

    def __post_init__(self):
        self.table = Table(self.head)
        k = min(self.settings.vocabulary, len(self.head))
        #: The class of each place of the vocabulary, -1 where there is no such word, and of the places that others share.
        self.class_of = np.concatenate([(self.head[:k] & _U(CLASSES - 1)).astype(np.int64), np.full(self.settings.vocabulary - k, -1), np.arange(CLASSES)])

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the head, or -1, and place among the words and shared places of the vocabulary."""
        at = self.table(ids)
        k = self.settings.vocabulary
        return at, np.where((at >= 0) & (at < k), at, k + (ids & _U(CLASSES - 1)).astype(np.int64))

    def features(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight rows of each token's features, and the class before it. first: places where texts begin."""
        one = np.concatenate([np.zeros(1, dtype=_U), ids[:-1]])
        one[first] = 0
        two = np.concatenate([np.zeros(1, dtype=_U), one[:-1]])
        two[first] = 0
        bits = self.settings.row_bits
        row = lambda x, k: (mix(x * _U(2 * FEATURES + 1) + _U(k)) >> _U(64 - bits)).astype(np.int64) + (k << bits)
        return np.stack([row(one, 0), row(two, 1), row(mix(two) + one, 2)]), (one & _U(CLASSES - 1)).astype(np.int64)

    def class_scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of all classes, the largest 0."""
        z = self.weights[rows[0]]
        for k in range(1, FEATURES):
            z += self.weights[rows[k]]
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        return z

    def class_logs(self, rows: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of the given classes."""
        z = self.class_scores(rows)
        own = z[np.arange(len(z)), cls]
        return (own - np.log(np.exp(z, out=z).sum(axis=1))) * np.float32(1 / np.log(10))


def _sums(g: np.ndarray, at: np.ndarray, start: np.ndarray, n: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of the rows g[at] over n from each start. Most sums have few rows: their first rows are taken together, then
    their second ones, and so on; the others are summed one by one."""
    out = g[at[start]]
    for k in range(1, few):
        s = np.flatnonzero((n > k) & (n <= few))
        out[s] += g[at[start[s] + k]]
    for s in np.flatnonzero(n > few).tolist():
        out[s] = g[at[start[s] : start[s] + n[s]]].sum(axis=0)
    return out


class Learner:
    """Gradient steps over the texts of one piece, from a model's weights, and the counts of words after classes.

    Steps are made of ``batch`` tokens, counted from the piece's first, however the texts come."""

    def __init__(self, m: Model, pieces: int):
        self.m = copy.copy(m)
        self.start, self.m.weights = m.weights, m.weights.copy()
        #: What the steps are scaled by goes on from what one piece of the rounds before has seen.
        self.before = m.seen / np.float32(pieces)
        self.seen = np.zeros(len(m.weights), dtype=np.float32)
        self.rows, self.cls = np.zeros((FEATURES, 0), dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.codes: list[np.ndarray] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []

    def feed(self, texts: list) -> None:
        m = self.m
        ids, sizes = token_ids(texts)
        rows, before = m.features(ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        self.codes.append((before * (m.settings.vocabulary + CLASSES) + m.places(ids)[1]).astype(np.int32))
        if sum(map(len, self.codes)) > m.settings.counted:
            self._count()
        self.rows = np.concatenate([self.rows, rows.astype(np.int32)], axis=1)
        self.cls = np.concatenate([self.cls, (ids & _U(CLASSES - 1)).astype(np.int32)])
        at, batch = 0, m.settings.batch
        for at in range(0, len(self.cls) - batch + 1, batch):
            self._step(self.rows[:, at : at + batch], self.cls[at : at + batch])
        done = len(self.cls) // batch * batch
        self.rows, self.cls = self.rows[:, done:], self.cls[done:]

    def _count(self) -> None:
        if self.codes:
            self.counted.append(np.unique(np.concatenate(self.codes), return_counts=True))
            self.codes = []

    def _step(self, r: np.ndarray, c: np.ndarray) -> None:
        m = self.m
        g = m.class_scores(r)
        np.exp(g, out=g)
        g *= (-1 / g.sum(axis=1))[:, None]
        g[np.arange(len(c)), c] += 1
        # All features at once: the rows of different kinds are different.
        flat = r.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(self.seen) <= 1 << 16 else flat, kind="stable")
        at = flat[order]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        own, n = at[start], np.diff(np.append(start, len(at)))
        self.seen[own] += n
        step = _sums(g, order % len(c), start, n)
        step *= (m.settings.rate / np.sqrt(1 + self.before[own] + self.seen[own]))[:, None]
        m.weights[own] += step

    def result(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """kind, chunk, places, numbers: of weights (0), by ranges of rows, the rows that have changed and by how much; of words (1),
        by class, pairs of the class before and the word."""
        if len(self.cls):
            self._step(self.rows, self.cls)
        self._count()
        s = self.m.settings
        ends = np.linspace(0, len(self.seen), s.chunks + 1).astype(np.int64)
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            at = a + np.flatnonzero(self.seen[a:b])
            yield 0, i, at, self.seen[at], self.m.weights[at] - self.start[at]
        if self.counted:
            at, inverse = np.unique(np.concatenate([x for x, _ in self.counted]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([x for _, x in self.counted]))
            cls = self.m.class_of[at % (s.vocabulary + CLASSES)]
            for i in np.unique(cls).tolist():
                yield 1, i, at[cls == i], n[cls == i], np.zeros((0, CLASSES), dtype=np.float32)


LEARNT = "kind int, chunk int, piece long, at binary, n binary, v binary"


def _learnt(texts: DataFrame, held, pieces: int) -> DataFrame:
    """What each piece (piece, k, __text; in order) has learnt, as the rows it has seen."""

    def rows(piece: int, own: Learner) -> Iterator[pa.RecordBatch]:
        for kind, chunk, at, n, v in own.result():
            # Changes of weights in half precision: the shuffle moves half as much.
            cells = [[kind], [chunk], [piece], [at.astype(np.uint32).tobytes()], [n.astype(np.float32).tobytes()], [v.astype(np.float16).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in LEARNT.split(", ")])

    def run(batches):
        piece, own = None, None
        for x in chain.from_iterable(slices(b, "__text") for b in batches):
            of = x.column(0).to_numpy()
            turns = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(turns, turns[1:]):
                if piece != int(of[a]):
                    if own:
                        yield from rows(piece, own)
                    piece, own = int(of[a]), Learner(held.value, pieces)
                own.feed(x.column(1).slice(a, b - a).to_pylist())
        if own:
            yield from rows(piece, own)
        release()

    return texts.mapInArrow(run, LEARNT)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sum of several parts of one chunk, changes times their numbers, in the order of their pieces, so that it is the same
    whatever task has which."""
    pdf = pdf.sort_values("piece")
    ats = [np.frombuffer(x, dtype=np.uint32) for x in pdf["at"]]
    at = np.unique(np.concatenate(ats))
    weights = pdf["kind"].iloc[0] == 0
    n, v = np.zeros(len(at)), np.zeros((len(at) if weights else 0, CLASSES), dtype=np.float32)
    for x, y, z in zip(ats, pdf["n"], pdf["v"], strict=True):
        i, first = np.searchsorted(at, x), len(y) == 4 * len(x)
        own = np.frombuffer(y, dtype=np.float32 if first else np.float64)
        n[i] += own
        if weights:
            change = np.frombuffer(z, dtype=np.float16 if first else np.float32).reshape(-1, CLASSES)
            v[i] += change.astype(np.float32) * own[:, None].astype(np.float32) if first else change
    return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "piece": pdf["piece"].iloc[:1], "at": [at.tobytes()], "n": [n.tobytes()], "v": [v.tobytes()]})


def train(docs: DataFrame, text: str, counts: DataFrame, s: Settings, text_bytes: int) -> Model:
    """The model of all texts.

    From the counts come the head, the biases and the shared masses. Texts are dealt into pieces, and within them ordered,
    by their hash; the number of pieces follows from the input's size alone. In each round some of the pieces make gradient
    steps, all from the same weights; then a weight row becomes the mean of the pieces' rows, by how often each has seen its
    feature. What pieces send is summed as a tree, so no task holds more than fan_in parts, and in a fixed order:
    neither partitions nor cores change the model. Words in their classes are fitted last, a task for each class.
    """
    mass, different = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(F.col("h").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["k"]], different[r["k"]] = r["n"], r["v"]
    s = s.sized(int(mass.sum()), int(different.sum()))
    h, c = head_of(counts, s.head)
    in_vocabulary = np.zeros(CLASSES, dtype=np.float64)
    kinds = np.zeros(CLASSES, dtype=np.float64)
    k = min(s.vocabulary, len(h))
    np.add.at(in_vocabulary, (h[:k] & _U(CLASSES - 1)).astype(np.int64), c[:k])
    np.add.at(kinds, (h[:k] & _U(CLASSES - 1)).astype(np.int64), 1)
    width, rows = s.vocabulary + CLASSES, FEATURES << s.row_bits
    m = Model(
        s, h, c, int(mass.sum()), int(different.sum()),
        np.log((mass + 1) / (mass.sum() + CLASSES)).astype(np.float32),
        np.log10(mass - in_vocabulary + different - kinds + 1),
        np.zeros((rows, CLASSES), dtype=np.float32), np.zeros(rows, dtype=np.float32),
    )
    spark = docs.sparkSession
    pieces = max(1, text_bytes // max(s.piece_bytes, s.piece_models * m.weights.nbytes))
    rounds = min(s.rounds, pieces)
    each = pieces // rounds
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"))
    keyed = own.select(F.pmod(F.xxhash64("__text"), F.lit(rounds * each)).alias("piece"), F.xxhash64(F.lit(1), "__text").alias("__k"), "__text")
    tables = []
    for turn in range(rounds):
        # More partitions than pieces, so that few of them get two.
        held = spark.sparkContext.broadcast(m)
        part = keyed.where(F.col("piece") % rounds == turn).repartition(8 * each, "piece").sortWithinPartitions("piece", "__k", "__text").select("piece", "__text")
        sums, left = _learnt(part, held, each), each
        while True:
            group = F.floor(F.col("piece") / F.lit(rounds * s.fan_in)).alias("group")
            sums = sums.groupBy("kind", "chunk", group).applyInPandas(_added, LEARNT).withColumn("piece", F.floor(F.col("piece") / F.lit(rounds * s.fan_in)) * rounds)
            left = -(-left // s.fan_in)
            if left == 1:
                break
        tables.append(cut_rows(sums))
        new = m.weights.copy()
        for r in tables[-1].where("kind = 0").toLocalIterator():
            at, n = np.frombuffer(r["at"], dtype=np.uint32), np.frombuffer(r["n"], dtype=np.float64)
            new[at] += np.frombuffer(r["v"], dtype=np.float32).reshape(-1, CLASSES) / np.maximum(n, 1)[:, None].astype(np.float32)
            m.seen[at] += n.astype(np.float32)
        held.unpersist()
        m = replace(m, weights=new)
    m.words = _fitted(tables, m)
    drop(*tables)
    return m


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit_words(x: np.ndarray, smoothing: float, turns: int = 30) -> np.ndarray:
    """Weights of words and of words after classes that make the counts of one class likely, as log10 probabilities.

    x: counts by class before and word. Gradient steps scaled by the curvature; weights of words after classes are held
    near 0 by a penalty, without which a pair that was not seen would be impossible.
    """
    z = np.broadcast_to(np.log((x.sum(axis=0) + 0.5) / (x.sum() + 0.5 * x.shape[1])), x.shape)
    u, total = np.zeros(x.shape), x.sum(axis=1, keepdims=True)
    for _ in range(turns):
        p = _softmax(z + u)
        u += np.clip(0.5 * (x - total * p - smoothing * u) / (total * p + smoothing), -1, 1)
    return np.log10(np.maximum(_softmax(z + u), 1e-30))


def _fitted(tables: list[DataFrame], m: Model) -> np.ndarray:
    """Words in their classes, from what the rounds have counted: each class, whose counts are enough for its gradient, is
    fitted in a task of its own."""
    s, class_of = m.settings, m.class_of
    width = s.vocabulary + CLASSES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["chunk"].iloc[0])
        own = np.flatnonzero(class_of == c)
        x = np.zeros((CLASSES, len(own)))
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            code = np.frombuffer(at, dtype=np.uint32)
            x[code // width, np.searchsorted(own, code % width)] += np.frombuffer(n, dtype=np.float64)
        return pd.DataFrame({"chunk": [c], "v": [_fit_words(x, s.smoothing).astype(np.float32).tobytes()]})

    every = functools.reduce(DataFrame.unionByName, tables).where("kind = 1").select("chunk", "at", "n")
    out = np.zeros((CLASSES, width), dtype=np.float32)
    for c in range(CLASSES):  # what was never seen: as likely as anything else of its class
        own = np.flatnonzero(class_of == c)
        out[:, own] = -np.log10(max(len(own), 1))
    for r in every.groupBy("chunk").applyInPandas(run, "chunk int, v binary").toLocalIterator():
        out[:, class_of == r["chunk"]] = np.frombuffer(r["v"], dtype=np.float32).reshape(CLASSES, -1)
    return out


SCORES = "n_tokens long, head_known long, head_base double, local_score double, tail array<long>, tail_n array<int>"


def _score(m: Model, texts: list) -> list[pa.Array]:
    """Scores but for what the counts of words beyond the head add."""
    s = m.settings
    ids, sizes = token_ids(texts)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at, place = m.places(ids)
    rows, before = m.features(ids, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    cls = (ids & _U(CLASSES - 1)).astype(np.int64)
    score = m.words[before, place].astype(np.float64)
    for a in range(0, len(ids), s.batch):
        score[a : a + s.batch] += m.class_logs(rows[:, a : a + s.batch], cls[a : a + s.batch])
    known = at >= 0
    base = np.zeros(len(ids))
    base[known] = np.log10(m.head_counts[at[known]] + 1.0)
    other = place >= s.vocabulary
    score[other] += base[other] - m.rest[cls[other]]
    per = lambda w: np.bincount(doc, weights=w, minlength=len(texts))
    d, h = doc[~known], ids[~known]
    o = np.lexsort((h, d))
    d, h = d[o], h[o]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))[: len(d)])
    n = np.diff(np.append(first, len(d)))
    ends = np.searchsorted(d[first], np.arange(len(texts)), side="right")
    return [pa.array(sizes), pa.array(per(known).astype(np.int64)), pa.array(per(base)), pa.array(per(score)), lists(h[first].view(np.int64), ends), lists(n.astype(np.int32), ends)]


def is_held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score(docs: DataFrame, held_out, settings: Settings = Settings(), text: str = "text", more: list[str] | None = None) -> DataFrame:
    """The columns ``more`` of docs (all but the text by default), with held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model learns from all rows where the boolean expression held_out is false or null, and scores all rows.
    A null or empty text is one token, the end. Columns with the names of the new ones are replaced.

    Neither the partitions of docs nor the cores change a score, but for the rounding of sums. A very long text is scored whole;
    ties of counts are broken by the words' hashes; an empty table gives no rows.

    Every token of every text is counted and trained on. Frequent words are counted in each task before they are
    moved. Words beyond the head, none of which is frequent, are looked up by a join on their hash. Rows that are equal
    meet in that join as one text, and their sums are divided by their number.
    """
    s = settings
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in (more if more is not None else [c for c in docs.columns if c != text]) if c.lower() not in new]
    base = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("__text"))
    learn = base.where("not held_out").select("__text")
    counts = cut(count_words(learn, "__text", s))
    size = learn.agg(F.sum(F.octet_length("__text"))).head()[0] or 0
    m = train(learn, "__text", counts, s, size)
    held = docs.sparkSession.sparkContext.broadcast(m)
    keyed = base.withColumns({"__a": F.xxhash64(*(F.col(f"__c{i}") for i in range(len(kept))), "held_out", "__text"), "__b": F.xxhash64(F.lit(1), "__text")})
    seen = cut(with_columns(keyed, "__text", SCORES, _score, lambda: held.value).drop("__text"))
    tail = seen.select("__a", "__b", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("__a", "__b", F.col("x.tail").alias("h"), F.col("x.tail_n").alias("n"))
    found = tail.join(counts, "h")
    times = seen.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("times"))
    sums = found.groupBy("__a", "__b").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    each = sums.join(times, ["__a", "__b"]).select("__a", "__b", (F.col("known") / F.col("times")).cast("long").alias("known"), (F.col("logs") / F.col("times")).alias("logs"))
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return seen.join(each, ["__a", "__b"], "left").select(
        *(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)),
        "held_out",
        "n_tokens",
        (F.col("head_known") + known).cast("long").alias("n_known"),
        F.lit(m.n).cast("long").alias("train_tokens"),
        (F.col("head_base") + logs - F.col("n_tokens") * F.lit(float(np.log10(m.n + m.v + 1)))).alias("base_score"),
        (F.col("local_score") + logs).alias("score"),
    )
