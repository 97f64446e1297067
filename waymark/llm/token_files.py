"""Token ids as binary shards with a minimal perfect hash index of the document keys.

File format. A store is a folder of two Parquet tables, written and committed by Spark, so that any file system
that Spark writes to can hold it and a lost task leaves nothing behind.

``shards`` has a row for each shard: ``part`` and ``no`` (which order the shards), ``least`` and ``most`` (its keys; null in
shards of documents without key), ``n`` (documents), ``total`` (ids), and as little-endian arrays

* ``payload``: the ids of all its documents, one after the other, in ``width`` bytes each;
* ``keys`` (8 bytes) and ``sizes`` (4): the documents' keys and numbers of ids, in file order;
* ``levels`` (8), ``bits`` (8): the perfect hash of the different keys;
* ``prints`` (4), ``places`` (4): by hash value, the key's fingerprint and the first of its documents in file order;
* ``offsets`` (8): in file order, the ids before each document.

``starts`` has for each shard the number of ids in all shards before it.

A key is looked up in the shard whose range holds it: hash value, fingerprint, place, offset, slice. None of these
steps depends on the number of documents. Each shard is a row group of its own: its range is compared with its statistics, its
index is read without its payload, and its payload only where the index has the key.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waymark.llm.common import release, slices
from waymark.llm.sketch import mix

#: Bytes of text in one shard, about; and in one partition of the writer: a 10,000th of the input within these bounds.
SHARD_BYTES, PART_BYTES = 8 << 20, (32 << 20, 256 << 20)
#: Distinct pieces of text, and bytes of their ids, that a worker keeps; of twice as many at most, and those of one slice.
KEPT_PIECES, KEPT_BYTES = 350_000, 8 << 20
#: Shards up to which their starts are broadcast (16 bytes each); beyond, they are joined.
BROADCAST = 500_000
#: Ranges of keys that a lookup compares shards with.
RANGES = 64


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def ordinary_tokenizer(path: str):
    """The same, for text between special tokens: what only lower case makes equal to one is ordinary text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


_BREAK = "\x01"
#: Letters that normalisation leaves as they are: lower-case ones up to U+00FF.
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Marks that are a word of their own after such letters. An apostrophe may belong to letters that follow, so it is none.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes that a byte-level vocabulary writes as another character: from U+0100 on, those that cannot be printed first.
_HIDDEN = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _lower(text: str) -> str:
    """Lower case as far as no rule depends on what stands around: up to U+00FF where nothing beyond occurs, else A-Z."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode().lower().decode()
    return text.lower()


@functools.lru_cache(maxsize=2)
def plain_tokenizer(path: str):
    """The same vocabulary for words that are given one by one, in the vocabulary's own letters."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.normalizer = t.pre_tokenizer = None
    return t


class _Places(dict):
    """Numbers the pieces as they come; ``new`` has those that have come since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class _Held:
    """Ids of numbered pieces, one after the other."""

    def __init__(self, kind: str):
        self.places = _Places()
        self.ids = np.zeros(0, dtype=kind)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def put(self, at: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        more = len(self.places) - len(self.start)
        self.start, self.size = (np.concatenate([x, np.zeros(more, dtype=np.int64)]) for x in (self.start, self.size))
        self.start[at], self.size[at] = len(self.ids) + np.cumsum(size) - size, size
        self.ids = np.concatenate([self.ids, ids])

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at these places, and how many each has."""
        size = self.size[at]
        end = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)], size


class Pieces:
    """Ids, as little-endian integers, of whole texts, from the library's ids of each distinct piece between spaces.

    For a vocabulary that normalises by NFC and to lower case, and whose pre-tokenizer drops white space and parts letters
    from marks, this gives the ids of the whole text: no step looks beyond a space, A-Z may be lower-cased before, and
    marks after letters up to U+00FF are a word of their own. Pieces that are new to a slice of texts are encoded together. A
    special token's string in a text is one id, as the library has it; the text before and after is encoded by itself.
    """

    def __init__(self, path: str, width: int):
        self.tokenizer, self.plain, self.kind = ordinary_tokenizer(path), plain_tokenizer(path), f"<u{width}"
        self.held, self.before = _Held(self.kind), _Held(self.kind)
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a word: each word has one, its last.
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix or "\n")]] = True
        at = self._ids(self.tokenizer, _BREAK)
        self.sep = at[0] if len(at) == 1 else None
        special = {i: a for i, a in self.tokenizer.get_added_tokens_decoder().items() if a.special}
        if any(a.normalized or a.lstrip or a.rstrip or a.single_word for a in special.values()):
            raise ValueError("special tokens that depend on the text around them")
        self.special = {a.content: np.array([i], dtype=self.kind).tobytes() for i, a in special.items()}
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _ids(self, t, text, **how) -> np.ndarray:
        return np.array(t.encode_batch_fast([text], add_special_tokens=False, **how)[0].ids, dtype=self.kind)

    def _words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters up to U+00FF, and how many each has."""
        own = [w if w.isascii() else w.encode().decode("latin-1").translate(_HIDDEN) for w in some]
        ids = self._ids(self.plain, own, is_pretokenized=True) if own else self.held.ids[:0]
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(own):  # not a vocabulary that marks the ends of words
            return self._each(some)
        return ids, np.diff(ends, prepend=-1)

    def _each(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(self.tokenizer, p) for p in some]
        return np.concatenate([self.held.ids[:0], *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def _any(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces, encoded together with a break between them."""
        if self.sep is None or not some:
            return self._each(some)
        ids = self._ids(self.tokenizer, f" {_BREAK} ".join([*some, ""]))
        ends = np.flatnonzero(ids == self.sep)
        if len(ends) != len(some):  # a break in a piece
            return self._each(some)
        return ids[ids != self.sep], np.diff(ends, prepend=-1) - 1

    def _learn(self) -> None:
        held, places = self.held, self.held.places
        words, other, whole, stems, tails = ([], []), ([], []), [], [], []

        def deal(new: list[str]) -> None:
            """What was held before is taken over; the others are words, or go to the library as they are, or are parted."""
            first = len(places) - len(new)
            was = np.fromiter(map(self.before.places.get, new, repeat(-1)), dtype=np.int64, count=len(new))
            again = np.flatnonzero(was >= 0)
            held.put(first + again, *self.before.get(was[again]))
            for k in np.flatnonzero(was < 0).tolist():
                stem = new[k].rstrip(_MARKS)
                if not stem.isalpha() or not (stem.isascii() or _LETTERS.fullmatch(stem)):
                    other[0].append(first + k)
                    other[1].append(new[k])
                elif len(stem) == len(new[k]):
                    words[0].append(first + k)
                    words[1].append(stem)
                else:
                    whole.append(first + k)
                    stems.append(stem)
                    tails.append(new[k][len(stem) :])

        new, places.new = places.new, []
        deal(new)
        parts = [*map(places.__getitem__, stems)], [*map(places.__getitem__, tails)]
        new, places.new = places.new, []
        deal(new)
        held.put(np.array(words[0], dtype=np.int64), *self._words(words[1]))
        held.put(np.array(other[0], dtype=np.int64), *self._any(other[1]))
        if whole:
            ids, size = held.get(np.array(parts, dtype=np.int64).T.ravel())
            held.put(np.array(whole, dtype=np.int64), ids, size.reshape(-1, 2).sum(axis=1))

    def of(self, texts: list) -> list[bytes]:
        parts = [self.any_special.split(t) if t and any(x in t for x in self.special) else [t] for t in texts]
        between = iter(self._between([*chain.from_iterable(p[::2] for p in parts)]))
        return [b"".join(self.special[x] if k % 2 else next(between) for k, x in enumerate(p)) for p in parts]

    def _between(self, texts: list) -> list[bytes]:
        split = pc.split_pattern(pa.array([_lower(t).replace("\n", " ") if t else None for t in texts], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        if len(self.held.places) > KEPT_PIECES or self.held.ids.nbytes > KEPT_BYTES:
            # What is used again is taken over from what was held until now.
            self.held, self.before = _Held(self.kind), self.held
        different = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")[0].as_py().split(" ") if len(coded) else []
        at = np.fromiter(map(self.held.places.__getitem__, different), dtype=np.int64, count=len(different))[coded.indices.to_numpy()]
        if self.held.places.new:
            self._learn()
        ids, size = self.held.get(at)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *pc.fill_null(pc.list_value_length(split), 0).to_pylist()])] * ids.itemsize
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]


@functools.lru_cache(maxsize=2)
def pieces(path: str, width: int) -> Pieces:
    return Pieces(path, width)


class PerfectHash:
    """Minimal perfect hash of different 64-bit keys: level by level, each key that is alone at its place in a bit
    field gets it, and the others go on to the next, smaller field. A key's value is the number of bits before its own."""

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels, bits
        self.starts = np.concatenate([[0], np.cumsum(levels)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        keys, fields = keys.view(np.uint64), []
        while len(keys):
            size = max(1, math.ceil(gamma * len(keys) / 64)) * 64
            at = cls._place(keys, len(fields), size)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(alone)
            keys = keys[~alone[at]]
        flat = np.concatenate(fields) if fields else np.zeros(0, dtype=bool)
        return cls(np.array([len(f) for f in fields], dtype="<i8"), np.packbits(flat, bitorder="little").view("<u8"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Hash values; -1 where no level has the key. A foreign key may get a value too: its fingerprint tells."""
        keys = keys.view(np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.levels.tolist()):
            at = self._place(keys[left], level, size) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            before = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = (self.rank[word] + before)[there]
            left = left[~there]
        return out


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


SHARDS = "part int, no int, least long, most long, n long, total long, width int, payload binary, keys binary, sizes binary, levels binary, bits binary, prints binary, places binary, offsets binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, SHARDS.split(", "))])


def _shard(part: int, no: int, keys: list, ids: list[bytes], width: int) -> pa.RecordBatch:
    own = np.array([0 if k is None else k for k in keys], dtype="<i8")
    sizes = np.array([len(x) // width for x in ids], dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[:-1]]).astype("<i8")
    none = keys[0] is None
    different, first = np.unique(own, return_index=True) if not none else (own[:0], np.zeros(0, dtype=np.int64))
    h = PerfectHash.of(different)
    at = h(different)
    prints, places = np.zeros(len(different), dtype="<u4"), np.zeros(len(different), dtype="<u4")
    prints[at], places[at] = prints_of(different), first
    row = (part, no, keys[0], keys[-1], len(keys), int(sizes.sum()), width, b"".join(ids), *(x.tobytes() for x in (own, sizes, h.levels, h.bits, prints, places, offsets)))
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, row, strict=True))], schema=_ARROW)


def write(docs: DataFrame, folder: str, path: str, end: int, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES, part_bytes: tuple[int, int] = PART_BYTES) -> None:
    """Encodes each whole text, appends ``end``, and writes the store in ascending order of keys.

    Texts are dealt by ranges of key and text hash, so that a key of many rows is split too, and sorted;
    each task writes the shards of its range. A null or empty text has the end id only; a very long one makes a shard of
    its own size. Rows without key come first, in no stated order. Rows that repeat a key follow each other, by a hash of their
    texts; the index leads to the first. An empty table makes an empty store. Other columns, whatever their names, are not read.
    """
    size = docs.agg(F.sum(F.octet_length(text))).head()[0] or 0
    rows = docs.select(F.col(key).cast("long").alias("__key"), F.xxhash64(text).alias("__h"), F.col(text).alias("__text"))
    dealt = rows.repartitionByRange(max(1, math.ceil(size / min(max(size // 10_000, part_bytes[0]), part_bytes[1]))), "__key", "__h").sortWithinPartitions("__key", "__h").select("__key", "__text")

    def run(batches):
        width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
        last = end.to_bytes(width, "little")
        held, part, no = pieces(path, width), TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0
        for s in chain.from_iterable(slices(b, "__text") for b in batches):
            texts = s.column(1).to_pylist()
            for k, t, own in zip(s.column(0).to_pylist(), texts, held.of(texts), strict=True):
                if keys and (size >= shard_bytes or (keys[0] is None) != (k is None)):
                    yield _shard(part, no, keys, ids, width)
                    keys, ids, size, no = [], [], 0, no + 1
                keys.append(k)
                ids.append(own + last)
                size += len(t or "")
        if keys:
            yield _shard(part, no, keys, ids, width)
        release()

    # A row group for each shard, so that a lookup reads the payload of the shards it needs alone.
    dealt.mapInArrow(run, SHARDS).write.option("parquet.block.size", shard_bytes // 2).option("parquet.page.size.row.check.min", 1).parquet(f"{folder}/shards")
    shards = docs.sparkSession.read.schema(SHARDS).parquet(f"{folder}/shards").select("part", "no", "total")
    parts = shards.groupBy("part").agg(F.sum("total").alias("total"))
    # One row a part and then one a shard: what goes before within all parts, and within its own.
    before = lambda w: F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("base"))
    own = shards.select("part", "no", before(Window.partitionBy("part").orderBy("no")).alias("own"))
    own.join(parts, "part").select("part", "no", (F.col("base") + F.col("own")).alias("start")).write.parquet(f"{folder}/starts")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(f"{folder}/shards")


def _started(shards: DataFrame, folder: str) -> DataFrame:
    """Shards with their starts."""
    spark = shards.sparkSession
    starts = spark.read.schema("part int, no int, start long").parquet(f"{folder}/starts")
    few = starts.count() <= BROADCAST
    return shards.join(F.broadcast(starts) if few else starts, ["part", "no"])


OUT = "key long, start long, ids binary"


class Shard:
    """A shard in memory."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.ids = get("payload", f"<u{row['width']}") if "payload" in row else None
        self.keys, self.sizes, self.offsets = get("keys", "<i8"), get("sizes", "<u4"), get("offsets", "<i8")
        self.hash = PerfectHash(get("levels", "<i8"), get("bits", "<u8"))
        self.prints, self.places = get("prints", "<u4"), get("places", "<u4")
        self.start, self.none = row["start"], row["least"] is None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For each key the first of its documents in file order, or -1."""
        if not len(self.prints):
            return np.full(len(keys), -1, dtype=np.int64)
        at = self.hash(keys)
        known = (at >= 0) & (self.prints[at] == prints_of(keys))
        return np.where(known, self.places[at].astype(np.int64), -1)

    def rows(self, at: np.ndarray) -> pa.RecordBatch:
        """Documents by their places; ids as little-endian 32-bit integers."""
        o, n = self.offsets[at].tolist(), self.sizes[at].tolist()
        raw = [self.ids[a : a + b].astype("<u4").tobytes() for a, b in zip(o, n, strict=True)]
        keys = pa.array(self.keys[at], pa.int64(), mask=np.full(len(at), self.none))
        return pa.RecordBatch.from_arrays([keys, pa.array(self.start + self.offsets[at], pa.int64()), pa.array(raw, pa.binary())], names=["key", "start", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """key, start (ids of all documents before it), ids of every document, each found in its shard by its key.

    A document whose key the index does not lead to, or leads past, fails the job. Rows that repeat a key, or have none,
    are listed from the first on.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                at = np.arange(len(s.keys))
                if not s.none:
                    first = s.find(s.keys)
                    again = at - first
                    if (first < 0).any() or (again < 0).any() or (s.keys[first] != s.keys).any():
                        raise ValueError(f"shard {row['part']}, {row['no']}: a key is not where its index says")
                    at = first + again
                for i in range(0, len(at), 1000):
                    yield s.rows(at[i : i + 1000])

    return _started(_shards(spark, folder), folder).mapInArrow(run, OUT)


def _any_of(conditions: list) -> F.Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def places_of(spark: SparkSession, folder: str, keys: np.ndarray) -> DataFrame:
    """part, no, place, key of the first document of each of the given keys that there is, by the indexes of those shards
    whose range holds one. Ranges are compared in the scan; no payload is read."""
    wanted = np.unique(keys)
    near = np.array_split(wanted, min(len(wanted), RANGES)) if len(wanted) else []
    some = _shards(spark, folder).where(_any_of([(F.col("least") <= int(k[-1])) & (F.col("most") >= int(k[0])) for k in near]))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                at = s.find(wanted)
                at = at[(at >= 0) & (s.keys[at] == wanted)]
                part, no = (pa.array([row[c]] * len(at), pa.int32()) for c in ("part", "no"))
                yield pa.RecordBatch.from_arrays([part, no, pa.array(at, pa.int64()), pa.array(s.keys[at], pa.int64())], names=["part", "no", "place", "key"])

    index = some.select("part", "no", "least", F.lit(0).alias("start"), "keys", "sizes", "levels", "bits", "prints", "places", "offsets")
    return index.mapInArrow(run, "part int, no int, place long, key long")


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> DataFrame:
    """key, start, ids of the first document of each of the given keys that there is.

    The index tells the shards and the places in them, of which at most one for each given key comes to the driver; then
    only the row groups of these shards are read.
    """
    found: dict[tuple[int, int], list[int]] = {}
    for r in places_of(spark, folder, np.array(keys, dtype=np.int64)).collect():
        found.setdefault((r["part"], r["no"]), []).append(r["place"])
    parts: dict[int, list[int]] = {}
    for part, no in found:
        parts.setdefault(part, []).append(no)
    hit = _any_of([(F.col("part") == part) & F.col("no").isin(nos) for part, nos in parts.items()])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if at := found.get((row["part"], row["no"])):
                    yield Shard(row).rows(np.array(at))

    return _started(_shards(spark, folder).where(hit), folder).mapInArrow(run, OUT)
