"""Repeated passages: sparse suffix sorting of texts as bytes, deep-shallow.

Which 50-byte strings of a document also begin in an earlier one is found without moving every suffix. Each window of 50
bytes has one anchor, the place of its smallest hash of 24 bytes, which its content alone decides. So equal windows have
equal anchors, and the windows around one anchor make one short context (76 bytes at most).

1. Each chunk of documents sends its anchors, each once, as 32-bit prints dealt into buckets; those that more than one document
   has are shared (a false one costs work only), and those with very many contexts frequent.
2. Each chunk sends its different contexts of shared anchors, each once with its smallest document. Of frequent anchors, a phrase
   in all kinds of surroundings, it sends the different windows one by one instead, which are dealt by their own hash, not
   the anchor's: however frequent a phrase is, no task gets more of one thing than there are chunks.
3. All contexts of an anchor meet. Where their bytes are all equal, the smallest document decides. Elsewhere the
   suffixes at their windows are sorted: by multikey quicksort to a shallow depth, and what still agrees by blind tries
   down to 50 bytes. Equal windows stand together and their smallest document is known.
4. Chunks get back which windows begin in an earlier document, and remove all bytes of these.

Texts are dealt into chunks by one shuffle, which steps 1, 2 and 4 read. Hashes only bring together: wherever equal hashes
would decide, bytes are compared (contexts in a chunk and of an anchor, windows that are dealt one by one). Only exact
copies of a text are told by two 64-bit hashes before, and need none of this.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import release, small
from waymark.llm.sketch import mix

LENGTH, GRAM = 50, 24
_SPAN = LENGTH - GRAM + 1
#: Bytes of text in a chunk: a 20,000th of the input within these bounds.
CHUNK_BYTES = (2 << 20, 64 << 20)
#: Anchors of a bucket of prints, and contexts of a bucket of contexts, about.
PRINTS, CONTEXTS = 500_000, 60_000
#: Windows that are sorted at a time.
WINDOWS = 300_000
#: Contexts beyond which an anchor is frequent.
FREQUENT = 20_000
#: Rows of bytes that are compared at a time.
ROWS = 50_000
_MOST = 2 * LENGTH - GRAM
_LAST = (1 << 63) - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far has bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 1 << 16)
            make = lambda b: np.concatenate([np.ones(1, dtype=_U), np.cumprod(np.full(m, b, dtype=_U))])
            self.up, self.down = make(_U(_BASE)), make(_U(pow(_BASE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


class Anchors:
    """A text's contexts: those windows that follow each other and have one anchor.

    hash: of the anchor's bytes; left: from the context's start to the anchor; start: of the first window; more:
    windows after the first. key: hash of the whole context and its anchor's place.
    """

    def __init__(self, raw: bytes):
        n = len(raw)
        up, down = _powers.of(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * down[:n], out=sums[1:])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1])
        # Of equal hashes the first place counts: 40 bits of hash, then the place. Longer texts go on in the next block.
        best = h >> _U(24) << _U(24) | (np.arange(len(h), dtype=_U) & _U((1 << 24) - 1))
        if len(h) > 1 << 24:
            best = h >> _U(32) << _U(32) | np.arange(len(h), dtype=_U)
        for step in (1, 2, 4, 8, _SPAN - 16):
            best = np.minimum(best[:-step], best[step:])
        at = (best & _U((1 << 24) - 1 if len(h) <= 1 << 24 else (1 << 32) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.start, self.more = first, np.diff(np.append(first, len(at))) - 1
        self.hash = h[at[first]]
        self.left = at[first] - first
        end = first + self.more + LENGTH
        self.key = mix((sums[end] - sums[first]) * up[first] + mix(self.hash + self.left.astype(_U)))


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _pieces(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """From each start to the next, and from the last to n."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n][: len(starts)], strict=True))


def _quicksort(by: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by which each run (run: its number at each place, rising) is sorted by its values, and the numbers of runs of
    equal values in that order. Quicksort of all runs at once: each is split three ways around the median of three of its values;
    what is equal to it is done, what is less or greater goes on."""
    n = len(by)
    order, part = np.arange(n), run.astype(np.int64)
    at = np.arange(n)  # places that go on; whole parts, in order
    while len(at):
        starts = _cuts(part[at])
        size = np.diff(np.append(starts, len(at)))
        v = by[order[at]]
        three = np.sort(np.stack([v[starts], v[starts + size // 2], v[starts + size - 1]]), axis=0)[1]
        pivot = np.repeat(three, size)
        side = (v > pivot).astype(np.int8) - (v < pivot)
        begin, place = np.repeat(starts, size), np.empty(len(at), dtype=np.int64)
        before = np.zeros(len(starts), dtype=np.int64)
        for k in (-1, 0, 1):
            mine = side == k
            seen = np.cumsum(mine)
            first = seen[starts] - mine[starts]
            place[mine] = (begin + np.repeat(before, size) + seen - 1 - np.repeat(first, size))[mine]
            before += np.append(first[1:], seen[-1]) - first
        moved = np.empty(len(at), dtype=np.int64)
        moved[place] = order[at]
        order[at] = moved
        side_now = np.empty(len(at), dtype=np.int8)
        side_now[place] = side
        # New numbers, three for each old one, keep the order of all parts.
        part = part * 3 + 1
        part[at] += side_now
        part = np.cumsum(np.append(False, part[1:] != part[:-1]))
        more = side_now != 0
        at = at[more]
        if len(at):
            at = at[np.bincount(part[at])[part[at]] > 1]
    return order, part


def sorted_runs(words: np.ndarray, group: np.ndarray, shallow: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings within groups, and where runs of equal strings begin in it.

    words: the strings, 8 bytes a column. Shallow: multikey quicksort, which goes on to the next column with what is equal in
    the columns so far. Deep: blind tries of all groups that still agree, a level at a time: every member is
    compared with one of its trie, the first column where any differs is where the trie branches, and only by that
    column its members are parted. What lies between branches is never sorted.
    """
    order = np.argsort(group, kind="stable")
    run = np.unique(group[order], return_inverse=True)[1].astype(np.int64)
    for k in range(min(shallow, words.shape[1])):
        many = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else np.arange(0)
        o, part = _quicksort(words[order[many], k], run[many])
        order[many] = order[many][o]
        run = _parted(run, many, part)
    deep = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else np.arange(0)
    while len(deep) and shallow < words.shape[1]:
        starts = _cuts(run[deep])
        size = np.diff(np.append(starts, len(deep)))
        head = np.repeat(order[deep[starts]], size)
        differs = words[order[deep], shallow:] != words[head, shallow:]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
        branch = np.repeat(np.minimum.reduceat(first, starts), size)
        open_ = branch < words.shape[1]
        deep, branch = deep[open_], branch[open_]
        if not len(deep):
            break
        o, part = _quicksort(words[order[deep], shallow + branch], run[deep])
        order[deep] = order[deep][o]
        run = _parted(run, deep, part)
        deep = deep[np.bincount(run)[run[deep]] > 1]
    return order, _cuts(run)


def _parted(run: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Numbers of runs after those at the given places have been parted."""
    fine = np.zeros(len(run), dtype=np.int64)
    fine[at] = part
    return np.cumsum(np.append(False, (run[1:] != run[:-1]) | (fine[1:] != fine[:-1]))) if len(run) else run


def _window_words(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), -(-LENGTH // 8) * 8), dtype=np.uint8)
    out[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[start]
    return out.view(">u8").astype(_U)


class Chunk:
    """All contexts of the documents of a chunk, one after the other."""

    def __init__(self, pdf: pd.DataFrame):
        self.raw = [t.encode() for t in pdf["text"]]
        self.id = pdf["d"].to_numpy(dtype=np.int64)
        self.long = [k for k, t in enumerate(self.raw) if len(t) >= LENGTH]
        anchors = [Anchors(self.raw[k]) for k in self.long]
        all_ = lambda name: np.concatenate([getattr(a, name) for a in anchors]) if anchors else np.zeros(0, dtype=np.int64)
        self.start, self.more, self.left, self.hash = (all_(x) for x in ("start", "more", "left", "hash"))
        #: For each context the document's place in the chunk.
        self.owner = np.repeat(np.array(self.long, dtype=np.int64), [len(a.start) for a in anchors])
        #: All bytes, and where each context stands in them.
        self.flat = np.frombuffer(b"".join(self.raw) + bytes(_MOST), dtype=np.uint8)
        self.at = (np.cumsum([0, *map(len, self.raw)])[self.owner] if anchors else self.owner) + self.start
        self.key = self._settled(all_("key"))

    def _settled(self, key: np.ndarray) -> np.ndarray:
        """Keys that are equal only for equal contexts."""
        o = np.argsort(key, kind="stable")
        starts = _cuts(key[o])
        size = np.diff(np.append(starts, len(o)))
        head = np.repeat(o[starts], size)
        other = o != head
        o, head = o[other], head[other]
        wrong = unequal(self.flat, self.at[o], self.at[head], self.more[o] + LENGTH, self.more[head] + LENGTH)
        if wrong.any():
            mixed = np.flatnonzero(np.isin(key, key[o[wrong]]))
            texts = [self.flat[a : a + n].tobytes() for a, n in zip(self.at[mixed].tolist(), (self.more[mixed] + LENGTH).tolist(), strict=True)]
            rest = np.delete(key, mixed)
            for seed in count(1):
                new = np.array([xxhash.xxh64_intdigest(t, seed) for t in texts], dtype=_U)
                if len({*new.tolist()}) == len({*texts}) and not np.isin(new, rest).any():
                    break
            key = key.copy()
            key[mixed] = new
        return key

    def windows(self, contexts_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some contexts all windows: their context, their place in it, and a hash of their bytes."""
        n = self.more[contexts_] + 1
        c = np.repeat(contexts_, n)
        offset = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
        at, key = self.at[c] + offset, np.empty(len(c), dtype=_U)
        view = np.lib.stride_tricks.sliding_window_view(self.flat, LENGTH)
        up = _powers.of(LENGTH)[0][:LENGTH]
        for i in range(0, len(at), ROWS // 4):
            key[i : i + ROWS // 4] = mix((_BYTES[view[at[i : i + ROWS // 4]]] * up).sum(axis=1, dtype=_U))
        return c, offset, key


def unequal(flat: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which of the strings of n bytes at a differ from those of m bytes at b; none is longer than a context can be."""
    out = n != m
    view = np.lib.stride_tricks.sliding_window_view(flat, _MOST)
    place = np.arange(_MOST)
    for i in range(0, len(a), ROWS):
        s = slice(i, i + ROWS)
        out[s] |= ((view[a[s]] != view[b[s]]) & (place < n[s][:, None])).any(axis=1)
    return out


def _one(f):
    """f of one group, after which what it has freed is given back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        release()
        return out

    return run


def _two(f):
    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf, known)
        release()
        return out

    return run


def _columns(starts: np.ndarray, n: int, **values: tuple[np.ndarray, type]) -> dict[str, list[bytes]]:
    """Each piece of each array as bytes."""
    pieces = _pieces(starts, n)
    return {k: [v[i:j].astype(kind).tobytes() for i, j in pieces] for k, (v, kind) in values.items()}


def prints(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk and, as arrays, prints and counts of a chunk's anchors, each once. A count has the number of different
    contexts (32,767 at most), twice, and one more if more than one document has the anchor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = Chunk(pdf)
        p, b = x.hash.astype(np.uint32), bucket(x.hash, buckets)
        o = np.lexsort((x.key, p, b))
        b, p, key, owner = b[o], p[o], x.key[o], x.owner[o]
        starts = _cuts(b, p)
        if not len(starts):
            return pd.DataFrame({k: [] for k in ("bucket", "chunk", "prints", "counts")})
        kinds = np.add.reduceat(np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1])).astype(np.int64), starts)
        many = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
        b, p, counts = b[starts], p[starts], 2 * np.minimum(kinds, 32_767) + many
        rows = _cuts(b)
        return pd.DataFrame({"bucket": b[rows].astype(np.int32), "chunk": np.full(len(rows), pdf["chunk"].iloc[0], dtype=np.int32), **_columns(rows, len(b), prints=(p, np.uint32), counts=(counts, np.uint16))})

    return chunks.groupBy("chunk").applyInPandas(_one(run), "bucket int, chunk int, prints binary, counts binary")


def shared_prints(found: DataFrame, frequent: int) -> DataFrame:
    """bucket, chunk and, as arrays, prints that more than one document has, and whether they are frequent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        get = lambda name, kind: np.frombuffer(b"".join(pdf[name]), dtype=kind)
        p, n = get("prints", np.uint32), get("counts", np.uint16).astype(np.int64)
        c = np.repeat(pdf["chunk"].to_numpy(), [len(x) // 4 for x in pdf["prints"]])
        o = np.argsort(p, kind="stable")
        starts = _cuts(p[o])
        size = np.diff(np.append(starts, len(o)))
        shared = (size > 1) | (np.maximum.reduceat(n[o] & 1, starts) > 0)
        often = np.repeat(np.add.reduceat(n[o] >> 1, starts) > frequent, size)
        keep = np.repeat(shared, size)
        many, often = o[keep], often[keep]
        s = np.argsort(c[many], kind="stable")
        many, often = many[s], often[s]
        rows = _cuts(c[many])
        return pd.DataFrame({"chunk": c[many][rows].astype(np.int32), "bucket": np.full(len(rows), pdf["bucket"].iloc[0], dtype=np.int32), **_columns(rows, len(many), prints=(p[many], np.uint32), often=(often, np.uint8))})

    return found.groupBy("bucket").applyInPandas(_one(run), "chunk int, bucket int, prints binary, often binary")


SENT = "bucket int, chunk int, single boolean, hash binary, left binary, more binary, key binary, least binary, most binary, raw binary"


def contexts(chunks: DataFrame, many: DataFrame, buckets: int, wide: int) -> DataFrame:
    """bucket, chunk and, as arrays, each different context of a chunk whose anchor's print is shared, with its smallest document;
    and, single, each different window of frequent ones, with its smallest and largest document."""

    def sent(x: Chunk, chunk: int, single: bool, at, offset, more, key, least, most, by) -> pd.DataFrame:
        b = bucket(mix(by), wide)
        o = np.argsort(b, kind="stable")
        at, offset, more, b = at[o], offset[o], more[o], b[o]
        begin = x.at[at] + offset
        raw = [x.flat[i:j].tobytes() for i, j in zip(begin.tolist(), (begin + more + LENGTH).tolist(), strict=True)]
        rows = _cuts(b)
        arrays = _columns(rows, len(b), hash=(x.hash[at], np.uint64), left=(x.left[at], np.uint8), more=(more, np.uint8), key=(key[o], np.uint64), least=(least[o], np.int64), most=(most[o], np.int64))
        return pd.DataFrame({"bucket": b[rows].astype(np.int32), "chunk": np.full(len(rows), chunk, dtype=np.int32), "single": np.full(len(rows), single), **arrays, "raw": [b"".join(raw[i:j]) for i, j in _pieces(rows, len(b))]})

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({k.split()[0]: [] for k in SENT.split(", ")})
        if not len(pdf) or not len(known):
            return empty
        x, chunk = Chunk(pdf), int(pdf["chunk"].iloc[0])
        if not len(x.hash):
            return empty
        own = np.concatenate([(np.uint64(b) << _U(32)) | np.frombuffer(p, np.uint32).astype(_U) for b, p in zip(known["bucket"], known["prints"], strict=True)])
        often = np.frombuffer(b"".join(known["often"]), dtype=np.uint8)[np.argsort(own)] > 0
        own = np.sort(own)
        mine = bucket(x.hash, buckets).astype(_U) << _U(32) | (x.hash & _U(0xFFFFFFFF))
        at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
        shared, often = own[at] == mine, often[at]
        at = np.flatnonzero(shared & ~often)
        at = at[np.lexsort((x.id[x.owner[at]], x.key[at]))]
        at = at[_cuts(x.key[at])]
        least = x.id[x.owner[at]]
        out = [sent(x, chunk, False, at, np.zeros(len(at), dtype=np.int64), x.more[at], x.key[at], least, least, x.hash[at])]
        hot = np.flatnonzero(shared & often)
        if len(hot):
            c, offset, key = x.windows(hot)
            d = x.id[x.owner[c]]
            o = np.lexsort((d, key, x.hash[c]))
            c, offset, key, d = c[o], offset[o], key[o], d[o]
            rows = _cuts(x.hash[c], key)
            last = np.append(rows[1:], len(c)) - 1
            out.append(sent(x, chunk, True, c[rows], offset[rows], np.zeros(len(rows), dtype=np.int64), key[rows], d[rows], d[last], key[rows]))
        return pd.concat(out)

    return chunks.groupBy("chunk").cogroup(many.groupBy("chunk")).applyInPandas(_two(run), SENT)


TOLD = "chunk int, single boolean, key binary, first binary, last binary, hash binary, low binary"


def earlier(found: DataFrame) -> DataFrame:
    """chunk and, as arrays, key, first, last: windows of a chunk's contexts that begin in a document before its smallest; and,
    single, key, hash, low: windows that begin in a document (low) before the largest of the chunk that has them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(x) // 8 for x in pdf["hash"]]
        get = lambda name, kind: np.frombuffer(b"".join(pdf[name]), dtype=kind)
        h, more, key, least, most = get("hash", np.uint64), get("more", np.uint8).astype(np.int64), get("key", np.uint64), get("least", np.int64), get("most", np.int64)
        flat = np.frombuffer(b"".join(pdf["raw"]) + bytes(_MOST), dtype=np.uint8)
        chunk, single = np.repeat(pdf["chunk"].to_numpy(), sizes), np.repeat(pdf["single"].to_numpy(dtype=bool), sizes)
        begin = np.concatenate([[0], np.cumsum(more + LENGTH)[:-1]])
        # Contexts meet by their anchor, windows by their own hash too.
        o = np.lexsort((key, h, single))
        starts = _cuts(single[o], h[o], np.where(single[o], key[o], _U(0)))
        size = np.diff(np.append(starts, len(o)))
        group = np.repeat(np.arange(len(starts)), size)
        head = o[starts][group]
        other = key[o] != key[head]
        alike = np.flatnonzero(~other & (o != head))
        x, y = o[alike], head[alike]
        other[alike] = unequal(flat, begin[x], begin[y], more[x] + LENGTH, more[y] + LENGTH)
        mixed = np.unique(group[other])
        whole = np.ones(len(starts), dtype=bool)
        whole[mixed] = False
        low = np.minimum.reduceat(least[o], starts)[group]
        won = o[whole[group] & (low < most[o])]
        lows = low[whole[group] & (low < most[o])]
        out = [(won, np.zeros(len(won), dtype=np.int64), more[won], lows)]
        rest, group = o[~whole[group]], group[~whole[group]]
        n = more[rest] + 1
        ends = np.cumsum(n)
        at = 0
        while at < len(rest):  # whole groups, up to about WINDOWS windows
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WINDOWS, side="right")))
            if stop < len(rest):
                stop = int(np.searchsorted(group, group[stop], side="left"))
                stop = int(np.searchsorted(group, group[at], side="right")) if stop <= at else stop
            out.append(_settle(rest[at:stop], group[at:stop], flat, begin, more, least))
            at = stop
        e, a, b, low = (np.concatenate(x) for x in zip(*out, strict=True))
        p = np.lexsort((a, key[e], single[e], chunk[e]))
        e, a, b, low = e[p], a[p], b[p], low[p]
        rows = _cuts(chunk[e], single[e])
        return pd.DataFrame({"chunk": chunk[e][rows].astype(np.int32), "single": single[e][rows], **_columns(rows, len(e), key=(key[e], np.uint64), first=(a, np.uint8), last=(b, np.uint8), hash=(np.where(single[e], h[e], _U(0)), np.uint64), low=(low, np.int64))})

    return found.groupBy("bucket").applyInPandas(_one(run), TOLD)


def _settle(entry: np.ndarray, group: np.ndarray, flat: np.ndarray, begin: np.ndarray, more: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts of mixed groups the runs of windows that begin in a document before the context's own, and the first window's document."""
    n = more[entry] + 1
    own = np.repeat(np.arange(len(entry)), n)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    order, starts = sorted_runs(_window_words(flat, begin[entry][own] + offset), group[own])
    doc = least[entry][own]
    low = np.empty(len(own), dtype=np.int64)
    low[order] = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(order))))
    hit = np.flatnonzero(low < doc)
    if not len(hit):
        return (np.zeros(0, dtype=np.int64),) * 4
    new = np.append(True, (own[hit][1:] != own[hit][:-1]) | (offset[hit][1:] != offset[hit][:-1] + 1))
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(hit)) - 1
    return entry[own[hit[a]]], offset[hit[a]], offset[hit[b]], low[hit[a]]


def removed_runs(chunks: DataFrame, told: DataFrame) -> DataFrame:
    """id, none, n_bytes, spans, kept, times of every document of the chunks."""

    def run(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        x = Chunk(pdf) if len(pdf) else None
        if x is None:
            return pd.DataFrame({k: [] for k in ("id", "none", "n_bytes", "starts", "ends", "kept", "times")})
        edges = {k: np.zeros(len(x.raw[k]) + 1, dtype=np.int32) for k in x.long}
        if x.long:
            # Within the chunk: a context that an earlier document has too.
            o = np.lexsort((x.id[x.owner], x.key))
            cuts = _cuts(x.key[o])
            low = np.repeat(x.id[x.owner[o[cuts]]], np.diff(np.append(cuts, len(o))))
            own = o[low < x.id[x.owner[o]]]
            found = [(own, x.start[own], x.start[own] + x.more[own])]
            get = lambda rows, name, kind: np.frombuffer(b"".join(rows[name]), dtype=kind)
            whole, single = known[~known["single"].astype(bool)], known[known["single"].astype(bool)]
            if len(whole):
                k, a, b = get(whole, "key", np.uint64), get(whole, "first", np.uint8).astype(np.int64), get(whole, "last", np.uint8).astype(np.int64)
                s = np.argsort(k, kind="stable")
                k, a, b = k[s], a[s], b[s]
                i, j = np.searchsorted(k, x.key, "left"), np.searchsorted(k, x.key, "right")
                c = np.repeat(np.arange(len(x.key)), j - i)
                r = np.arange(len(c)) - np.repeat(np.cumsum(j - i) - (j - i), j - i) + np.repeat(i, j - i)
                found.append((c, x.start[c] + a[r], x.start[c] + b[r]))
            if len(single):
                k, h, low = get(single, "key", np.uint64), get(single, "hash", np.uint64), get(single, "low", np.int64)
                s = np.argsort(k, kind="stable")
                k, h, low = k[s], h[s], low[s]
                c, offset, key = x.windows(np.flatnonzero(np.isin(x.hash, h)))
                at = np.minimum(np.searchsorted(k, key), len(k) - 1)
                hit = (k[at] == key) & (h[at] == x.hash[c]) & (low[at] < x.id[x.owner[c]])
                found.append((c[hit], x.start[c[hit]] + offset[hit], x.start[c[hit]] + offset[hit]))
            c, a, b = (np.concatenate(y) for y in zip(*found, strict=True))
            d = x.owner[c]
            o = np.argsort(d, kind="stable")
            d, a, b = d[o], a[o], b[o] + LENGTH
            cuts = _cuts(d)
            for i, j in _pieces(cuts, len(d)):
                e = edges[int(d[i])]
                np.add.at(e, a[i:j], 1)
                np.add.at(e, b[i:j], -1)
        starts, ends, kept = [], [], []
        for k, raw in enumerate(x.raw):
            e = edges.get(k)
            if e is None or not e.any():
                starts.append([])
                ends.append([])
                kept.append(raw)
                continue
            gone = np.cumsum(e[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            starts.append(turn[::2].tolist())
            ends.append(turn[1::2].tolist())
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        return pd.DataFrame({"id": x.id, "none": pdf["none"], "n_bytes": [len(t) for t in x.raw], "starts": starts, "ends": ends, "kept": kept, "times": pdf["times"]})

    schema = "id long, none boolean, n_bytes long, starts array<int>, ends array<int>, kept binary, times long"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_two(run), schema)


SPANS = "array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes, end exclusive) and kept (the other bytes) of each row.

    A byte is removed if it is covered by a string of 50 bytes that also begins in a document of a smaller id, judged
    on the input. A null text is empty; one of fewer bytes, or an empty one, loses nothing; a very long one is part of one
    chunk, which is then larger. Rows that repeat an id do not count as earlier for each other. Rows without id come
    after all others and count as earlier for none (where there are such rows, and one of id -2^63 too, a row of id 2^63 - 1
    counts as one of them). An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    t, none = F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull()
    id_ = F.col(doc_id).cast("long")
    size, first_id, last_id, nones = docs.agg(F.sum(F.octet_length(text)), F.min(id_), F.max(id_), F.max(none)).head()
    size = size or 0
    # Ids move by one where the last place, which rows without id take, is taken.
    by = 1 if nones and last_id == _LAST and first_id > -_LAST - 1 else 0
    base = docs.select(F.coalesce(id_ - by, F.lit(_LAST)).alias("d"), none.alias("none"), t.alias("text"), F.xxhash64(t).alias("__a"), F.xxhash64(F.lit(1), t).alias("__b"))
    # Exact copies: every window also begins in the group's smallest document. Rows of equal id and text go as one.
    narrow = base.where(F.octet_length("text") >= LENGTH).groupBy("__a", "__b", "d").agg(F.count(F.lit(1)).alias("n"))
    first = narrow.groupBy("__a", "__b").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.min_by("n", "d").alias("n")).where("first < last or n > 1").drop("last")
    firsts = small(first)
    marked = base.join(firsts, ["__a", "__b"], "left")
    long, copy = F.octet_length("text") >= LENGTH, F.coalesce(F.col("d") > F.col("first"), F.lit(False))
    least, most = CHUNK_BYTES
    chunks = max(1, math.ceil(size / min(max(size // 20_000, least), most)))
    anchors = size * 2 / (_SPAN + 1)
    buckets, wide = max(1, math.ceil(anchors / PRINTS)), max(1, math.ceil(anchors / 4 / CONTEXTS))
    once = marked.where(long & ~copy & (F.coalesce("n", F.lit(1)) == 1)).select("d", "none", "__a", "text", F.lit(1).cast("long").alias("times"))
    again = marked.where(long & ~copy & (F.col("n") > 1)).groupBy("d", "none", "__a", "__b").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times")).drop("__b")
    own = once.unionByName(again).select(F.pmod(F.xxhash64("d", "__a"), F.lit(chunks)).cast("int").alias("chunk"), "d", "none", "text", "times")
    many = shared_prints(prints(own, buckets), frequent)
    told = earlier(contexts(own, many, buckets, wide))
    rest = removed_runs(own, told)
    all_ = rest.select(F.when(~F.col("none"), F.col("id") + by).alias(doc_id), "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).cast(SPANS).alias("spans"), "kept", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
    # The others lose all, or are too short to lose any.
    n = F.octet_length("text").cast("long")
    rows = marked.where(~long | copy).select(F.when(~F.col("none"), F.col("d") + by).alias(doc_id), n.alias("n_bytes"), copy.alias("gone"), F.when(~copy, F.col("text")).otherwise(F.lit("")).cast("binary").alias("kept"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end"))).cast(SPANS)
    return all_.unionByName(rows.select(doc_id, "n_bytes", F.when(F.col("gone"), whole).otherwise(F.array().cast(SPANS)).alias("spans"), "kept"))


def sql(n: int = LENGTH) -> str:
    """DuckDB SQL for the digest columns, from every window of every text."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT k, doc_id, i, b[i + 1:i + {n}] AS w FROM (SELECT k, doc_id, b, unnest(range(0, octet_length(b) - {n - 1})) AS i FROM d)),
first AS (SELECT w, min(doc_id) AS f FROM win GROUP BY w),
hit AS (SELECT k, i FROM win JOIN first USING (w) WHERE f < doc_id OR (doc_id IS NULL AND f IS NOT NULL)),
run AS (SELECT k, min(i) AS a, max(i) + {n} AS b FROM (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS r FROM (SELECT k, i, CAST(i > coalesce(lag(i) OVER (PARTITION BY k ORDER BY i) + {n}, -1) AS INT) AS new FROM hit)) GROUP BY k, r),
gap AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS last FROM run),
per AS (SELECT k, CAST(sum(gap.b - a) AS BIGINT) AS removed, count(*) AS runs, string_agg(hex(d.b[last + 1:a]), '' ORDER BY a) || hex(any_value(d.b)[max(gap.b) + 1:]) AS kept FROM gap JOIN d USING (k) GROUP BY k)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256 FROM d LEFT JOIN per USING (k)
"""
