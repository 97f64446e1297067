"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from waymark.llm.common import alnum_words, cut_rows, drop, release, slices

WINDOW = 8
#: Words of items in one automaton, and automata (some 60 bytes a word and their different words) that workers hold at a time.
#: More items make more automata, which take their turns.
BLOCK_WORDS, HELD = 200_000, 8
#: A document loses its place when more than this share of its words is hit.
COVERAGE = 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several word sequences, each begun at the root again, as arrays.

    It knows every run of words of every item. A state holds runs that end at the same places; ``items_of`` names
    for a state those items in which its window of ``window`` words stands, or that are shorter and end here as a whole.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        made = _Made(items, window)
        self.ids, self.shortest, self.bits, self.grams = made.ids, made.shortest, made.bits, made.grams
        states = [(s, c, t) for s, own in enumerate(made.next) for c, t in own.items()]
        code = np.array([s * len(self.ids) + c for s, c, _ in states], dtype=np.int64)
        order = np.argsort(code)
        #: Transitions, by state and word, and where they lead.
        self.code, self.to = code[order], np.array([t for _, _, t in states], dtype=np.int32)[order]
        self.link, self.len, self.near = (np.array(x, dtype=np.int32) for x in (made.link, made.len, made.near))
        #: Items of the states that have any: (words, item) from one end to the next.
        self.marked = np.array(sorted(made.items), dtype=np.int32)
        sizes = [len(made.items[s]) for s in self.marked.tolist()]
        self.ends = np.cumsum([0, *sizes])
        names = sorted({name for x in made.items.values() for _, name in x})
        place = {name: k for k, name in enumerate(names)}
        self.names = names
        self.mark_len, self.mark_item = (np.array(x, dtype=np.int32) for x in zip(*((n, place[name]) for s in self.marked.tolist() for n, name in sorted(made.items[s])))) if names else (np.zeros(0, dtype=np.int32),) * 2

    def _next(self, state: int, word: int) -> int:
        code = state * len(self.ids) + word
        k = int(np.searchsorted(self.code, code))
        return int(self.to[k]) if k < len(self.code) and self.code[k] == code else -1

    def walk(self, seq) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest run that ends there and is in some item."""
        state, length = 0, 0
        for c in seq:
            to = self._next(state, c)
            while to < 0 and state:
                state = int(self.link[state])
                length = int(self.len[state])
                to = self._next(state, c)
            if to >= 0:
                state, length = to, length + 1
            yield state, length

    def items_of(self, state: int) -> Iterator[tuple[int, str]]:
        k = int(np.searchsorted(self.marked, state))
        for i in range(int(self.ends[k]), int(self.ends[k + 1])):
            yield int(self.mark_len[i]), self.names[self.mark_item[i]]

    def matches(self, words: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]] | None]:
        """For each document the mask of hit words and the items found, or None where nothing is.

        Only runs of words whose neighbours are neighbours in items too, and that are long enough for a
        window, are walked: no window goes beyond such a run.
        """
        ids = np.fromiter((x for w in words for x in (*map(self.ids.get, w, repeat(-1)), -1)), dtype=np.int64, count=sum(map(len, words)) + len(words))
        out: list = [None] * len(words)
        if not self.ids or not len(ids):
            return out
        known = ids >= 0
        joined = np.zeros(len(ids) + 1, dtype=bool)  # a word and the one before it may stand in one window
        joined[1:-1] = known[1:] & known[:-1]
        at = np.flatnonzero(joined)
        joined[at] = self.grams[_pair(ids[at - 1], ids[at], self.bits)]
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        doc_ends = np.cumsum([len(w) + 1 for w in words])
        for a, b, d in zip(starts.tolist(), ends.tolist(), np.searchsorted(doc_ends, starts, side="right").tolist(), strict=True):
            base = int(doc_ends[d]) - len(words[d]) - 1
            for i, (state, length) in enumerate(self.walk(ids[a:b].tolist()), a + 1):
                s = int(self.near[state]) if state else -1
                while s > 0:
                    for n, name in self.items_of(s):
                        if n <= length:
                            if out[d] is None:
                                out[d] = np.zeros(len(words[d]), dtype=bool), set()
                            out[d][0][i - n - base : i - base] = True
                            out[d][1].add(name)
                    s = int(self.near[self.link[s]])
        return out


def _pair(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)


class _Made:
    """The automaton while it is made, on the driver, with a table of transitions for each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        seen: list[tuple[str, list[int]]] = []
        for name, words in items:
            if words:
                seq = [self.ids.setdefault(w, len(self.ids)) for w in words]
                seen.append((name, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(s) for _, s in seen)])
        self.items: dict[int, set[tuple[int, str]]] = {}
        self._mark(seen)
        self.grams = self._filter([s for _, s in seen])

    def _clone(self, q: int, length: int) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(length)
        return len(self.len) - 1

    def _redirect(self, p: int, c: int, q: int) -> int:
        """The state of the longest run at p followed by c, split off from q if q holds longer ones too."""
        if self.len[q] == self.len[p] + 1:
            return q
        new = self._clone(q, self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._redirect(last, c, self.next[last][c])
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        cur, p = len(self.len) - 1, last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            self.link[cur] = self._redirect(p, c, self.next[p][c])
        return cur

    def walk(self, seq) -> list[tuple[int, int]]:
        """For each word the state and length of the longest run that ends there and is in some item."""
        state, length, out = 0, 0, []
        nxt, link, lens = self.next, self.link, self.len
        for c in seq:
            while state and c not in nxt[state]:
                state = link[state]
                length = lens[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            out.append((state, length))
        return out

    def _of(self, state: int, n: int) -> int:
        """The state of the last n words, from a state of at least as many."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, seen) -> None:
        for name, seq in seen:
            n = min(self.window, len(seq))
            for state, length in self.walk(seq)[n - 1 :]:
                self.items.setdefault(self._of(state, n), set()).add((n, name))
        #: For each state the nearest one on its way to the root, itself included, that has items.
        self.near = [-1] * len(self.len)
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.near[s] = s if s in self.items else self.near[self.link[s]]

    def _filter(self, seqs) -> np.ndarray:
        """Marks the pairs of neighbours in items by hash: a pair without a mark is in none."""
        bits = max(16, (8 * sum(map(len, seqs)) + 1).bit_length())
        grams = np.zeros(1 << bits, dtype=bool)
        for s in seqs:
            a = np.array(s, dtype=np.int64)
            grams[_pair(a[:-1], a[1:], bits)] = True
        self.bits = bits
        return grams


def blocks_of(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata of all items, each of at most block_words words (or one item that has more), one after the other.

    The items come to the driver one partition at a time, and it holds one block of them. An item without id is listed as
    an empty string, one without words matches nothing.
    """
    block, size = [], 0
    for r in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), text).toLocalIterator():
        words = alnum_words(r[1])
        if block and size + len(words) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((r[0], words))
        size += len(words)
    yield Automaton(block, window)


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code points from the first to past the last word of each run of hit words."""
    out: list[tuple[int, int]] = []
    last = False
    for m, h in zip(_WORD.finditer(text), hit.tolist(), strict=True):
        if h:
            out[-1:] = [(out[-1][0], m.end())] if last else [*out[-1:], m.span()]
        last = h
    return out


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW, block_words: int = BLOCK_WORDS, held: int = HELD, prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings) and spans (start, end in code points).

    A word is hit if it stands in an occurrence of ``window`` consecutive words of an item, or of a shorter
    item as a whole. A null or empty text has no words; a very long one is gone through whole. An id that several items share
    counts once. Rows, ties and other columns stay; columns with the names of the new ones, which a prefix may change, are
    replaced. Empty tables give no rows, or no hits.

    One pass over docs without a shuffle while the items make no more than ``held`` automata, which are broadcast: a bound
    on their size that is counted as they are made. More take turns of as many, with what was found so far
    written to the shared folder, so workers never hold more.
    """
    sc, blocks = docs.sparkSession.sparkContext, blocks_of(items, item_text, item_id, window, block_words)
    new = [f"{prefix}{c}" for c in ("n_words", "n_hit", "item_ids", "spans")]
    kept = [c for c in docs.columns if c.lower() not in {x.lower() for x in new}]
    if text not in kept:
        raise ValueError(f"{text} is read and cannot be replaced")
    found, last = docs.select(*kept), None
    while turn := [*islice(blocks, held)]:
        found = _turn(found, text, [sc.broadcast(a) for a in turn], "__hit" if last is not None else None)
        if len(turn) < held:
            break
        # There may be more.
        before, last = last, cut_rows(found)
        found = last
        if before is not None:
            drop(before)
    size = lambda runs: F.aggregate(runs, F.lit(0), lambda n, r: n + r["end"] - r["start"]).cast("long")
    return found.select(*kept, F.col("__n").alias(new[0]), size(F.col("__hit.runs")).alias(new[1]), F.col("__hit.items").alias(new[2]), F.col("__hit.spans").alias(new[3]))


_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_HIT = pa.struct([("items", pa.list_(pa.string())), ("runs", pa.list_(_RUN)), ("spans", pa.list_(_RUN))])
HIT = "__n long, __hit struct<items:array<string>,runs:array<struct<start:int,end:int>>,spans:array<struct<start:int,end:int>>>"


def _turn(docs: DataFrame, text: str, held: list, so_far: str | None) -> DataFrame:
    """docs with the number of words and what the held automata find, added to what was found before: items, runs of hit words
    and where these stand in the text."""
    columns = [c for c in docs.columns if c not in ("__n", "__hit")]
    schema = T.StructType([*(docs.schema[c] for c in columns), *T.StructType.fromDDL(HIT)])

    def run(batches):
        for s in chain.from_iterable(slices(b, text) for b in batches):
            texts = s.column(text).to_pylist()
            words = [alnum_words(t) for t in texts]
            found: list = [None] * len(texts)
            if so_far:
                for k, h in enumerate(s.column(so_far).to_pylist()):
                    if h["items"]:
                        mask = np.zeros(len(words[k]), dtype=bool)
                        for r in h["runs"]:
                            mask[r["start"] : r["end"]] = True
                        found[k] = mask, {*h["items"]}
            for b in held:
                for k, m in enumerate(b.value.matches(words)):
                    if m is not None:
                        found[k] = m if found[k] is None else (found[k][0] | m[0], found[k][1] | m[1])
            hits = [{"items": sorted(m[1]), "runs": _runs(m[0]), "spans": [{"start": a, "end": b} for a, b in spans_of(t, m[0])]} if m else {"items": [], "runs": [], "spans": []} for t, m in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in columns), pa.array([len(w) for w in words], pa.int64()), pa.array(hits, _HIT)], names=[x.name for x in schema])
        release()

    return docs.mapInArrow(run, schema)


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]))).tolist()
    return [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]


def remove(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **how) -> DataFrame:
    """docs without their hit spans, and without those documents that are hit in more than ``coverage`` of their words."""
    text = how.get("text", "text")
    columns = docs.columns
    found = find(docs, items, **how, prefix="__found_").where(F.col("__found_n_hit") <= F.lit(coverage) * F.col("__found_n_words"))
    # What stands between the spans: from each span's end to the next one's start.
    starts = F.concat(F.array(F.lit(0)), F.col("__found_spans.end"))
    ends = F.concat(F.col("__found_spans.start"), F.array(F.length(text)))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substr(F.col(text), a + 1, b - a)), "")
    return found.withColumn(text, F.when(F.col("__found_n_hit") > 0, left).otherwise(F.col(text))).select(*columns)


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the digest columns of all documents."""
    words = lambda c: f"list_filter(string_split_regex(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {words("text")} AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least({window}, len(w)) AS n FROM item WHERE len(w) > 0))),
g AS (SELECT k, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT k, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT k, i, n, item FROM g JOIN win USING (n, g)),
words AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + n)) AS j FROM hit) GROUP BY k),
items AS (SELECT k, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(len(coalesce(l, [])) AS BIGINT) AS n_items, sha256(array_to_string(coalesce(l, []), ',')) AS items_sha256, len(coalesce(l, [])) >= 2 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""
