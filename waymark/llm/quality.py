"""Quality rules: figures of each text, and cross-document line frequency."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import cut, lists, release, slices, small, with_columns

WINDOW = 8
_WHITE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_SHAPE = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate on its host if at least ``least`` different documents there have it, however many the host has: a
    share of them would grow with the host without bound. A document is depleted if more than ``depleted`` of its words are in
    such lines."""

    least: int = 20
    depleted: float = 0.75


def repeat_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each document the number of words that stand in a window of words found twice or more in it."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(words), dtype=np.int64)
    if total < window:
        return out
    doc = np.repeat(np.arange(len(words)), sizes)
    ids = np.fromiter(map(hash, chain.from_iterable(words)), dtype=np.int64, count=total).view(np.uint64)
    key = np.zeros(total - window + 1, dtype=np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : total - window + 1 + k]
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[: len(key)].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    at = np.flatnonzero(doc[: len(key)] == doc[window - 1 :])
    if not len(at):
        return out
    order = at[np.argsort(key[at], kind="stable")]
    same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    for k in range(window):  # the hashes of the words, not only the window's
        same[same] = ids[order[1:][same] + k] == ids[order[:-1][same] + k]
    again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    hit = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[hit], minlength=len(words)).astype(np.int64)


def line_id(words: list[bytes]) -> int:
    """Hash of a line as it is compared: A-Z lower-cased, digits alike, single spaces."""
    return xxhash.xxh64_intdigest(b" ".join(words).translate(_SHAPE)) - (1 << 63)


def _profile(texts: list) -> list[pa.Array]:
    words, chars, symbols, dups, hashes, counts, ends = [], [], [], [], [], [], []
    for t in texts:
        raw = (t or "").encode()
        lines = raw.split(b"\n")
        split = [x.split() for x in lines]
        words.append([*chain.from_iterable(split)])
        chars.append(len(t or "") - len(raw) + len(raw.translate(None, _WHITE)))
        symbols.append(len(raw) - len(raw.translate(None, _SYMBOLS)))
        some = [x for x, w in zip(lines, split, strict=True) if w]
        dups.append(len(some) - len({*some}))
        own: dict[int, int] = {}
        for w in split:
            if w:
                h = line_id(w)
                own[h] = own.get(h, 0) + len(w)
        hashes += own.keys()
        counts += own.values()
        ends.append(len(hashes))
    figures = [np.array([len(w) for w in words]), np.array(chars), np.array(symbols), np.array(dups), repeat_words(words)]
    at = np.array(ends, dtype=np.int64)
    return [*(pa.array(x.astype(np.int64)) for x in figures), lists(np.array(hashes, dtype=np.int64), at), lists(np.array(counts, dtype=np.int32), at)]


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the figures of each whole text, and its different lines as two arrays: hash, and words in all lines of it."""
    return with_columns(docs, text, ", ".join(f"{c} long" for c in FIGURES) + ", line_ids array<long>, line_words array<int>", _profile)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def text_id(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text, null as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("__a"), F.xxhash64(F.lit("other"), t).alias("__b")]


KEY = ["__host", "__a", "__b"]


def boilerplate(lines: DataFrame, limits: Limits) -> DataFrame:
    """__host, line: those above the limit. Exact copies on a host are one document: copying a text makes no line boilerplate."""
    return lines.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limits.least).select("__host", "line")


def verdicts(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """One row for each different text of a host: figures, removed (line hashes), removed_words, kept.

    Texts are read once; figures and line hashes go to the shared folder. Lines are counted with partial sums,
    a very common line adds one row a partition. A host or line with many documents is a matter of counts only.
    """
    own = docs.select(F.coalesce(F.col(host), F.lit("")).alias("__host"), *text_id(F.col(text)), F.col(text).alias("__text"))
    seen = cut(profile(own, "__text").drop("__text"))
    texts = seen.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in FIGURES))
    lines = seen.select(*KEY, F.explode(F.arrays_zip("line_ids", "line_words")).alias("x")).groupBy("__host", F.col("x.line_ids").alias("line"), "__a", "__b").agg(F.max("x.line_words").alias("words"))
    removed = lines.join(boilerplate(lines, limits), ["__host", "line"]).groupBy(*KEY).agg(F.collect_list("line").alias("removed"), F.sum("words").alias("removed_words"))
    all_ = texts.join(removed, KEY, "left").withColumns({"removed": F.coalesce("removed", F.array().cast("array<long>")), "removed_words": F.coalesce("removed_words", F.lit(0)).cast("long"), "base_failed": base_failed()})
    return all_.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= limits.depleted * F.col("n_words")))


def judge(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """docs with the figures, base_failed, removed (hashes of its boilerplate lines), removed_words and kept.

    Verdicts are made for each different text of a host and joined to all rows that have it: rows of equal
    text and host, repeated ones too, get equal verdicts; ties of counts do not matter. A null host is the host "", a null
    text the empty text, which fails for its length; a very long one is read whole. An empty table gives no rows.
    Columns with the names of the new ones are replaced.
    """
    new = (*FIGURES, "base_failed", "removed", "removed_words", "kept")
    kept = [c for c in docs.columns if c.lower() not in new]
    keyed = docs.select(*kept, F.coalesce(F.col(host), F.lit("")).alias("__host"), *text_id(F.col(text)))
    return keyed.join(verdicts(docs, limits, text, host), KEY, "left").select(*kept, *new)


def apply(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """The kept documents without their boilerplate lines; columns as they were. Texts are not moved while the verdicts
    that change something are few enough to broadcast."""
    change = small(verdicts(docs, limits, text, host).where(~F.col("kept") | (F.size("removed") > 0)).select(*KEY, F.when(F.col("kept"), F.col("removed")).alias("__removed"), F.col("kept").alias("__kept")))
    keyed = docs.select(*docs.columns, F.coalesce(F.col(host), F.lit("")).alias("__host"), *text_id(F.col(text)))
    good = keyed.join(change, KEY, "left").where("coalesce(__kept, true)")
    schema = docs.schema

    def run(batches):
        for batch in chain.from_iterable(slices(b, text) for b in batches):
            texts, removed = batch.column(text).to_pylist(), batch.column("__removed").to_pylist()
            for k, gone in enumerate(removed):
                if gone:
                    gone = {*gone}
                    lines = texts[k].split("\n")
                    texts[k] = "\n".join(x for x in lines if not (w := x.encode().split()) or line_id(w) not in gone)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in schema.names], names=schema.names)
        release()

    return good.select(*docs.columns, "__removed").mapInArrow(run, schema)


def sql(limits: Limits = Limits()) -> str:
    words = lambda c: f"list_filter(string_split_regex({c}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words("t")} AS w FROM d),
line AS (SELECT k, host, t, l, len({words("l")}) AS n, regexp_replace(translate(array_to_string({words("l")}, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm
  FROM (SELECT k, host, t, unnest(string_split(t, chr(10))) AS l FROM d)),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM line WHERE n > 0 GROUP BY k),
grams AS (SELECT k, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
again AS (SELECT k, i FROM grams QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + {WINDOW})) AS j FROM again) GROUP BY k),
freq AS (SELECT host, norm FROM line WHERE n > 0 GROUP BY ALL HAVING count(DISTINCT t) >= {limits.least}),
gone AS (SELECT k, sum(n) AS n FROM line JOIN freq USING (host, norm) WHERE n > 0 GROUP BY k),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (k) LEFT JOIN rep USING (k) LEFT JOIN gone USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND removed_words <= {limits.depleted} * n_words AS kept FROM b
"""
