"""License scans: exact set-similarity join of text blocks with license templates. DataFrame operations only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.urls import _LOWER, _UPPER, lower_ascii

#: Everything that is no part of a word, once A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices and their labels. A block holds a template if it has this share of its distinct words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
)
THRESHOLD = 0.8
#: Templates of up to so many distinct words are met by all of them.
SHORT = 8
#: Words that tell one licence from another: whatever meets a template has those of them that the template has.
NAMES = frozenset("mit apache cc by nc creative commons attribution gnu general mozilla proprietary 0 2 3 4".split())


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def templates_of(table: DataFrame, label: str = "label", text: str = "text") -> tuple[tuple[str, str], ...]:
    """Templates out of a table of labels and notices or whole license texts, which is a set of rules and no corpus."""
    rows = table.select(F.coalesce(label, F.lit("")).alias("label"), F.array_join(words_of(F.col(text)), " ").alias("text"))
    return tuple((r["label"], r["text"]) for r in rows.distinct().orderBy("label", "text").collect() if r["text"])


def places(words: Column, phrase: str) -> Column:
    """Words from 0 at which the phrase begins."""
    p = phrase.split()
    fits = lambda i: every([F.get(words, i + k) == w for k, w in enumerate(p)])
    all_ = F.filter(F.sequence(F.lit(0), F.size(words) - len(p)), fits)
    return F.when((F.size(words) >= len(p)) & F.array_contains(words, max(p, key=len)), all_).otherwise(F.array().cast("array<int>"))


def every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def wants(tokens: list[str], threshold: float) -> int:
    """How many of its distinct words a template wants."""
    return len(tokens) if len(tokens) <= SHORT else math.ceil(threshold * len(tokens) - 1e-9)


def span(template: str, threshold: float) -> int:
    """How many words a block that may meet the template has."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def token_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """How many documents have each token of the vocabulary: one number a token for the driver."""
    tokens = docs.select(F.explode(F.array_intersect(_constant(vocabulary, "array<string>"), words_of(F.col(text)))).alias("token"))
    return {r["token"]: r["n"] for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def _constant(value, kind: str) -> Column:
    """A value of any size as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def find(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with n_words, places (struct of label and first word), blocks (struct of first word, label and
    containment) and score (the largest containment, 1 where a phrase stands, else 0).

    A block is any run of words of the whole text, across its lines, as long as the template divided by ``threshold``. It
    meets a template if it has at least ``threshold`` of the template's distinct words, all of them if the template is
    SHORT, and all of the template's NAMES. Of blocks of one template that overlap the one with most words counts, of ties
    the first.

    The words of all templates are put in one order, the rarest in the corpus first. A template of n words
    that wants m of them shares one of its first n - m + 1 with every block that meets it, so only these are
    indexed. A text's own words, in the same order, fetch templates from the index; one goes on
    only if what follows in both can still reach m, and then its blocks are counted. A text with fewer
    than m words of any template is passed over before.

    Each document is judged by itself: no row is moved but the partial counts of the templates' words. A
    null or empty text has no words, a very long one is gone through whole; an empty table gives no rows. Rows, ties and
    other columns stay; columns with the names of the new ones are replaced.
    """
    templates = [(label, t) for label, t in templates if t]
    tokens = [sorted(set(t.split())) for _, t in templates]
    vocabulary = sorted({w for t in tokens for w in t})
    seen = token_counts(docs, vocabulary, text)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    tokens = [sorted(t, key=rank.__getitem__) for t in tokens]
    wanted = [wants(t, threshold) for t in tokens]
    index: dict[str, list[dict]] = {}
    for k, t in enumerate(tokens):
        for i, w in enumerate(t[: len(t) - wanted[k] + 1]):
            index.setdefault(w, []).append({"t": k, "after": len(t) - 1 - i, "need": wanted[k]})
    fetch = _constant(index, "map<string,array<struct<t:int,after:int,need:int>>>")
    known = _constant(
        [{"label": label, "tokens": t, "n": len(t), "need": wanted[k], "names": [w for w in t if w in NAMES], "span": span(raw, threshold)} for k, ((label, raw), t) in enumerate(zip(templates, tokens, strict=True))],
        "array<struct<label:string,tokens:array<string>,n:int,need:int,names:array<string>,span:int>>",
    )
    least = min(wanted, default=1)

    def candidates(b: Column) -> Column:
        """b: a text's words that any template has, in the common order. Of a template that several words
        fetch the first one counts: no word before it is shared, so what follows bounds the overlap."""
        got = F.transform(b, lambda w, j: F.filter(F.coalesce(fetch[w], F.array()), lambda e: F.least(e["after"], F.size(b) - 1 - j) + 1 >= e["need"]))
        return F.array_distinct(F.transform(F.flatten(got), lambda e: e["t"]))

    def runs(words: Column, t: Column) -> Column:
        """Where the template stands: word, label and containment of each run that meets it."""

        def sized(i: Column) -> Column:
            run = F.slice(words, i + 1, t["span"])
            named = F.size(F.array_intersect(t["names"], run)) == F.size(t["names"])
            return F.struct(i.alias("word"), F.when(named, F.size(F.array_intersect(t["tokens"], run))).otherwise(0).alias("shared"))

        def step(acc: Column, x: Column) -> Column:
            last, one = F.try_element_at(acc, F.lit(-1)), F.array(x)
            apart = last.isNull() | (x["word"] >= last["word"] + t["span"])
            return F.when(apart, F.concat(acc, one)).when(x["shared"] > last["shared"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), one)).otherwise(acc)

        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(t["tokens"], F.get(words, i)))
        good = F.filter(F.transform(at, sized), lambda x: x["shared"] >= t["need"])
        apart = F.aggregate(good, F.array().cast("array<struct<word:int,shared:int>>"), step)
        return F.transform(apart, lambda x: F.struct(x["word"].alias("word"), t["label"].alias("label"), (x["shared"] / t["n"]).alias("containment")))

    new = ("n_words", "places", "blocks", "score")
    kept = [c for c in docs.columns if c.lower() not in new]
    # Whatever a run shares with a template the whole text shares with it too.
    own = docs.select(*kept, words_of(F.col(text)).alias("__words"))
    own = own.withColumn("__words_known", F.array_intersect(_constant(order, "array<string>"), "__words"))
    none = F.array().cast("array<struct<word:int,label:string,containment:double>>")
    stood = F.transform(candidates(F.col("__words_known")), lambda t: runs(F.col("__words"), F.get(known, t)))
    found = F.when(F.size("__words_known") >= least, F.flatten(stood)).otherwise(none)
    labelled = lambda label: lambda i: F.struct(F.lit(label).alias("label"), i.alias("word"))
    stand = F.concat(*(F.transform(places(F.col("__words"), p), labelled(label)) for p, label in phrases))
    out = own.select(*kept, F.size("__words").cast("long").alias("n_words"), stand.alias("places"), found.alias("blocks"))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0)))
    return out.withColumn("score", score)


def sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    distinct = lambda t: sorted(set(t.split()))
    values = ", ".join(f"({i}, '{label}', {distinct(t)}, {wants(distinct(t), threshold)}, {span(t, threshold)}, CAST({[w for w in distinct(t) if w in NAMES]} AS VARCHAR[]))" for i, (label, t) in enumerate(templates))
    parts = [f"SELECT k, '{label}' AS label, i - 1 AS word FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, '{max(p.split(), key=len)}')) WHERE w[i:i+{len(p.split()) - 1}] = {p.split()}" for p, label in phrases]
    return f"""
WITH d AS (SELECT k, doc_id, list_filter(string_split_regex(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)),
tpl(i, label, tokens, need, span, names) AS (VALUES {values}),
near AS (SELECT k, label, tokens, need, span, names, w FROM d, tpl WHERE len(list_intersect(tokens, list_distinct(w))) >= need AND list_has_all(w, names)),
run AS (SELECT k, label, tokens, need, names, w[j:j+span-1] AS r FROM (SELECT *, unnest(range(1, len(w) + 1)) AS j FROM near) WHERE list_contains(tokens, w[j])),
met AS (SELECT k, label, len(list_intersect(tokens, list_distinct(r))) / CAST(len(tokens) AS DOUBLE) AS c FROM run WHERE list_has_all(r, names) AND len(list_intersect(tokens, list_distinct(r))) >= need),
place AS ({" UNION ALL ".join(parts)}),
p AS (SELECT k, count(*) AS n, min(word) AS a, max(word) AS b, list(DISTINCT label) AS labels FROM place GROUP BY k),
m AS (SELECT k, max(c) AS c, list(DISTINCT label) AS labels FROM met GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, b AS last_word,
  array_to_string(list_sort(coalesce(p.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN p USING (k) LEFT JOIN m USING (k)
"""
