"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import cut, cut_rows, drop, lists, release, small, with_columns
from waymark.llm.components import components
from waymark.llm.sketch import bands, parities, set_ids, shingle_sets, sketches


@dataclass(frozen=True)
class Settings:
    """Two texts are linked if 100 * shared >= percent * all of their shingles of ``size`` words.

    With bands of 4 of 128 coordinates, two texts of similarity 0.85 share no band with a probability of
    (1 - 0.85^4)^32 = 6e-11, of 0.8 with 5e-8.
    """

    size: int = 5
    percent: int = 80
    coordinates: int = 128
    rows: int = 4
    #: Members of a bucket that are compared with as many others in one task, by their parities and by their sets.
    wide: int = 4096
    block: int = 1024


def sketch(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """docs with n_shingles, node (hash of the set), node2 (another) and bands; no text without words has bands."""

    def run(texts: list) -> list[pa.Array]:
        sets = shingle_sets(texts, s.size)
        some = np.array([len(x) > 0 for x in sets], dtype=bool)
        b = bands(sketches([x for x in sets if len(x)], s.coordinates), s.rows) if some.any() else np.zeros((0, 1), dtype=np.int64)
        a1, a2 = set_ids(sets)
        return [pa.array([len(x) for x in sets], pa.int64()), pa.array(a1), pa.array(a2), lists(b.reshape(-1), np.cumsum(some * (s.coordinates // s.rows)))]

    return with_columns(docs, text, "n_shingles long, node long, node2 long, bands array<long>", run)


def _sets(docs: DataFrame, s: Settings, text: str) -> DataFrame:
    """docs with the hashes of the text's set, its size, its shingles, their different 32-bit ends, and their parities."""

    def run(texts: list) -> list[pa.Array]:
        sets = shingle_sets(texts, s.size)
        short = pa.array([np.unique(x.astype(np.uint32)).tobytes() for x in sets])
        own = set_ids(sets)
        return [*map(pa.array, own), pa.array([len(x) for x in sets], pa.int64()), lists(np.concatenate(sets).view(np.int64), np.cumsum([len(x) for x in sets])), short, pa.array([parities(x).tobytes() for x in sets])]

    return with_columns(docs, text, "node long, node2 long, n long, shingles array<long>, short binary, parity binary", run)


def _looked_up(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, s: Settings, text: str) -> DataFrame:
    """id and set of the wanted nodes, each from one of the rows that have it."""
    r = small(nodes.join(wanted, "id").select("id", F.col("__id").alias("__i"), F.col("__tid").alias("__t"), F.col("node").alias("__n"), F.col("node2").alias("__n2")))
    base = docs.select("__id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__tid"), text)
    found = base.join(r, (F.col("__tid") == F.col("__t")) & F.col("__id").eqNullSafe(F.col("__i"))).select("id", "__n", "__n2", text)
    same = _sets(found, s, text).where((F.col("node") == F.col("__n")) & (F.col("node2") == F.col("__n2")))
    out = cut_rows(same.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "shingles", "short", "parity"))))
    drop(r)
    return out


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(b, "b").join(a, "a").where(linked(shared, F.size("x"), F.size("y"), s.percent)).select("a", "b")


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Parities of rows of words, folded to a smaller power of two of words."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ, a word at a time."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int32)
    for c in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., c] ^ b[..., c])
    return out


def _near(asking: list[np.ndarray], n: np.ndarray, label: np.ndarray, told: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int, cells: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asking, and of the told, may be linked with one of another label.

    asking, told: parities as 64-bit words. Two sets differ in at least as many shingles as their parities
    differ in bits, folded ones too, so what is left out here is not linked. A quarter of the bits tells most.
    """
    ask, tell = np.zeros(len(asking), dtype=bool), np.zeros(len(told), dtype=bool)
    width, wide = (np.array([len(x) for x in y]) for y in (asking, told))
    # 2 * shared = both - differ at most
    may = lambda both, differ: 100 * (both - differ) >= percent * (both + differ)
    for v in np.unique(width):
        for w in np.unique(wide):
            i, j, k = np.flatnonzero(width == v), np.flatnonzero(wide == w), int(min(v, w))
            a, b = (_folded(np.stack([x[y] for y in z]), k) for x, z in ((asking, i), (told, j)))
            short_a, short_b = (_folded(x, max(1, k // 4)) for x in (a, b))
            step = max(1, cells // len(j))
            for at in range(0, len(i), step):
                q = i[at : at + step]
                both = n[q][:, None] + sizes[j][None]
                good = may(both, _bits(short_a[at : at + step, None], short_b[None])) & (label[q][:, None] != labels[j][None])
                x, y = np.nonzero(good)
                for z in range(0, len(x), cells):
                    x_, y_ = x[z : z + cells], y[z : z + cells]
                    still = may(both[x_, y_], _bits(a[at + x_], b[y_]))
                    ask[q[x_[still]]] = True
                    tell[j[y_[still]]] = True
    return ask, tell


def _union(asking: list[np.ndarray], n: np.ndarray, label: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (place in asking, place in sets) between members of different labels, enough to tell which belong together.

    asking, sets: different 32-bit ends of shingles; n, sizes: numbers of shingles. Each asking set counts what it shares
    with all others at once, over the lists of the sets that hold a shingle. What two sets share is never more than the ends they
    share and those ends that either has lost to equal ones, so no link is missed.
    """
    out, held = [], np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), held)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    for i, (own, c) in enumerate(zip(asking, label.tolist(), strict=True)):
        a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        k = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        shared = np.bincount(owner[at], minlength=len(sets)) + np.minimum(n[i] - len(own), sizes - held)
        for j in np.flatnonzero((labels != c) & linked(shared, n[i], sizes, percent)).tolist():
            x, y = root(c), root(int(labels[j]))
            if x != y:
                joined[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _dealt(members: DataFrame, s: Settings, block: int) -> DataFrame:
    """Members (key, id, n, component) of a bucket as they meet: key, g, i, j, asks, id, component.

    The members outside a bucket's largest component ask, and all are told. Both are dealt by classes of size, g: a set
    asks those of its own class and the next ones on both sides, beyond which no size is near enough. In a class
    each block of the ones meets each block of the others, so t told and a asking make t * ceil(a / block) + a * ceil(t / block) rows.
    """
    # A little wider than the quotient of sizes, so that rounding cannot part sizes at the threshold by two classes.
    class_ = F.floor(F.log(F.col("n")) / F.lit(1.0001 * math.log(100 / s.percent))).cast("int")
    sized = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = sized.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    told = members.select("key", class_.alias("g"), "id", "component")
    asks = members.join(largest, "key").where("component <> largest").select("key", F.explode(F.array(class_ - 1, class_, class_ + 1)).alias("g"), "id", "component")
    blocks = lambda x, name: x.groupBy("key", "g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    most = blocks(asks, "asking").join(blocks(told, "asked"), ["key", "g"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asks.join(most, ["key", "g"]).select("key", "g", own("asking").alias("i"), each("asked").alias("j"), F.lit(True).alias("asks"), "id", "component")
    b = told.join(most, ["key", "g"]).select("key", "g", own("asked").alias("j"), each("asking").alias("i"), F.lit(False).alias("asks"), "id", "component")
    return a.unionByName(b)


_MEET = ("key", "g", "i", "j")


def _meetings(dealt: DataFrame, f, schema: str) -> DataFrame:
    """f over each group of rows that meet, as one record batch. Groups are small and many, so they are cut out of whole
    batches of sorted rows; a task holds one batch and one group."""

    def groups_of(batches):
        rest = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            keys = [b.column(c).to_numpy() for c in _MEET]
            turn = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if len(b) > 1 else np.zeros(0, dtype=np.int64)
            ends = [0, *turn.tolist()]
            for x, y in zip(ends, ends[1:]):
                yield b.slice(x, y - x)
            rest = b.slice(ends[-1])
        if rest is not None and len(rest):
            yield rest

    def run(batches):
        for g in groups_of(b for b in batches if len(b)):
            asks = g.column("asks").to_numpy(zero_copy_only=False)
            if asks.any() and not asks.all():
                yield f(g, asks)
        release()

    return dealt.repartition(*_MEET).sortWithinPartitions(*_MEET).mapInArrow(run, schema)


def _sides(g: pa.RecordBatch, asks: np.ndarray, kind: str):
    """Sets, sizes and components of those that ask, and of the others."""
    x = [np.frombuffer(v, dtype=kind) if isinstance(v, bytes) else np.asarray(v, dtype=kind) for v in g.column("x").to_pylist()]
    n, component = g.column("n").to_numpy(), g.column("component").to_numpy()
    for own in (asks, ~asks):
        yield [x[k] for k in np.flatnonzero(own)], n[own], component[own]


def _maybe(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Those members that their parities allow a link with a member of the same bucket and another component."""
    dealt = _dealt(members, s, s.wide).join(sets.select("id", "n", F.col("parity").alias("x")), "id")

    def run(g: pa.RecordBatch, asks: np.ndarray) -> pa.RecordBatch:
        good = np.zeros(len(g), dtype=bool)
        q, d = _sides(g, asks, "<u8")
        good[asks], good[~asks] = _near(*q, *d, s.percent)
        at = np.flatnonzero(good)
        return pa.RecordBatch.from_arrays([pa.array(g.column(c).to_numpy()[at]) for c in ("key", "id")], names=["key", "id"])

    found = _meetings(dealt, run, "key long, id long").distinct()
    return members.join(found, ["key", "id"], "left_semi")


def _within(members: DataFrame, sets: DataFrame, s: Settings, short: bool = True) -> DataFrame:
    """All links (a, b) that matter between members of a bucket that are not together yet, by whole sets. short: sets go as
    32-bit ends, and links have to be verified."""
    dealt = _dealt(members, s, s.block).join(sets.select("id", "n", F.col("short" if short else "shingles").alias("x")), "id")

    def run(g: pa.RecordBatch, asks: np.ndarray) -> pa.RecordBatch:
        q, d = _sides(g, asks, "<u4" if short else "<i8")
        found = np.array(_union(*q, *d, s.percent), dtype=np.int64).reshape(-1, 2)
        id_ = g.column("id").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(id_[asks][found[:, 0]]), pa.array(id_[~asks][found[:, 1]])], names=["a", "b"])

    return _meetings(dealt, run, "a long, b long").distinct()


def _more_links(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links within buckets: parities tell which members may have any, 32-bit ends which links they may be, whole sets which
    they are. Should one not hold, which only equal ends of different shingles can bring about, what it has kept from
    being compared is compared by whole sets."""
    some = cut(_maybe(members, sets, s))
    found = cut(_within(some, sets, s))
    good = cut(_verified(found, sets, s))
    if good.count() != found.count():
        drop(good)
        good = cut(_within(some, sets, s, short=False))
    drop(some, found)
    return good


def groups(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: its id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Rows of equal shingle sets (by two 64-bit hashes) are one node, with a number of its own. In each bucket (band) every node
    is verified against the smallest one. Where a bucket's nodes are then in more than one component and not every two of
    them have been compared, its members are compared with each other, but for those already together; buckets with
    the same members count once. So no link between different components is left out, and no bucket is written out as pairs.

    A text without words is linked with nothing: component_id is its own id. A very long text is one set of all its shingles.
    Rows without id belong to the component of their text; its component_id is the smallest id there is, or null, and kept
    tells whether both are equal, nulls too. Rows that repeat an id get the result of their own text, and count each; of
    equal ids with different texts both are kept if both are the smallest of their components. An empty table gives
    no rows. Columns other than the text and the id are not read, whatever their names.
    """
    out = _groups(docs, settings, text, doc_id)
    kept = F.col("component_id").eqNullSafe(F.col("__id"))
    return out.select(F.col("__id").alias(doc_id), "n_shingles", "component_id", kept.alias("kept"))


def _groups(docs: DataFrame, s: Settings, text: str, doc_id: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    base = own.withColumn("__tid", F.xxhash64(F.coalesce("__text", F.lit(""))))
    sig = cut(sketch(base, s, "__text").drop("__text"))
    first = F.struct(F.col("__id").isNull(), F.col("__id").alias("__id"), F.col("__tid").alias("__tid"))
    each = sig.where("n_shingles > 0").groupBy("node", "node2").agg(F.min(first).alias("f"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    # Numbers, written at once, stand for the two hashes from here on: different sets have different ones.
    nodes = cut(each.select(F.monotonically_increasing_id().alias("id"), "node", "node2", "size", "f.__id", "f.__tid", "bands"))
    spread = nodes.select("id", "size", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot"), F.min_by("size", "id").alias("pivot_size"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # Buckets of equal members are one; most copies share nearly all of their bands.
    buckets = buckets.groupBy("n", "pivot", "pivot_size", "members").agg(F.min("key").alias("key")).drop("members")
    members = cut(spread.join(buckets, "key").select("key", "id", "size", "n", "pivot", "pivot_size"))
    # Sets of too different sizes cannot be similar enough.
    near = 100 * F.least("size", "pivot_size") >= s.percent * F.greatest("size", "pivot_size")
    pairs = cut(members.where((F.col("id") != F.col("pivot")) & near).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    ends = [pairs.select(F.col(c).alias("id")) for c in "ab"]
    wanted = members.where("n > 2").select("id").unionByName(ends[0]).unionByName(ends[1]).distinct()
    sets = _looked_up(own, wanted, nodes.select("id", "node", "node2", "__id", "__tid"), s, "__text")
    links = _verified(pairs, sets, s)
    found = components(links)
    # A bucket of two has been compared as a whole.
    at = members.where("n > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.col("size").alias("n"), F.coalesce("component", "id").alias("component"))
    split = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    left = cut(at.join(split, "key"))
    if left.head() is not None:
        more = _more_links(left, sets, s)
        if more.head() is not None:
            last, found = found, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
            drop(last)
        drop(more)
    known = nodes.select("id", "node", "node2", "__id").join(found.withColumnRenamed("node", "id"), "id", "left")
    least = known.where("component is not null").groupBy("component").agg(F.min("__id").alias("component_id"))
    result = cut(known.join(least, "component", "left").select("node", "node2", F.when(F.col("component").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id")))
    drop(left, sets, pairs, members, found, nodes)
    some = sig.where("n_shingles > 0").select("__id", "__tid", "n_shingles", "node", "node2").join(result, ["node", "node2"]).select("__id", "__tid", "n_shingles", "component_id")
    none = sig.where("n_shingles = 0").select("__id", "__tid", "n_shingles", F.col("__id").alias("component_id"))
    return some.unionByName(none)


def apply(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group: the one with the smallest id. Columns stay.

    Of rows that repeat an id and text one stays. Rows without id stay, one for each text, unless their group has an id.
    """
    key = lambda i, t: [F.xxhash64(F.lit(k), i, i.isNull(), t).alias(f"__k{k}") for k in (1, 2)]
    keys = ["__k1", "__k2"]
    out = _groups(docs, settings, text, doc_id).select(*key(F.col("__id"), F.col("__tid")), F.col("component_id").eqNullSafe(F.col("__id")).alias("kept"))
    odd = cut(out.groupBy(*keys).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    keyed = docs.select(*docs.columns, *key(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    single = keyed.join(small(odd.select(*keys)), keys, "left_anti")
    repeated = odd.where("kept")
    if repeated.head() is not None:
        single = single.unionByName(keyed.join(small(repeated.select(*keys)), keys, "left_semi").dropDuplicates(keys))
    return single.select(*docs.columns)


def sql(size: int, percent: int) -> str:
    """DuckDB SQL for the groups: every two different sets that share a shingle are compared."""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT k, array_to_string(w[i:i+{size - 1}], ' ') AS e FROM (SELECT k, w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT d.k, doc_id, coalesce(s, []) AS s FROM d LEFT JOIN (SELECT k, list_sort(list(DISTINCT e)) AS s FROM grams GROUP BY k) g ON d.k = g.k),
ids AS (SELECT k, doc_id, len(s) AS n, s, dense_rank() OVER (ORDER BY s) AS c FROM s),
sets AS (SELECT c, any_value(n) AS n, any_value(s) AS s FROM ids WHERE n > 0 GROUP BY c),
x AS (SELECT c, n, unnest(s) AS e FROM sets),
link AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.e = b.e AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT c, c AS m FROM sets UNION SELECT b, m FROM reach JOIN edge ON a = c),
least AS (SELECT m AS c, min(doc_id) AS component_id FROM reach JOIN (SELECT c, min(doc_id) AS doc_id FROM ids GROUP BY c) USING (c) GROUP BY m)
SELECT doc_id, CAST(ids.n AS BIGINT) AS n_shingles, CASE WHEN ids.n = 0 THEN doc_id ELSE component_id END AS component_id, (CASE WHEN ids.n = 0 THEN doc_id ELSE component_id END) IS NOT DISTINCT FROM doc_id AS kept
FROM ids LEFT JOIN least USING (c)
"""
