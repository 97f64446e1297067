"""Journeys as a directed network.

Stops come in long form, one row each: ``layer, ord, pos, stop`` (ord: the trip's place in its
source; pos: anything that orders the stops of a trip). Places: ``layer, code, name, lng, lat``.
Long form needs no array of a trip in one row, and every per-trip result is one aggregate with
partial sums before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, StructType

TRIP = ("layer", "ord")
#: How trips are grouped and joined: by the number first, as a sort by it is fast, and one by a layer's name is not.
BY = ("ord", "layer")
PAIR = ("layer", "start_lng", "start_lat", "end_lng", "end_lat")


def stops_of(trips: DataFrame) -> DataFrame:
    """Long form of trips that carry a ``route`` array; a trip without stops has no row."""
    return trips.select(*TRIP, F.posexplode("route").alias("pos", "stop"))


def _order(stops: DataFrame) -> tuple[Column, Callable[[Column], Column]]:
    """What orders the stops of a trip by pos and then by stop, null where pos is, and how the stop is taken out of it.

    Where pos, or all fields of it, and the stop are whole numbers whose ranges together need at most 63 bits, it is one
    long, so that the least and greatest are hashed and no stop is sorted; the ranges are read from all stops first. A field
    that is always the stop itself is put in once. Otherwise it is a struct, which Spark aggregates by sorting.
    """
    pos, kept = stops.schema["pos"].dataType, stops.schema["stop"].dataType
    whole = F.when(F.col("pos").isNotNull(), F.struct("pos", "stop")), lambda k: k["stop"]
    fields = [(f.dataType, F.col("pos").getField(f.name)) for f in pos] if isinstance(pos, StructType) else [(pos, F.col("pos"))]
    fields.append((kept, F.col("stop")))
    if not all(isinstance(t, IntegralType) for t, _ in fields):
        return whole
    parts = [c.cast("long") for _, c in fields]
    found = stops.where("pos IS NOT NULL").agg(*(f(c) for c in parts for f in (F.min, F.max)), *(F.bool_and(c.eqNullSafe(parts[-1])) for c in parts[:-1])).head()
    least, most, same = found[: 2 * len(parts) : 2], found[1 : 2 * len(parts) : 2], found[2 * len(parts) :]
    at = next((i for i, x in enumerate(same) if x), len(parts) - 1)
    if at < len(parts) - 1:
        parts = parts[:-1]
    # A null comes before the least, as it does in a struct.
    bits = [0 if lo is None else (hi - lo + 1).bit_length() for lo, hi in zip(least, most, strict=True)][: len(parts)]
    if sum(bits) > 63:
        return whole
    key = F.lit(0).cast("long")
    for c, lo, n in zip(parts, least, bits, strict=False):
        if n:
            key = F.shiftleft(key, n).bitwiseOR(F.coalesce(c - F.lit(lo).cast("long") + F.lit(1), F.lit(0).cast("long")))

    def stop(k: Column) -> Column:
        if not bits[at]:
            return F.lit(None).cast(kept)
        n = F.shiftright(k, sum(bits[at + 1 :])).bitwiseAND(F.lit((1 << bits[at]) - 1).cast("long"))
        return F.when(n > 0, n - F.lit(1) + F.lit(least[at]).cast("long")).cast(kept)

    return F.when(F.col("pos").isNotNull(), key), stop


def endpoint_counts(stops: DataFrame) -> DataFrame:
    """How often each stop begins or ends a trip; a trip of one stop counts twice for it."""
    key, stop = _order(stops)
    ends = stops.select(*TRIP, key.alias("k")).groupBy(*BY).agg(F.min("k").alias("s"), F.max("k").alias("e"))
    return counts_of(ends.select("layer", stop(F.col("s")).alias("first"), stop(F.col("e")).alias("last")))


def counts_of(ends: DataFrame) -> DataFrame:
    """:func:`endpoint_counts` from what :func:`trip_ends` or :func:`end_stops` gives."""
    return (
        ends.select("layer", F.explode(F.array("first", "last")).alias("stop"))
        .groupBy("layer", "stop")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def resolved_stops(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Stops that are known places, in order, numbered from 0 among those."""
    known = stops.join(places.withColumnRenamed("code", "stop"), ["layer", "stop"])
    rank = F.row_number().over(Window.partitionBy(*BY).orderBy("pos")) - 1
    return known.withColumn("k", rank.cast("long"))


def _of(df: DataFrame, *columns: str) -> list[str]:
    """The columns but for a layer that is not there: tables of one layer can come without, which makes keys shorter."""
    return [c for c in columns if c != "layer" or c in df.columns]


def _lookup(places: DataFrame) -> DataFrame:
    """One row for each code: how many places have it, and what the first and the last stop of a trip take from it."""
    at = F.struct("lng", "lat")
    return places.groupBy(*_of(places, "layer", "code")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name0"), F.max("name").alias("name1"), F.min(at).alias("at0"), F.max(at).alias("at1"))


def end_stops(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Of each trip the first and last stop, how many stops are known, the first and last of these, and whether any stop
    has a pos. One aggregate of numbers alone where :func:`_order` gives numbers: names and positions are
    put to its few rows by :func:`placed`, and are not moved with every stop. Both tables have a layer, or neither."""
    key, stop = _order(stops)
    found = stops.join(_lookup(places).withColumnRenamed("code", "stop").select(*_of(places, "layer", "stop"), "n"), _of(places, "layer", "stop"), "left").withColumn("k", key)
    known = F.when(F.col("n").isNotNull(), F.col("k"))
    ends = found.groupBy(*_of(stops, *BY)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_known"), F.min("k").alias("s"), F.max("k").alias("e"), F.min(known).alias("a"), F.max(known).alias("b"))
    named = (("s", "first"), ("e", "last"), ("a", "first_known"), ("b", "last_known"))
    return ends.select(*_of(stops, *TRIP), "n_known", F.col("s").isNotNull().alias("in_order"), *(stop(F.col(k)).alias(name) for k, name in named))


def placed(ends: DataFrame, places: DataFrame) -> DataFrame:
    """What :func:`end_stops` gives, with names and positions. Codes are unique in what is joined, so a join for columns that
    nobody selects is left out of the plan where tables have no layer."""
    found, layer = _lookup(places), _of(places, "layer")
    for side, i in (("start", 0), ("end", 1)):
        own, known = ("first", "first_known") if i == 0 else ("last", "last_known")
        name = found.select(*layer, F.col("code").alias(own), F.col(f"name{i}").alias(f"{side}_name"), F.lit(True).alias(f"{side}_known"))
        at = found.select(*layer, F.col("code").alias(known), F.col(f"at{i}.lng").alias(f"{side}_lng"), F.col(f"at{i}.lat").alias(f"{side}_lat"))
        ends = ends.join(name, [*layer, own], "left").join(at, [*layer, known], "left")
    told = {f"{side}_known": F.when(F.col("in_order"), F.coalesce(f"{side}_known", F.lit(False))) for side in ("start", "end")}
    return ends.withColumns(told).select(*_of(places, *TRIP), "n_known", "first", "last", "start_lng", "start_lat", "end_lng", "end_lat", "start_name", "end_name", "start_known", "end_known")


def trip_ends(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Of each trip the first and last stop, their names and whether they are known, how many stops are known, and
    where the first and last of these are. From it :func:`edges_of` and :func:`counts_of` are taken."""
    return placed(end_stops(stops, places), places)


def edges(stops: DataFrame, places: DataFrame) -> DataFrame:
    """One edge per trip of at least two known stops, from the first to the last of them.

    start_known and end_known tell whether the trip's own first and last stop is known, which
    :func:`check_ends` demands. A stop that is no known place is passed over.
    """
    return edges_of(trip_ends(stops, places))


def edges_of(ends: DataFrame) -> DataFrame:
    """:func:`edges` from what :func:`trip_ends` gives."""
    return ends.where("n_known > 1").drop("n_known", "first", "last")


def check_ends(edges_: DataFrame) -> DataFrame:
    """Fails the job on an edge whose trip begins or ends at an unknown stop.

    The check sits in start_name and end_name: select them, or it is pruned.
    """
    bad = F.raise_error(F.concat(F.lit("trip begins or ends at an unknown place: "), F.concat_ws(" ", *(F.col(c).cast("string") for c in TRIP))))
    ok = F.col("start_known") & F.col("end_known")
    return edges_.withColumns({c: F.when(ok, F.col(c)).otherwise(bad) for c in ("start_name", "end_name")})


def edge_rank(edges_: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Adds rank: how many earlier trips (by ord) made the same directed pair of positions.

    Trips are numbered within their pair and within ``span`` places of the source, and what the spans before
    have of the pair is added. So however many trips a pair has, no task numbers more than span of them.
    That number comes as a row of its own before the trips of its pair and span, so one window adds it up and no trip is
    moved again to meet it. Edges are read twice.
    """
    at = edges_.withColumn("__span", F.floor(F.col("ord") / span))
    counts = at.groupBy(*PAIR, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*PAIR).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.withColumn("__add", before).where("__add > 0").select(*PAIR, "__span", "__add", F.lit(False).alias("__trip"))
    rows = at.withColumns({"__add": F.lit(1).cast("long"), "__trip": F.lit(True)}).unionByName(earlier, allowMissingColumns=True)
    upto = Window.partitionBy("__span", *PAIR).orderBy("__trip", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("rank", F.sum("__add").over(upto) - 1).where("__trip")
    return ranked.select(*edges_.columns, "rank")


def pair_counts(edges_: DataFrame) -> DataFrame:
    return edges_.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("cnt"))


def markers(places: DataFrame, counts: DataFrame) -> DataFrame:
    """Places that begin or end a trip, with the count; counts of unknown places are not shown."""
    return places.join(counts.withColumnRenamed("stop", "code"), ["layer", "code"])
