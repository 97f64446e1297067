"""The whole plan: counts, edges, markers, and the layers put together."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.functions import scalars as S
from waymark.operators import network as N

#: Layer name and the branches of its edges and markers in the combined result.
BRANCHES = {"train": (0, 1), "flight": (2, 3)}


def layer_edges(trips: DataFrame, places: DataFrame, layer: str, strict: bool = True, stops: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Edges of a layer with rank, curveness, symbol, period and tooltip.

    trips: ``layer, ord, code, time, information`` and, without stops or ends, ``route``. strict: fail on a
    trip that begins or ends at an unknown place. ends: what :func:`network.trip_ends` gives, where it has been kept.
    """
    e = N.edges_of(N.trip_ends(N.stops_of(trips) if stops is None else stops, places) if ends is None else ends)
    e = N.edge_rank(N.check_ends(e) if strict else e)
    symbol = S.train_symbol if layer == "train" else S.flight_symbol
    return e.join(trips.select(*N.TRIP, "code", "time", "information"), list(N.BY)).select(
        *N.TRIP, "code", "time", "start_name", "end_name", "information", "start_lng", "start_lat", "end_lng", "end_lat", "rank",
        S.curveness(F.col("rank")).alias("curveness"),
        symbol(F.col("code"), F.col("start_lng"), F.col("end_lng")).alias("symbol"),
        S.period(F.col("layer"), F.col("ord")).alias("period"),
        S.tooltip(F.col("code"), F.col("time"), F.col("start_name"), F.col("end_name"), F.col("information")).alias("tooltip"),
    )


def layer_markers(stops: DataFrame | None, places: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Used places with count, size and, as their tooltip, the name; ends: as in :func:`layer_edges`."""
    m = N.markers(places, N.endpoint_counts(stops) if ends is None else N.counts_of(ends))
    return m.withColumns({"symbol_size": S.marker_size(F.col("cnt")), "tooltip": F.col("name")})


def combine(parts: dict[str, tuple[DataFrame, DataFrame]], layer: str = "all") -> DataFrame:
    """Edges and markers of the chosen layers, one after the other, kept apart by ``branch``.

    parts: layer name to (edges, markers). A layer that is not known gives no rows.
    """
    out = None
    for name, frames in parts.items():
        for branch, frame in zip(BRANCHES[name], frames, strict=True):
            part = frame.withColumn("branch", F.lit(branch)).where(F.lit(layer in ("all", name)))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def replace_result(df: DataFrame, path: str, *by: str) -> None:
    """Puts a new result in the place of the old one, in folders by the given columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def prepare(parts: dict[str, tuple[DataFrame, DataFrame]], path: str) -> None:
    """Computes the edges and markers of all layers once and keeps them, a folder for each branch."""
    replace_result(combine(parts), path, "branch")


def prepared(spark: SparkSession, path: str, layer: str = "all") -> DataFrame:
    """What :func:`combine` gives, from what :func:`prepare` has kept: only the folders of the layer's branches are read."""
    chosen = [b for name, branches in BRANCHES.items() if layer in ("all", name) for b in branches]
    return spark.read.parquet(path).where(F.col("branch").isin(chosen))


def shown(df: DataFrame) -> DataFrame:
    """kind (lines, or scatter for markers) and hover text of what :func:`combine` gives."""
    lines = F.col("branch").isin([b[0] for b in BRANCHES.values()])
    out = df.withColumn("kind", F.when(lines, F.lit("lines")).otherwise(F.lit("scatter")))
    return out.withColumn("hover", S.hover(F.col("kind"), F.col("tooltip"), F.col("name")))


def load(spark: SparkSession, make, path: str) -> tuple[int, str | None]:
    """Puts what make() gives in the place of the old result: its rows and no error. Whatever fails, reading, parsing or
    a rule, is reported, and the old result stays as it was."""
    new = f"{path}.new"
    try:
        replace_result(make(), new)
        replace_result(spark.read.parquet(new), path)
        return spark.read.parquet(path).count(), None
    except (PySparkException, Py4JError) as e:
        return 0, str(e)
