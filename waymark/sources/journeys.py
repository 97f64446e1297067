"""Readers of the JSON inputs. Positions in the files are kept, as they are the only order there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PLACES = "map<string,struct<LatLng:array<double>,name:string>>"
TRIPS = "array<struct<code:string,time:string,route:array<string>,information:string>>"
POLYGON = "array<array<array<double>>>"
REGIONS = (
    "struct<features:array<struct<properties:struct<id:string,name:string,cp:array<double>,childNum:int>,"
    "geometry:struct<type:string,coordinates:string>>>>"
)


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j"))


def read_places(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """An object keyed by code. Of a repeated key the last value holds, at the first position."""
    rows = _whole(spark, path, PLACES).select(F.posexplode("j").alias("pos", "code", "v"))
    one = rows.groupBy("code").agg(F.max_by("v", "pos").alias("v"), F.min("pos").alias("ord"))
    return one.select(
        F.lit(layer).alias("layer"),
        "code",
        "ord",
        F.get("v.LatLng", F.lit(0)).alias("lng"),  # longitude comes first, whatever the field is called
        F.get("v.LatLng", F.lit(1)).alias("lat"),
        F.col("v.name").alias("name"),
    )


def read_trips(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """An array of trips; ord is the place in the file, time stays text."""
    return (
        _whole(spark, path, TRIPS)
        .select(F.posexplode("j").alias("ord", "t"))
        .select(F.lit(layer).alias("layer"), "ord", "t.code", "t.time", "t.route", "t.information")
    )


#: What stands before the collection where it comes as a script that registers it.
REGISTERED = r"""(?s)^.*?registerMap\(\s*(?:'[^']*'|"[^"]*")\s*,\s*"""


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON feature collection, bare or within a script that registers it; polygons are brought to the depth of
    multipolygons. A geometry that is neither, or whose coordinates are of another depth, fails the job."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", REGISTERED, "").alias("value"))
    strict = {"mode": "FAILFAST"}
    f = text.select(F.from_json("value", REGIONS, strict).alias("j")).select(F.posexplode("j.features").alias("ord", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(raw, POLYGON, strict))
    other = F.raise_error(F.concat(F.lit("geometry that is no polygon: "), F.coalesce(kind, F.lit("none"))))
    return f.select(
        "ord",
        "f.properties.*",
        kind.alias("geometry_type"),
        F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.from_json(raw, f"array<{POLYGON}>", strict)).otherwise(other).alias("coordinates"),
    )
