"""The journey plan over the driver's tables, each query with its SQL.

A trip is an order and its stops are the suppliers of its lines; every seventh supplier is left out
of the places, so that some stops are unknown. The second layer has users as trips and their
events as stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.functions import scalars as S
from waymark.operators import network as N
from waymark.plans import journeys as J
from waymark.shared import shared_dir
from waymark.sources.journeys import read_places, read_regions, read_trips
from waymark.sources.palette import PALETTE, palette, region_style

RAIL, AIR = "train", "flight"
AIR_PLACES = [("click", 10.0, 1.0), ("purchase", 12.0, 2.0), ("signup", 9.0, 3.0), ("view", 11.0, 4.0)]
#: Nations from the 21st on have a name that the palette lacks, and most colours belong to no nation.
COLOURED = 20
#: Places (some 100 bytes each) up to which they are broadcast; to more of them stops go by a shuffle.
FEW_PLACES = 500_000
SYMBOL_CASES = [("G1", 1.0), ("g1", 1.0), ("G1", -1.0), ("G1", 0.0), ("D1", -1.0), ("C1", -1.0), ("K1", 1.0), ("Y1", 1.0), ("Z1", -1.0), ("T1", -1.0), ("1234", -1.0), (None, 1.0), ("", -1.0)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rail_stops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.lit(RAIL).alias("layer"), F.col("l_orderkey").alias("ord"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_suppkey").alias("stop")
    )


def rail_places(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    places = s.where("s_suppkey % 7 <> 0").join(n, s.s_nationkey == n.n_nationkey).select(
        F.lit(RAIL).alias("layer"), F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("double").alias("lng"), F.col("n_regionkey").cast("double").alias("lat")
    )
    # Spark takes a join for as large as the product of its sides, and would move all stops to meet a few places.
    return F.broadcast(places) if s.count() <= FEW_PLACES else places


def rail_trips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.lit(RAIL).alias("layer"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("information")
    )


def air_stops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.lit(AIR).alias("layer"), F.col("user_id").alias("ord"), F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("stop"))


def air_places(spark: SparkSession) -> DataFrame:
    # A relation of the plan itself: a list would be read by Python workers wherever it is joined.
    p = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({c!r}, {x}D, {y}D)' for c, x, y in AIR_PLACES)} AS p(code, lng, lat)")
    return F.broadcast(p.select(F.lit(AIR).alias("layer"), "code", F.upper("code").alias("name"), "lng", "lat"))


def air_trips(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("ord")).distinct()
    code = F.when(F.col("ord") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("U"), F.col("ord").cast("string")))
    return users.select(F.lit(AIR).alias("layer"), "ord", code.alias("code"), F.lit("").alias("time"), F.lit(None).cast("string").alias("information"))


def _kept(df: DataFrame, layer: str) -> DataFrame:
    """A layer's rows as a table in the shared folder, for what is read more than once; later steps read only the columns they need."""
    own = df.drop("layer")
    folder = _folder(df.sparkSession, "kept")
    own.write.parquet(folder)
    return df.sparkSession.read.schema(own.schema).parquet(folder).select(F.lit(layer).alias("layer"), "*")


def _parts(spark: SparkSession, d: str, layer: str = "all") -> dict[str, tuple[DataFrame, DataFrame]]:
    """Edges and markers of each layer. The ends of trips are computed once for both, in a chosen layer: others are planned only."""
    out = {}
    for name, stops, places, trips in ((RAIL, rail_stops(spark, d), rail_places(spark, d), rail_trips(spark, d)), (AIR, air_stops(spark, d), air_places(spark), air_trips(spark, d))):
        found = N.end_stops(stops.drop("layer"), places.drop("layer"))
        if layer in ("all", name):
            found = _kept(found, name).drop("layer")
        markers = J.layer_markers(None, places, found.withColumn("layer", F.lit(name)))
        ends = N.placed(found, places.drop("layer")).withColumn("layer", F.lit(name))
        out[name] = (J.layer_edges(trips, places, name, strict=False, ends=ends), markers.withColumn("code", F.col("code").cast("string")))
    return out


def _layer(layer: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = J.combine({k: tuple(x.withColumn("id", F.col("ord" if "ord" in x.columns else "code").cast("string")) for x in v) for k, v in _parts(spark, d, layer).items()}, layer)
        return c.select("branch", "id", F.round("curveness", 6).alias("curveness"), F.round("symbol_size", 6).alias("symbol_size"), "rank", "cnt", "symbol")

    return query


def _rail_edges(spark: SparkSession, d: str) -> DataFrame:
    return N.edges(rail_stops(spark, d), rail_places(spark, d))


def endpoint_counts(spark, d):
    return N.endpoint_counts(rail_stops(spark, d)).select("stop", "cnt")


def marker_size(spark, d):
    return J.layer_markers(rail_stops(spark, d), rail_places(spark, d)).select("code", "name", "lng", "lat", "cnt", F.round("symbol_size", 6).alias("symbol_size"))


def resolved_stops(spark, d):
    return N.resolved_stops(rail_stops(spark, d), rail_places(spark, d)).select("ord", "k", "stop", "lng", "lat")


def edges(spark, d):
    return _rail_edges(spark, d).select("ord", "start_lng", "start_lat", "end_lng", "end_lat", "start_known", "end_known")


def edge_rank_curveness(spark, d):
    e = N.edge_rank(_kept(_rail_edges(spark, d).select(*N.TRIP, *N.PAIR[1:]), RAIL))
    return e.select("ord", "rank", S.curveness(F.col("rank")).alias("curveness"))


def pair_counts(spark, d):
    return N.pair_counts(_rail_edges(spark, d)).drop("layer")


def edge_direction_symbol(spark, d):
    """The priority's first digit stands for the letter of a train's code."""
    letter = F.get(F.array(*map(F.lit, ("", "G", "D", "K", "T", "C"))), F.substring("code", 1, 1).cast("int"))
    e = _rail_edges(spark, d).join(rail_trips(spark, d), list(N.BY)).withColumn("letter", letter)
    return e.select("ord", "letter", S.train_symbol(F.col("letter"), F.col("start_lng"), F.col("end_lng")).alias("symbol"))


def air_symbol(spark, d):
    e = N.edges(air_stops(spark, d), air_places(spark)).join(air_trips(spark, d), list(N.BY))
    return e.select("ord", S.flight_symbol(F.col("code"), F.col("start_lng"), F.col("end_lng")).alias("symbol"))


def edge_tooltip(spark, d):
    e = _rail_edges(spark, d).join(rail_trips(spark, d), list(N.BY))
    return e.select("ord", S.tooltip(F.col("code"), F.col("time"), F.col("start_name"), F.col("end_name"), F.col("information")).alias("tooltip"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4()}"


def _json_file(df: DataFrame, column, path: str, head: str = "") -> str:
    """One file with one JSON text, as the sources come."""
    df.select(F.concat(F.lit(head), F.to_json(column)).alias("value")).coalesce(1).write.text(path)
    return path


def _ordered(key: str, value) -> F.Column:
    """An array of all rows' values by key; of lookup tables and fixtures, which are one file."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v")))), lambda x: x["v"])


def region_style_(spark, d):
    """Nations as GeoJSON within a script, with the palette's names, read and joined with the palette."""
    names = F.array(*(F.lit(n) for n, _, _ in PALETTE[:COLOURED]))
    n = table(spark, d, "nation").withColumn("name", F.coalesce(F.get(names, F.col("n_nationkey")), F.col("n_name")))
    x = F.col("n_nationkey").cast("double")
    ring = F.array(*(F.array(x + a, x + b) for a, b in ((0, 0), (1, 0), (0, 1), (0, 0))))
    many = F.col("n_nationkey") % 2 == 1
    geometry = F.struct(F.when(many, "MultiPolygon").otherwise("Polygon").alias("type"), F.when(many, F.to_json(F.array(F.array(ring)))).otherwise(F.to_json(F.array(ring))).alias("coordinates"))
    feature = F.struct(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("name"), F.array(x, x).alias("cp"), F.lit(1).alias("childNum")).alias("properties"), geometry.alias("geometry"))
    text = F.struct(F.lit("FeatureCollection").alias("type"), _ordered("n_nationkey", feature).alias("features"))
    # Coordinates go in as JSON, not as the text of it.
    made = n.agg(F.to_json(text).alias("j")).select(F.regexp_replace("j", r'"coordinates":"([^"]*)"', r'"coordinates":$1').alias("j"))
    path = _folder(spark, "regions")
    made.select(F.concat(F.lit("registerMap('nations', "), "j", F.lit(");")).alias("value")).coalesce(1).write.text(path)
    regions = read_regions(spark, path)
    out = region_style(regions.select("ord", "id", "name", "geometry_type", F.size("coordinates").alias("polygons"), F.get(F.get(F.get(F.get("coordinates", F.lit(0)), F.lit(0)), F.lit(1)), F.lit(0)).alias("lng")), palette(spark))
    return out.select("ord", "id", "name", "geometry_type", "polygons", "lng", "area_color")


def json_places(spark, d):
    """Places as an object keyed by code, written and read again."""
    p = rail_places(spark, d)
    one = F.struct(F.col("code").cast("string").alias("key"), F.struct(F.array("lng", "lat").alias("LatLng"), F.col("name").alias("name")).alias("value"))
    path = _json_file(p.agg(F.map_from_entries(_ordered("code", one)).alias("j")), F.col("j"), _folder(spark, "places"))
    return read_places(spark, path, RAIL)


def _json_trips(spark, d) -> DataFrame:
    """Trips of every tenth user as an array, written and read again; every other one has an information."""
    stops = air_stops(spark, d).where("ord % 10 = 0").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop"))), lambda x: x["stop"]).alias("route"))
    trip = F.struct(F.concat(F.lit("U"), F.col("ord").cast("string")).alias("code"), F.lit("20xx").alias("time"), F.col("route"), F.when(F.col("ord") % 20 == 0, F.lit("note")).alias("information"))
    path = _json_file(stops.agg(_ordered("ord", trip).alias("j")), F.col("j"), _folder(spark, "trips"))
    return read_trips(spark, path, AIR)


def json_trips(spark, d):
    t = _json_trips(spark, d)
    return t.select("ord", "code", "time", F.size("route").cast("long").alias("stops"), F.array_join(F.transform("route", F.upper), " ").alias("route"), "information")


def json_journeys(spark, d):
    """Counts of the ends of trips that have come as JSON, with their places."""
    return N.markers(air_places(spark), N.endpoint_counts(N.stops_of(_json_trips(spark, d)))).select("code", "name", "cnt")


def strict_loads(spark, d):
    """What is drawn, and whether a load has failed: all trips, those of known ends, and trips of a file that is no JSON."""
    e = N.check_ends(_rail_edges(spark, d)).select("ord", "start_name", "end_name")
    known = N.check_ends(_rail_edges(spark, d).where("start_known and end_known")).select("ord", "start_name", "end_name")
    broken = _folder(spark, "broken")
    spark.createDataFrame([('[{"code": "K1", "route": ["a"',)], "value string").coalesce(1).write.text(broken)
    folder = _folder(spark, "drawn")
    rows = []
    for name, make in (("known", lambda: known), ("all", lambda: e), ("broken", lambda: read_trips(spark, broken, RAIL))):
        n, error = J.load(spark, make, f"{folder}/{name}")
        rows.append((name, n, error is not None, bool(error and "unknown place" in error)))
    return spark.createDataFrame(rows, "load string, drawn long, failed boolean, by_unknown_place boolean")


def hover_text(spark, d):
    """Over edges their text, over markers their name."""
    parts = {k: tuple(x.withColumn("id", F.col("ord" if "ord" in x.columns else "code").cast("string")) for x in v) for k, v in _parts(spark, d).items()}
    return J.shown(J.combine(parts)).select("branch", "id", "kind", "hover")


def layer_switch(spark, d):
    """The flight layer out of layers that have been computed once, after another result had stood in their place."""
    folder = _folder(spark, "layers")
    J.replace_result(spark.range(3), folder)
    J.prepare(_parts(spark, d), folder)
    out = J.prepared(spark, folder, AIR)
    return out.select("branch", F.coalesce(F.col("ord").cast("string"), "code").alias("id"), "rank", "cnt")


def train_symbol_rules(spark, d):
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(SYMBOL_CASES)], "k long, code string, dx double")
    return c.select("k", S.train_symbol(F.col("code"), F.lit(0.0), F.col("dx")).alias("train"), S.flight_symbol(F.col("code"), F.lit(0.0), F.col("dx")).alias("flight"))


def period_range(spark, d):
    """How many trips have each period."""
    return table(spark, d, "orders").select(S.period(F.lit(RAIL), F.col("o_orderkey")).alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("trips"))


QUERIES = {
    "endpoint_counts": endpoint_counts,
    "marker_size": marker_size,
    "resolved_stops": resolved_stops,
    "edges": edges,
    "edge_rank_curveness": edge_rank_curveness,
    "pair_counts": pair_counts,
    "edge_direction_symbol": edge_direction_symbol,
    "air_symbol": air_symbol,
    "edge_tooltip": edge_tooltip,
    "layer_all": _layer("all"),
    "layer_train": _layer(RAIL),
    "layer_flight": _layer(AIR),
    "layer_unknown": _layer("other"),
    "region_style": region_style_,
    "train_symbol_rules": train_symbol_rules,
    "period_range": period_range,
    "json_places": json_places,
    "json_trips": json_trips,
    "json_journeys": json_journeys,
    "strict_loads": strict_loads,
    "hover_text": hover_text,
    "layer_switch": layer_switch,
}

_sql = lambda v: "NULL" if v is None else repr(v)
_CTE = f"""
WITH place AS (SELECT s_suppkey AS code, s_name AS name, CAST(s_nationkey AS DOUBLE) AS lng, CAST(n_regionkey AS DOUBLE) AS lat
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 7 <> 0),
stop AS (SELECT l_orderkey AS ord, row(l_linenumber, l_partkey, l_suppkey) AS pos, l_suppkey AS stop FROM lineitem),
ends AS (SELECT ord, arg_min(stop, pos) AS a, arg_max(stop, pos) AS b FROM stop GROUP BY ord),
counts AS (SELECT stop, count(*) AS cnt FROM (SELECT a AS stop FROM ends UNION ALL SELECT b FROM ends) GROUP BY stop),
res AS (SELECT ord, pos, stop, name, lng, lat FROM stop JOIN place ON stop = code),
pair AS (SELECT ord, arg_min(lng, pos) AS start_lng, arg_min(lat, pos) AS start_lat, arg_max(lng, pos) AS end_lng, arg_max(lat, pos) AS end_lat
  FROM res GROUP BY ord HAVING count(*) > 1),
edge AS (SELECT pair.*, p.name AS start_name, q.name AS end_name, p.code IS NOT NULL AS start_known, q.code IS NOT NULL AS end_known
  FROM pair JOIN ends USING (ord) LEFT JOIN place p ON p.code = a LEFT JOIN place q ON q.code = b),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY start_lng, start_lat, end_lng, end_lat ORDER BY ord) - 1 AS BIGINT) AS rank FROM edge),
aplace(code, lng, lat) AS (VALUES {", ".join(f"('{c}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for c, x, y in AIR_PLACES)}),
astop AS (SELECT user_id AS ord, row(ts, event_id) AS pos, event_type AS stop FROM events),
aends AS (SELECT ord, arg_min(stop, pos) AS a, arg_max(stop, pos) AS b FROM astop GROUP BY ord),
acounts AS (SELECT stop, count(*) AS cnt FROM (SELECT a AS stop FROM aends UNION ALL SELECT b FROM aends) GROUP BY stop),
aedge AS (SELECT ord, arg_min(lng, pos) AS start_lng, arg_min(lat, pos) AS start_lat, arg_max(lng, pos) AS end_lng, arg_max(lat, pos) AS end_lat
  FROM astop JOIN aplace ON stop = code GROUP BY ord HAVING count(*) > 1),
aranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY start_lng, start_lat, end_lng, end_lat ORDER BY ord) - 1 AS BIGINT) AS rank FROM aedge)
"""


def _train_sql(code: str, dx: str) -> str:
    f = f"upper(substr({code}, 1, 1))"
    kind = f"CASE WHEN {f} = 'G' THEN '高铁' WHEN {f} IN ('D', 'C') THEN '动车' WHEN {f} IN ('K', 'Y', 'Z') THEN '火车' END"
    return f"CASE WHEN coalesce({code}, '') = '' OR ({kind}) IS NULL THEN 'arrow' ELSE 'image://./images/' || ({kind}) || CASE WHEN {dx} < 0 THEN '反' ELSE '' END || '.png' END"


def _flight_sql(code: str, dx: str) -> str:
    return f"CASE WHEN coalesce({code}, '') = '' THEN 'arrow' ELSE 'image://./images/飞机' || CASE WHEN {dx} < 0 THEN '反' ELSE '' END || '.png' END"


_JSON = """
WITH trip AS (SELECT *, 'U' || user_id AS code, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INT) AS ord
  FROM (SELECT user_id, list(event_type ORDER BY ts, event_id) AS route FROM events WHERE user_id % 10 = 0 GROUP BY user_id))
"""


def _line_sql(code: str, time: str, start: str, end: str, note: str) -> str:
    parts = "".join(f"'{label}' || coalesce({x}, '') || '<br/>' || " for label, x in (("班次：", code), ("时间：", time), ("起点：", start), ("终点：", end)))
    return f"{parts}CASE WHEN coalesce({note}, '') = '' THEN '' ELSE '记录：' || {note} END"


_USER = "CASE WHEN ord % 5 = 0 THEN '' ELSE 'U' || CAST(ord AS VARCHAR) END"


def _layer_sql(*branches: int) -> str:
    parts = [
        f"SELECT CAST(0 AS INT) AS branch, CAST(ord AS VARCHAR) AS id, round(CAST(0.3 AS DOUBLE) + rank * CAST(0.05 AS DOUBLE), 6) AS curveness, CAST(NULL AS DOUBLE) AS symbol_size, rank, CAST(NULL AS BIGINT) AS cnt, {_train_sql('o_orderpriority', 'end_lng - start_lng')} AS symbol FROM ranked JOIN orders ON ord = o_orderkey",
        "SELECT CAST(1 AS INT), CAST(code AS VARCHAR), NULL, round(ln(cnt + 1) * 10, 6), NULL, cnt, NULL FROM place JOIN counts ON code = stop",
        f"SELECT CAST(2 AS INT), CAST(ord AS VARCHAR), round(CAST(0.3 AS DOUBLE) + rank * CAST(0.05 AS DOUBLE), 6), NULL, rank, NULL, {_flight_sql(_USER, 'end_lng - start_lng')} FROM aranked",
        "SELECT CAST(3 AS INT), code, NULL, round(ln(cnt + 1) * 10, 6), NULL, cnt, NULL FROM aplace JOIN acounts ON code = stop",
    ]
    return f"{_CTE} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE branch IN ({', '.join(map(str, branches))})"


SQL = {
    "endpoint_counts": f"{_CTE} SELECT stop, cnt FROM counts",
    "marker_size": f"{_CTE} SELECT code, name, lng, lat, cnt, round(ln(cnt + 1) * 10, 6) AS symbol_size FROM place JOIN counts ON code = stop",
    "resolved_stops": f"{_CTE} SELECT ord, CAST(row_number() OVER (PARTITION BY ord ORDER BY pos) - 1 AS BIGINT) AS k, stop, lng, lat FROM res",
    "edges": f"{_CTE} SELECT ord, start_lng, start_lat, end_lng, end_lat, start_known, end_known FROM edge",
    "edge_rank_curveness": f"{_CTE} SELECT ord, rank, CAST(0.3 AS DOUBLE) + rank * CAST(0.05 AS DOUBLE) AS curveness FROM ranked",
    "pair_counts": f"{_CTE} SELECT start_lng, start_lat, end_lng, end_lat, count(*) AS cnt FROM edge GROUP BY ALL",
    "edge_direction_symbol": f"{_CTE}, lettered AS (SELECT edge.*, (['G', 'D', 'K', 'T', 'C'])[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS letter FROM edge JOIN orders ON ord = o_orderkey) SELECT ord, letter, {_train_sql('letter', 'end_lng - start_lng')} AS symbol FROM lettered",
    "air_symbol": f"{_CTE} SELECT ord, {_flight_sql(_USER, 'end_lng - start_lng')} AS symbol FROM aedge",
    "edge_tooltip": f"{_CTE} SELECT ord, '班次：' || coalesce(o_orderpriority, '') || '<br/>时间：' || coalesce(strftime(o_orderdate, '%Y-%m-%d'), '') || '<br/>起点：' || coalesce(start_name, '') || '<br/>终点：' || coalesce(end_name, '') || '<br/>' || CASE WHEN coalesce(o_orderstatus, 'F') IN ('F', '') THEN '' ELSE '记录：' || o_orderstatus END AS tooltip FROM edge JOIN orders ON ord = o_orderkey",
    "layer_all": _layer_sql(0, 1, 2, 3),
    "layer_train": _layer_sql(0, 1),
    "layer_flight": _layer_sql(2, 3),
    "layer_unknown": _layer_sql(9),
    "region_style": f"SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ord, CAST(n_nationkey AS VARCHAR) AS id, p.name, CASE WHEN n_nationkey % 2 = 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS geometry_type, CAST(1 AS INT) AS polygons, CAST(n_nationkey + 1 AS DOUBLE) AS lng, area_color FROM nation JOIN (VALUES {', '.join(f'({i}, {_sql(n)}, {_sql(c)})' for i, (n, c, _) in enumerate(PALETTE[:COLOURED]))}) p(k, name, area_color) ON n_nationkey = p.k",
    "train_symbol_rules": f"SELECT k, {_train_sql('code', 'dx')} AS train, {_flight_sql('code', 'dx')} AS flight FROM (VALUES {', '.join(f'(CAST({i} AS BIGINT), {_sql(c)}, CAST({x} AS DOUBLE))' for i, (c, x) in enumerate(SYMBOL_CASES))}) t(k, code, dx)",
    "period_range": "SELECT CAST(CAST('0x' || substr(md5('train|' || o_orderkey), 1, 8) AS BIGINT) % 5 + 4 AS INT) AS period, count(*) AS trips FROM orders GROUP BY ALL",
    "json_places": f"{_CTE} SELECT 'train' AS layer, CAST(code AS VARCHAR) AS code, CAST(row_number() OVER (ORDER BY code) - 1 AS INT) AS ord, lng, lat, name FROM place",
    "json_trips": f"{_JSON} SELECT ord, code, '20xx' AS time, CAST(len(route) AS BIGINT) AS stops, array_to_string(list_transform(route, lambda x: upper(x)), ' ') AS route, CASE WHEN user_id % 20 = 0 THEN 'note' END AS information FROM trip",
    "json_journeys": f"{_JSON} SELECT code, upper(code) AS name, count(*) AS cnt FROM (SELECT unnest([route[1], route[-1]]) AS stop FROM trip) JOIN (VALUES {', '.join(f'({_sql(c)})' for c, _, _ in AIR_PLACES)}) p(code) ON stop = code GROUP BY ALL",
    "strict_loads": f"{_CTE} SELECT 'known' AS load, count(*) FILTER (start_known AND end_known) AS drawn, false AS failed, false AS by_unknown_place FROM edge UNION ALL SELECT 'all', CASE WHEN bool_and(start_known AND end_known) THEN count(*) ELSE 0 END, NOT bool_and(start_known AND end_known), NOT bool_and(start_known AND end_known) FROM edge UNION ALL SELECT 'broken', 0, true, false",
    "hover_text": f"{_CTE}, ahead AS (SELECT ord, a, b, arg_min(stop, pos) AS x FROM astop JOIN aends USING (ord) GROUP BY ord, a, b) SELECT CAST(0 AS INT) AS branch, CAST(ord AS VARCHAR) AS id, 'lines' AS kind, {_line_sql('o_orderpriority', "strftime(o_orderdate, '%Y-%m-%d')", 'start_name', 'end_name', "nullif(o_orderstatus, 'F')")} AS hover FROM edge JOIN orders ON ord = o_orderkey UNION ALL SELECT 1, CAST(code AS VARCHAR), 'scatter', name FROM place JOIN counts ON code = stop UNION ALL SELECT 2, CAST(ord AS VARCHAR), 'lines', {_line_sql(_USER, "''", 'upper(p.code)', 'upper(q.code)', 'NULL')} FROM aedge JOIN ahead USING (ord) LEFT JOIN aplace p ON p.code = a LEFT JOIN aplace q ON q.code = b UNION ALL SELECT 3, code, 'scatter', upper(code) FROM aplace JOIN acounts ON code = stop",
    "layer_switch": f"{_CTE} SELECT CAST(2 AS INT) AS branch, CAST(ord AS VARCHAR) AS id, rank, CAST(NULL AS BIGINT) AS cnt FROM aranked UNION ALL SELECT 3, code, NULL, cnt FROM aplace JOIN acounts ON code = stop",
}
