"""Small invented journeys, one rule each."""

import json
import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import scalars as S
from waymark.operators import network as N
from waymark.plans import journeys as J
from waymark.sources import journeys as R
from waymark.sources.palette import PALETTE, palette, region_style
from waymark.streaming.counts import endpoint_counts_stream

PLACES = [("train", "a", "Aa", 10.0, 20.0), ("train", "b", "Bb", 11.0, 21.0), ("train", "c", "Cc", 12.0, 22.0), ("train", "d", "Dd", 11.0, 21.0)]
TRIPS = "layer string, ord long, code string, time string, route array<string>, information string"


def made(spark, *routes, layer="train"):
    trips = spark.createDataFrame([(layer, i, "G1", "20xx-xx-xx", r, None) for i, r in enumerate(routes)], TRIPS)
    places = spark.createDataFrame(PLACES, "layer string, code string, name string, lng double, lat double")
    return trips, places


def counts(spark, *routes):
    trips, _ = made(spark, *routes)
    return {r.stop: r.cnt for r in N.endpoint_counts(N.stops_of(trips)).collect()}


def ranks(spark, *routes):
    trips, places = made(spark, *routes)
    return [r["rank"] for r in N.edge_rank(N.edges(N.stops_of(trips), places)).orderBy("ord").collect()]


def test_counts(spark):
    assert counts(spark, ["a", "b"]) == {"a": 1, "b": 1}
    assert counts(spark, ["a", "c", "b"]) == {"a": 1, "b": 1}
    assert counts(spark, ["a"]) == {"a": 2}
    assert counts(spark, ["a", "b", "a"]) == {"a": 2}
    assert counts(spark, []) == {}
    assert counts(spark, ["a", "?"]) == {"a": 1, "?": 1}


def test_ranks(spark):
    assert ranks(spark, ["a", "b"], ["b", "a"], ["a", "b"]) == [0, 0, 1]
    assert ranks(spark, ["a", "b"], ["a", "d"]) == [0, 1]
    assert ranks(spark, ["a", "?", "b"]) == [0]
    assert ranks(spark, ["a", "?"], ["a"], []) == []
    assert ranks(spark, ["a", "b", "a"]) == [0]


def test_edge(spark):
    trips, places = made(spark, ["a", "c", "b"])
    r = J.layer_edges(trips, places, "train").collect()[0]
    assert (r.start_name, r.end_name, r.curveness, r.time) == ("Aa", "Bb", 0.3, "20xx-xx-xx")
    assert r.tooltip == "班次：G1<br/>时间：20xx-xx-xx<br/>起点：Aa<br/>终点：Bb<br/>" and 4 <= r.period <= 8


def test_unknown_end_fails(spark):
    trips, places = made(spark, ["?", "a", "b"])
    with pytest.raises(Exception, match="unknown place"):
        J.layer_edges(trips, places, "train").collect()


def test_markers_and_layers(spark):
    trips, places = made(spark, ["a", "c", "b"])
    m = J.layer_markers(N.stops_of(trips), places)
    assert {r.code: round(r.symbol_size, 9) for r in m.collect()} == {x: round(math.log(2) * 10, 9) for x in "ab"}
    e = J.layer_edges(trips, places, "train")
    parts = {"train": (e, m), "flight": (e.where("false"), m.where("false"))}
    assert [J.combine(parts, x).count() for x in ("all", "train", "flight", "other")] == [3, 3, 0, 0]


def test_same_code_in_two_layers(spark):
    a, b = made(spark, ["a", "b"])[0], made(spark, ["a", "b"], layer="flight")[0]
    assert N.endpoint_counts(N.stops_of(a.union(b))).where("cnt = 1").count() == 4


def test_tooltip_note(spark):
    t = lambda note: spark.range(1).select(S.tooltip(F.lit("x"), F.lit(None), F.lit("s"), F.lit("e"), F.lit(note)).alias("t")).head().t
    assert t(None) == t("") and t("n").endswith("记录：n") and "null" not in t("n")


def test_json(spark, tmp_path):
    p = tmp_path / "places.json"
    p.write_text('{"x": {"LatLng": [1, 2],\n "name": "old"},\n"7": {"LatLng": [3, 4.5], "name": "seven"}, "x": {"LatLng": [5, 6], "name": "new"}}')
    assert [tuple(r) for r in R.read_places(spark, str(p), "train").orderBy("ord").collect()] == [("train", "x", 0, 5.0, 6.0, "new"), ("train", "7", 1, 3.0, 4.5, "seven")]
    t = tmp_path / "trips.json"
    t.write_text(json.dumps([{"code": "K1", "time": "t", "route": ["x", "7"]}, {"code": "C1", "time": "t", "route": [], "information": "i"}], indent=2))
    assert [(r.ord, r.code, r.information) for r in R.read_trips(spark, str(t), "train").orderBy("ord").collect()] == [(0, "K1", None), (1, "C1", "i")]
    g = tmp_path / "regions.json"
    ring = [[0, 0], [1, 0], [0, 1], [0, 0]]
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"properties": {"id": "11", "name": PALETTE[0][0], "cp": [0, 1], "childNum": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"id": "99", "name": "?"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
    ]}))
    regions = R.read_regions(spark, str(g))
    assert [len(r.coordinates) for r in regions.orderBy("ord").collect()] == [1, 2]
    assert [(r.id, r.area_color) for r in region_style(regions, palette(spark)).collect()] == [("11", PALETTE[0][1])]


def test_rank_over_spans(spark):
    """Trips of one pair in many spans of the source, some of them without any."""
    e = spark.range(400).selectExpr("'train' AS layer", "id * 3 AS ord", "id % 2 * 1.0 AS start_lng", "0.0 AS start_lat", "if(id < 5, null, 1.0) AS end_lng", "0.0 AS end_lat")
    key = lambda r: (r.ord, r["rank"])
    want = sorted(map(key, N.edge_rank(e).collect()))
    for span in (1, 7, 100):
        assert sorted(map(key, N.edge_rank(e, span).collect())) == want
    assert max(r for _, r in want) == 197


def test_rank_joins_nothing(spark):
    """No trip is moved again to meet the count of those before, and positions may be null or zero of either sign."""
    rows = [("train", i, x, 0.0, 1.0, y) for i, (x, y) in enumerate([(0.0, None), (-0.0, None), (None, 1.0), (0.0, None), (None, 1.0), (0.0, 1.0)])]
    e = spark.createDataFrame(rows, "layer string, ord long, start_lng double, start_lat double, end_lng double, end_lat double")
    for span in (1, 2, 100):
        ranked = N.edge_rank(e, span)
        assert [r["rank"] for r in ranked.orderBy("ord").collect()] == [0, 1, 0, 2, 1, 0]
        assert "Join" not in ranked._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_odd_stops(spark):
    """Stops without a place in the trip, of no known name, twice in one place."""
    rows = [(0, None, "a"), (0, 1, "a"), (0, 2, None), (1, None, "a"), (1, None, "b"), (2, 1, "a"), (2, 1, "a"), (3, 2, "b"), (3, 1, "?"), (3, 3, "c")]
    stops = spark.createDataFrame([("train", *r) for r in rows], "layer string, ord long, pos int, stop string")
    ends = N.trip_ends(stops, made(spark)[1])
    got = {r.ord: (r.n_known, r.first, r.last, r.start_lng, r.end_lng, r.start_name, r.end_name, r.start_known, r.end_known) for r in ends.collect()}
    assert got[0] == (2, "a", None, 10.0, 10.0, "Aa", None, True, False)
    assert got[1][:5] == (2, None, None, None, None)
    assert got[2] == (2, "a", "a", 10.0, 10.0, "Aa", "Aa", True, True)
    assert got[3] == (2, "?", "c", 11.0, 12.0, None, "Cc", False, True)
    key = lambda df: sorted((str(r.stop), r.cnt) for r in df.collect())
    assert key(N.counts_of(ends)) == key(N.endpoint_counts(stops))


def test_ends_by_numbers(spark):
    """Where pos and stop are whole numbers the ends are those that rows in order give, with nulls, signs and codes that come twice,
    and where the numbers need more than 63 bits too."""
    places = spark.createDataFrame([("train", c, n, x, y) for c, n, x, y in [(1, "A", 1.0, 2.0), (2, "B", 3.0, 4.0), (2, "C", 0.0, 9.0), (-3, None, 5.0, 6.0), (2**40, "E", 7.0, 8.0)]], "layer string, code long, name string, lng double, lat double")
    pick = lambda i, j, *of: of[(i * 7 + j * 5 + i * j) % len(of)]
    rows = [("train", i, (pick(i, j, 0, None, -5, 2, 2), pick(j, i, 7, -(2**30), None)) if pick(i, j, *range(11)) else None, pick(i, j, 1, 2, -3, None, 2**40, 9)) for i in range(60) for j in range(i % 6)]
    for more in ([], [("train", 99, (1, -(2**63)), 1), ("train", 99, (1, 2**63 - 1), 2)]):
        stops = spark.createDataFrame(rows + more, "layer string, ord long, pos struct<p: int, q: long>, stop long")
        within = stops.withColumn("pos", F.when(F.col("pos").isNotNull(), F.struct("pos.p", "pos.q", F.col("stop").alias("r"))))
        # A text in pos cannot be made a number of.
        by_rows = stops.withColumn("pos", F.when(F.col("pos").isNotNull(), F.struct("pos.p", "pos.q", F.lit(""))))
        plain = lambda df: sorted(map(str, df.collect()))
        want = plain(N.trip_ends(by_rows, places))
        assert want == plain(N.trip_ends(stops, places)) == plain(N.trip_ends(within, places))
        assert plain(N.endpoint_counts(by_rows)) == plain(N.endpoint_counts(stops)) == plain(N.endpoint_counts(within))
        one = N.trip_ends(stops.drop("layer"), places.drop("layer"))
        assert want == plain(one.select(F.lit("train").alias("layer"), "*"))
    none = N.trip_ends(stops.where("false"), places)
    assert none.count() == 0 and N.endpoint_counts(stops.where("false")).count() == 0


def test_regions_in_a_script(spark, tmp_path):
    ring = [[0, 0], [1, 0], [0, 1], [0, 0]]
    feature = lambda kind, c: {"type": "Feature", "properties": {"id": "1", "name": "n)", "cp": [0, 1], "childNum": 1}, "geometry": {"type": kind, "coordinates": c}}

    def read(*features):
        p = tmp_path / "regions.js"
        p.write_text("(function (root) {\n  if (!x.registerMap) { return; }\n  x.registerMap('place', " + json.dumps({"type": "FeatureCollection", "features": features}, indent=1) + ")\n}));")
        return [r.coordinates for r in R.read_regions(spark, str(p)).orderBy("ord").collect()]

    assert read(feature("Polygon", [ring]), feature("MultiPolygon", [[ring], [ring]])) == [[[ring]], [[ring], [ring]]]
    for bad in (feature("Point", [1, 2]), feature("Polygon", [["x"]]), feature("MultiPolygon", "no")):
        with pytest.raises(Exception):  # noqa: B017
            read(bad)


def test_one_broken_source_fails_all(spark, tmp_path):
    """Nothing is drawn, and what was drawn before stays."""
    (tmp_path / "places.json").write_text('{"a": {"LatLng": [1, 2], "name": "A"}, "b": {"LatLng": [3, 4], "name": "B"}}')
    (tmp_path / "trips.json").write_text('[{"code": "G1", "time": "t", "route": ["a", "b"]}]')
    (tmp_path / "broken.json").write_text('[{"code": "G1", "time": ')

    def make(trips):
        return J.layer_edges(R.read_trips(spark, str(tmp_path / trips), "train"), R.read_places(spark, str(tmp_path / "places.json"), "train"), "train")

    out = str(tmp_path / "out")
    assert J.load(spark, lambda: make("trips.json"), out) == (1, None)
    n, error = J.load(spark, lambda: make("broken.json"), out)
    assert n == 0 and error and spark.read.parquet(out).count() == 1
    assert J.load(spark, lambda: make("absent.json"), out)[1]


def test_hover(spark):
    rows = spark.createDataFrame([("lines", "l", "n"), ("scatter", "l", "n"), (None, "l", "n")], "kind string, line string, name string")
    assert [r.t for r in rows.select(S.hover(F.col("kind"), F.col("line"), F.col("name")).alias("t")).collect()] == ["l", "n", "n"]


def test_shared_dir_is_never_local_on_a_cluster(monkeypatch):
    from waymark import shared

    class Fake:
        def __init__(self, master):
            self.sparkContext, self.conf, self.master, self._jsc = self, self, master, self

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

    assert shared.shared_dir(Fake("local[4]")) == shared.shared_dir(Fake("local"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="shared|share"):
            shared.shared_dir(Fake(master))


def test_replace_result(spark, tmp_path):
    for n in (3, 2):
        J.replace_result(spark.range(n), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream(spark, tmp_path):
    trips, _ = made(spark, ["a", "b"], ["a"], [], None)
    trips.write.parquet(str(tmp_path / "in"))
    q = endpoint_counts_stream(spark.readStream.schema(TRIPS).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("ends").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.stop: r.cnt for r in spark.table("ends").collect()} == {"a": 3, "b": 1}
