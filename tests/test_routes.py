"""Route operators on hand-made segments and ways, and against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hedgerow.functions import geo, ways
from hedgerow.functions.numbers import round_half_even
from hedgerow.operators import geojson, routes
from hedgerow.rules import routes as R

SEGMENT = ("route_id string, seq int, way_id long, provision string, highway string, speed_limit int, surface string, "
           "lit boolean, distance_m double, name string, original_provision string, geometry array<array<double>>")


def segments(spark, rows, route="r"):
    base = dict(way_id=1, provision="none", highway="residential", speed_limit=30, surface="asphalt", lit=None,
                distance_m=100.0, name="Road", original_provision=None, geometry=None)
    data = []
    for i, row in enumerate(rows):
        full = {**base, **row}
        data.append((row.get("route", route), i, *[full[c] for c in base]))
    return spark.createDataFrame(data, SEGMENT)


def trip(spark, cycling=1000.0, shortest=None, route="r"):
    return spark.createDataFrame([(route, cycling, 600.0, shortest)],
                                 "route_id string, cycling_distance_m double, duration_s double, shortest_distance_m double")


def test_rounding_agrees_with_python(spark):
    values = [0.35, 0.25, 0.75, 2.5, 3.5, 12.45, 25.2, 1.005, 0.05, 1234.5, 99.95, 0.0] + [random.Random(1).random() * 100 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", round_half_even(F.col("v"), 1).alias("a"), round_half_even(F.col("v"), 0).alias("b")).collect()
    for r in got:
        assert (r.a, r.b) == (round(r.v, 1), round(r.v))


@pytest.mark.parametrize("tags, provision, speed", [
    ({"highway": "cycleway"}, "segregated", 0),
    ({"highway": "path", "bicycle": "yes", "foot": "designated"}, "shared_use", 0),
    ({"highway": "footway", "bicycle": "designated"}, "segregated", 0),
    ({"highway": "bridleway", "designation": "Shared route"}, "shared_use", 0),
    ({"highway": "path"}, "none", 0),
    ({"highway": "primary", "cycleway:both": "separate"}, "segregated", 60),
    ({"highway": "tertiary", "cycleway:left": "lane", "maxspeed": "20 mph"}, "on_road_lane", 20),
    ({"highway": "service", "cycleway": "share_busway", "maxspeed": "signals"}, "advisory_lane", 20),
    ({"highway": "odd"}, "none", 30), ({}, "none", 30),
])
def test_tags(spark, tags, provision, speed):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>").select(*ways.pulled(F.col("tags")))
    row = df.select(ways.provision().alias("p"), ways.speed_limit().alias("s"), ways.surface().alias("u"), ways.lit().alias("l")).head()
    assert (row.p, row.s, row.u, row.l) == (provision, speed, "unknown", None)


def test_segregated_route_is_green(spark):
    s = segments(spark, [dict(provision="segregated", highway="cycleway", speed_limit=0)] * 3)
    row = routes.score_routes(s, trip(spark, 300.0, 300.0), routes.transition_summary(trip(spark), s)).head()
    assert (row.score, row.rating, row.short_route_note) == (100, "green", None)
    assert row.breakdown.asDict() == {"segregation": 36.0, "speed_safety": 23.0, "surface_quality": 13.0, "directness": 9.0,
                                      "junction_safety": 9.0, "transition_quality": 10.0}


def test_fast_bare_route_is_red(spark):
    s = segments(spark, [dict(highway="primary", speed_limit=60, surface="gravel")] * 6)
    row = routes.score_routes(s, trip(spark, 150.0)).head()
    assert row.breakdown.asDict() == {"segregation": 0.0, "speed_safety": 0.0, "surface_quality": 2.6, "directness": 4.5,
                                      "junction_safety": 0.0, "transition_quality": 5.0}
    assert (row.score, row.rating, row.hostile_junctions) == (12, "red", 6)
    assert row.short_route_note == R.SHORT_ROUTE_NOTE


@pytest.mark.parametrize("ratio, points", [(1.1, 9.0), (1.2, 6.3), (1.5, 3.6), (1.6, 0.9)])
def test_directness_bands(spark, ratio, points):
    s = segments(spark, [{}])
    assert routes.score_routes(s, trip(spark, 1000.0 * ratio, 1000.0)).head().breakdown.directness == points


@pytest.mark.parametrize("hostile, points", [(0, 9.0), (2, 5.4), (5, 2.7), (6, 0.0)])
def test_hostile_bands(spark, hostile, points):
    s = segments(spark, [dict(highway="secondary")] * hostile + [dict(provision="segregated", highway="path")])
    assert routes.score_routes(s, trip(spark)).head().breakdown.junction_safety == points


def test_empty_route_scores_zero(spark):
    s = segments(spark, [{}], route="other")
    row = routes.route_assessment(trip(spark, 1000.0, 1005.0), s).head()
    assert (row.score, row.rating, row.segment_count, row.same_route, row.breakdown) == (0, "red", 0, True, None)


def test_transitions_and_penalties(spark):
    off, road = dict(provision="shared_use", highway="path"), dict(name="High St", speed_limit=40)
    s = segments(spark, [{**off, "geometry": [[1.0, 2.0], [3.0, 4.0]]}, road, off, {**road, "speed_limit": 20}])
    found = [(r.seq, r.road_name, r.road_speed_limit, r.lat, r.lon) for r in routes.non_priority_crossings(s).orderBy("seq").collect()]
    assert found == [(0, "High St", 40, 4.0, 3.0), (1, "High St", 40, None, None), (2, "High St", 20, None, None)]
    assert [r.seq for r in routes.side_changes(s).collect()] == [1]
    summary = routes.transition_summary(trip(spark), s)
    row = summary.head()
    assert (row.non_priority_crossing_count, row.fast_crossing_count, row.side_change_count) == (3, 2, 1)
    # 10 - 1.5 - 1.5 - 0.5 - 1
    assert routes.score_routes(s, trip(spark), summary).head().breakdown.transition_quality == 5.5
    many = summary.withColumn("barrier_count", F.lit(9))
    assert routes.score_routes(s, trip(spark), many).head().breakdown.transition_quality == 0.0
    lost = summary.withColumn("unavailable", F.lit(True))
    assert routes.score_routes(s, trip(spark), lost).head().breakdown.transition_quality == 5.0
    nodes = spark.createDataFrame([("r", 0, 9, 0.0, 0.0, {"crossing": "marked"})],
                                  "route_id string, ord int, node_id long, lat double, lon double, tags map<string,string>")
    assert routes.non_priority_crossings(s, nodes).count() == 0
    assert routes.transition_summary(trip(spark), s, None, nodes).head().non_priority_crossing_count == 0


def test_runs_keep_order_and_drop_empty_geometry(spark):
    a = dict(provision="segregated", lit=None, geometry=[[0.0, 0.0], [1.0, 1.0]])
    s = segments(spark, [{**a, "name": "B", "way_id": 5}, {**a, "name": "A", "way_id": 4}, {**a, "name": "B", "way_id": 3},
                         {**a, "lit": False, "geometry": None}, {**a, "name": "", "way_id": 9}])
    rows = routes.merge_runs_nested(s).orderBy("first_seq").collect()
    assert [(r.way_ids, r.names, r.distance_m, len(r.geometry)) for r in rows] == [([5, 4, 3], ["B", "A"], 300.0, 6), ([9], [], 100.0, 2)]
    assert [(r.ways, r.run) for r in routes.merge_runs(s).orderBy("run").collect()] == [(3, 1), (1, 3)]


def test_issues(spark):
    s = segments(spark, [
        dict(name="A", highway="primary", speed_limit=60, distance_m=10.5), dict(name="B", highway="tertiary", surface="Gravel"),
        dict(name="A", highway="trunk", speed_limit=40, distance_m=12.0), dict(name="C", provision="shared_use", highway="path", lit=False, surface="mud"),
        dict(name="D", provision="segregated", highway="cycleway", lit=None), dict(name="E", highway="residential")])
    got = [(r.location, r.problem, r.severity) for r in routes.identify_issues(s).orderBy("road_seq", "kind_order").collect()]
    assert got == [
        ("A (22m)", "60mph speed limit with no cycle provision on primary road", "high"),
        ("B (100m)", "30mph tertiary road with no cycle provision", "medium"),
        ("B (100m)", "Poor surface (Gravel) on tertiary", "medium"),
        ("C (100m)", "Poor surface (mud) on shared-use path", "medium"),
        ("C (100m)", "Unlit shared use path", "low")]
    top = [r.problem for r in routes.top_issues(routes.identify_issues(s), 3).orderBy("rank").collect()]
    assert top == [got[0][1], got[1][1], got[2][1]]
    assert routes.funding_suggestions(routes.identify_issues(s)).count() == 4


def test_polyline(spark):
    rows = [("a", "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), ("b", ""), ("c", None), ("d", "_p~iF~ps|U")]
    got = {r.route_id: r.points for r in routes.decode_shapes(spark.createDataFrame(rows, "route_id string, shape string"), 5).collect()}
    assert got == {"a": [[-120.2, 38.5], [-120.95, 40.7], [-126.453, 43.252]], "b": [], "c": [], "d": [[-120.2, 38.5]]}
    six = routes.decode_shapes(spark.createDataFrame(rows[3:], "route_id string, shape string")).head().points
    assert six == [[-12.02, 3.85]]


def test_sampling(spark):
    df = spark.createDataFrame([(n, i, float(i), 0.0) for n in (3, 100, 149) for i in range(n)], "route_id int, idx int, lat double, lon double")
    kept = {}
    for r in routes.sample_points(df).collect():
        kept.setdefault(r.route_id, set()).add(r.idx)
    assert kept == {3: {0, 1, 2}, 100: set(range(0, 100, 2)) | {99}, 149: set(range(0, 149, 2))}


def haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_barriers_match_the_greedy_walk(spark):
    rng = random.Random(3)
    rows = []
    for route in ("hot", "b"):
        for i in range(400 if route == "hot" else 40):
            lat, lon = 51.9 + rng.randrange(60) / 100_000 * 0.4, -1.15 + rng.randrange(40) / 100_000 * 0.4
            rows.append((route, i, i * 10, "gate", lat, lon))
    rows += [("hot", 500 + i, 1, "gate", 51.9, -1.15) for i in range(50)]  # copies of one spot
    for i in range(60):  # beside the pole, on the equator, and a row of barriers in extract order
        rows.append(("pole", i, 1, "gate", 89.9999 + rng.random() / 10_000, rng.random() * 170))
        rows.append(("zero", i, 1, "gate", (rng.random() - 0.5) / 5_000, (rng.random() - 0.5) / 5_000))
        rows.append(("row", i, 1, "gate", 60.0, 5 + i * 0.00002))
    df = spark.createDataFrame(rows, "route_id string, ord int, node_id int, barrier_type string, lat double, lon double")
    want = set()
    for route in ("hot", "b", "pole", "zero", "row"):
        kept = []
        for r in sorted(x for x in rows if x[0] == route):
            if not any(haversine(r[4:], k[4:]) < 5 for k in kept):
                kept.append(r)
        want |= {(k[0], k[1]) for k in kept}
    assert {(r.route_id, r.ord) for r in routes.dedupe_barriers(df).collect()} == want


def bearing(g):
    (a, b), (c, d) = [[math.radians(x) for x in p] for p in (g[0], g[-1])]
    x = math.sin(d - b) * math.cos(c)
    y = math.cos(a) * math.sin(c) - math.sin(a) * math.cos(c) * math.cos(d - b)
    return math.degrees(math.atan2(x, y)) % 360


def test_parallel_upgrade_matches_all_pairs(spark):
    rng = random.Random(5)
    way_rows, seg_rows = [], []
    for i in range(300):
        g = [(51.9, -1.1), (51.9 + rng.uniform(-1, 1) / 100, -1.1 + rng.uniform(-1, 1) / 100)]
        tags = rng.choice([{"highway": "cycleway"}, {"highway": "path", "bicycle": "yes", "foot": "yes"}, {"highway": "path"},
                           {"highway": "residential"}, {"highway": "primary", "cycleway": "lane"}])
        if rng.random() < 0.7 and tags["highway"] in ("cycleway", "path"):
            tags = {"highway": "service"}
        way_rows.append(("r", i, i, tags, g[:1] if i % 37 == 0 else g))
        if tags["highway"] in ("residential", "primary", "service"):
            seg_rows.append(dict(way_id=i, highway=tags["highway"], provision="on_road_lane" if "cycleway" in tags else "none"))
    w = spark.createDataFrame([(a, b, c, t, [{"lat": p[0], "lon": p[1]} for p in g]) for a, b, c, t, g in way_rows],
                              "route_id string, ord int, way_id long, tags map<string,string>, geometry array<struct<lat double, lon double>>")
    s = segments(spark, seg_rows)
    on_route = {r["way_id"] for r in seg_rows}
    rank = R.PROVISION_RANK
    want = {}
    for r in seg_rows:
        g, best, best_rank = way_rows[r["way_id"]][4], None, rank[r["provision"]]
        for _, _, c, t, h in way_rows if len(g) > 1 else []:
            if c in on_route or len(h) < 2 or not (t["highway"] == "cycleway" or t.get("bicycle") == "yes"):
                continue
            d = abs(bearing(g) - bearing(h)) % 360
            d = 360 - d if d > 180 else d
            d = 180 - d if d > 90 else d
            p = "segregated" if t["highway"] == "cycleway" else "shared_use"
            if d <= 30 and rank[p] > best_rank:
                best, best_rank = p, rank[p]
        want[r["way_id"]] = (best or r["provision"], r["provision"] if best else None)
    got = {r.way_id: (r.provision, r.original_provision) for r in routes.upgrade_parallel(s, w).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_geometry_columns(spark):
    row = spark.range(1).select(
        geo.bearing_difference(F.lit(10.0), F.lit(185.0)).alias("d"),
        geo.way_length_m(F.array(F.struct(F.lit(51.0).alias("lat"), F.lit(0.0).alias("lon")))).alias("one"),
        geo.way_bearing(F.array(F.struct(F.lit(51.0).alias("lat"), F.lit(0.0).alias("lon")))).alias("none"),
        geo.ring_centroid(F.array().cast("array<array<double>>")).alias("c")).head()
    assert (row.d, row.one, row.none, row.c.asDict()) == (5.0, 0.0, None, {"lon": 0.0, "lat": 0.0})


def test_site_collection(spark):
    import json

    ring = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    rows = [([ring], {"DLGSDST.dbo.Planning_ArcGIS_Link_Public.application_number": "21/1/F", "location": "A\r\nB ", "SHAPE.STArea()": "245844.04"})]
    doc = json.loads(geojson.site_collections(spark.createDataFrame(rows, "rings array<array<array<double>>>, attributes map<string,string>")).head().geojson)
    outer, centre = doc["features"]
    assert outer["geometry"]["coordinates"] == [ring] and outer["properties"]["address"] == "A, B"
    assert centre["geometry"]["coordinates"] == [1.0, 1.0] and centre["properties"]["centroid_note"] == R.LARGE_SITE_NOTE
    assert outer["properties"]["area_sqm"] == 245844.0


def test_feature_collections(spark):
    import json

    s = segments(spark, [dict(geometry=[[1.0, 2.0], [3.0, 4.0]], original_provision="none", provision="segregated"), dict(lit=True)])
    features = json.loads(geojson.collections(geojson.segment_features(s)).head().geojson)["features"]
    assert features[0]["properties"]["original_provision"] == "none" and features[0]["properties"]["lit"] is None
    assert features[1]["geometry"] is None and "original_provision" not in features[1]["properties"]


def test_destinations(spark):
    d = spark.createDataFrame(list(R.DEFAULT_DESTINATIONS), "destination_id string, name string, lat double, lon double, category string")
    assert routes.next_destination_id(d).head().next_id == "dest_004"
    assert routes.next_destination_id(d.filter("lat > 99")).head().next_id == "dest_001"
    sites = spark.createDataFrame([("a",), ("b",)], "site string")
    assert routes.site_destinations(sites, d).count() == 6
    assert routes.site_destinations(sites, d, ["dest_002"]).count() == 2
    assert routes.site_destinations(sites, d, []).count() == 0


def test_missing_routing_falls_back(spark):
    kind = "route_id string, length_km double, time_s double, shape string"
    short = spark.createDataFrame([("a", 1.0, 60.0, "s"), ("b", 2.0, 90.0, "t")], kind)
    safe = spark.createDataFrame([("a", 1.5, 80.0, "u"), ("c", 3.0, 99.0, "v")], kind)
    got = {r.route_id: (r.cycling_distance_m, r.shortest_distance_m, r.shape) for r in routes.pick_routes(short, safe).collect()}
    assert got == {"a": (1500.0, 1000.0, "u"), "b": (2000.0, 2000.0, "t"), "c": (3000.0, 3000.0, "v")}


def test_narrative_tells_whole_summaries(spark, tmp_path):
    """The registered query returns every destination's two summaries, not just how many there are."""
    import json

    import duckdb

    import __spark_entry__ as entry
    from compare import compare

    orders = [(1, 5, 8000.0, "1-URGENT"), (6, 5, 8000.0, "2-HIGH"), (6, 5, 8000.0, "2-HIGH"), (7, 5, 8000.0, "3-MEDIUM"), (12, None, 80.0, None)]
    good, bad = (1, 1, 1, 5.0, 8000.0, "A", "F"), (2, 1, 1, 45.0, 8000.0, "N", "O")
    lines = [(k, *row) for k, row in ((1, good), (6, bad), (7, good))]
    tables = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"),
        "lineitem": spark.createDataFrame(
            lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                   "l_returnflag string, l_linestatus string").withColumn("l_shipdate", F.lit("1995-01-01").cast("timestamp_ntz")),
        "part": spark.createDataFrame([(1, "A", "ECONOMY", 2), (2, "B", "STANDARD", 1)],
                                      "p_partkey long, p_brand string, p_type string, p_size int"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = entry.queries()["route_narrative"](spark, str(tmp_path))
    assert compare(found, con, entry.oracle_sql()["route_narrative"]) is None

    def summary(metres, score, rating):
        return {"distance_m": metres, "ltn_score": score, "rating": rating}

    def told(name, shortest, safest, same):
        return {"destination_name": name, "shortest_route_summary": shortest, "safest_route_summary": safest, "same_route": same}

    got = {r.application_ref: (r.destinations, json.loads(r.narrative)) for r in found.collect()}
    poor = told("2-HIGH", summary(1000, 27, "red"), summary(1000, 27, "red"), True)
    assert got[5] == (4, [
        told("1-URGENT", summary(909, None, None), summary(1000, 97, "green"), False), poor, poor,
        told("3-MEDIUM", summary(1000, 96, "green"), summary(1000, 96, "green"), True)])  # no shortest routing
    assert got[None] == (1, [told(None, summary(10, 0, "red"), summary(10, 0, "red"), True)])  # no segments
