"""Queries on route segments, map ways and places."""

from pyspark.sql import functions as F

from hedgerow.functions import geo, ways
from hedgerow.operators import geojson, ordered, routes
from hedgerow.plans.catalog import half_even, listed, query
from hedgerow.plans.inputs import load, map_ways, segments, table, way_id, way_order, with_clause
from hedgerow.rules import routes as R

# --- SQL pieces -------------------------------------------------------------

_ROAD = listed(R.ROAD_HIGHWAYS)
_MAIN = listed(R.MAIN_ROADS)
_OFF = listed(R.OFF_ROAD)
SEGMENTS = with_clause("segment_rows") + """, segments AS (
    SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                                 l_extendedprice, l_shipdate) - 1 AS seq FROM segment_rows)
    """
_SURFACE_CLASS = (f"CASE WHEN lower(surface) IN {listed(R.GOOD_SURFACES)} THEN 'good' "
                  f"WHEN lower(surface) IN {listed(R.FAIR_SURFACES)} THEN 'fair' "
                  "WHEN lower(surface) = 'unknown' THEN 'unknown' ELSE 'poor' END")
_HOSTILE = f"provision = 'none' AND highway IN {_MAIN} AND speed_limit >= 30"
_SEGREGATION = "CASE provision WHEN 'segregated' THEN 1e0 WHEN 'shared_use' THEN 0.7e0 WHEN 'on_road_lane' THEN 0.4e0 ELSE 0e0 END"
_SPEED = """CASE WHEN provision IN ('none', 'advisory_lane') THEN CASE WHEN speed_limit <= 20 THEN 1e0
            WHEN speed_limit <= 30 THEN 0.6e0 WHEN speed_limit <= 40 THEN 0.2e0 ELSE 0e0 END END"""
_SURFACE = f"CASE {_SURFACE_CLASS} WHEN 'good' THEN 1e0 WHEN 'fair' THEN 0.6e0 WHEN 'unknown' THEN 0.5e0 ELSE 0.2e0 END"


# --- from tags --------------------------------------------------------------

_PROVISION = f"""CASE WHEN highway = 'cycleway' THEN 'segregated'
    WHEN highway IN ('path', 'footway', 'bridleway') THEN CASE
      WHEN bicycle IN ('designated', 'yes') AND foot IN ('designated', 'yes') THEN 'shared_use'
      WHEN bicycle IN ('designated', 'yes') THEN 'segregated'
      WHEN contains(lower(coalesce(designation, '')), 'shared') THEN 'shared_use' ELSE 'none' END
    WHEN cycleway IN ('track', 'separate') OR cycleway_left IN ('track', 'separate') THEN 'segregated'
    WHEN cycleway = 'lane' OR cycleway_left = 'lane' THEN 'on_road_lane'
    WHEN cycleway IN ('shared_lane', 'share_busway') OR cycleway_left IN ('shared_lane', 'share_busway') THEN 'advisory_lane'
    ELSE 'none' END"""
_DEFAULT_SPEED = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.DEFAULT_SPEEDS.items()) + " ELSE 30 END"
_WAY_ID = "CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE -l_partkey - 1 END"
_ORD = "l_partkey * 100000000 + l_suppkey * 10 + l_linenumber"


def _haversine(lat1, lon1, lat2, lon2):
    a = (f"(sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* sin(radians({lon2} - {lon1}) / 2) ** 2)")
    return f"(12742000e0 * atan2(sqrt{a}, sqrt(1 - {a})))"


def _bearing(lat1, lon1, lat2, lon2):
    turn = f"(radians({lon2}) - radians({lon1}))"
    x = f"sin({turn}) * cos(radians({lat2}))"
    y = (f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({turn})")
    angle = f"degrees(atan2({x}, {y}))"
    return f"(CASE WHEN {angle} < 0 THEN {angle} + 360 ELSE {angle} END)"


@query("segments_from_ways", with_clause("way_tags") + f"""
    SELECT route_id, {_ORD} AS seq, {_WAY_ID} AS way_id, {_PROVISION} AS provision,
           coalesce(highway, 'unknown') AS highway,
           coalesce(CASE WHEN maxspeed IN ('30 mph', '20') THEN CAST(split_part(maxspeed, ' ', 1) AS INT) END,
                    {_DEFAULT_SPEED}) AS speed_limit,
           coalesce(surface, 'unknown') AS surface,
           CASE lit WHEN 'yes' THEN 'lit' WHEN 'no' THEN 'unlit' ELSE 'unknown' END AS lit,
           round({_haversine('lat1', 'lon1', 'lat2', 'lon2')}, 5) AS distance_m
    FROM way_tags WHERE coalesce(highway, 'unknown') NOT IN {listed(R.NOT_ROUTABLE)}""")
def segments_from_ways(spark, sf):
    found = routes.segments_from_ways(map_ways(spark, sf))
    return found.select(
        "route_id", "seq", "way_id", "provision", "highway", "speed_limit", "surface",
        F.when(F.col("lit"), "lit").when(~F.col("lit"), "unlit").otherwise("unknown").alias("lit"),
        F.round("distance_m", 5).alias("distance_m"))


@query("routable_ways", with_clause("way_tags") + f"""
    SELECT route_id, count(*) AS ways FROM way_tags
    WHERE coalesce(highway, 'unknown') NOT IN {listed(R.NOT_ROUTABLE)} GROUP BY route_id""")
def routable_ways(spark, sf):
    return routes.routable(map_ways(spark, sf)).groupBy("route_id").agg(F.count("*").alias("ways"))


@query("distinct_way_ids", """
    SELECT DISTINCT l_orderkey AS route_id, l_partkey % 50 AS way_id FROM lineitem WHERE l_partkey % 50 <> 0""")
def distinct_way_ids(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route_id"), (F.col("l_partkey") % 50).alias("way_id"))
    return routes.distinct_way_ids(edges)


_CANDIDATES = f"""(highway = 'cycleway' OR (highway IN ('path', 'footway') AND bicycle IN ('designated', 'yes')))"""
_RANK = "CASE {} WHEN 'segregated' THEN 4 WHEN 'shared_use' THEN 3 WHEN 'on_road_lane' THEN 2 WHEN 'advisory_lane' THEN 1 ELSE 0 END"


# routes are suppliers here, so that a route has hundreds of ways to choose from
@query("upgrade_parallel", with_clause("way_tags") + f""", w AS (
      SELECT l_suppkey AS route_id, route_id * 8 + l_linenumber AS ord, l_partkey * 10 + route_id % 10 AS way_id, {_PROVISION} AS provision,
             coalesce(highway, 'unknown') AS highway, bicycle, {_bearing('lat1', 'lon1', 'lat2', 'lon2')} AS bearing, l_partkey
      FROM way_tags),
    s AS (SELECT route_id, way_id, min(ord) AS seq, arg_min(provision, ord) AS provision, arg_min(highway, ord) AS highway,
                 arg_min(bearing, ord) AS bearing
          FROM w WHERE l_partkey % 2 = 0 GROUP BY route_id, way_id),
    c AS (SELECT *, {_RANK.format('provision')} AS rank FROM w
          WHERE {_CANDIDATES} AND NOT EXISTS (SELECT 1 FROM s WHERE s.route_id = w.route_id AND s.way_id = w.way_id)),
    pairs AS (SELECT s.route_id, s.way_id, c.provision AS lifted, c.rank, c.ord, abs(s.bearing - c.bearing) AS d,
                     {_RANK.format('s.provision')} AS own
              FROM s JOIN c ON c.route_id = s.route_id
              WHERE s.provision IN ('none', 'advisory_lane', 'on_road_lane') AND s.highway IN {_ROAD}),
    near AS (SELECT *, CASE WHEN d > 180 THEN 360 - d ELSE d END AS e FROM pairs WHERE rank > own),
    best AS (SELECT route_id, way_id, arg_min(lifted, (-rank, ord)) AS lifted FROM near
             WHERE (CASE WHEN e > 90 THEN 180 - e ELSE e END) <= 30 GROUP BY route_id, way_id)
    SELECT s.route_id, s.way_id, coalesce(b.lifted, s.provision) AS provision,
           CASE WHEN b.lifted IS NULL THEN '' ELSE s.provision END AS original_provision
    FROM s LEFT JOIN best b ON b.route_id = s.route_id AND b.way_id = s.way_id""")
def upgrade_parallel(spark, sf):
    rows = map_ways(spark, sf)
    # ord of map_ways is part * 10^8 + supplier * 10 + line; take the parts back out of it
    part, line = F.floor(F.col("ord") / 100_000_000), F.col("ord") % 10
    supplier = F.floor(F.col("ord") % 100_000_000 / 10)
    w = rows.select(
        supplier.alias("route_id"), (F.col("route_id") * 8 + line).alias("ord"),
        (part * 10 + F.col("route_id") % 10).alias("way_id"), "tags", "geometry", part.alias("part"))
    on_route = w.filter("part % 2 = 0").select("route_id", "ord", "way_id", *ways.pulled(F.col("tags")))
    s = on_route.groupBy("route_id", "way_id").agg(
        F.min("ord").alias("seq"), F.min_by(ways.provision(), "ord").alias("provision"),
        F.min_by(ways.highway(), "ord").alias("highway")).withColumn(
        "original_provision", F.lit(None).cast("string"))
    # a segment's bearing is that of its way's first entry
    found = routes.upgrade_parallel(s, w.drop("part"))
    return found.select("route_id", "way_id", "provision", F.coalesce("original_provision", F.lit("")).alias("original_provision"))


# --- runs -------------------------------------------------------------------

_RUNS = SEGMENTS + """, marked AS (
      SELECT *, CASE WHEN seq = 0 OR provision IS DISTINCT FROM lag(provision) OVER w OR speed_limit IS DISTINCT FROM lag(speed_limit) OVER w
                      OR surface IS DISTINCT FROM lag(surface) OVER w OR lit IS DISTINCT FROM lag(lit) OVER w
                      OR highway IS DISTINCT FROM lag(highway) OVER w THEN 1 ELSE 0 END AS change
      FROM segments WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
    runs AS (SELECT *, CAST(sum(change) OVER (PARTITION BY route_id ORDER BY seq) AS BIGINT) AS run FROM marked)
    """


@query("number_runs", _RUNS + "SELECT route_id, seq, run FROM runs")
def number_runs(spark, sf):
    return routes.number_runs(segments(spark, sf)).select("route_id", "seq", "run")


@query("merge_runs", _RUNS + f"""
    SELECT route_id, run, first_seq, provision, highway, speed_limit, ways, {half_even('total', 1)} AS distance_m,
           {_SEGREGATION} AS segregation, coalesce({_SPEED}, -1) AS speed_safety, {_SURFACE} AS surface_quality,
           {_HOSTILE} AS hostile_junction
    FROM (SELECT route_id, run, min(seq) AS first_seq, any_value(provision) AS provision, any_value(highway) AS highway,
                 any_value(speed_limit) AS speed_limit, any_value(surface) AS surface, count(*) AS ways, sum(distance_m) AS total
          FROM runs GROUP BY route_id, run HAVING count(lon) > 0) x""")
def merge_runs(spark, sf):
    found = routes.merge_runs(segments(spark, sf))
    return found.select(
        "route_id", "run", "first_seq", "provision", "highway", "speed_limit", "ways", "distance_m",
        "score_factors.segregation", F.coalesce("score_factors.speed_safety", F.lit(-1.0)).alias("speed_safety"),
        "score_factors.surface_quality", "score_factors.hostile_junction")


@query("merge_runs_nested", _RUNS + f"""
    SELECT route_id, run, {half_even('total', 1)} AS distance_m, way_ids, names, points FROM (
      SELECT route_id, run, sum(distance_m) AS total, string_agg(CAST(way_id AS STRING), ',' ORDER BY seq) AS way_ids,
             2 * count(lon) AS points FROM runs GROUP BY route_id, run HAVING count(lon) > 0) x
    JOIN (SELECT route_id, run, string_agg(name, ',' ORDER BY first) AS names FROM (
            SELECT route_id, run, name, min(seq) AS first FROM runs GROUP BY route_id, run, name) y GROUP BY route_id, run) z
    USING (route_id, run)""")
def merge_runs_nested(spark, sf):
    found = routes.merge_runs_nested(segments(spark, sf))
    return found.select(
        "route_id", "run", "distance_m",
        F.array_join(F.transform("way_ids", lambda w: w.cast("string")), ",").alias("way_ids"),
        F.array_join("names", ",").alias("names"), F.size("geometry").cast("long").alias("points"))


# --- scores -----------------------------------------------------------------

@query("segment_score", SEGMENTS + f"""
    SELECT route_id, seq, {_SEGREGATION} AS segregation, coalesce({_SPEED}, -1) AS speed_safety,
           {_SURFACE} AS surface_quality, {_HOSTILE} AS hostile_junction FROM segments""")
def segment_score(spark, sf):
    return routes.segment_factors(segments(spark, sf)).select(
        "route_id", "seq", "segregation", F.coalesce("speed_safety", F.lit(-1.0)).alias("speed_safety"),
        "surface_quality", "hostile_junction")


@query("provision_summary", SEGMENTS + f""", per AS (
      SELECT route_id, provision, sum(distance_m) AS m FROM segments GROUP BY route_id, provision),
    r AS (SELECT route_id, provision, {half_even('m', 1)} AS distance_m FROM per),
    t AS (SELECT *, distance_m / sum(distance_m) OVER (PARTITION BY route_id) * 100 AS share FROM r)
    SELECT route_id, provision, distance_m, round(share, 4) AS share FROM t""")
def provision_summary(spark, sf):
    per = routes.summarise_provision(segments(spark, sf))
    whole = per.groupBy("route_id").agg(F.sum("distance_m").alias("whole"))
    return per.join(whole, "route_id").select(
        "route_id", "provision", "distance_m", F.round(F.col("distance_m") / F.col("whole") * 100, 4).alias("share"))


_SCORE = f"""sums AS (
      SELECT route_id, sum(distance_m) AS total,
             sum(CASE WHEN provision = 'segregated' THEN distance_m ELSE 0 END) AS segregated,
             sum(CASE WHEN provision = 'shared_use' THEN distance_m ELSE 0 END) AS shared,
             sum(CASE WHEN provision = 'on_road_lane' THEN distance_m ELSE 0 END) AS lane,
             sum(CASE WHEN provision IN ('none', 'advisory_lane') THEN distance_m ELSE 0 END) AS exposed,
             sum(CASE WHEN provision IN ('none', 'advisory_lane') AND speed_limit <= 20 THEN distance_m ELSE 0 END) AS b0,
             sum(CASE WHEN provision IN ('none', 'advisory_lane') AND speed_limit > 20 AND speed_limit <= 30 THEN distance_m ELSE 0 END) AS b1,
             sum(CASE WHEN provision IN ('none', 'advisory_lane') AND speed_limit > 30 AND speed_limit <= 40 THEN distance_m ELSE 0 END) AS b2,
             sum(CASE WHEN {_SURFACE_CLASS} = 'good' THEN distance_m ELSE 0 END) AS good,
             sum(CASE WHEN {_SURFACE_CLASS} = 'fair' THEN distance_m ELSE 0 END) AS fair,
             sum(CASE WHEN {_SURFACE_CLASS} = 'unknown' THEN distance_m ELSE 0 END) AS unk,
             sum(CASE WHEN {_SURFACE_CLASS} = 'poor' THEN distance_m ELSE 0 END) AS poor,
             count(*) FILTER (WHERE {_HOSTILE}) AS hostile, count(*) AS n
      FROM segments GROUP BY route_id),
    pts AS (SELECT r.*, coalesce(s.hostile, 0) AS hostile, coalesce(s.n, 0) AS n,
             CASE WHEN coalesce(s.total, 0) = 0 THEN 0e0 ELSE (s.segregated * 1e0 + s.shared * 0.7e0 + s.lane * 0.4e0) / s.total * 36e0 END AS p1,
             CASE WHEN coalesce(s.exposed, 0) = 0 THEN 23e0 ELSE (s.b0 * 1e0 + s.b1 * 0.6e0 + s.b2 * 0.2e0) / s.exposed * 23e0 END AS p2,
             CASE WHEN coalesce(s.total, 0) = 0 THEN 0e0 ELSE (s.good * 1e0 + s.fair * 0.6e0 + s.unk * 0.5e0 + s.poor * 0.2e0) / s.total * 13e0 END AS p3,
             CASE WHEN coalesce(shortest_distance_m, 0) = 0 THEN 4.5e0 WHEN cycling_distance_m / shortest_distance_m <= 1.1e0 THEN 9e0
                  WHEN cycling_distance_m / shortest_distance_m <= 1.3e0 THEN 9 * 0.7e0
                  WHEN cycling_distance_m / shortest_distance_m <= 1.5e0 THEN 9 * 0.4e0 ELSE 9 * 0.1e0 END AS directness,
             CASE WHEN coalesce(s.hostile, 0) = 0 THEN 9e0 WHEN s.hostile <= 2 THEN 9 * 0.6e0 WHEN s.hostile <= 5 THEN 9 * 0.3e0 ELSE 0e0 END AS junctions
      FROM routes r LEFT JOIN sums s ON s.route_id = r.route_id),
    parts AS (SELECT *, CASE WHEN p1 = 0 THEN 0e0 ELSE {half_even('p1', 1)} END AS segregation,
                     {half_even('p2', 1)} AS speed_safety, {half_even('p3', 1)} AS surface_quality FROM pts)"""
_TRANSITION_COUNTS = f"""pairs AS (
      SELECT route_id, seq, provision, highway, name, speed_limit, lon, lat, lag(provision) OVER w AS pp,
             lead(provision) OVER w AS np, lead(highway) OVER w AS nh, lead(name) OVER w AS nn, lead(speed_limit) OVER w AS ns,
             lead(lon) OVER w AS nlon, lead(lat) OVER w AS nlat
      FROM segments WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
    crossings AS (SELECT route_id, seq, CASE WHEN nh IN {_ROAD} THEN nn ELSE name END AS road_name,
             CASE WHEN nh IN {_ROAD} THEN ns ELSE speed_limit END AS road_speed_limit,
             coalesce(lat + 0.25e0, nlat, -999) AS lat, coalesce(lon + 0.5e0, nlon, -999) AS lon
      FROM pairs WHERE nh IS NOT NULL AND ((provision IN {_OFF} AND nh IN {_ROAD}) OR (highway IN {_ROAD} AND np IN {_OFF}))),
    changes AS (SELECT route_id, seq, name AS road_name FROM pairs WHERE pp IN {_OFF} AND highway IN {_ROAD} AND np IN {_OFF}),
    counts AS (SELECT r.route_id, coalesce(c.n, 0) AS crossings, coalesce(c.fast, 0) AS fast, coalesce(s.n, 0) AS changes
      FROM routes r
      LEFT JOIN (SELECT route_id, count(*) AS n, count(*) FILTER (WHERE road_speed_limit >= 30) AS fast FROM crossings GROUP BY route_id) c ON c.route_id = r.route_id
      LEFT JOIN (SELECT route_id, count(*) AS n FROM changes GROUP BY route_id) s ON s.route_id = r.route_id)"""
_SEGMENTS_AND_ROUTES = with_clause("segment_rows", "routes") + SEGMENTS[len(with_clause("segment_rows")):]


def _score_select(transition):
    total = "segregation + speed_safety + surface_quality + directness + junctions + transition"
    return f"""
    SELECT route_id, hostile AS hostile_junctions, CAST(score AS BIGINT) AS score,
           CASE WHEN score >= 70 THEN 'green' WHEN score >= 40 THEN 'amber' ELSE 'red' END AS rating,
           segregation, speed_safety, surface_quality, {half_even('directness', 1)} AS directness,
           {half_even('junctions', 1)} AS junction_safety, transition AS transition_quality,
           cycling_distance_m < 200 AS short_route
    FROM (SELECT *, greatest(0, least(100, {half_even('raw', 0)})) AS score
          FROM (SELECT *, {total} AS raw FROM (SELECT p.*, {transition} AS transition FROM parts p
                LEFT JOIN counts c ON c.route_id = p.route_id) x) y) z"""


def _score_columns(scored):
    return scored.select(
        "route_id", "hostile_junctions", "score", "rating", "breakdown.*",
        F.col("short_route_note").isNotNull().alias("short_route"))


@query("route_score", _SEGMENTS_AND_ROUTES + ", counts AS (SELECT route_id FROM routes), " + _SCORE + _score_select("5e0"))
def route_score(spark, sf):
    return _score_columns(routes.score_routes(segments(spark, sf), load(spark, sf, "routes")))


@query("route_score_with_transitions", _SEGMENTS_AND_ROUTES + ", " + _TRANSITION_COUNTS + ", " + _SCORE + _score_select(
    "greatest(0e0, 10 - (c.fast * 1.5e0 + (c.crossings - c.fast) * 0.5e0 + c.changes * 1e0))"))
def route_score_with_transitions(spark, sf):
    s, r = segments(spark, sf), load(spark, sf, "routes")
    return _score_columns(routes.score_routes(s, r, routes.transition_summary(r, s)))


# --- transitions ------------------------------------------------------------

@query("crossings", _SEGMENTS_AND_ROUTES + ", " + _TRANSITION_COUNTS + " SELECT * FROM crossings")
def crossings(spark, sf):
    return routes.non_priority_crossings(segments(spark, sf)).fillna(-999, ["lat", "lon"])


@query("crossings_without_priority", _SEGMENTS_AND_ROUTES + ", " + _TRANSITION_COUNTS + """
    SELECT route_id, count(*) AS crossings FROM crossings
    WHERE route_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 1) GROUP BY route_id""")
def crossings_without_priority(spark, sf):
    nodes = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), F.create_map(
            F.lit("crossing"), F.when(F.col("l_suppkey") % 10 == 1, "marked").otherwise("unmarked")).alias("tags"))
    return routes.non_priority_crossings(segments(spark, sf), nodes).groupBy("route_id").agg(F.count("*").alias("crossings"))


@query("side_changes", _SEGMENTS_AND_ROUTES + ", " + _TRANSITION_COUNTS + " SELECT * FROM changes")
def side_changes(spark, sf):
    return routes.side_changes(segments(spark, sf))


@query("transition_summary", _SEGMENTS_AND_ROUTES + ", " + _TRANSITION_COUNTS + """
    SELECT route_id, 0 AS barrier_count, crossings AS non_priority_crossing_count, fast AS fast_crossing_count,
           changes AS side_change_count, 0 AS parallel_upgrades FROM counts""")
def transition_summary(spark, sf):
    found = routes.transition_summary(load(spark, sf, "routes"), segments(spark, sf))
    return found.drop("directness_differential")


# the walk itself: barriers of all routes one by one in extract order, each held against the list of those kept before
@query("barrier_dedupe", "WITH RECURSIVE " + with_clause("barrier_spots")[5:].rstrip() + f""",
    turns AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY ord, node_id, lat, lon) AS turn FROM barrier_spots),
    walk AS (
        SELECT DISTINCT route_id, CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(lat DOUBLE, lon DOUBLE)[]) AS kept,
               false AS stays FROM turns
        UNION ALL
        SELECT route_id, turn, CASE WHEN stays THEN list_append(kept, struct_pack(lat := lat, lon := lon)) ELSE kept END, stays
        FROM (SELECT t.route_id, t.turn, t.lat, t.lon, w.kept, len(list_filter(w.kept, lambda k:
                  2 * {R.EARTH_RADIUS_M} * asin(sqrt(sin(radians(k.lat - t.lat) / 2) ** 2 + cos(radians(t.lat))
                  * cos(radians(k.lat)) * sin(radians(k.lon - t.lon) / 2) ** 2)) < {R.BARRIER_SPACING_M})) = 0 AS stays
              FROM walk w JOIN turns t ON t.route_id = w.route_id AND t.turn = w.turn + 1))
    SELECT t.route_id, t.ord, t.node_id, 'gate' AS barrier_type, t.lat, t.lon FROM turns t JOIN walk w USING (route_id, turn)
    WHERE w.stays""")
def barrier_dedupe(spark, sf):
    spots = load(spark, sf, "barrier_spots").withColumn("barrier_type", F.lit("gate"))
    return routes.dedupe_barriers(spots)


@query("barrier_first_spots", with_clause("barrier_spots") + """
    SELECT route_id, min(ord) AS ord FROM barrier_spots GROUP BY route_id""")
def barrier_first_spots(spark, sf):
    return barrier_dedupe(spark, sf).groupBy("route_id").agg(F.min("ord").alias("ord"))


# --- issues -----------------------------------------------------------------

_LENGTH = f"CAST(CAST({half_even('m', 0)} AS BIGINT) AS STRING)"


def _issue_sql(order, cond, severity, problem):
    return f"""SELECT s.route_id, r.road_seq, {order} AS kind_order, '{severity}' AS severity, s.name || ' (' || {_LENGTH} || 'm)' AS location,
        {problem} AS problem FROM (
          SELECT route_id, name, sum(distance_m) AS m, max(speed_limit) AS speed, arg_min(highway, seq) AS highway,
                 arg_min(surface, seq) AS surface, arg_min(provision, seq) AS provision
          FROM segments WHERE {cond} GROUP BY route_id, name) s JOIN roads r ON r.route_id = s.route_id AND r.name = s.name"""


_ISSUES = SEGMENTS + ", roads AS (SELECT route_id, name, min(seq) AS road_seq FROM segments GROUP BY route_id, name), issues AS (" + \
    " UNION ALL ".join([
        _issue_sql(1, "provision = 'none' AND speed_limit >= 40", "high",
                   "speed || 'mph speed limit with no cycle provision on ' || highway || ' road'"),
        _issue_sql(2, f"provision = 'none' AND speed_limit >= 30 AND speed_limit < 40 AND highway IN {_MAIN}", "medium",
                   "speed || 'mph ' || highway || ' road with no cycle provision'"),
        _issue_sql(3, f"lower(surface) IN {listed(R.ROUGH_SURFACES)}", "medium",
                   "'Poor surface (' || surface || ') on ' || CASE WHEN provision = 'shared_use' THEN 'shared-use path' ELSE highway END"),
        _issue_sql(4, f"lit = false AND provision IN {_OFF}", "low",
                   "'Unlit ' || replace(provision, '_', ' ') || ' path'"),
    ]) + ")\n"


@query("issues", _ISSUES + "SELECT * FROM issues")
def issues(spark, sf):
    return routes.identify_issues(segments(spark, sf)).drop("suggested_improvement")


@query("top_issues", _ISSUES + """
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY route_id ORDER BY
        CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, road_seq, kind_order) AS INT) AS rank FROM issues) x
    WHERE rank <= 5""")
def top_issues(spark, sf):
    return routes.top_issues(routes.identify_issues(segments(spark, sf))).drop("suggested_improvement")


@query("severity_counts", _ISSUES + """
    SELECT route_id, count(*) FILTER (WHERE severity = 'high') AS high_count,
           count(*) FILTER (WHERE severity = 'medium') AS medium_count, count(*) FILTER (WHERE severity = 'low') AS low_count
    FROM issues GROUP BY route_id""")
def severity_counts(spark, sf):
    return routes.severity_counts(routes.identify_issues(segments(spark, sf)))


@query("funding_suggestions", _ISSUES + f"""
    SELECT route_id, road_seq, kind_order, location AS issue_location, severity,
           'Addresses identified deficiency: ' || problem || '. S106 contribution towards off-site cycling infrastructure '
           || 'improvements is justified under {R.DEFAULT_SCORING.policy_basis}.' AS justification
    FROM issues WHERE severity IN ('high', 'medium')""")
def funding_suggestions(spark, sf):
    return routes.funding_suggestions(routes.identify_issues(segments(spark, sf))).drop("improvement")


# --- geometry ---------------------------------------------------------------

_LEG = ("lat1", "lon1", "lat2", "lon2")


@query("haversine_legs", with_clause("legs") + f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_haversine(*_LEG)}, 4) AS metres FROM legs""")
def haversine_legs(spark, sf):
    return load(spark, sf, "legs").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(geo.haversine_m(*map(F.col, _LEG)), 4).alias("metres"))


@query("bearing_pairs", with_clause("legs") + f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b, 5) AS bearing,
           round(CASE WHEN e > 90 THEN 180 - e ELSE e END, 5) AS off_north_east
    FROM (SELECT *, CASE WHEN abs(b - 45) > 180 THEN 360 - abs(b - 45) ELSE abs(b - 45) END AS e
          FROM (SELECT *, {_bearing(*_LEG)} AS b FROM legs WHERE lat1 <> lat2 OR lon1 <> lon2) x) y""")
def bearing_pairs(spark, sf):
    legs = load(spark, sf, "legs").filter("lat1 <> lat2 OR lon1 <> lon2")
    angle = geo.bearing(*map(F.col, _LEG))
    return legs.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(angle, 5).alias("bearing"),
        F.round(geo.bearing_difference(angle, F.lit(45.0)), 5).alias("off_north_east"))


@query("way_lengths", with_clause("legs") + f"""
    SELECT l_orderkey, round(sum(d), 3) AS metres FROM (
      SELECT l_orderkey, {_haversine('lat1', 'lon1', 'lat2', 'lon2')} + {_haversine('lat2', 'lon2', 'lat1', 'lon2')} AS d FROM legs) x
    GROUP BY l_orderkey""")
def way_lengths(spark, sf):
    def point(lat, lon):
        return F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))

    shape = F.array(point("lat1", "lon1"), point("lat2", "lon2"), point("lat1", "lon2"))
    return load(spark, sf, "legs").groupBy("l_orderkey").agg(F.round(F.sum(geo.way_length_m(shape)), 3).alias("metres"))


@query("site_facts", """
    SELECT s_suppkey AS site_id, 'APP/' || s_suppkey AS application_ref,
           CASE WHEN s_suppkey % 2 = 0 THEN s_name || ', Town' ELSE '' END AS address,
           coalesce(CASE WHEN floor(abs(s_acctbal)) <> 0 THEN floor(abs(s_acctbal)) * 20 END, -1) AS area_sqm,
           (s_suppkey * 3 + 4) / 4e0 AS lon, (s_nationkey * 3 + 4) / 4e0 AS lat,
           floor(abs(s_acctbal)) * 20 > 100000 AS large
    FROM supplier""")
def site_facts(spark, sf):
    x, y = F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double")
    corner = F.array(x, y)
    ring = F.array(corner, F.array(x + 4, y), F.array(x, y + 4), F.array(F.lit(0.0), F.lit(0.0)), corner)
    even = F.col("s_suppkey") % 2 == 0
    area = (F.floor(F.abs("s_acctbal")) * 20).cast("double").cast("string")
    attributes = F.create_map(
        F.when(even, R.SITE_ATTRIBUTE_PREFIXES[0] + "application_number").otherwise("APPLICATION_REF"),
        F.concat(F.lit("APP/"), F.col("s_suppkey").cast("string")),
        F.when(even, R.SITE_ATTRIBUTE_PREFIXES[1] + "location").otherwise("somewhere"),
        F.concat("s_name", F.lit("\r\nTown ")),
        F.lit("SHAPE.STArea()"), area)
    sites = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id"), F.array(ring).alias("rings"),
                                                attributes.alias("attributes"))
    return geojson.site_facts(sites).select(
        "site_id", "application_ref", "address", F.coalesce("area_sqm", F.lit(-1.0)).alias("area_sqm"),
        F.col("centroid.lon").alias("lon"), F.col("centroid.lat").alias("lat"),
        (F.col("centroid_note") == R.LARGE_SITE_NOTE).alias("large"))


@query("site_destinations", with_clause("places", "destinations") + """
    SELECT supplier_id, destination_id, name FROM places, destinations WHERE destination_id <> 'dest_1003'""")
def site_destinations(spark, sf):
    places, destinations = load(spark, sf, "places"), load(spark, sf, "destinations")
    chosen = destinations.filter("destination_id <> 'dest_1003'")
    return routes.site_destinations(places, chosen).select("supplier_id", "destination_id", "name")


@query("next_destination_id", with_clause("destinations") + """
    SELECT 'dest_' || (max(CAST(substr(destination_id, 6) AS BIGINT)) + 1) AS next_id FROM destinations""")
def next_destination_id(spark, sf):
    return routes.next_destination_id(load(spark, sf, "destinations"))


@query("list_destinations", with_clause("destinations") + "SELECT destination_id, name, zone FROM destinations")
def list_destinations(spark, sf):
    return routes.list_destinations(load(spark, sf, "destinations"))


def _sampled(spark, sf):
    """Route points of each supplier: its parts in order, every (n div 50)-th kept."""
    points = load(spark, sf, "legs").select(
        F.col("l_suppkey").alias("route_id"), "l_partkey", F.col("lat2").alias("lat"), F.col("lon2").alias("lon")).distinct()
    numbered = ordered.position(points, ["route_id"], ["l_partkey"], "idx", ordered.seq_block("l_partkey", 4096))
    return routes.sample_points(numbered.select("route_id", (F.col("idx") - 1).alias("idx"), "lat", "lon"))


_SAMPLED = with_clause("legs") + """, pts AS (SELECT DISTINCT l_suppkey AS route_id, l_partkey, lat2 AS lat, lon2 AS lon FROM legs),
    num AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY l_partkey) - 1 AS i, count(*) OVER (PARTITION BY route_id) AS n FROM pts),
    grid AS (SELECT * FROM num WHERE i % greatest(1, n // 50) = 0),
    kept AS (SELECT route_id, n, lat, lon FROM grid UNION ALL
             SELECT m.route_id, m.n, m.lat, m.lon FROM num m WHERE m.i = m.n - 1 AND NOT EXISTS (
               SELECT 1 FROM grid g WHERE g.route_id = m.route_id AND g.lat = m.lat AND g.lon = m.lon))
    """


@query("sample_points", _SAMPLED + """
    SELECT route_id, count(*) AS kept, round(sum(lat), 6) AS lat_sum FROM kept GROUP BY route_id""")
def sample_points(spark, sf):
    return _sampled(spark, sf).groupBy("route_id").agg(
        F.count("*").alias("kept"), F.round(F.sum("lat"), 6).alias("lat_sum"))


@query("on_route_barriers", with_clause("legs") + f""", kept AS (SELECT l_suppkey AS route_id, lat2 AS lat, lon2 AS lon FROM legs), things AS (
      SELECT l_suppkey AS route_id, l_orderkey * 8 + l_linenumber AS node_id, l_linenumber AS way_id, 51.8e0 + CAST(l_orderkey % 830 AS DOUBLE) / 10000 AS lat,
             -1.2e0 + CAST(l_partkey % 790 AS DOUBLE) / 10000 AS lon FROM lineitem)
    SELECT t.route_id, t.node_id FROM things t WHERE (t.route_id % 2 = 0 AND t.way_id > 3) OR (t.route_id % 2 = 1 AND EXISTS (
      SELECT 1 FROM kept k WHERE k.route_id = t.route_id AND {_haversine('t.lat', 't.lon', 'k.lat', 'k.lon')} <= 15))""")
def on_route_barriers(spark, sf):
    rows = table(spark, sf, "lineitem")
    barriers = rows.select(
        F.col("l_suppkey").alias("route_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"),
        F.col("l_linenumber").alias("way_id"), (51.8 + (F.col("l_orderkey") % 830).cast("double") / 10000).alias("lat"),
        (-1.2 + (F.col("l_partkey") % 790).cast("double") / 10000).alias("lon"))
    # half of the routes know their ways, and every way but the first three is on them
    ways = barriers.filter("route_id % 2 = 0").select("route_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("way_id")).distinct()
    points = load(spark, sf, "legs").select(
        F.col("l_suppkey").alias("route_id"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    return routes.on_route_barriers(barriers, ways.filter("way_id > 3"), points).select("route_id", "node_id")


@query("near_route", with_clause("legs") + f""", kept AS (SELECT l_suppkey AS route_id, lat2 AS lat, lon2 AS lon FROM legs), things AS (
      SELECT l_suppkey AS route_id, l_orderkey * 8 + l_linenumber AS node_id, 51.8e0 + CAST(l_orderkey % 830 AS DOUBLE) / 10000 AS lat,
             -1.2e0 + CAST(l_partkey % 790 AS DOUBLE) / 10000 AS lon FROM lineitem)
    SELECT t.route_id, t.node_id FROM things t WHERE EXISTS (
      SELECT 1 FROM kept k WHERE k.route_id = t.route_id AND {_haversine('t.lat', 't.lon', 'k.lat', 'k.lon')} <= 20)""")
def near_route(spark, sf):
    things = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("route_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("node_id"),
        (51.8 + (F.col("l_orderkey") % 830).cast("double") / 10000).alias("lat"),
        (-1.2 + (F.col("l_partkey") % 790).cast("double") / 10000).alias("lon"))
    points = load(spark, sf, "legs").select(
        F.col("l_suppkey").alias("route_id"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    return routes.near_route(things, points, R.CROSSING_REACH_M).select("route_id", "node_id")


@query("decode_shapes", """
    SELECT o_orderkey AS route_id, idx, CASE idx WHEN 0 THEN -120.2e0 WHEN 1 THEN -120.95e0 ELSE -126.453e0 END AS lon,
           CASE idx WHEN 0 THEN 38.5e0 WHEN 1 THEN 40.7e0 ELSE 43.252e0 END AS lat
    FROM orders CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2) n WHERE idx < 1 + o_orderkey % 3""")
def decode_shapes(spark, sf):
    # a published example line, cut after its first, second or third point
    shape = F.element_at(F.array(F.lit("_p~iF~ps|U"), F.lit("_p~iF~ps|U_ulLnnqC"), F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")),
                         (1 + F.col("o_orderkey") % 3).cast("int"))
    shapes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("route_id"), shape.alias("shape"))
    return routes.route_points(routes.decode_shapes(shapes, 5))


# --- whole routes -----------------------------------------------------------

@query("route_assessment", _SEGMENTS_AND_ROUTES.rstrip() + ", roads AS (SELECT route_id, name, min(seq) AS road_seq FROM segments GROUP BY route_id, name), issues AS ("
       + _ISSUES.split("issues AS (", 1)[1].rstrip() + ", " + _TRANSITION_COUNTS + ", " + _SCORE + f""",
    final AS (SELECT p.*, greatest(0e0, 10 - (c.fast * 1.5e0 + (c.crossings - c.fast) * 0.5e0 + c.changes * 1e0)) AS transition, c.crossings, c.changes
              FROM parts p LEFT JOIN counts c ON c.route_id = p.route_id),
    sev AS (SELECT route_id, count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
                   count(*) FILTER (WHERE severity = 'low') AS low_count FROM issues GROUP BY route_id),
    raw AS (SELECT *, segregation + speed_safety + surface_quality + directness + junctions + transition AS raw, duration_s / 60 AS mins FROM final)
    SELECT f.route_id, CAST({half_even('cycling_distance_m', 0)} AS BIGINT) AS distance_m, {half_even('mins', 1)} AS duration_minutes,
           CASE WHEN n = 0 THEN 0 ELSE CAST(greatest(0, least(100, {half_even('raw', 0)})) AS BIGINT) END AS score,
           n AS segment_count, coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count, coalesce(low_count, 0) AS low_count,
           crossings AS non_priority_crossing_count, changes AS side_change_count,
           coalesce(abs(shortest_distance_m - cycling_distance_m) / greatest(shortest_distance_m, 1) < 0.01, false) AS same_route
    FROM raw f LEFT JOIN sev ON sev.route_id = f.route_id""")
def route_assessment(spark, sf):
    return assessed(spark, sf).select(
        "route_id", "distance_m", "duration_minutes", "score", "segment_count", "high_count", "medium_count",
        "low_count", "non_priority_crossing_count", "side_change_count",
        F.coalesce("same_route", F.lit(False)).alias("same_route"))


def assessed(spark, sf):
    return routes.route_assessment(load(spark, sf, "routes"), segments(spark, sf))


_ENTRY = ("destination", "short_m", "short_score", "short_rating", "safest_m", "score", "rating", "same")


@query("route_narrative", _SEGMENTS_AND_ROUTES + ", " + _TRANSITION_COUNTS + ", " + _SCORE + f""",
    final AS (SELECT p.*, segregation + speed_safety + surface_quality + directness + junctions
                     + greatest(0e0, 10 - (c.fast * 1.5e0 + (c.crossings - c.fast) * 0.5e0 + c.changes * 1e0)) AS raw
              FROM parts p LEFT JOIN (SELECT DISTINCT * FROM counts) c ON c.route_id = p.route_id),
    scored AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(greatest(0, least(100, {half_even('raw', 0)})) AS BIGINT) END AS score FROM final),
    told AS (SELECT application_ref, destination, CAST({half_even('cycling_distance_m', 0)} AS BIGINT) AS safest_m,
                    CAST({half_even('shortest_distance_m', 0)} AS BIGINT) AS shortest_m, score,
                    CASE WHEN score >= 70 THEN 'green' WHEN score >= 40 THEN 'amber' ELSE 'red' END AS rating,
                    CASE WHEN shortest_distance_m IS NULL THEN true
                         ELSE abs(shortest_distance_m - cycling_distance_m) / greatest(shortest_distance_m, 1) < 0.01 END AS same
             FROM scored),
    entries AS (SELECT application_ref, destination, coalesce(shortest_m, safest_m) AS short_m, CASE WHEN same THEN score END AS short_score,
                       CASE WHEN same THEN rating END AS short_rating, safest_m, score, rating, same FROM told)
    SELECT application_ref, count(*) AS destinations, CAST(to_json(list(struct_pack(destination_name := destination,
             shortest_route_summary := struct_pack(distance_m := short_m, ltn_score := short_score, rating := short_rating),
             safest_route_summary := struct_pack(distance_m := safest_m, ltn_score := score, rating := rating), same_route := same)
             ORDER BY {', '.join(c + ' NULLS FIRST' for c in _ENTRY)})) AS VARCHAR) AS narrative
    FROM entries GROUP BY application_ref""")
def route_narrative(spark, sf):
    found = routes.route_narrative(assessed(spark, sf))
    return found.select(
        "application_ref", F.size("destinations").cast("long").alias("destinations"),
        F.to_json("destinations", {"ignoreNullFields": "false"}).alias("narrative"))


@query("route_features")
def route_features(spark, sf):
    return geojson.collections(geojson.run_features(routes.merge_runs_nested(segments(spark, sf))))


@query("crossing_features")
def crossing_features(spark, sf):
    return geojson.collections(geojson.crossing_features(routes.non_priority_crossings(segments(spark, sf))))
