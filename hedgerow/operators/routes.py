"""Route analytics: segments of many routes at once.

``segments(route_id, seq, way_id, provision, highway, speed_limit, surface, lit, distance_m, name,
original_provision, geometry)``: ``seq`` is the position on the route, unique within it;
``geometry`` is an array of [lon, lat] or null.
``map_ways(route_id, ord, way_id, tags, geometry)`` and ``map_nodes(route_id, ord, node_id, lat, lon,
tags)``: ``ord`` is the position in the map extract; way geometry is an array of (lat, lon).
"""

import math
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.functions import geo, ways
from hedgerow.functions.numbers import round_half_even, round_to_long
from hedgerow.operators import ordered
from hedgerow.operators.pairing import every_pair
from hedgerow.rules import routes as R

SEGMENT_KEY = ("provision", "speed_limit", "surface", "lit", "original_provision", "highway")


# --- from the map extract ---------------------------------------------------

def routable(map_ways: DataFrame) -> DataFrame:
    """Leave out planned and removed ways."""
    return map_ways.filter(~ways.tag(F.col("tags"), "highway", "unknown").isin(*R.NOT_ROUTABLE))


def segments_from_ways(map_ways: DataFrame) -> DataFrame:
    """One segment per routable way, in extract order."""
    shape = F.col("geometry")
    return routable(map_ways).select("route_id", "ord", "way_id", "geometry", *ways.pulled(F.col("tags"))).select(
        "route_id", F.col("ord").alias("seq"), "way_id",
        ways.provision().alias("provision"), ways.highway().alias("highway"),
        ways.speed_limit().alias("speed_limit"), ways.surface().alias("surface"), ways.lit().alias("lit"),
        geo.way_length_m(shape).alias("distance_m"), ways.name().alias("name"),
        F.lit(None).cast("string").alias("original_provision"),
        F.when(F.size(shape) >= 2, F.transform(shape, lambda p: F.array(p["lon"], p["lat"]))).alias("geometry"),
    )


def distinct_way_ids(edges: DataFrame) -> DataFrame:
    """Ways a route runs on; 0 stands for unknown and is left out."""
    return edges.filter("way_id <> 0").select("route_id", "way_id").distinct()


# --- upgrades by a parallel cycleway ----------------------------------------

def _best_parallel(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate within 30 degrees for each question (route_id, angle), angles modulo 180.

    Cells are 30 degrees wide, so an angle reaches its whole own cell and part of the two beside it.  Everything meets
    on (route, cell): the own cell brings its winner once, the cells beside it their candidates, answered by running
    maxima over the sorted positions within the cell, up to the exact angle.
    """
    def row(q, part, role, best, angle):
        return F.struct(q.alias("q"), part.alias("part"), F.lit(role).alias("role"), best.alias("best"),
                        angle.alias("angle"))

    part = F.col("angle") - F.col("cell") * 30
    nothing, no_angle = F.lit(None).cast(candidates.schema["best"].dataType), F.lit(None).cast("double")
    edges = F.array(
        row(F.pmod(F.col("cell") - 1, F.lit(6)), part, 1, F.col("best"), no_angle),
        row(F.pmod(F.col("cell") + 1, F.lit(6)), part, 2, F.col("best"), no_angle))
    cells = candidates.groupBy("route_id", "cell").agg(F.max("best").alias("best"))
    rows = (
        questions.select("route_id", row(F.col("cell"), part, 0, nothing, F.col("angle")).alias("r"))
        .unionByName(candidates.select("route_id", F.explode(edges).alias("r")))
        .unionByName(cells.select("route_id", row(F.col("cell"), no_angle, 3, F.col("best"), no_angle).alias("r")))
        .select("route_id", "r.*")
    )
    cell = Window.partitionBy("route_id", "q")
    so_far = (Window.unboundedPreceding, 0)
    # a candidate exactly on the edge is seen before the question: role 0 comes last
    up = cell.orderBy(F.col("part").asc(), F.col("role").desc()).rowsBetween(*so_far)
    down = cell.orderBy(F.col("part").desc(), F.col("role").desc()).rowsBetween(*so_far)

    def held(role):
        return F.when(F.col("role") == role, F.col("best"))

    found = F.greatest(F.max(held(1)).over(up), F.max(held(2)).over(down), F.max(held(3)).over(cell))
    return rows.withColumn("found", found).filter("role = 0 and found is not null").select(
        "route_id", "angle", F.col("found").alias("best"))


def upgrade_parallel(segments: DataFrame, map_ways: DataFrame) -> DataFrame:
    """Lift poor road segments to the provision of the best parallel cycleway.

    A cycleway qualifies if it is not itself on the route and its bearing is within 30 degrees of
    the segment's way (either direction); it must rank strictly higher; the first of equals wins.

    Only bearings modulo 180 matter, so each distinct angle of a route is asked once and no segment
    is paired with a candidate.
    """
    highway = F.col("_tag_highway")
    angle = F.pmod(geo.way_bearing(F.col("geometry")), F.lit(180.0))
    angles = map_ways.select("route_id", "ord", "way_id", angle.alias("angle"), F.size("geometry").alias("nodes"),
                             *ways.pulled(F.col("tags")))
    cell = F.floor(F.floor("angle") / 30).cast("int").alias("cell")  # whole degrees first: exact at the edges
    # such ways are always segregated or shared use
    candidates = (
        angles.filter("nodes >= 2").filter((highway == "cycleway") | (highway.isin(*R.PARALLEL_PATHS)
                      & F.col("_tag_bicycle").isin("designated", "yes")))
        .join(segments.select("route_id", "way_id").distinct(), ["route_id", "way_id"], "left_anti")
        .select("route_id", "angle", (-F.col("ord")).alias("order"), ways.provision().alias("provision"))
        # copies of a bearing count once
        .groupBy("route_id", cell, "angle")
        .agg(F.max(F.struct(ways.provision_rank(F.col("provision")).alias("rank"), "order", "provision")).alias("best"))
    )
    # the first way of an id in the extract gives the segment's bearing
    first_angle = angles.groupBy("route_id", "way_id").agg(F.min_by("angle", "ord").alias("angle"))
    poor = F.col("provision").isin(*R.POOR_PROVISION) & ways.is_road(F.col("highway"))
    asked = segments.filter(poor).select("route_id", "way_id").distinct().join(first_angle, ["route_id", "way_id"])
    answers = _best_parallel(
        asked.filter("angle is not null").select("route_id", "angle", cell).distinct(), candidates)
    found = asked.join(answers, ["route_id", "angle"]).select("route_id", "way_id", "best")
    better = poor & (F.col("best.rank") > ways.provision_rank(F.col("provision")))
    return (
        segments.join(found, ["route_id", "way_id"], "left")
        .withColumn("original_provision", F.when(better, F.col("provision")).otherwise(F.col("original_provision")))
        .withColumn("provision", F.when(better, F.col("best.provision")).otherwise(F.col("provision")))
        .select(*segments.columns)
    )


# --- runs -------------------------------------------------------------------

def number_runs(segments: DataFrame) -> DataFrame:
    """Add ``run``: consecutive segments alike in all of the six properties share a number."""
    return ordered.islands(
        segments, ["route_id"], ["seq"], SEGMENT_KEY, lambda before, row: ~row.eqNullSafe(before),
        "run", ordered.seq_block("seq"), ordered.known(segments))


def merge_runs(segments: DataFrame, cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> DataFrame:
    """One row per run with summed distance, number of ways and score factors.

    Runs without any geometry are dropped.  Sums and minima only, so a hot route is combined
    before the shuffle; ``number_runs`` lists the members and ``merge_runs_nested`` gathers them.
    """
    return (
        number_runs(segments)
        .groupBy("route_id", "run")
        .agg(
            F.min("seq").alias("first_seq"),
            *[F.first(c).alias(c) for c in SEGMENT_KEY],
            F.sum("distance_m").alias("distance_m"),
            F.count("*").alias("ways"),
            F.sum(F.coalesce(F.size("geometry"), F.lit(0)).cast("long")).alias("points"),
        )
        .filter("points > 0")
        .withColumn("distance_m", round_half_even(F.col("distance_m"), 1))
        .withColumn("score_factors", ways.score_factors(
            F.col("provision"), F.col("speed_limit"), F.col("surface"), F.col("highway"), cfg))
    )


def merge_runs_nested(segments: DataFrame, cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> DataFrame:
    """Runs with their way ids, distinct names in first-seen order and joined geometry.

    A run is one output row here, as a map feature has to be.
    """
    members = F.array_sort(F.collect_list(F.struct("seq", "way_id", "name", "geometry")))
    return (
        number_runs(segments)
        .groupBy("route_id", "run")
        .agg(members.alias("members"), F.sum("distance_m").alias("distance_m"),
             *[F.first(c).alias(c) for c in SEGMENT_KEY])
        .select(
            "route_id", "run", F.col("members")[0]["seq"].alias("first_seq"), *SEGMENT_KEY,
            round_half_even(F.col("distance_m"), 1).alias("distance_m"),
            F.transform("members", lambda m: m["way_id"]).alias("way_ids"),
            F.array_distinct(F.filter(F.transform("members", lambda m: m["name"]),
                                      lambda n: F.coalesce(n, F.lit("")) != "")).alias("names"),
            F.flatten(F.filter(F.transform("members", lambda m: m["geometry"]),
                               lambda g: g.isNotNull())).alias("geometry"),
        )
        .filter(F.size("geometry") > 0)
        .withColumn("score_factors", ways.score_factors(
            F.col("provision"), F.col("speed_limit"), F.col("surface"), F.col("highway"), cfg))
    )


# --- transitions ------------------------------------------------------------

def _transitions(segments: DataFrame) -> DataFrame:
    cols = ["provision", "highway", "name", "speed_limit",
            F.try_element_at("geometry", F.lit(1)).alias("start")]
    return ordered.with_neighbours(segments, ["route_id"], ["seq"], cols, ordered.seq_block("seq"), ordered.known(segments))


def priority_routes(map_nodes: DataFrame) -> DataFrame:
    """Routes with a signalled or marked crossing among their nodes."""
    kind = F.try_element_at("tags", F.lit("crossing"))
    return map_nodes.filter(kind.isin(*R.PRIORITY_CROSSINGS)).select("route_id").distinct()


def _is_crossing() -> Column:
    """Does the segment and the next one change between an off-road path and a road?"""
    a_off, a_road = ways.is_off_road(F.col("provision")), ways.is_road(F.col("highway"))
    b_off, b_road = ways.is_off_road(F.col("next.provision")), ways.is_road(F.col("next.highway"))
    return F.coalesce(F.col("next").isNotNull() & ((a_off & b_road) | (a_road & b_off)), F.lit(False))


def _crossing_speed() -> Column:
    return F.when(ways.is_road(F.col("next.highway")), F.col("next.speed_limit")).otherwise(F.col("speed_limit"))


def _is_side_change() -> Column:
    return F.coalesce(ways.is_off_road(F.col("prev.provision")) & ways.is_road(F.col("highway"))
                      & ways.is_off_road(F.col("next.provision")), F.lit(False))


def non_priority_crossings(segments: DataFrame, map_nodes: DataFrame = None) -> DataFrame:
    """Where a route changes between an off-road path and a road without a priority crossing.

    One priority crossing anywhere on the route clears the whole route.
    """
    b_road = ways.is_road(F.col("next.highway"))
    here = F.try_element_at("geometry", F.lit(-1))
    spot = F.coalesce(F.when(F.size("geometry") > 0, here), F.col("next.start"))
    found = _transitions(segments).filter(_is_crossing()).select(
        "route_id", "seq",
        F.when(b_road, F.col("next.name")).otherwise(F.col("name")).alias("road_name"),
        _crossing_speed().alias("road_speed_limit"),
        F.try_element_at(spot, F.lit(2)).alias("lat"),
        F.try_element_at(spot, F.lit(1)).alias("lon"),
    )
    if map_nodes is None:
        return found
    return found.join(priority_routes(map_nodes), "route_id", "left_anti")


def side_changes(segments: DataFrame) -> DataFrame:
    """Road segments between two off-road ones."""
    return _transitions(segments).filter(_is_side_change()).select(
        "route_id", "seq", F.col("name").alias("road_name"))


def barrier_nodes(map_nodes: DataFrame) -> DataFrame:
    kind = F.try_element_at("tags", F.lit("barrier"))
    return map_nodes.filter(kind.isin(*R.BARRIERS)).select(
        "route_id", "ord", "node_id", kind.alias("barrier_type"),
        F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lon", F.lit(0.0)).alias("lon"))


def _islands(df: DataFrame, keys, axis: str, reach: Column, out: str, cell: float, long) -> DataFrame:
    """Number stretches of an axis more than ``reach`` (per row, a safe over-estimate of 5 m) apart."""
    return ordered.islands(
        df.withColumn("_reach", reach), keys, [axis, "ord"], [axis, "_reach"],
        lambda before, row: row[axis] - before[axis] > row["_reach"],
        out, F.floor(F.col(axis) / cell), long).drop("_reach")


def dedupe_barriers(barriers: DataFrame) -> DataFrame:
    """Keep a barrier unless an earlier kept one lies within 5 m, in extract order (ties: node, latitude, longitude).

    Copies of one spot go first (only the earliest can be kept).  The rest is cut into islands
    more than 5 m apart in latitude, then in longitude; islands cannot influence each other, so
    each is walked on its own and a hot route is spread over its islands.
    """
    long = ordered.long_keys(barriers, ["route_id"])  # spots are no more than barriers
    if long is None:
        barriers = barriers.repartition("route_id")  # spots and islands go by route
    spots = (
        barriers.groupBy("route_id", "lat", "lon")
        .agg(F.min(F.struct("ord", "node_id", "barrier_type")).alias("first"))
        .select("route_id", "lat", "lon", "first.*")
    )
    metre = 1 / 111_000  # degrees of latitude, rounded up
    rows = _islands(spots, ["route_id"], "lat", F.lit(6 * metre), "lat_island", 0.01, long)
    widest = F.when(F.abs("lat") < 89, 6 * metre / F.cos(F.radians("lat"))).otherwise(360.0)
    rows = _islands(rows, ["route_id", "lat_island"], "lon", 2 * widest, "lon_island", 0.01,
                    None if long is None else ordered.COUNTED)
    kept_schema = "route_id " + dict(barriers.dtypes)["route_id"] + (
        ", ord bigint, node_id bigint, barrier_type string, lat double, lon double")
    island = ["route_id", "lat_island", "lon_island"]
    return (
        rows.select(*island, F.col("ord").cast("long"), F.col("node_id").cast("long"), "barrier_type", "lat", "lon")
        .repartition(*island).sortWithinPartitions(*island, "ord", "node_id", "lat", "lon")
        .mapInPandas(_walk_islands, kept_schema)
    )


def _walk_islands(batches):
    """Greedy walk of each island in extract order, over a stream sorted by island.

    The last island of a batch may go on in the next one, so what was kept of it is remembered, in cells a little over
    5 m wide: a barrier is held against the kept ones of nine cells, which are few as they are 5 m apart.
    """
    import numpy as np

    step = (R.BARRIER_SPACING_M + 1) / R.EARTH_RADIUS_M

    @cache
    def width(strip):
        """Width in radians of a strip's cells, enough for barriers of the strips beside it; one cell near a pole."""
        outer = math.cos(min(math.pi / 2, step * max(abs(strip - 1), abs(strip + 2))))
        return 1.001 * step / outer if outer > 100 * step else 8 * math.pi

    def taken(p, q, cos, strip):
        for r in (strip, strip - 1, strip + 1):
            column = math.floor(q / width(r))
            for c in (column, column - 1, column + 1):
                for p2, q2, cos2 in cells.get((r, c), ()):
                    a = math.sin((p2 - p) / 2) ** 2 + cos * cos2 * math.sin((q2 - q) / 2) ** 2
                    if a <= beyond and 2 * R.EARTH_RADIUS_M * math.atan2(math.sqrt(a), math.sqrt(1 - a)) < R.BARRIER_SPACING_M:
                        return True
        return False

    at, cells, beyond = None, {}, step * step / 4
    for batch in batches:
        keys = zip(batch["route_id"], batch["lat_island"], batch["lon_island"])
        lat, lon = (np.radians(batch[c].to_numpy(float)).tolist() for c in ("lat", "lon"))
        keep = np.ones(len(batch), dtype=bool)
        for i, (key, p, q) in enumerate(zip(keys, lat, lon)):
            if key != at:
                at, cells = key, {}
                width.cache_clear()
            if not (math.isfinite(p) and math.isfinite(q)):
                continue  # near to nothing
            strip, cos = math.floor(p / step), math.cos(p)
            keep[i] = not taken(p, q, cos, strip)
            if keep[i]:
                cells.setdefault((strip, math.floor(q / width(strip))), []).append((p, q, cos))
        yield batch.loc[keep, ["route_id", "ord", "node_id", "barrier_type", "lat", "lon"]]


_COUNTS = ("barrier_count", "non_priority_crossing_count", "fast_crossing_count", "side_change_count",
           "parallel_upgrades")


def _transition_counts():
    crossing, fast = _is_crossing(), F.coalesce(_crossing_speed(), F.lit(30)) >= 30
    return [
        F.count_if(crossing).alias("non_priority_crossing_count"),
        F.count_if(crossing & fast).alias("fast_crossing_count"),
        F.count_if(_is_side_change()).alias("side_change_count"),
        F.count("original_provision").alias("parallel_upgrades"),
    ]


def _around(segments: DataFrame) -> DataFrame:
    """Segments with just what the counts need of their neighbours."""
    return ordered.with_neighbours(
        segments.drop("geometry"), ["route_id"], ["seq"], ["provision", "highway", "speed_limit"],
        ordered.seq_block("seq"), ordered.known(segments))


def _with_barriers(counts: DataFrame, barriers: DataFrame, map_nodes: DataFrame) -> DataFrame:
    """Add barrier counts, clear crossings of routes with a priority crossing, fill gaps with 0."""
    if barriers is not None:
        per = barriers.groupBy("route_id").agg(F.count("*").alias("barrier_count"))
        counts = counts.join(per, "route_id", "left")
    else:
        counts = counts.withColumn("barrier_count", F.lit(0).cast("long"))
    if map_nodes is not None:
        clear = priority_routes(map_nodes).withColumn("_clear", F.lit(True))
        counts = counts.join(clear, "route_id", "left")
        for c in ("non_priority_crossing_count", "fast_crossing_count"):
            counts = counts.withColumn(c, F.when(F.col("_clear"), 0).otherwise(F.col(c)))
        counts = counts.drop("_clear")
    return counts.fillna(0, list(_COUNTS)).withColumn(
        "directness_differential", F.when(F.col("parallel_upgrades") > 0, 1.0))


def transition_summary(routes: DataFrame, segments: DataFrame, barriers: DataFrame = None,
                       map_nodes: DataFrame = None) -> DataFrame:
    """Per route: barriers, crossings (all, fast), side changes, upgrades and the directness note.

    ``barriers`` are the deduplicated ones.  One pass over the segments with their neighbours.
    """
    per = _around(segments).groupBy("route_id").agg(*_transition_counts())
    return _with_barriers(routes.select("route_id").join(per, "route_id", "left"), barriers, map_nodes)


# --- scores -----------------------------------------------------------------

def summarise_provision(segments: DataFrame) -> DataFrame:
    """Metres per provision and their share of the route, in percent."""
    per = segments.groupBy("route_id", "provision").agg(F.sum("distance_m").alias("metres"))
    whole = F.sum("distance_m").over(Window.partitionBy("route_id"))  # five rows a route at most
    return (
        per.withColumn("distance_m", round_half_even(F.col("metres"), 1))
        .withColumn("share_pct", F.when(whole > 0, round_half_even(F.col("distance_m") / whole * 100, 0)))
        .drop("metres")
    )


def segment_factors(segments: DataFrame, cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> DataFrame:
    factors = ways.score_factors(F.col("provision"), F.col("speed_limit"), F.col("surface"), F.col("highway"), cfg)
    return segments.withColumn("_f", factors).select(*segments.columns, "_f.*")


def _steps(value: Column, steps, points: float, rest: float) -> Column:
    chain = None
    for upper, share in steps:
        hit, score = value <= upper, points * share
        chain = F.when(hit, score) if chain is None else chain.when(hit, score)
    return chain.otherwise(rest)


def _score_sums(cfg: R.ScoringConfig):
    """Conditional sums of metres per class: all a score needs of a route's segments."""
    d, speed = F.col("distance_m"), F.col("speed_limit")

    def metres(cond):
        return F.coalesce(F.sum(F.when(cond, d)), F.lit(0.0))

    exposed = F.col("provision").isin("none", "advisory_lane")
    kind = ways.surface_class(F.col("surface"))
    bands, lower = [], None
    for i, (upper, _) in enumerate(cfg.speed_steps):
        inside = exposed & (speed <= upper) & (F.lit(True) if lower is None else (speed > lower))
        bands.append(metres(inside).alias(f"_band{i}"))
        lower = upper
    return [
        F.count("*").alias("segment_count"),
        F.coalesce(F.sum(d), F.lit(0.0)).alias("_total"),
        metres(F.col("provision") == "segregated").alias("_segregated"),
        metres(F.col("provision") == "shared_use").alias("_shared"),
        metres(F.col("provision") == "on_road_lane").alias("_lane"),
        metres(exposed).alias("_exposed"),
        *bands,
        *[metres(kind == k).alias(f"_{k}") for k in ("good", "fair", "unknown", "poor")],
        F.count_if(ways.is_hostile(F.col("provision"), F.col("highway"), speed, cfg)).alias("hostile_junctions"),
    ]


def _score(df: DataFrame, with_transitions: bool, cfg: R.ScoringConfig) -> DataFrame:
    """Replace the sums of ``_score_sums`` by score, rating, breakdown and note."""
    total = F.coalesce("_total", F.lit(0.0))
    weighted = (F.col("_segregated") * cfg.segregated + F.col("_shared") * cfg.shared_use
                + F.col("_lane") * cfg.on_road_lane)
    segregation = F.when(total == 0, 0.0).otherwise(
        round_half_even(weighted / F.col("_total") * cfg.segregation_points, 1))
    slowed = reduce(lambda a, b: a + b, [F.col(f"_band{i}") * share for i, (_, share) in enumerate(cfg.speed_steps)])
    speed_score = F.when(F.coalesce("_exposed", F.lit(0.0)) == 0, float(cfg.speed_points)).otherwise(
        round_half_even(slowed / F.col("_exposed") * cfg.speed_points, 1))
    smooth = (F.col("_good") * cfg.surface_good + F.col("_fair") * cfg.surface_fair
              + F.col("_unknown") * cfg.surface_unknown + F.col("_poor") * cfg.surface_poor)
    surface_score = F.when(total == 0, 0.0).otherwise(
        round_half_even(smooth / F.col("_total") * cfg.surface_points, 1))
    ratio = F.col("cycling_distance_m") / F.nullif(F.col("shortest_distance_m").cast("double"), F.lit(0.0))
    directness = F.when(ratio.isNull(), cfg.directness_points / 2).otherwise(
        _steps(ratio, cfg.directness_steps, cfg.directness_points, cfg.directness_points * cfg.directness_rest))
    junctions = _steps(F.coalesce("hostile_junctions", F.lit(0)), cfg.junction_steps, cfg.junction_points, 0.0)
    neutral = F.lit(cfg.transition_points / 2)
    if not with_transitions:
        transition = neutral
    else:
        slow = F.col("non_priority_crossing_count") - F.col("fast_crossing_count")
        penalty = (F.col("barrier_count") * cfg.barrier_penalty
                   + F.col("fast_crossing_count") * cfg.fast_crossing_penalty
                   + slow * cfg.slow_crossing_penalty
                   + F.col("side_change_count") * cfg.side_change_penalty)
        known = F.greatest(F.lit(0.0), cfg.transition_points - penalty)
        missing = penalty.isNull()
        if "unavailable" in df.columns:
            missing = missing | F.coalesce("unavailable", F.lit(False))
        transition = F.when(missing, neutral).otherwise(round_half_even(known, 1))

    names = ("segregation", "speed_safety", "surface_quality", "directness", "junction_safety", "transition_quality")
    scores = (segregation, speed_score, surface_score, directness, junctions, transition)
    kept = [c for c in df.columns if not c.startswith("_") and c not in ("hostile_junctions", "segment_count")]
    df = df.select(*kept, *[s.cast("double").alias(f"_{n}") for n, s in zip(names, scores)],
                   *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hostile_junctions", "segment_count")])
    raw = reduce(lambda a, b: a + b, [F.col(f"_{n}") for n in names])
    return (
        df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), round_to_long(raw))))
        .withColumn("rating", F.when(F.col("score") >= cfg.green_from, "green")
                    .when(F.col("score") >= cfg.amber_from, "amber").otherwise("red"))
        .withColumn("breakdown", F.struct(*[round_half_even(F.col(f"_{n}"), 1).alias(n) for n in names]))
        .withColumn("short_route_note", F.when(F.col("cycling_distance_m") < cfg.short_route_m, R.SHORT_ROUTE_NOTE))
        .drop(*[f"_{n}" for n in names])
    )


def score_routes(segments: DataFrame, routes: DataFrame, transitions: DataFrame = None,
                 cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> DataFrame:
    """Score every route 0-100 with rating and breakdown.

    ``routes(route_id, cycling_distance_m, shortest_distance_m)``; ``transitions`` is the result of
    ``transition_summary`` (column ``unavailable`` optional).  Distances are summed per class and
    weighted afterwards: one pass of conditional sums, combined before the shuffle.
    """
    df = routes.join(segments.groupBy("route_id").agg(*_score_sums(cfg)), "route_id", "left")
    if transitions is not None:
        df = df.join(transitions, "route_id", "left")
    return _score(df, transitions is not None, cfg)


# --- issues -----------------------------------------------------------------

def identify_issues(segments: DataFrame) -> DataFrame:
    """At most four issues per (route, road name), each with its affected length.

    ``issue_order`` is the order of roads on the route, then of the kinds.
    """
    d, speed = F.col("distance_m"), F.col("speed_limit")
    bare = F.col("provision") == "none"
    kinds = {
        "high": bare & (speed >= 40),
        "medium": bare & (speed >= 30) & (speed < 40) & F.col("highway").isin(*R.MAIN_ROADS),
        "rough": F.lower("surface").isin(*R.ROUGH_SURFACES),
        "unlit": (F.col("lit") == False) & ways.is_off_road(F.col("provision")),  # noqa: E712
    }
    shown = F.struct("seq", "highway", "surface", "provision")
    aggs = [F.min("seq").alias("road_seq")]
    for name, cond in kinds.items():
        aggs += [F.sum(F.when(cond, d)).alias(f"{name}_m"),
                 F.max(F.when(cond, speed)).alias(f"{name}_speed"),
                 F.min(F.when(cond, shown)).alias(f"{name}_first")]
    roads = segments.groupBy("route_id", "name").agg(*aggs)

    def issue(kind, order, severity, problem, advice):
        length = round_to_long(F.col(f"{kind}_m")).cast("string")
        return F.when(F.col(f"{kind}_first").isNotNull(), F.struct(
            F.lit(order).alias("kind_order"), F.lit(severity).alias("severity"),
            F.concat("name", F.lit(" ("), length, F.lit("m)")).alias("location"),
            problem.alias("problem"), advice.alias("suggested_improvement")))

    def mph(kind):
        return F.col(f"{kind}_speed").cast("string")

    first = F.col
    issues = F.array_compact(F.array(
        issue("high", 1, "high", F.concat(
            mph("high"), F.lit("mph speed limit with no cycle provision on "), first("high_first.highway"),
            F.lit(" road")), F.lit(R.ADVICE_HIGH)),
        issue("medium", 2, "medium", F.concat(
            mph("medium"), F.lit("mph "), first("medium_first.highway"), F.lit(" road with no cycle provision")),
            F.format_string(R.ADVICE_MEDIUM, first("medium_first.highway"))),
        issue("rough", 3, "medium", F.concat(
            F.lit("Poor surface ("), first("rough_first.surface"), F.lit(") on "),
            F.when(first("rough_first.provision") == "shared_use", "shared-use path")
            .otherwise(first("rough_first.highway"))), F.lit(R.ADVICE_SURFACE)),
        issue("unlit", 4, "low", F.concat(
            F.lit("Unlit "), F.translate(first("unlit_first.provision"), "_", " "), F.lit(" path")),
            F.lit(R.ADVICE_LIGHTING)),
    ))
    return roads.select("route_id", "road_seq", F.explode(issues).alias("i")).select(
        "route_id", "road_seq", "i.*")


def funding_suggestions(issues: DataFrame, cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> DataFrame:
    """A suggestion for every high or medium issue."""
    reason = F.concat(
        F.lit("Addresses identified deficiency: "), "problem",
        F.lit(". S106 contribution towards off-site cycling infrastructure improvements is justified under "
              + cfg.policy_basis + "."))
    return issues.filter(F.col("severity").isin("high", "medium")).select(
        "route_id", "road_seq", "kind_order", F.col("location").alias("issue_location"),
        F.col("suggested_improvement").alias("improvement"), reason.alias("justification"), "severity")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).otherwise(3)


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("route_id").agg(*[
        F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("high", "medium", "low")])


def top_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` by severity, then in order of appearance (the limit is applied before the shuffle)."""
    w = Window.partitionBy("route_id").orderBy(severity_rank(F.col("severity")), "road_seq", "kind_order")
    return issues.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# --- polylines and places ---------------------------------------------------

def sample_points(points: DataFrame) -> DataFrame:
    """Every (n div 50)-th point of each route and the last one if its place is not among them.

    ``points(route_id, idx, lat, lon)`` with ``idx`` counting from 0.  Rows are filtered in place;
    only a count per route and the last point of each route are shuffled.
    """
    sizes = points.groupBy("route_id").agg(
        F.count("*").alias("n"), F.max_by(F.struct("idx", "lat", "lon"), "idx").alias("last"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / R.SAMPLE_POINTS))
    picked = points.join(sizes.select("route_id", "n"), "route_id").filter(F.col("idx") % step == 0).drop("n")
    last = sizes.select("route_id", "last.*").join(picked, ["route_id", "lat", "lon"], "left_anti")
    columns = ["route_id", "idx", "lat", "lon"]
    return picked.select(*columns).unionByName(last.select(*columns))


def decode_shapes(routes: DataFrame, precision: int = 6) -> DataFrame:
    """Add ``points``: the encoded ``shape`` as an array of [lon, lat]; empty without a shape."""
    import pyarrow as pa

    @F.arrow_udf("array<array<double>>")
    def decode(shapes: pa.Array) -> pa.Array:
        return _decode(shapes.to_pylist(), 10.0**precision)

    return routes.withColumn("points", decode("shape"))


def _decode(shapes, factor):
    """Undo the delta encoding of a whole batch: 5-bit groups, low group first, sign in the lowest bit."""
    import numpy as np
    import pyarrow as pa

    digits = np.frombuffer("".join(s or "" for s in shapes).encode("ascii"), dtype=np.uint8).astype(np.int64) - 63
    ends = np.flatnonzero(digits < 32)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if len(ends) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(digits)) - np.repeat(starts, ends + 1 - starts)
    values = np.add.reduceat((digits & 31) << (5 * place), starts) if len(starts) else starts
    totals = np.stack([np.where(values & 1, ~(values >> 1), values >> 1)[k::2] for k in (1, 0)], axis=1).cumsum(axis=0)
    # points per shape: its share of the numbers, halved; sums start afresh with every shape
    edges = np.concatenate(([0], np.cumsum([len(s or "") for s in shapes])))
    bounds = np.searchsorted(ends, edges) // 2
    before = np.concatenate((np.zeros((1, 2), dtype=totals.dtype), totals))[bounds[:-1]]
    points = (totals - np.repeat(before, np.diff(bounds), axis=0)) / factor
    pairs = pa.ListArray.from_arrays(
        pa.array(np.arange(len(points) + 1) * 2, pa.int32()), pa.array(points.reshape(-1), pa.float64()))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)


def route_points(decoded: DataFrame) -> DataFrame:
    return decoded.select("route_id", F.posexplode("points").alias("idx", "p")).select(
        "route_id", "idx", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def _cell(lat: Column, lon: Column, size: float):
    return F.floor(lat / size), F.floor(lon / size)


def near_route(things: DataFrame, points: DataFrame, reach_m: float, key: str = "node_id") -> DataFrame:
    """Things (route_id, lat, lon, ...) within ``reach_m`` of any of the route's points.

    ``points(route_id, lat, lon)``: all points of a route; pass those of ``sample_points`` to look near samples only.
    Both sides meet on 0.002-degree cells; a point is entered in every cell its reach can touch, which are more
    columns towards the poles.
    """
    size = 0.002
    metres = 111_000 * size
    wide = F.ceil(reach_m / (metres * F.greatest(F.cos(F.radians("lat")), F.lit(1e-4)))).cast("int")
    high = -int(-reach_m // metres)
    row, col = _cell(F.col("lat"), F.col("lon"), size)
    spread = (
        points.select("route_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"),
                      row.alias("row0"), col.alias("col0"), wide.alias("wide"))
        .withColumn("up", F.explode(F.sequence(F.lit(-high), F.lit(high))))
        .withColumn("right", F.explode(F.sequence(-F.col("wide"), F.col("wide"))))
        .select("route_id", "plat", "plon", (F.col("row0") + F.col("up")).alias("row"),
                (F.col("col0") + F.col("right")).alias("col"))
    )
    near = geo.haversine_m(F.col("t.lat"), F.col("t.lon"), F.col("p.plat"), F.col("p.plon")) <= reach_m
    left = things.withColumn("_row", row).withColumn("_col", col).alias("t")
    return left.join(
        spread.alias("p"),
        (F.col("t.route_id") == F.col("p.route_id")) & (F.col("t._row") == F.col("p.row"))
        & (F.col("t._col") == F.col("p.col")) & near, "left_semi",
    ).drop("_row", "_col")


def on_route_barriers(barriers: DataFrame, route_ways: DataFrame, points: DataFrame) -> DataFrame:
    """Barrier nodes of a route: those on its ways where they are known, else near its points.

    ``barriers(route_id, node_id, way_id, lat, lon)``; ``route_ways(route_id, way_id)``.
    """
    known = route_ways.select("route_id").distinct()
    on_ways = barriers.join(route_ways, ["route_id", "way_id"], "left_semi")
    rest = barriers.join(known, "route_id", "left_anti")
    return on_ways.unionByName(near_route(rest, points, R.BARRIER_REACH_M))


def site_destinations(sites: DataFrame, destinations: DataFrame, ids=None) -> DataFrame:
    """Every site with every chosen destination: no ids means all, an empty list none."""
    if ids is not None:
        destinations = destinations.filter(F.col("destination_id").isin(*ids) if ids else F.lit(False))
    return every_pair(sites, destinations, "destination_id")


def list_destinations(destinations: DataFrame) -> DataFrame:
    return destinations.orderBy("destination_id")


def next_destination_id(destinations: DataFrame) -> DataFrame:
    """``dest_`` and the highest number plus one, three digits at least."""
    number = F.regexp_extract("destination_id", r"^dest_([+-]?\d+)(?:_|\z)", 1).try_cast("int")
    top = F.coalesce(F.greatest(F.max(number), F.lit(0)), F.lit(0)) + 1
    text = top.cast("string")
    return destinations.agg(
        F.concat(F.lit("dest_"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0"))).alias("next_id"))


# --- whole routes -----------------------------------------------------------

def route_assessment(routes: DataFrame, segments: DataFrame, map_ways: DataFrame = None,
                     map_nodes: DataFrame = None, cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> DataFrame:
    """One row per route: rounded lengths, score, issue counts, transitions, same-route flag.

    ``routes(route_id, cycling_distance_m, duration_s, shortest_distance_m)``.  A route without
    segments gets score 0, rating red and no issues.

    Everything counted on segments comes from one aggregation per route (over segments with their
    neighbours); only issues, which are per road name, need a second one.
    """
    if map_ways is not None:
        segments = upgrade_parallel(segments, map_ways)
    per_route = _around(segments).groupBy("route_id").agg(*_score_sums(cfg), *_transition_counts())
    barriers = None if map_nodes is None else dedupe_barriers(barrier_nodes(map_nodes))
    facts = _with_barriers(routes.join(per_route, "route_id", "left"), barriers, map_nodes)
    issues = severity_counts(identify_issues(segments))
    ride, short = F.col("cycling_distance_m"), F.col("shortest_distance_m")
    held = F.col("segment_count") > 0
    return (
        _score(facts, True, cfg).join(issues, "route_id", "left")
        .fillna(0, ["high_count", "medium_count", "low_count"])
        .withColumn("distance_m", round_to_long(ride))
        .withColumn("duration_minutes", round_half_even(F.col("duration_s") / 60, 1))
        .withColumn("shortest_route_distance_m", round_to_long(short))
        .withColumn("same_route", F.abs(short - ride) / F.greatest(short, F.lit(1.0)) < 0.01)
        .withColumn("score", F.when(held, F.col("score")).otherwise(0))
        .withColumn("rating", F.when(held, F.col("rating")).otherwise("red"))
        .withColumn("breakdown", F.when(held, F.col("breakdown")))
    )


def pick_routes(shortest: DataFrame, safest: DataFrame) -> DataFrame:
    """Pair the two routings of a trip; a missing one is replaced by the other.

    Both have ``(route_id, length_km, time_s, shape)``; the safest is the one assessed.
    """
    s, f = shortest.alias("s"), safest.alias("f")
    pair = s.join(f, "route_id", "full_outer")

    def pick(first, second, col):
        return F.coalesce(F.col(f"{first}.{col}"), F.col(f"{second}.{col}"))

    return pair.select(
        "route_id",
        (pick("f", "s", "length_km") * 1000).alias("cycling_distance_m"),
        pick("f", "s", "time_s").alias("duration_s"),
        pick("f", "s", "shape").alias("shape"),
        (pick("s", "f", "length_km") * 1000).alias("shortest_distance_m"),
        pick("s", "f", "shape").alias("shortest_shape"),
    )


def route_narrative(assessed: DataFrame, by: str = "application_ref") -> DataFrame:
    """Per application the list of destinations with shortest and safest summary.

    Without a shortest routing the safest stands for both, so that the route is the same.
    """
    same = F.coalesce("same_route", F.when(F.col("shortest_route_distance_m").isNull(), True))
    entry = F.struct(
        F.col("destination").alias("destination_name"),
        F.struct(F.coalesce("shortest_route_distance_m", "distance_m").alias("distance_m"),
                 F.when(same, F.col("score")).alias("ltn_score"),
                 F.when(same, F.col("rating")).alias("rating")).alias("shortest_route_summary"),
        F.struct("distance_m", F.col("score").alias("ltn_score"), "rating").alias("safest_route_summary"),
        same.alias("same_route"),
    )
    return assessed.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("destinations"))
