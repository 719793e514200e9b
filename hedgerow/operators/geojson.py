"""GeoJSON text: one feature per row, gathered to a collection per route only at the end."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.functions import geo
from hedgerow.functions.numbers import round_half_even, round_to_long
from hedgerow.rules import routes as R

_KEEP_NULLS = {"ignoreNullFields": "false"}


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    """GeoJSON text of one feature; null coordinates give a null geometry."""
    geometry = F.when(coordinates.isNotNull(), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              properties.alias("properties")), _KEEP_NULLS)


def collections(features: DataFrame, by="route_id", order="seq") -> DataFrame:
    """Features (by, order, feature) -> one FeatureCollection text per route."""
    listed = F.array_sort(F.collect_list(F.struct(order, "feature")))
    return features.groupBy(by).agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.array_join(F.transform(listed, lambda x: x["feature"]), ","), F.lit("]}")).alias("geojson"))


def _with_original(kind, coordinates, columns) -> Column:
    plain = feature(kind, coordinates, F.struct(*columns))
    marked = feature(kind, coordinates, F.struct(*columns, F.col("original_provision")))
    return F.when(F.col("original_provision").isNull(), plain).otherwise(marked)


def segment_features(segments: DataFrame) -> DataFrame:
    columns = [F.col(c) for c in ("way_id", "provision", "highway", "speed_limit", "surface", "lit")] + [
        round_half_even(F.col("distance_m"), 1).alias("distance_m"), F.col("name")]
    return segments.select("route_id", "seq", _with_original("LineString", F.col("geometry"), columns).alias("feature"))


def run_features(runs: DataFrame) -> DataFrame:
    """Features of ``merge_runs_nested``."""
    columns = [F.col(c) for c in ("provision", "speed_limit", "surface", "lit", "highway", "distance_m",
                                  "names", "way_ids", "score_factors")]
    return runs.select("route_id", F.col("first_seq").alias("seq"),
                       _with_original("LineString", F.col("geometry"), columns).alias("feature"))


def route_features(routes: DataFrame) -> DataFrame:
    """The line of each route; fewer than two points give a null geometry."""
    line = F.when(F.size("points") >= 2, F.col("points"))
    facts = F.struct(round_to_long(F.col("distance_m")).alias("distance_m"),
                     round_half_even(F.col("duration_s") / 60, 1).alias("duration_minutes"))
    return routes.select("route_id", F.lit(0).alias("seq"), feature("LineString", line, facts).alias("feature"))


def crossing_features(crossings: DataFrame) -> DataFrame:
    """Crossings without a place are left out."""
    facts = F.struct(F.coalesce("road_name", F.lit("Unknown")).alias("road_name"),
                     F.coalesce("road_speed_limit", F.lit(30)).alias("road_speed_limit"))
    return crossings.filter("lat is not null and lon is not null").select(
        "route_id", "seq", feature("Point", F.array("lon", "lat"), facts).alias("feature"))


def barrier_features(barriers: DataFrame) -> DataFrame:
    facts = F.struct(F.coalesce("barrier_type", F.lit("unknown")).alias("barrier_type"),
                     F.coalesce("node_id", F.lit(0)).alias("node_id"))
    return barriers.select("route_id", F.col("ord").alias("seq"),
                           feature("Point", F.array("lon", "lat"), facts).alias("feature"))


def site_facts(sites: DataFrame) -> DataFrame:
    """Reference, address, area, centre and accuracy note of each site (attributes, rings)."""
    attributes = F.col("attributes")

    def held(name):
        value = geo.site_attribute(attributes, name)
        return F.when(value != "", value)

    area = F.try_element_at(attributes, F.lit("SHAPE.STArea()")).try_cast("double")
    ring = F.coalesce(F.try_element_at("rings", F.lit(1)), F.array().cast("array<array<double>>"))
    address = F.coalesce(held("location"), F.lit(""))
    return sites.select(
        "*",
        F.coalesce(held("application_number"), held("APPLICATION_REF"), F.lit("unknown")).alias("application_ref"),
        F.trim(F.replace(address, F.lit("\r\n"), F.lit(", "))).alias("address"),
        F.when(area != 0, round_half_even(area, 1)).alias("area_sqm"),
        geo.ring_centroid(ring).alias("centroid"),
        F.when(area > R.LARGE_SITE_SQM, R.LARGE_SITE_NOTE).otherwise(R.CENTROID_NOTE).alias("centroid_note"),
    )


def site_collections(sites: DataFrame) -> DataFrame:
    """Boundary and centre of each site as one FeatureCollection."""
    facts = site_facts(sites)
    shared = [F.col("application_ref"), F.col("address"), F.col("area_sqm")]
    boundary = feature("Polygon", F.col("rings"), F.struct(*shared, F.lit("site_boundary").alias("feature_type")))
    centre = feature("Point", F.array("centroid.lon", "centroid.lat"), F.struct(
        *shared, F.lit("centroid").alias("feature_type"), F.col("centroid_note")))
    return facts.withColumn("geojson", F.concat(
        F.lit('{"type":"FeatureCollection","features":['), boundary, F.lit(","), centre, F.lit("]}")))
