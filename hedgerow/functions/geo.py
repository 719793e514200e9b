"""Distances, bearings and centres as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.rules import routes as R


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * R.EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def way_length_m(geometry: Column) -> Column:
    """Summed leg lengths of an array of (lat, lon) points; 0 for fewer than two, null where a coordinate is.

    Arrow batches instead of array lambdas, which would keep the whole projection around them out of code generation.
    """
    import pyarrow as pa

    @F.arrow_udf("double")
    def lengths(shapes: pa.Array) -> pa.Array:
        return _lengths(shapes)

    return lengths(geometry)


def _lengths(shapes):
    """Legs of a batch of ways as one array of points; each way's legs are added up in order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    counts = pc.list_value_length(shapes).fill_null(0).to_numpy(zero_copy_only=False)
    points = shapes.flatten()
    lat, lon = (np.radians(pc.struct_field(points, n).cast(pa.float64()).to_numpy(zero_copy_only=False)) for n in ("lat", "lon"))
    way = np.repeat(np.arange(len(counts)), counts)
    inside = way[1:] == way[:-1]
    half_lat, half_lon = (np.sin((x[1:] - x[:-1])[inside] / 2) for x in (lat, lon))
    a = half_lat * half_lat + (np.cos(lat[:-1]) * np.cos(lat[1:]))[inside] * half_lon * half_lon
    legs = 2.0 * R.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))
    return pa.array(np.bincount(way[1:][inside], legs, len(counts)).astype(float), from_pandas=True)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Compass bearing 0-360 from the first point to the second."""
    lat1, lat2, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    x = F.sin(turn) * F.cos(lat2)
    y = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def way_bearing(geometry: Column) -> Column:
    """Bearing from first to last point; null for fewer than two points."""
    first, last = F.try_element_at(geometry, F.lit(1)), F.try_element_at(geometry, F.lit(-1))
    return F.when(F.size(geometry) >= 2, bearing(first["lat"], first["lon"], last["lat"], last["lon"]))


def bearing_difference(a: Column, b: Column) -> Column:
    """0-90 degrees; opposite directions are parallel."""
    turn = F.pmod(F.abs(a - b), F.lit(360.0))
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    return F.when(turn > 90, 180 - turn).otherwise(turn)


def ring_centroid(ring: Column) -> Column:
    """Mean vertex of an array of [lon, lat]; the point that closes the ring counts once."""
    size = F.size(ring)
    closed = (size > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    points = F.when(closed, F.slice(ring, F.lit(1), F.greatest(size - 1, F.lit(0)))).otherwise(ring)

    def mean(axis):
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)

    empty = F.coalesce(size, F.lit(0)) <= 0
    return F.struct(
        F.when(empty, 0.0).otherwise(mean(0)).alias("lon"),
        F.when(empty, 0.0).otherwise(mean(1)).alias("lat"),
    )


def site_attribute(attributes: Column, name: str) -> Column:
    """Value under the first of the known prefixes, then under the bare name."""
    keys = [prefix + name for prefix in R.SITE_ATTRIBUTE_PREFIXES] + [name]
    chain = None
    for key in keys[:-1]:
        held = F.map_contains_key(attributes, F.lit(key))
        value = F.try_element_at(attributes, F.lit(key))
        chain = F.when(held, value) if chain is None else chain.when(held, value)
    return chain.otherwise(F.try_element_at(attributes, F.lit(keys[-1])))
