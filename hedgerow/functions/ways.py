"""What the tags of a map way say about cycling on it, and the score factors of a segment."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.rules import routes as R


def tag(tags: Column, name: str, missing: str = "") -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(missing))


USED_TAGS = ("highway", "bicycle", "foot", "designation", *R.CYCLEWAY_TAGS, "maxspeed", "surface", "lit", "name")


def pulled(tags: Column):
    """The tags the functions below read, as columns ``_tag_<name>``: each is looked up once."""
    return [F.try_element_at(tags, F.lit(t)).alias(f"_tag_{t}") for t in USED_TAGS]


def _held(name: str, missing: str = "") -> Column:
    return F.coalesce(F.col(f"`_tag_{name}`"), F.lit(missing))


def provision() -> Column:
    """Provision from pulled tags: paths by who may use them, roads by their lanes."""
    highway = F.col("_tag_highway")
    for_bikes, for_feet = (_held(t).isin("designated", "yes") for t in ("bicycle", "foot"))
    on_path = highway.isin(*R.PATH_HIGHWAYS)

    def any_lane(*kinds):
        return reduce(lambda a, b: a | b, [_held(t).isin(*kinds) for t in R.CYCLEWAY_TAGS])

    return (
        F.when(highway == "cycleway", "segregated")
        .when(on_path & for_bikes & for_feet, "shared_use")
        .when(on_path & for_bikes, "segregated")
        .when(on_path & F.lower(_held("designation")).contains("shared"), "shared_use")
        .when(on_path, "none")
        .when(any_lane("track", "separate"), "segregated")
        .when(any_lane("lane"), "on_road_lane")
        .when(any_lane("shared_lane", "share_busway"), "advisory_lane")
        .otherwise("none")
    )


def speed_limit() -> Column:
    """First word of maxspeed as a whole number, else the usual limit of that kind of highway."""
    posted = F.regexp_extract(_held("maxspeed"), r"^\s*([+-]?\d+)(?:\s|\z)", 1).try_cast("int")
    usual = reduce(lambda c, kv: c.when(F.col("_tag_highway") == kv[0], kv[1]), R.DEFAULT_SPEEDS.items(), F)
    return F.coalesce(posted, usual.otherwise(R.OTHER_SPEED))


def surface() -> Column:
    return _held("surface", "unknown")


def lit() -> Column:
    value = F.col("_tag_lit")
    return F.when(value == "yes", True).when(value == "no", False)


def name() -> Column:
    return _held("name", "Unnamed")


def highway() -> Column:
    return _held("highway", "unknown")


# --- segments ---------------------------------------------------------------

def is_off_road(provision: Column) -> Column:
    return provision.isin(*R.OFF_ROAD)


def is_road(highway: Column) -> Column:
    return highway.isin(*R.ROAD_HIGHWAYS)


def provision_rank(provision: Column) -> Column:
    return reduce(lambda c, kv: c.when(provision == kv[0], kv[1]), R.PROVISION_RANK.items(), F).otherwise(0)


def speed_factor(speed: Column, cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> Column:
    chain = None
    for upper, share in cfg.speed_steps:
        hit = speed <= upper
        chain = F.when(hit, share) if chain is None else chain.when(hit, share)
    return chain.otherwise(0.0)


def surface_class(surface_: Column) -> Column:
    name = F.lower(surface_)
    return (F.when(name.isin(*R.GOOD_SURFACES), "good").when(name.isin(*R.FAIR_SURFACES), "fair")
            .when(name == "unknown", "unknown").otherwise("poor"))


def is_hostile(provision: Column, highway: Column, speed: Column,
               cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> Column:
    return (provision == "none") & highway.isin(*R.MAIN_ROADS) & (speed >= cfg.hostile_speed)


def score_factors(provision: Column, speed: Column, surface_: Column, highway: Column,
                  cfg: R.ScoringConfig = R.DEFAULT_SCORING) -> Column:
    kind = surface_class(surface_)
    return F.struct(
        F.when(provision == "segregated", cfg.segregated)
        .when(provision == "shared_use", cfg.shared_use)
        .when(provision == "on_road_lane", cfg.on_road_lane)
        .otherwise(0.0).alias("segregation"),
        F.when(provision.isin("none", "advisory_lane"), speed_factor(speed, cfg)).alias("speed_safety"),
        F.when(kind == "good", cfg.surface_good).when(kind == "fair", cfg.surface_fair)
        .when(kind == "unknown", cfg.surface_unknown).otherwise(cfg.surface_poor)
        .alias("surface_quality"),
        is_hostile(provision, highway, speed, cfg).alias("hostile_junction"),
    )
