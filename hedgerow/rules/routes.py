"""Tables and weights for map ways, route segments and route scores."""

from dataclasses import dataclass

# --- fixed values: default speed limit (mph) by kind of highway -------------
DEFAULT_SPEEDS = {
    "motorway": 70,
    "trunk": 60,
    "primary": 60,
    "secondary": 60,
    "tertiary": 30,
    "unclassified": 30,
    "residential": 30,
    "living_street": 20,
    "service": 20,
    "cycleway": 0,
    "path": 0,
    "footway": 0,
    "bridleway": 0,
    "track": 0,
    "pedestrian": 0,
}
OTHER_SPEED = 30

# --- fixed values: kinds of highway, barrier, crossing, surface -------------
NOT_ROUTABLE = ("proposed", "construction", "abandoned", "razed", "platform")
ROAD_HIGHWAYS = (
    "residential", "tertiary", "secondary", "primary",
    "trunk", "unclassified", "living_street", "service",
)
MAIN_ROADS = ("primary", "secondary", "tertiary", "trunk")
PATH_HIGHWAYS = ("path", "footway", "bridleway")
PARALLEL_PATHS = ("path", "footway")
CYCLEWAY_TAGS = ("cycleway", "cycleway:left", "cycleway:right", "cycleway:both")
OFF_ROAD = ("segregated", "shared_use")
POOR_PROVISION = ("none", "advisory_lane", "on_road_lane")
PROVISION_RANK = {
    "segregated": 4, "shared_use": 3, "on_road_lane": 2, "advisory_lane": 1, "none": 0,
}
BARRIERS = ("cycle_barrier", "bollard", "gate", "stile", "lift_gate")
PRIORITY_CROSSINGS = ("traffic_signals", "marked")
GOOD_SURFACES = ("asphalt", "paved", "concrete", "concrete:plates", "paving_stones")
FAIR_SURFACES = ("compacted", "fine_gravel")
ROUGH_SURFACES = ("gravel", "dirt", "grass", "mud", "sand", "ground")

# --- fixed values: geometry -------------------------------------------------
EARTH_RADIUS_M = 6_371_000
BARRIER_SPACING_M = 5.0
BARRIER_REACH_M = 15
CROSSING_REACH_M = 20
SAMPLE_POINTS = 50
SITE_ATTRIBUTE_PREFIXES = (
    "DLGSDST.dbo.Planning_ArcGIS_Link_Public.",
    "CORPGIS.MASTERGOV.DEF_Planning.",
)
LARGE_SITE_SQM = 100_000
CENTROID_NOTE = "Geometric centre of site boundary; actual entrance may differ"
LARGE_SITE_NOTE = "Approximate origin; actual access point may vary significantly for this large site"
SHORT_ROUTE_NOTE = "Short distance; walking may be preferable"

# --- fixed values: wording of issues ----------------------------------------
ADVICE_HIGH = (
    "Segregated cycleway required — LTN 1/20 Table 4-1 states that speeds above 30mph "
    "require physical separation from motor traffic"
)
ADVICE_MEDIUM = (
    "On-road cycle lane or segregated cycleway — LTN 1/20 recommends protection on roads "
    "classified %s with speeds at 30mph"
)
ADVICE_SURFACE = (
    "Resurface to sealed tarmac/asphalt — LTN 1/20 para 5.5 requires smooth, sealed surfaces "
    "for cycling infrastructure"
)
ADVICE_LIGHTING = (
    "Install lighting — LTN 1/20 para 10.5 states cycle routes should be lit where they form "
    "part of the highway or run through areas of public open space"
)

# --- fixed values: destinations every table starts with ---------------------
DEFAULT_DESTINATIONS = (
    ("dest_001", "Bicester North Station", 51.9054, -1.1512, "rail"),
    ("dest_002", "Bicester Village Station", 51.8899, -1.1467, "rail"),
    ("dest_003", "Manorsfield Road (Pioneer Bus S5)", 51.8936, -1.1538, "bus"),
)


@dataclass(frozen=True)
class ScoringConfig:
    """Points, weights and thresholds of the 0-100 route score."""

    segregation_points: float = 36
    speed_points: float = 23
    surface_points: float = 13
    directness_points: float = 9
    junction_points: float = 9
    transition_points: float = 10
    green_from: int = 70
    amber_from: int = 40
    short_route_m: float = 200
    # share of the points by provision
    segregated: float = 1.0
    shared_use: float = 0.7
    on_road_lane: float = 0.4
    # (upper speed, share of the points); faster gets nothing
    speed_steps: tuple = ((20, 1.0), (30, 0.6), (40, 0.2))
    surface_good: float = 1.0
    surface_fair: float = 0.6
    surface_unknown: float = 0.5
    surface_poor: float = 0.2
    # (upper ratio to the shortest route, share); longer gets the last share
    directness_steps: tuple = ((1.1, 1.0), (1.3, 0.7), (1.5, 0.4))
    directness_rest: float = 0.1
    hostile_speed: int = 30
    junction_steps: tuple = ((0, 1.0), (2, 0.6), (5, 0.3))
    barrier_penalty: float = 2.0
    fast_crossing_penalty: float = 1.5
    slow_crossing_penalty: float = 0.5
    side_change_penalty: float = 1.0
    # the policies a contribution is asked under; name the adopted local plan here
    policy_basis: str = "Local Plan Policy INF1 and NPPF paragraph 116"


DEFAULT_SCORING = ScoringConfig()
