"""Formats and states of policies and their revisions."""

# --- fixed values -----------------------------------------------------------
SLUG_PATTERN = r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"
REFERENCE_PATTERN = r"^\d{2}/\d{4,5}/[A-Z]{1,4}$"
CATEGORIES = (
    "national_policy", "national_guidance", "local_plan",
    "local_guidance", "county_strategy", "supplementary",
)
IN_FORCE_STATUSES = ("active", "superseded")
OPEN_END = 99991231
