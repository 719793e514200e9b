"""Words, codes and weights for review results, jobs and progress."""

# --- fixed values: ratings and categories -----------------------------------
RATINGS = ("red", "amber", "green")
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
CATEGORIES = ("Transport & Access", "Design & Layout", "Application Core")
CATEGORY_WORDS = (
    ("Transport & Access", ("transport", "travel", "route", "highway", "parking", "traffic")),
    ("Design & Layout", ("design", "layout", "landscape", "elevation", "plan")),
)

# --- fixed values: rating read from a written report ------------------------
RED_MARKS = ("overall rating:** red", "overall rating:** 🔴")
GREEN_MARKS = ("overall rating:** green", "overall rating:** 🟢")

# --- fixed values: evidence caps and texts ----------------------------------
EVIDENCE_JOINER = "\n\n---\n\n"
NO_APPLICATION_EVIDENCE = "No application document content retrieved."
NO_POLICY_EVIDENCE = "No policy content retrieved."
UNKNOWN_DOCUMENT = "(unknown document)"

# --- fixed values: weight of each phase, adding up to 100 -------------------
PHASE_WEIGHTS = {
    "fetching_metadata": 5,
    "filtering_documents": 5,
    "downloading_documents": 15,
    "ingesting_documents": 22,
    "analysing_application": 20,
    "assessing_routes": 8,
    "generating_review": 15,
    "verifying_review": 10,
}

# --- fixed values: job states and limits ------------------------------------
ACTIVE_STATUSES = ("queued", "processing")
RESULT_TTL_DAYS = 30
PAGE_SIZE = 20
REQUEST_LIMIT = 60
REQUEST_WINDOW_S = 60
