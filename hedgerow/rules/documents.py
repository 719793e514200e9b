"""Word lists and patterns for filtering and classifying listed documents.

Everything in this file is a fixed value: results are only right when these
texts are exactly as given.
"""

# --- fixed values: portal categories (whole-string, lower case) -------------
CATEGORY_ALLOWED = (
    "application forms",
    "supporting documents",
    "site plans",
    "proposed plans",
    "officer/committee consideration",
    "decision and legal agreements",
    "planning application documents",
)
CATEGORY_CONSULTATION = ("consultation responses", "consultee responses")
CATEGORY_PUBLIC = ("public comments",)
SUPERSEDED_WORD = "superseded"

# --- fixed values: substrings looked for in category and title --------------
CONSULTATION_PHRASES = ("consultation response", "consultee response", "statutory consultee")
PUBLIC_PHRASES = (
    "public comment",
    "comment from",
    "objection",
    "representation from",
    "letter from resident",
    "letter from neighbour",
    "letter of objection",
    "letter of support",
    "petition",
)
CORE_PHRASES = (
    "planning statement",
    "design and access",
    "design & access",
    "application form",
    "proposed plan",
    "proposed drawing",
    "site plan",
    "location plan",
    "block plan",
    "elevation",
    "floor plan",
    "section",
)
ASSESSMENT_PHRASES = (
    "transport assessment",
    "transport statement",
    "travel plan",
    "highway",
    "parking",
)
OFFICER_PHRASES = (
    "officer report",
    "officer's report",
    "planning officer",
    "case officer",
    "committee report",
    "delegated report",
    "decision notice",
    "decision letter",
    "planning condition",
    "conditions document",
    "approval notice",
    "refusal notice",
    "s106",
    "section 106",
    "legal agreement",
)
NON_TRANSPORT_PHRASES = (
    "ecology",
    "ecological",
    "biodiversity",
    "arboricultural",
    "tree survey",
    "heritage statement",
    "heritage impact",
    "archaeological",
    "flood risk",
    "drainage",
    "noise",
    "acoustic",
    "air quality",
    "energy statement",
    "sustainability",
    "landscape",
    "visual impact",
    "ground condition",
    "contamination",
    "geotechnical",
)

# --- fixed values: reasons written next to each decision --------------------
REASON_EMPTY = "No document type - allowed by default (fail-safe)"
REASON_SUPERSEDED = "Superseded document - excluded from review"
REASON_CATEGORY_PREFIX = "Portal category: "
REASON_CATEGORY_CONSULTATION = "Portal category: consultation responses - not included in review scope"
REASON_CATEGORY_PUBLIC = "Portal category: public comments - not relevant for policy review"
REASON_CONSULTATION = "Consultation response - not included in review scope"
REASON_PUBLIC = "Public comment - not relevant for policy review"
REASON_CORE = "Core application document"
REASON_ASSESSMENT = "Technical assessment document"
REASON_OFFICER = "Officer/decision document"
REASON_NON_TRANSPORT = "Non-transport technical document - not relevant for cycling review"
REASON_UNKNOWN = "Unknown document type - allowed by default (fail-safe)"
REASON_BYPASSED = "Filter bypassed"

# --- fixed values: file name patterns, first match wins ---------------------
FILENAME_PATTERNS = (
    (r"transport[_\s-]*(assessment|statement)", "transport_assessment"),
    (r"travel[_\s-]*plan", "transport_assessment"),
    (r"traffic[_\s-]*(impact|assessment)", "transport_assessment"),
    (r"highways?[_\s-]*(statement|assessment)", "transport_assessment"),
    (r"design[_\s-]*(and[_\s-]*)?access[_\s-]*statement", "design_access_statement"),
    (r"d[_\s-]*&?[_\s-]*a[_\s-]*statement", "design_access_statement"),
    (r"site[_\s-]*plan", "site_plan"),
    (r"location[_\s-]*plan", "site_plan"),
    (r"block[_\s-]*plan", "site_plan"),
    (r"layout[_\s-]*plan", "site_plan"),
    (r"floor[_\s-]*plan", "floor_plan"),
    (r"ground[_\s-]*floor", "floor_plan"),
    (r"first[_\s-]*floor", "floor_plan"),
    (r"elevation", "elevation"),
    (r"street[_\s-]*scene", "elevation"),
    (r"planning[_\s-]*statement", "planning_statement"),
    (r"supporting[_\s-]*statement", "planning_statement"),
    (r"environmental[_\s-]*(impact[_\s-]*)?(statement|assessment)", "environmental_statement"),
    (r"e[_\s-]*i[_\s-]*a", "environmental_statement"),
    (r"noise[_\s-]*(impact[_\s-]*)?(assessment|report|survey)", "noise_assessment"),
    (r"acoustic", "noise_assessment"),
    (r"flood[_\s-]*risk[_\s-]*(assessment)?", "flood_risk_assessment"),
    (r"fra", "flood_risk_assessment"),
    (r"drainage[_\s-]*strategy", "flood_risk_assessment"),
    (r"ecology[_\s-]*(report|survey|assessment)", "ecology_report"),
    (r"ecological[_\s-]*(appraisal|assessment)", "ecology_report"),
    (r"bat[_\s-]*survey", "ecology_report"),
    (r"biodiversity", "ecology_report"),
    (r"heritage[_\s-]*(statement|assessment)", "heritage_statement"),
    (r"archaeological", "heritage_statement"),
    (r"arboricultural[_\s-]*(report|survey|assessment)", "arboricultural_report"),
    (r"tree[_\s-]*survey", "arboricultural_report"),
)

# --- fixed values: words that give a type away in the text ------------------
CONTENT_KEYWORDS = (
    ("transport_assessment", (
        "trip generation", "traffic flow", "junction capacity", "parking provision",
        "cycle parking", "pedestrian", "highway network", "vehicle movements",
        "transport assessment", "travel plan", "modal split", "trics",
    )),
    ("design_access_statement", (
        "design principles", "access arrangements", "inclusive design",
        "character and appearance", "scale and massing", "visual impact",
        "design and access", "layout and design",
    )),
    ("planning_statement", (
        "planning policy", "local plan", "nppf", "national planning policy",
        "material considerations", "planning balance", "development plan",
    )),
    ("flood_risk_assessment", (
        "flood zone", "surface water", "drainage", "suds", "attenuation",
        "flood risk", "sequential test", "exception test",
    )),
    ("ecology_report", (
        "protected species", "habitat", "biodiversity net gain", "bat survey",
        "great crested newt", "breeding birds", "ecological appraisal",
    )),
    ("noise_assessment", (
        "noise level", "decibel", "acoustic", "sound insulation",
        "noise sensitive", "background noise", "noise impact",
    )),
    ("heritage_statement", (
        "listed building", "conservation area", "heritage asset", "significance",
        "archaeological", "historic environment", "setting",
    )),
)
CONTENT_MINIMUM = 2
FALLBACK_TYPE = "other"

# --- fixed values: names of 3-D renders, where OCR is pointless -------------
RENDERING_PATTERN = (
    r"(?:bird.?s?\s*eye|perspective|aerial\s*view|cgi|3d\s*visual|artist.?s?\s*impression"
    r"|photomontage|street\s*scene|render(?:ing)?(?:\s*\d+)?)"
)

# --- fixed values: files that can be ingested -------------------------------
INGESTIBLE_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif")

# --- fixed values: section references, by priority --------------------------
SECTION_PATTERNS = (
    r"(Chapter\s+\d+(?:\.\d+)?)",
    r"(Section\s+\d+(?:\.\d+)?)",
    r"(Para(?:graph)?\s+\d+(?:\.\d+)?)",
    r"(Table\s+\d+(?:[-.]\d+)?)",
    r"(Figure\s+\d+(?:[-.]\d+)?)",
    r"(Annex\s+[A-Z])",
)

# --- fixed values: chunking and embedding sizes -----------------------------
CHUNK_TOKENS = 200
OVERLAP_TOKENS = 50
CHARS_PER_TOKEN = 4
CHUNK_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
EMBEDDING_CHARS = 1024
EMBEDDING_DIM = 384
IMAGE_THRESHOLD = 0.7

# --- fixed values: date layouts tried in order ------------------------------
DATE_LAYOUTS = ("d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-M-d", "d-M-yyyy")

# --- fixed values: label substrings -> metadata field, first match wins -----
LABEL_FIELDS = (
    ("address", ("address", "location", "property")),
    ("proposal", ("proposal", "description", "development")),
    ("applicant", ("applicant",)),
    ("agent", ("agent",)),
    ("status", ("status",)),
    ("decision", ("decision",)),
    ("application_type", ("type", "category")),
    ("ward", ("ward",)),
    ("parish", ("parish",)),
    ("case_officer", ("officer",)),
)
DATE_FIELDS = (
    ("date_received", "received"),
    ("date_validated", "valid"),
    ("target_date", "target"),
    ("decision_date", "decision"),
)
METADATA_FIELDS = (
    "address", "proposal", "applicant", "agent", "status", "decision", "application_type",
    "ward", "parish", "case_officer", "date_received", "date_validated", "target_date",
    "decision_date",
)

# --- fixed values: what marks a link as a document link ---------------------
DOCUMENT_LINK_MARKERS = (".pdf", "/document/", "/viewdoc", "docid=", "fileid=")
NEXT_LINK_TEXTS = ("next", "next >", "next page", ">>", ">")
UNNAMED_DOCUMENT = "Unknown Document"
