"""Lists, limits and formats that results depend on, kept together as plain text."""

# File kinds accepted by the reader, by name.
FILE_KINDS = ("csv", "json", "parquet")
JSON_NAMES = ("json", "jsonl", "ndjson")
MAX_UPLOAD_BYTES = 100 * 1024 * 1024

# Semantic classes a column can have.
SEMANTIC_TYPES = (
    "identifier", "metric", "dimension", "date", "currency",
    "percentage", "boolean", "text_description", "geographic", "unknown",
)

# Profile thresholds.
KEY_UNIQUE_SHARE = 0.99
MAX_SAMPLES = 5
DROP_ROWS_BELOW = 0.02
DROP_COLUMN_ABOVE = 0.15
APPROVE_AT = 0.75
REJECT_BELOW = 0.40
EXHAUSTED_AT = 0.95
SIMILAR_AT = 0.92
RUNS_PER_DAY = 3

# Intents in order of precedence with the phrases that signal them.
INTENT_PHRASES = (
    ("forecasting", ("forecast", "predict", "future", "project")),
    ("root_cause", ("why", "cause", "reason", "driver", "spike", "drop")),
    ("distribution", ("distribution", "spread", "demographics", "histogram", "percentile")),
    ("correlation", ("correlat", "relationship", "relate")),
    ("comparison", ("compare", " vs ", "versus", "between", "against")),
    ("ranking", ("top", "bottom", "rank", "best", "worst", "leader", "highest", "lowest")),
)
DEFAULT_INTENT = "trend_analysis"

# Business domains in order of precedence with the phrases that signal them.
DOMAIN_PHRASES = (
    ("ecommerce", ("ecommerce", "cart", "aov", "shipping", "order")),
    ("customer_success", ("churn", "customer", "nps", "product usage", "onboarding", "customer success")),
    ("healthcare", ("patient", "treatment", "hospital", "medical", "clinical", "diagnosis", "admission")),
    ("education", ("student", "academic", "enrollment", "marks", "semester", "subjects", "attendance",
                   "faculty", "curriculum", "grade")),
    ("hr", ("employee", " hr ", "retention", "attrition", "compensation", "headcount", "hire", "training",
            "performance review")),
    ("sales", ("sales", "deal", "win rate", "quota", "pipeline")),
    ("finance", ("revenue", "profit", "expense", "margin", "cash flow", "financial")),
    ("supply_chain", ("inventory", "supply chain", "stockout", "demand")),
    ("logistics", ("delivery", "logistics", "freight")),
    ("operations", ("manufacturing", "efficiency", "process", "supply", "throughput")),
    ("marketing", ("marketing", "campaign", "conversion", "engagement", "cac", "ltv", "acquisition",
                   "advertising", "lead", "roi")),
    ("iot", ("iot", "sensor", "telemetry", "uptime")),
)
DEFAULT_DOMAIN = "unknown"

# Words a read-only query may not contain.
FORBIDDEN_SQL_WORDS = ("DROP", "DELETE", "INSERT", "UPDATE", "CREATE", "EXEC")
FORBIDDEN_SQL_PREFIX = "xp_"

# Step number shown for each run status.
STATUS_STEPS = {
    "initiated": 0,
    "routing": 0,
    "ingesting": 1,
    "cleaning": 2,
    "featuring": 3,
    "querying": 4,
    "layouting": 5,
    "verifying": 5,
    "complete": 6,
}

# Fields each consumer of the run state may see ("*" means all).
CONSUMER_FIELDS = {
    "router": ["raw_query", "file_type", "raw_row_count", "raw_col_count"],
    "ingestion": ["raw_query", "raw_file_path", "file_type", "intent_class", "business_domain"],
    "cleaning": ["column_metadata", "raw_row_count", "intent_class", "key_entities"],
    "feature": ["column_metadata", "cleaning_operations", "intent_class", "business_domain", "key_entities",
                "time_dimension"],
    "analytics": ["column_metadata", "feature_definitions", "raw_query", "intent_class", "business_domain",
                  "key_entities", "time_dimension"],
    "layout": ["generated_queries", "query_results", "raw_query", "business_domain", "intent_class"],
    "qa": ["*"],
}

# Text of the record returned when an answer is not JSON.
BAD_JSON_MESSAGE = "Failed to parse JSON response"
