"""Fixed values. They are part of the results, so they are stated here once, as they must be."""

# Reaction contents that count as positive.
POSITIVE_REACTIONS = ["+1", "heart", "hooray", "rocket", "eyes"]

# The default category vocabulary, in order.
DEFAULT_CATEGORIES = [
    "bug",
    "feature",
    "documentation",
    "refactor",
    "security",
    "performance",
    "test",
    "other",
]

# Accepted priority levels, most urgent first.
PRIORITY_LEVELS = ["P0", "P1", "P2"]

# Sizes of the ranked cuts and the default issue limit.
TOP_URGENT = 20
TOP_SCORED = 10
DEFAULT_LIMIT = 300

# Days per duration unit, and the days used when a text is not a duration.
UNIT_DAYS = {"y": 365, "m": 30, "d": 1}
FALLBACK_DAYS = 730

# Texts of the report.
SUMMARY_LABELS = {
    "total_issues": "Total Issues Analyzed",
    "p0": "P0 Issues",
    "p1": "P1 Issues",
    "p2": "P2 Issues",
    "duplicate_groups": "Duplicate Groups",
}
TABLE_HEAD = ["| ID | Title | Priority | Reasoning |", "| --- | --- | --- | --- |"]
NO_ISSUES = "No issues found."
NO_DUPLICATES = "No duplicates found."
URGENT_TITLE = "## Top 20 Urgent Issues"
ALL_TITLE = "## All Issues (Sorted by Priority)"
DUPLICATES_TITLE = "## Potential Duplicate Issues"
