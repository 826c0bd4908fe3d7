"""Fix replacements, fix types, fix confidence, safety patterns."""

# --- fixed values: spelling and hedging replacements ------------------------------
SPELLING_FIXES = [
    (r"\bteh\b", "the"), (r"\brecieve\b", "receive"), (r"\bacheive\b", "achieve"), (r"\bbeleive\b", "believe"),
    (r"\bdefinately\b", "definitely"), (r"\boccured\b", "occurred"), (r"\boccuring\b", "occurring"),
    (r"\baccomodate\b", "accommodate"), (r"\bembarass\b", "embarrass"), (r"\bindependent\b", "independent"),
    (r"\bjudgment\b", "judgement"), (r"\blaboratory\b", "laboratory"), (r"\bliason\b", "liaison"),
    (r"\bmaintainance\b", "maintenance"), (r"\bminiscule\b", "minuscule"), (r"\bneccessary\b", "necessary"),
    (r"\boccassion\b", "occasion"), (r"\brepetition\b", "repetition"), (r"\bseparate\b", "separate"),
    (r"\bsupercede\b", "supersede"), (r"\btomorrow\b", "tomorrow"), (r"\bcalender\b", "calendar"),
    (r"\bheirarchy\b", "hierarchy"), (r"\bgoverment\b", "government"), (r"\bpriviledge\b", "privilege"),
    (r"\bpublically\b", "publicly"), (r"\btruely\b", "truly"), (r"\bwierd\b", "weird"),
]
HEDGING_FIXES = [
    (r"\barguably\b", ""), (r"\bquite\b", ""), (r"\brather\b", ""), (r"\bsomewhat\b", ""), (r"\bpossibly\b", ""),
    (r"\bperhaps\b", "maybe"), (r"\bseems to\b", "appears to"), (r"\btends to be\b", "is typically"),
]

# --- fixed values: fix types and confidence -----------------------------------------
SAFE_TYPE = [
    "heading-numbering", "heading-hierarchy", "font-size", "line-spacing", "paragraph-spacing", "margin",
    "page-number", "header", "footer", "caption-numbering", "figure-numbering", "table-numbering", "bullet-list",
    "numbered-list", "period-spacing", "reference-formatting", "broken-hyperlinks",
]
AI_TYPE = [
    "passive-voice", "grammar", "spelling", "punctuation", "weak-wording", "hedging", "repetition",
    "tone-consistency", "readability",
]
CONFIDENCE_SAFE = [
    "heading-numbering", "heading-hierarchy", "font-size", "line-spacing", "paragraph-spacing", "margin",
    "page-number", "header", "footer", "caption-numbering", "figure-numbering", "table-numbering",
    "table-of-contents", "list-of-figures", "list-of-tables", "reference-formatting", "broken-hyperlinks",
    "cross-reference",
]
CONFIDENCE_HIGH = [
    "heading-style", "font-family", "bold-italic-consistency", "bullet-list", "numbered-list", "caption-style",
    "apa-citation", "ieee-citation", "doi-validation", "url-validation",
]
CONFIDENCE_MEDIUM = [
    "passive-voice", "grammar", "spelling", "punctuation", "weak-wording", "hedging", "long-sentences",
    "repetition", "terminology-consistency",
]
CONFIDENCE_LOW = [
    "tone-consistency", "academic-tone", "business-tone", "sop-imperative", "readability",
    "clarity-improvement", "logic-suggestions", "writing-improvement", "ai-rewrite",
]
CATEGORY_CONFIDENCE = {
    "format": 98, "citation": 92, "structure": 88, "figure_table": 95, "writing": 75, "grammar": 80, "logic": 60,
    "compliance": 85, "ai_analysis": 50,
}

# --- fixed values: personal data and sensitive topics --------------------------------
PII = [
    ("email", r"\b[\w._%+-]+@[\w.-]+\.[a-zA-Z]{2,}\b"),
    ("phone", r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("api_key_like", r"\b(sk-[a-zA-Z0-9]{20,}|[A-Za-z0-9]{32,})\b"),
]
SENSITIVE_TOPICS = [
    "trade secret", "confidential", "classified", "proprietary", "internal only", "do not distribute", "embargoed",
]
SOP_RESTRICTED = [
    ("rewrite", ["rewrite", "rephrase", "paraphrase", "change the meaning"], "high",
     "SOP documents must not be rephrased. Only formatting fixes allowed."),
    ("delete_required", ["remove", "delete required section", "omit"], "high",
     "Required compliance sections must not be removed."),
    ("change_terminology", ["change terminology", "replace technical term", "simplify language"], "medium",
     "Technical terminology changes require regulatory approval."),
]
REPLY_FIELDS = ["category", "rule_id", "severity", "message", "recommendation"]

# --- fixed values: operations ------------------------------------------------------------
HISTOGRAM_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
ALERT_LIMITS = [
    ("api_error_rate", 0.05, "critical"), ("api_p95_seconds", 2.0, "warning"), ("autofix_failure_rate", 0.20, "warning"),
    ("storage_utilization", 0.85, "warning"), ("queue_depth", 1000.0, "warning"),
]
RETENTION_DAYS = {"document": 90, "review": 365, "audit": 730, "autofix_version": 365}
SECRET_KEYS = ["authorization", "token", "api_key", "secret", "password", "document_text", "content"]
