"""Review profiles, knowledge packs and the severity / scoring scales."""

# --- fixed values: profiles -----------------------------------------------------
# id, name, {category: weight} in profile order, {category: permission}, required sections, model focus
PROFILES = [
    ("academic", "Academic Review", {"structure": 30, "writing": 25, "citation": 30, "formatting": 15},
     {"writing": 3, "citation": 1, "structure": 2, "formatting": 2},
     ["Introduction", "Methodology", "Results", "Conclusion", "References"],
     ["argument_quality", "coherence", "clarity"]),
    ("business", "Business Review", {"structure": 25, "writing": 25, "formatting": 25, "compliance": 25},
     {"writing": 3, "formatting": 2, "structure": 2, "compliance": 1},
     ["Executive Summary", "Introduction", "Conclusion"], ["brevity", "tone"]),
    ("general", "General Review", {"structure": 35, "writing": 40, "formatting": 25},
     {"writing": 3, "formatting": 3, "structure": 3}, [], ["clarity", "grammar"]),
    ("legal", "Legal Document", {"structure": 30, "writing": 25, "formatting": 20, "compliance": 25},
     {"writing": 2, "formatting": 3, "structure": 3, "compliance": 1}, ["Parties", "Terms", "Definitions"],
     ["ambiguity", "definitions"]),
    ("research", "Research Document", {"structure": 25, "writing": 25, "citation": 30, "logic": 20},
     {"writing": 3, "citation": 1, "structure": 2, "logic": 1},
     ["Abstract", "Introduction", "Literature Review", "Methodology", "References"], ["logic", "methodology"]),
    ("sop", "SOP & Compliance", {"structure": 30, "writing": 20, "formatting": 20, "compliance": 30},
     {"writing": 2, "formatting": 3, "structure": 3, "compliance": 1}, ["Purpose", "Scope", "Procedure"],
     ["unambiguity", "compliance"]),
    ("technical_design", "Technical Design", {"structure": 35, "writing": 25, "formatting": 20, "logic": 20},
     {"writing": 3, "formatting": 3, "structure": 2, "logic": 1}, ["Overview", "Architecture", "Components"],
     ["precision", "clarity"]),
]

# --- fixed values: knowledge packs ------------------------------------------------
# id, name, profile, {category: permission level}, {config key: value}
PACKS = [
    ("academic-base", "Academic Base", "academic",
     {"structure": 3, "writing": 3, "citation": 3, "format": 3, "figure_table": 3, "logic": 3},
     {"min_abstract_words": 100, "max_abstract_words": 350, "min_section_words": 30, "max_words": 2000,
      "max_passive": 5, "max_hedging": 3, "max_weak": 5, "max_repeats": 3, "max_grammar_issues": 10,
      "max_spelling_issues": 15}),
    ("acm", "ACM", "academic", {"citation": 3}, {"citation_style": "acm"}),
    ("apa", "APA 7th Edition", "academic", {"citation": 3, "format": 5},
     {"citation_style": "apa", "heading_font": "bold", "heading_alignment": "center",
      "reference_format": "hanging_indent", "line_spacing": 2.0}),
    ("business", "Business Report & Proposal", "business", {"structure": 5, "writing": 5, "format": 5},
     {"max_passive": 8, "max_hedging": 2, "max_weak": 3, "min_abstract_words": 50, "max_abstract_words": 500,
      "min_section_words": 20, "variance_ratio": 15}),
    ("elsevier", "Elsevier", "academic", {"citation": 3}, {"citation_style": "elsevier"}),
    ("fda", "FDA 21 CFR Part 11", "sop", {"compliance": 2, "structure": 3}, {"pack_id": "fda"}),
    ("ieee", "IEEE", "academic", {"citation": 3}, {"citation_style": "ieee", "citation_separator": ","}),
    ("iso9001", "ISO 9001:2015", "sop", {"compliance": 2, "structure": 3}, {"pack_id": "iso9001"}),
    ("nature", "Nature", "academic", {"citation": 3}, {"citation_style": "nature"}),
    ("sop", "Standard Operating Procedure", "sop", {"structure": 3, "writing": 3, "compliance": 2},
     {"pack_id": "sop", "min_section_words": 20, "max_passive": 3}),
    ("springer", "Springer", "academic", {"citation": 3}, {"citation_style": "springer"}),
    ("who", "WHO Guidelines", "sop", {"compliance": 2, "structure": 3}, {"pack_id": "who"}),
]

# --- fixed values: scoring scales ----------------------------------------------------
DEDUCTIONS = {"high": 20, "medium": 10, "low": 4}
SCORING_MODES = {"strict": 1.25, "standard": 1.0, "relaxed": 0.75}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# --- fixed values: rule thresholds -----------------------------------------------------
DEFAULT_CONFIG = {
    "min_abstract_words": 50, "max_abstract_words": 350, "min_section_words": 10, "variance_ratio": 10,
    "max_long_words_pct": 25, "max_avg_sentence_words": 25, "max_sentence_words": 40, "max_repeats": 3, "min_words": 20,
    "max_words": 2000, "min_paragraph_lines": 3, "pack_id": "",
}

# --- fixed values: published limits on what a rule reads and reports --------------------
PUBLISHED_LIMITS = {
    "max_grammar_issues": 10, "max_spelling_issues": 15, "max_punctuation_issues": 10, "max_per_phrase": 2,
    "max_passive": 5, "max_hedging": 3, "max_weak": 5, "max_weak_per_line": 3, "max_tone_lines": 20,
    "max_abstract_lines": 80, "narrative_chars": 50, "max_listed_numbers": 10, "max_acm_references": 3,
    "reference_key_chars": 80, "fingerprint_words": 10, "max_duplicates": 5, "max_scope_terms": 5,
    "max_contrast_words": 3, "max_contradictions": 3, "max_contrast_mixes": 1, "max_claims": 5,
    "max_conclusion_lines": 30, "max_conclusion_terms": 10, "max_shown_terms": 5, "max_number_issues": 3,
    "max_aligned_blocks": 10, "max_gaps": 1,
}

# every limit is off unless a configuration names it
DEFAULT_CONFIG |= dict.fromkeys(PUBLISHED_LIMITS)

# --- fixed values: issue mapping, category names -------------------------------------
UNIFIED_CATEGORIES = [
    "formatting", "structure", "writing", "citation", "logic", "compliance", "figures", "tables", "consistency",
    "ai_finding",
]
UNIFIED_SOURCES = {
    "rule": "rule", "rule_engine": "rule", "ai": "ai", "ai_review": "ai", "cross_rule": "cross_rule",
    "compliance": "compliance",
}
SEMANTIC_CATEGORIES = ["writing", "logic", "summary", "technical"]
