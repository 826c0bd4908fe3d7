"""Document type signals."""

# --- fixed values: type families ---------------------------------------------------
TYPE_PROFILE = {
    "thesis": "academic", "dissertation": "academic", "journal_article": "academic",
    "conference_paper": "academic", "literature_review": "academic", "research_proposal": "academic",
    "internship_report": "academic", "survey_paper": "academic", "lab_report": "academic",
    "software_architecture": "technical_design", "system_design": "technical_design",
    "api_specification": "technical_design", "technical_spec": "technical_design",
    "user_manual": "technical_design", "developer_guide": "technical_design", "release_note": "technical_design",
    "rfc": "technical_design",
    "proposal": "business", "business_report": "business", "financial_report": "business",
    "meeting_minutes": "business", "project_plan": "business",
    "sop": "sop", "policy": "sop", "iso_document": "sop", "process_document": "sop",
    "report": "general", "essay": "general", "unknown": "general",
}

# --- fixed values: file name signals ----------------------------------------------------
FILENAME_SIGNALS = [
    (r"lu[aậ]n\s*v[aă]n", "thesis", 0.90), (r"kh[oó]a\s*lu[aậ]n", "thesis", 0.90),
    (r"đ[oồ]\s*[aá]n", "thesis", 0.85), (r"b[aá]o\s*c[aá]o\s*th[uự]c\s*t[aậ]p", "internship_report", 0.90),
    (r"quy\s*tr[iì]nh", "sop", 0.85), (r"h[uướ][oơ]ng\s*d[aẫ]n", "sop", 0.80),
    (r"thi[eế]t\s*k[eế]\s*h[eệ]\s*th[oố]ng", "system_design", 0.90),
    (r"ki[eế]n\s*tr[uú]c", "software_architecture", 0.88),
    (r"\bthesis\b", "thesis", 0.90), (r"\bdissertation\b", "dissertation", 0.90), (r"\bsop\b", "sop", 0.90),
    (r"\bprocedure\b", "sop", 0.80), (r"\barchitecture\b", "software_architecture", 0.85),
    (r"\bdesign\b", "system_design", 0.75), (r"\bspec(ification)?\b", "technical_spec", 0.80),
    (r"\bapi\b", "api_specification", 0.85), (r"\brfc\b", "rfc", 0.90), (r"\brelease.?note", "release_note", 0.88),
    (r"\bmanual\b", "user_manual", 0.85), (r"\bguide\b", "developer_guide", 0.78),
    (r"\bproposal\b", "proposal", 0.82), (r"\bminutes\b", "meeting_minutes", 0.90),
    (r"\bfinancial\b", "financial_report", 0.85), (r"\bproject.?plan\b", "project_plan", 0.88),
    (r"\bpolicy\b", "policy", 0.85), (r"\biso\b", "iso_document", 0.82), (r"\blab.?report\b", "lab_report", 0.88),
]

# --- fixed values: title signals -----------------------------------------------------
TITLE_SIGNALS = [
    (r"\bthesis\b|\bdissertation\b", "thesis", 0.20),
    (r"lu[aậ]n\s*v[aă]n|kh[oó]a\s*lu[aậ]n|đ[oồ]\s*[aá]n", "thesis", 0.20),
    (r"b[aá]o\s*c[aá]o\s*th[uự]c\s*t[aậ]p", "internship_report", 0.20),
    (r"\bsoftware\s+architecture\b|\bsystem\s+design\b", "software_architecture", 0.18),
    (r"\bapi\s+(spec|guide|reference)\b", "api_specification", 0.20),
    (r"\bsop\b|\bstandard\s+operating\s+procedure\b", "sop", 0.20),
]
THESIS_TITLE = r"thesis|dissertation|lu[aậ]n\s*v[aă]n"
THESIS_HEADINGS = ["abstract", "conclusion", "references"]

# --- fixed values: heading combinations -----------------------------------------------
HEADING_COMBOS = [
    (["abstract", "introduction", "methodology", "results", "references"], "journal_article", 0.95),
    (["abstract", "introduction", "conclusion", "references"], "journal_article", 0.80),
    (["abstract", "conclusion", "references"], "thesis", 0.70),
    (["literature review", "methodology", "references"], "thesis", 0.78),
    (["abstract", "introduction", "survey", "references"], "survey_paper", 0.82),
    (["objective", "materials", "methods", "results"], "lab_report", 0.88),
    (["system overview", "components", "api", "deployment"], "software_architecture", 0.92),
    (["architecture", "components", "deployment"], "software_architecture", 0.85),
    (["system design", "database", "api"], "system_design", 0.85),
    (["endpoints", "request", "response", "authentication"], "api_specification", 0.90),
    (["changelog", "version", "release"], "release_note", 0.88),
    (["purpose", "scope", "procedure"], "sop", 0.90),
    (["purpose", "scope", "responsibility", "procedure"], "sop", 0.95),
    (["purpose", "scope", "policy", "compliance"], "policy", 0.88),
    (["executive summary", "background", "objectives"], "business_report", 0.82),
    (["executive summary", "scope", "budget"], "proposal", 0.88),
    (["attendees", "agenda", "action items"], "meeting_minutes", 0.95),
    (["milestones", "timeline", "deliverables", "risks"], "project_plan", 0.90),
    (["income", "expenses", "balance sheet"], "financial_report", 0.92),
]

# --- fixed values: text signals ---------------------------------------------------------
TEXT_SIGNALS = [
    (["abstract", "introduction", "methodology", "references"], "journal_article", 0.10),
    (["thesis", "dissertation", "graduate", "faculty", "supervisor"], "thesis", 0.12),
    (["internship", "thực tập", "intern report"], "internship_report", 0.15),
    (["literature review", "systematic review", "bibliometric"], "literature_review", 0.18),
    (["research proposal", "research questions", "proposed methodology"], "research_proposal", 0.18),
    (["survey", "questionnaire", "respondents", "sample size"], "survey_paper", 0.12),
    (["microservice", "docker", "kubernetes", "ci/cd", "devops"], "software_architecture", 0.12),
    (["api endpoint", "rest api", "graphql", "swagger", "openapi"], "api_specification", 0.15),
    (["release notes", "bug fix", "known issues", "changelog"], "release_note", 0.15),
    (["rfc ", "request for comments", "ietf"], "rfc", 0.18),
    (["iso 9001", "iso 27001", "iso/iec", "certification"], "iso_document", 0.18),
    (["executive summary", "market analysis", "competitive landscape"], "business_report", 0.12),
    (["return on investment", "roi", "profit", "revenue", "financial statement"], "financial_report", 0.12),
    (["action items", "attendees", "minutes of meeting", "mom"], "meeting_minutes", 0.15),
    (["step 1", "step 2", "step 3", "procedure", "work instruction"], "sop", 0.10),
    (["revision history", "document control", "approved by", "effective date"], "sop", 0.12),
    (["bước 1", "bước 2", "quy trình", "hướng dẫn thực hiện"], "sop", 0.12),
    (["luận văn", "khóa luận", "đồ án", "giảng viên hướng dẫn"], "thesis", 0.15),
    (["báo cáo thực tập", "đơn vị thực tập", "nhận xét của đơn vị"], "internship_report", 0.18),
]
