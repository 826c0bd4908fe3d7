"""Shared pieces of the oracle SQL: base tables and issue rendering."""

from __future__ import annotations

import re

from quillspark.fixed.catalog import ISSUES
from quillspark.fixed.profiles import PROFILES
from quillspark.functions.findings import slots, texts_of

from .drafts import DRAFTS_SQL, RAW_SQL

ISSUE_COLUMNS = ["doc_id", "issue_id", "rule_id", "severity", "message", "recommendation", "excerpt", "line_start",
                 "line_end", "location", "confidence", "autofix_allowed"]
CHARS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_SLOT = re.compile(r"(\{\{|\}\}|\{\w+\})")


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {CHARS})"


def ascii_fold(x: str) -> str:
    """Every non-ASCII letter as ``_`` so that ASCII \\w and \\b act like the Unicode ones."""
    return (f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', chr(1), 'g'), "
            f"'[^\\x00-\\x7F]', '_', 'g')")


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def n(x: str, pattern: str, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"len(regexp_extract_all({x}, {q(prefix + pattern)}))"


def has(x: str, pattern: str, flags: str = "") -> str:
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_matches({x}, {q(prefix + pattern)})"


def any_in(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in needles) + ")"


def count_in(x: str, needles: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INTEGER)" for w in needles) + ")"


def text(template: str, values: dict[str, str]) -> str:
    parts = []
    for piece in _SLOT.split(template):
        if piece in ("{{", "}}"):
            parts.append(q(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            parts.append(f"CAST({values[piece[1:-1]]} AS VARCHAR)")
        elif piece:
            parts.append(q(piece))
    return " || ".join(parts)


def found(key: str, rel: str, where: str = "TRUE", /, line: str = "1", last: str | None = None, fix: str = "FALSE",
          **values: str) -> str:
    """SELECT of one issue kind; ``values`` are SQL expressions for its slots."""
    _, _, severity, confidence, _, *_ = ISSUES[key]
    issue_id, rule_id, message, advice, excerpt, location = texts_of(key)
    last = last or line
    assert set(slots(key)) <= set(values), (key, slots(key))
    values = {"line": line, "last_line": last, **values}
    return (f"SELECT doc_id, {text(issue_id, values)} AS issue_id, {text(rule_id, values)} AS rule_id, "
            f"{text(severity, values)} AS severity, {text(message, values)} AS message, "
            f"{text(advice, values)} AS recommendation, {text(excerpt, values)} AS excerpt, "
            f"CAST({line} AS INTEGER) AS line_start, CAST({last} AS INTEGER) AS line_end, "
            f"{text(location, values)} AS location, {confidence} AS confidence, {fix} AS autofix_allowed "
            f"FROM {rel} WHERE {where}")


_REQ = ", ".join(f"({q(p[0])}, {q(p[1])}, [{', '.join(q(s) for s in p[4])}]::VARCHAR[], {p[3].get('writing', 0)})"
                 for p in PROFILES)
HEAD = r"'^(#{1,6})\s+(.+?)\s*$'"
REF_HEAD = "'(?i)^(references|bibliography|tài liệu tham khảo)$'"


def base(source: str = "drafts") -> str:
    """docs, lines, heads, sects, refs, caps over the drafts or the raw documents."""
    first = DRAFTS_SQL if source == "drafts" else RAW_SQL
    return f"""WITH {first},
prof AS (SELECT * FROM (VALUES {_REQ}) t(profile_id, profile_name, required, writing_level)),
docs AS (SELECT d.doc_id, d.profile_id, p.profile_name, p.required, p.writing_level, d.text, lower(d.text) AS low,
    {ascii_fold('d.text')} AS folded, string_split(d.text, chr(10)) AS ls, len(string_split(d.text, chr(10))) AS n_lines
  FROM {source} d JOIN prof p USING (profile_id)),
raw_lines AS (SELECT doc_id, profile_id, profile_name, writing_level, n_lines, unnest(ls) AS line,
    generate_subscripts(ls, 1) AS line_no FROM docs),
lines AS MATERIALIZED (SELECT *, lower(line) AS low, {ascii_fold('line')} AS al, {strip('line')} AS bare FROM raw_lines),
heads AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx FROM (
    SELECT doc_id, profile_id, profile_name, n_lines, line_no, length(regexp_extract(line, {HEAD}, 1)) AS level,
      regexp_extract(line, {HEAD}, 2) AS title, lower({strip(f'regexp_extract(line, {HEAD}, 2)')}) AS key
    FROM lines WHERE regexp_matches(line, {HEAD}))),
sects AS (SELECT *, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt,
    lead(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_level FROM heads),
refs AS (SELECT l.doc_id, l.profile_id, l.bare AS ref, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.line_no) - 1 AS pos
  FROM lines l JOIN sects s ON l.doc_id = s.doc_id AND l.line_no > s.line_no AND (s.nxt IS NULL OR l.line_no < s.nxt)
  WHERE regexp_matches(s.title, {REF_HEAD}) AND l.bare <> ''),
nref AS (SELECT d.*, coalesce(r.n_refs, 0) AS n_refs, r.first_ref FROM docs d LEFT JOIN (
    SELECT doc_id, count(*) AS n_refs, min_by(ref, pos) AS first_ref FROM refs GROUP BY doc_id) r USING (doc_id)),
caps AS (SELECT *, try_cast(num AS INTEGER) AS number FROM (SELECT doc_id, profile_id, line_no, line,
    regexp_extract(line, {{cap}}, 0) AS whole, regexp_extract(line, {{cap}}, 1) AS num,
    {strip('regexp_extract(line, {cap}, 2)')} AS caption_text FROM lines WHERE regexp_matches(line, {{cap}})))
""".replace("{cap}", q("(?i)" + CAP))


from quillspark.fixed.words import CAPTION as CAP  # noqa: E402
