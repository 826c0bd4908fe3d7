"""Parsing, detection, configuration, template queries with their oracles: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.fixed import detection as D, profiles as P, words as W
from quillspark.functions import rx
from quillspark.operators import config as C, detect as DT, document as DOC, template as T
from quillspark.operators.parse import parse
from quillspark.session import read_table
from quillspark.sources import html

from .blocks import BLOCKS_SQL, blocks
from .drafts import PROFILE_CYCLE, RAW_SQL, documents, drafts, pick, sql_pick
from .sql import any_in, ascii_fold, base, count_in, has, q, strip, words

def parsed(s, d):
    return parse(drafts(s, d))


def raw(s, d):
    return parse(documents(s, d))


Q: dict[str, tuple] = {}

# --- P01-P05 ---------------------------------------------------------------------------
Q["p01_lines"] = (lambda s, d: DOC.line_rows(raw(s, d)), base("raw_docs") + "SELECT doc_id, line_no, line FROM lines")
Q["p02_headings"] = (lambda s, d: DOC.heading_rows(parsed(s, d)), base() + "SELECT doc_id, level, title, line_no FROM heads")
Q["p03_references"] = (lambda s, d: DOC.reference_rows(parsed(s, d)), base() + "SELECT doc_id, pos AS position, ref AS reference FROM refs")
Q["p04_sections"] = (
    lambda s, d: DOC.section_rows(parsed(s, d)),
    base() + "SELECT doc_id, idx AS section, title, line_no AS start_line, coalesce(nxt, n_lines) AS structure_end, "
             "coalesce(nxt - 1, n_lines) AS format_end FROM sects")
Q["p05_paragraphs"] = (
    lambda s, d: DOC.paragraph_rows(parsed(s, d)),
    base() + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS paragraph, count(*) AS n_lines,
    min_by(line, line_no) AS first_line FROM (SELECT *, sum(CASE WHEN bare = '' THEN 1 ELSE 0 END) OVER
    (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines) WHERE bare <> '' GROUP BY doc_id, g""")
# --- P06 -------------------------------------------------------------------------------
_ABBR = q("(?i)" + W.ABBREVIATIONS.replace(r"\b", r"(^|[^\p{L}\p{N}_])", 1))
Q["p06_sentences"] = (
    lambda s, d: DOC.sentence_rows(parsed(s, d)),
    base() + f"""SELECT doc_id, i - 1 AS sentence, part AS text, start_char, start_char + length(part) AS end_char FROM (
    SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM (
      SELECT doc_id, {strip("replace(piece, chr(1), '.')")} AS part, i FROM (
        SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(
          regexp_replace(text, {_ABBR}, '\\1\\2' || chr(1), 'g'), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS ps
          FROM docs WHERE {strip('text')} <> '')))) WHERE part <> ''""")
# --- P07, P08 ----------------------------------------------------------------------------
Q["p07_html_blocks"] = (
    lambda s, d: html.page_blocks(read_table(s, f"{d}/pages.parquet", "page_id", "html")).select("page_id", "block_idx", "type", "text", "level"), None)
# references to characters count without their semicolon too, as in HTML
_ENT = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&quot;?', '\"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
Q["p08_html_metadata"] = (
    lambda s, d: html.page_blocks(read_table(s, f"{d}/pages.parquet", "page_id", "html")).groupBy("page_id").agg(
        F.any_value("title").alias("title"), F.any_value("author").alias("author"),
        F.count_if(F.col("type") == "heading").alias("headings")),
    f"""SELECT page_id, trim({_ENT("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, '' AS author,
    len(regexp_extract_all(html, '<h1>')) AS headings FROM pages""")
# --- P09, P10 -------------------------------------------------------------------------
page_text = lambda s, d: drafts(s, d).select("doc_id", F.lit(1).alias("page"), "text")
_PAGES = base() + f""", pieces AS (SELECT doc_id, 1 AS page, i - 1 AS piece, p FROM (SELECT doc_id, {strip('p')} AS p, i FROM (
    SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) AS i FROM docs)) WHERE p <> ''),
typed AS (SELECT doc_id, page, piece, p AS text, {has('p', W.PAGE_FOOTNOTE)} AS foot, {has('p', W.PAGE_CHAPTER, 'i')} AS chap, {has('p', W.PAGE_NUMBERED)} AS num,
    length(p) < 100 AND upper(p) = p AND lower(p) <> p AND {words('p')} <= 8 AS shout,
    {has('p', W.PAGE_FIGURE_CAPTION, 'i')} OR {has('p', W.PAGE_TABLE_CAPTION, 'i')} AS cap FROM pieces)
"""
Q["p09_page_blocks"] = (
    lambda s, d: DOC.page_blocks(page_text(s, d)),
    _PAGES + f"""SELECT doc_id, page, piece, CASE WHEN foot THEN 'footnote' WHEN chap OR num OR shout THEN 'heading' WHEN cap THEN 'caption' ELSE 'paragraph' END AS type,
    CASE WHEN foot THEN 0 WHEN chap THEN 1 WHEN num THEN len(string_split(regexp_extract(text, {q(W.PAGE_NUMBERED)}, 1), '.')) WHEN shout THEN 2 ELSE 0 END AS level,
    CASE WHEN foot THEN 'left' ELSE 'center' END AS alignment, text FROM typed""")
_LOOK = f"len(string_split({strip('text')}, chr(10))) >= 2 AND (contains(text, chr(9)) OR regexp_matches(text, '(?m)^\\|'))"
Q["p10_table_cells"] = (
    lambda s, d: DOC.table_cells(DOC.page_blocks(page_text(s, d))),
    _PAGES + f"""SELECT doc_id, page, piece, r - 1 AS row, c - 1 AS col, cell AS text FROM (
    SELECT doc_id, page, piece, r, unnest(cells) AS cell, generate_subscripts(cells, 1) AS c FROM (
      SELECT doc_id, page, piece, r, CASE WHEN contains(line, '|') THEN list_filter(list_transform(string_split(line, '|'), lambda x: {strip('x')}), lambda x: x <> '')
        WHEN contains(line, chr(9)) THEN list_filter(list_transform(string_split(line, chr(9)), lambda x: {strip('x')}), lambda x: x <> '')
        ELSE [{strip('line')}] END AS cells FROM (
        SELECT doc_id, page, piece, unnest(string_split({strip('text')}, chr(10))) AS line, generate_subscripts(string_split({strip('text')}, chr(10)), 1) AS r FROM (
          SELECT doc_id, page, piece, text FROM typed) WHERE {_LOOK}))) WHERE cell <> '' AND cell <> '---'""")
# --- P11-P14 ---------------------------------------------------------------------------
Q["p11_citations"] = (
    lambda s, d: DOC.citation_rows(parsed(s, d)),
    base() + f"""SELECT doc_id, line_no, 'bracket' AS kind, '[' || m || ']' AS raw FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, {q(W.BRACKET_CITATION)}, 1)) AS m FROM lines)
    UNION ALL SELECT doc_id, line_no, 'apa', '(' || m || ')' FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, {q(W.APA_CITATION)}, 1)) AS m FROM lines)""")
broken = lambda s, d: blocks(s, d).withColumn("type", F.when(F.col("block_idx") % 7 == 6, F.lit("page_break")).otherwise(F.col("type")))
Q["p12_pages_from_breaks"] = (
    lambda s, d: DOC.pages_from_breaks(broken(s, d)).select("doc_id", "block_idx", "page"),
    base() + BLOCKS_SQL + "SELECT doc_id, block_idx, block_idx // 7 + 1 AS page FROM blk WHERE block_idx % 7 <> 6")
Q["p13_offset_map"] = (
    lambda s, d: DOC.offset_map(blocks(s, d)).select("doc_id", "block_idx", "start_offset", "end_offset"),
    (_MAP := base() + BLOCKS_SQL + """, omap AS (SELECT doc_id, block_idx, page_number, s AS start_offset, s + length(text) AS end_offset FROM (SELECT *, coalesce(sum(length(text) + 1)
    OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM blk WHERE text <> ''))
    """) + "SELECT doc_id, block_idx, start_offset, end_offset FROM omap")


def probes(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.explode(F.array(*[F.pmod(F.col("doc_id") * 37 * k, F.col("n_chars") + 5).cast("int") for k in (1, 2, 3)])).alias("offset"))


Q["p14_locate_offsets"] = (
    lambda s, d: DOC.locate_offsets(probes(s, d), DOC.offset_map(blocks(s, d))),
    _MAP + """, probes AS (SELECT DISTINCT doc_id, (doc_id * 37 * k) % (n_chars + 5) AS o FROM documents, (VALUES (1), (2), (3)) t(k))
    SELECT p.doc_id, p.o AS offset, min(m.block_idx) AS block_idx, min_by(m.page_number, m.block_idx) AS page_number FROM probes p LEFT JOIN omap m
    ON m.doc_id = p.doc_id AND p.o BETWEEN m.start_offset AND m.end_offset GROUP BY ALL""")
# --- P15, P16 ----------------------------------------------------------------------------


def validated(s, d):
    """The parser's tables of the drafts with faults: sentences that reach too far, offsets that overlap, pages that lack a block."""
    b = blocks(s, d)
    off = F.pmod(F.col("doc_id") + F.col("block_idx"), F.lit(5))
    sentences = b.where("text <> ''").select("doc_id", "block_idx", F.lit(0).alias("start_char"), (F.length("text") + F.when(off == 0, F.length("text")).otherwise(0)).alias("end_char"))
    mapped = DOC.offset_map(b)
    offsets = mapped.select("doc_id", (F.col("start_offset") - F.when(off == 1, 4).otherwise(0)).alias("start_offset"), (F.col("end_offset") + F.when(off == 3, 9).otherwise(0)).alias("end_offset"))
    pages = b.groupBy("doc_id", F.col("page_number").alias("page")).agg(F.count("*").alias("n")).select(
        "doc_id", "page", (F.col("n") - ((F.col("page") == 1) & (F.col("doc_id") % 3 == 0)).cast("int")).alias("n_blocks"))
    return DOC.parse_validation(parsed(s, d), b, max_text=3000, max_block=1000, sentences=sentences, offsets=offsets, pages=pages)


Q["p15_parse_validation"] = (
    validated,
    _MAP + f""", off AS (SELECT *, (doc_id + block_idx) % 5 AS o FROM blk),
    wide AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE o = 0) AS w FROM off WHERE text <> '' GROUP BY doc_id),
    spans AS (SELECT doc_id, start_offset - CASE WHEN (doc_id + block_idx) % 5 = 1 THEN 4 ELSE 0 END AS a, end_offset + CASE WHEN (doc_id + block_idx) % 5 = 3 THEN 9 ELSE 0 END AS b FROM omap),
    laps AS (SELECT doc_id, count(*) FILTER (WHERE a < r) AS laps FROM (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans) GROUP BY doc_id),
    bl AS (SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE length(text) > 1000) AS l, count(DISTINCT page_number) AS pages, count(*) FILTER (WHERE type = 'table') AS t, count(*) FILTER (WHERE type = 'figure') AS f,
      sum(len(regexp_extract_all(text, 'https?://\\S'))) AS links FROM blk GROUP BY doc_id),
    ci AS (SELECT doc_id, sum(len(regexp_extract_all(line, {q(W.BRACKET_CITATION)})) + len(regexp_extract_all(line, {q(W.APA_CITATION)}))) AS c FROM lines GROUP BY doc_id)
    SELECT d.doc_id, length(d.text) AS chars, n_lines AS total_lines, coalesce(h.c, 0) AS headings, coalesce(b.c, 0) AS blocks, TRUE AS has_content, TRUE AS unique_nodes, TRUE AS valid,
    CAST(length(d.text) > 3000 AS INTEGER) + CAST(coalesce(b.c, 0) < 1 AS INTEGER) + coalesce(b.l, 0) + coalesce(w.w, 0) + coalesce(laps, 0) + CAST(b.c > 0 AND d.doc_id % 3 = 0 AS INTEGER) AS warnings,
    coalesce(w.w, 0) AS wide_blocks, coalesce(laps, 0) AS overlapping_offsets, b.c > 0 AND d.doc_id % 3 = 0 AS page_mismatch, coalesce(t, 0) AS tables, coalesce(f, 0) AS figures, 0 AS footnotes, coalesce(w.n, 0) AS sentences,
    coalesce(links, 0) AS hyperlinks, coalesce(ci.c, 0) AS citations, coalesce(b.pages, 0) AS pages, 0 AS page_breaks, w.n > 0 AS has_offset_map, b.c > 0 AS has_node_ids FROM docs d
    LEFT JOIN (SELECT doc_id, count(*) AS c FROM heads GROUP BY doc_id) h USING (doc_id) LEFT JOIN bl b USING (doc_id) LEFT JOIN wide w USING (doc_id) LEFT JOIN laps USING (doc_id) LEFT JOIN ci USING (doc_id)""")
Q["p16_document_stats"] = (
    lambda s, d: DOC.document_stats(parsed(s, d), blocks(s, d)),
    base() + BLOCKS_SQL + f"""SELECT doc_id, (SELECT count(*) FROM blk b WHERE b.doc_id = nref.doc_id AND type = 'table') AS tables, (SELECT count(*) FROM blk b WHERE b.doc_id = nref.doc_id AND type = 'figure') AS figures, greatest(1, {words('text')} // 300) AS pages, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {strip('p')} <> '')) AS paragraphs,
    (SELECT count(*) FROM heads h WHERE h.doc_id = nref.doc_id) AS headings, {words('text')} AS words, n_refs AS "references", length(text) AS chars FROM nref""")
# --- P17-P19 -----------------------------------------------------------------------------
Q["p17_fixed_chunks"] = (
    lambda s, d: DOC.fixed_chunks(documents(s, d), 1000, 100),
    f"WITH {RAW_SQL} " + """SELECT doc_id, k AS chunk, k * 900 AS start_char, least(k * 900 + 1000, length(text)) AS end_char, substr(text, k * 900 + 1, 1000) AS chunk_text,
    1 + length(left(text, k * 900)) - length(replace(left(text, k * 900), chr(10), '')) AS start_line,
    1 + length(left(text, least(k * 900 + 1000, length(text)))) - length(replace(left(text, least(k * 900 + 1000, length(text))), chr(10), '')) AS end_line
    FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 900.0)) AS BIGINT) + 1)) AS k FROM raw_docs)""")


def chunked(source: str, size: int, overlap: int) -> str:
    """Recursive CTE ``chunks(k, text, chunk, start, stop)`` over source(k, text): a step a chunk."""
    best = ", ".join(f"nullif(length(regexp_extract(w, '(?s)^(.*{p})', 1)), 0)" for p in DOC.BREAKS)
    window = lambda rows: (f"SELECT *, substr(text, low + 1, e - low) AS w FROM (SELECT *, least(start + {size}, length(text)) AS e, "
                           f"greatest(start + {overlap + 1}, least(start + {size}, length(text)) - {DOC.REACH}) AS low FROM ({rows}))")
    stop = lambda rows: f"SELECT k, text, chunk, start, CASE WHEN e < length(text) THEN coalesce(low + coalesce({best}), e) ELSE e END AS stop FROM ({window(rows)})"
    return f"""chunks AS ({stop(f'SELECT k, text, 0 AS chunk, 0::BIGINT AS start FROM {source}')}
    UNION ALL {stop(f'SELECT k, text, chunk + 1 AS chunk, greatest(start + 1, stop - {overlap}) AS start FROM chunks WHERE stop < length(text)')})"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


Q["p17_boundary_chunks"] = (
    lambda s, d: DOC.boundary_chunks(drafts(s, d), 1000, 100),
    recursive(base()) + ", src AS (SELECT doc_id AS k, text FROM docs), " + chunked("src", 1000, 100)
    + " SELECT k AS doc_id, chunk, '' AS section, start AS start_char, stop AS end_char, substr(text, start + 1, stop - start) AS chunk_text FROM chunks")
Q["p18_section_chunks"] = (
    lambda s, d: DOC.section_chunks(drafts(s, d), 800, 100),
    recursive(base()) + """, ofs AS (SELECT doc_id, line_no, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) - length(line) - 1 AS a FROM lines),
    marks AS (SELECT doc_id, a, regexp_extract(line, '^(#{1,3})\\s+(.+)$', 2) AS name FROM ofs WHERE regexp_matches(line, '^#{1,3}\\s+.+$') UNION ALL SELECT doc_id, 0, 'document-start' FROM docs),
    secs AS (SELECT m.doc_id, a, name, coalesce(lead(a) OVER (PARTITION BY m.doc_id ORDER BY a, name <> 'document-start'), length(d.text)) AS b, d.text FROM marks m JOIN docs d USING (doc_id)),
    src AS (SELECT struct_pack(doc_id := doc_id, a := a, name := name) AS k, substr(text, a + 1, b - a) AS text FROM secs WHERE b > a), """ + chunked("src", 800, 100)
    + """ SELECT k.doc_id AS doc_id, row_number() OVER (PARTITION BY k.doc_id ORDER BY k.a, chunk) - 1 AS chunk, k.name AS section, k.a + start AS start_char, k.a + stop AS end_char,
    substr(text, start + 1, stop - start) AS chunk_text FROM chunks""")
Q["p19_token_budget"] = (
    lambda s, d: DOC.token_budget(documents(s, d), 250),
    f"WITH {RAW_SQL} SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 1000) || chr(10) || chr(10) || '[...truncated...]' END AS text FROM raw_docs")
Q["p19_token_budget_tail"] = (
    lambda s, d: DOC.token_budget(documents(s, d), 250, from_start=False),
    f"WITH {RAW_SQL} SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) <= 1000 THEN text ELSE '[...truncated...]' || chr(10) || chr(10) || right(text, 1000) END AS text FROM raw_docs")
Q["p23_table_captions"] = (
    lambda s, d: DOC.table_captions(blocks(s, d)),
    base() + BLOCKS_SQL + f"""SELECT doc_id, block_idx, coalesce(CASE WHEN regexp_matches(p, '(?i)table|bảng') THEN {strip('p')} END, CASE WHEN regexp_matches(f, '(?i)table|bảng') THEN {strip('f')} END, '') AS caption
    FROM (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS f FROM blk WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)) WHERE type = 'table'""")

# --- D01-D07 -------------------------------------------------------------------------------
_vals = lambda rows: ", ".join(f"({i}, {q(p)}, {q(t)}, {v})" for i, (p, t, v) in enumerate(rows))
_combo = ", ".join(f"({i}, [{', '.join(q(k) for k in ks)}], {q(t)}, {v})" for i, (ks, t, v) in enumerate(D.HEADING_COMBOS))
_text = ", ".join(f"({i}, [{', '.join(q(k) for k in ks)}], {q(t)}, {v})" for i, (ks, t, v) in enumerate(D.TEXT_SIGNALS))
_DETECT = base() + f""", meta AS (SELECT d.doc_id, lower(r.filename) AS filename, r.meta_title AS title, d.low FROM docs d JOIN drafts r USING (doc_id)),
sig AS (
  SELECT doc_id, 1 AS stage, i, type, v FROM meta JOIN (VALUES {_vals(D.FILENAME_SIGNALS)}) t(i, p, type, v) ON regexp_matches(filename, p)
  UNION ALL SELECT doc_id, 2, i, type, v FROM meta JOIN (VALUES {_vals(D.TITLE_SIGNALS)}) t(i, p, type, v) ON regexp_matches(title, p)
  UNION ALL SELECT doc_id, 3, i, type, v FROM (SELECT m.doc_id, t.i, t.type, t.v, len(t.ks) AS need, count(DISTINCT k.k) AS got FROM meta m JOIN heads h USING (doc_id)
    CROSS JOIN (VALUES {_combo}) t(i, ks, type, v), unnest(t.ks) k(k) WHERE contains(h.key, k.k) GROUP BY ALL) WHERE need = got
  UNION ALL SELECT doc_id, 4, i, type, v * n FROM (SELECT m.doc_id, t.i, t.type, t.v, len(list_filter(t.ks, lambda k: contains(m.low, k))) AS n FROM meta m CROSS JOIN (VALUES {_text}) t(i, ks, type, v)) WHERE n > 0
  UNION ALL SELECT doc_id, 5, 0, 'thesis', 0.15 FROM meta m WHERE regexp_matches(title, {q(D.THESIS_TITLE)}) AND EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = m.doc_id AND h.key IN ('abstract', 'conclusion', 'references'))),
scored AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first_at) AS rn FROM (SELECT doc_id, type, round(least(1.0, greatest(least(1.0, fn + ti), hd) + tx), 9)::DOUBLE AS score, first_at FROM (
  SELECT doc_id, type, coalesce(max(v) FILTER (WHERE stage = 1), 0) AS fn, coalesce(sum(v) FILTER (WHERE stage = 2), 0) AS ti, coalesce(max(v) FILTER (WHERE stage = 3), 0) AS hd,
    coalesce(sum(v) FILTER (WHERE stage >= 4), 0) AS tx, min(stage * 1000 + i) AS first_at FROM sig GROUP BY doc_id, type)))
"""


def stage(number):
    def run(s, d):
        rows = DT.with_signals(parsed(s, d)).select("doc_id", F.explode_outer("signals").alias("s")).where(f"s.stage = {number}")
        how = F.max if number in (1, 3) else F.sum
        return rows.groupBy("doc_id", F.col("s.type").alias("document_type")).agg(F.round(how("s.value"), 6).alias("stage_score"))
    how = "max" if number in (1, 3) else "sum"
    return run, _DETECT + f"SELECT doc_id, type AS document_type, round(CAST({how}(v) AS DOUBLE), 6) AS stage_score FROM sig WHERE stage = {number} GROUP BY doc_id, type"


for _n, _name in ((1, "d01_filename_signals"), (2, "d02_title_signals"), (3, "d03_heading_combos"), (4, "d04_text_signals"), (5, "d05_thesis_title")):
    Q[_name] = stage(_n)
Q["d06_document_type"] = (
    lambda s, d: DT.detect(parsed(s, d)).select("doc_id", "document_type", "confidence", F.array_join("alternatives", ",").alias("alternatives")),
    _DETECT + """SELECT d.doc_id, coalesce(max(type) FILTER (WHERE rn = 1), 'unknown') AS document_type, round(least(coalesce(max(score) FILTER (WHERE rn = 1), 0), 1.0), 4) AS confidence,
    coalesce(array_to_string((list(type ORDER BY rn) FILTER (WHERE rn > 1 AND score >= 0.30))[1:3], ','), '') AS alternatives FROM docs d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id""")
_map = ", ".join(f"({q(a)}, {q(b)})" for a, b in D.TYPE_PROFILE.items())
Q["d07_detected_profile"] = (
    lambda s, d: DT.detect(parsed(s, d)).groupBy("document_type", "detected_profile").agg(F.count("*").alias("n_docs")),
    _DETECT + f"""SELECT t AS document_type, p AS detected_profile, count(*) AS n_docs FROM (SELECT d.doc_id, coalesce(max(type) FILTER (WHERE rn = 1), 'unknown') AS t
    FROM docs d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id) JOIN (VALUES {_map}) m(t, p) USING (t) GROUP BY ALL""")

# --- C01-C12 ---------------------------------------------------------------------------------
_CATS = ", ".join(f"({q(p[0])}, {q(c)}, {w}, {p[3].get(c, 'NULL')})" for p in P.PROFILES for c, w in p[2].items())
_PERM = ", ".join(f"({q(p[0])}, {q(c)}, {v})" for p in P.PROFILES for c, v in p[3].items())
_PACKP = ", ".join(f"({q(p[0])}, {q(c)}, {v})" for p in P.PACKS for c, v in p[3].items())
_PACKC = ", ".join(f"({q(p[0])}, {q(c)}, {q(str(v))})" for p in P.PACKS for c, v in p[4].items())
PACK_SETS = [["apa"], ["academic-base", "ieee"], [], ["sop", "iso9001", "fda"], ["business"], ["sop", "who"], ["academic-base", "business"]]


def requests(s, d):
    """One review request per order: a profile, an ordered pack list and categories, taken from the order's keys."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    packs = F.array(*[F.array(*[F.lit(x) for x in p]) if p else F.array().cast("array<string>") for p in PACK_SETS])
    return orders.select(
        F.col("o_orderkey").alias("request_id"), pick(PROFILE_CYCLE, F.col("o_custkey")).alias("profile_id"),
        F.element_at(packs, (F.col("o_orderkey") % len(PACK_SETS) + 1).cast("int")).alias("pack_ids"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("writing"), F.lit("logic"))).when(
            F.col("o_orderstatus") == "O", F.array(F.lit("citation"))).otherwise(F.array().cast("array<string>")).alias("enabled_categories"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit("equal")).otherwise(F.lit("base")).alias("scoring"))


_REQS = f"""WITH req AS (SELECT o_orderkey AS request_id, {sql_pick(PROFILE_CYCLE, 'o_custkey')} AS profile_id,
    [{', '.join('[' + ', '.join(q(x) for x in p) + ']::VARCHAR[]' for p in PACK_SETS)}][CAST(o_orderkey % {len(PACK_SETS)} + 1 AS INTEGER)] AS pack_ids,
    CASE o_orderstatus WHEN 'F' THEN ['writing', 'logic'] WHEN 'O' THEN ['citation'] ELSE []::VARCHAR[] END AS enabled,
    CASE WHEN starts_with(o_orderpriority, '1') THEN 'equal' ELSE 'base' END AS scoring FROM orders),
cats AS (SELECT * FROM (VALUES {_CATS}) t(profile_id, category, weight, level)),
profs AS (SELECT profile_id, list(category) AS cs FROM cats GROUP BY profile_id)
"""
Q["c01_profile_resolution"] = (
    lambda s, d: C.attach_profile(
        DT.detect(parsed(s, d)).withColumn("requested", F.when(F.col("doc_id") % 2 == 0, F.lit("auto")).otherwise(F.col("profile_id"))).drop("profile_id"),
        requested="requested", detected="detected_profile").select("doc_id", "profile_id", "profile_name", F.size("categories").alias("n_categories")),
    _DETECT + f"""SELECT x.doc_id, x.pid AS profile_id, p.profile_name, (SELECT count(*) FROM (VALUES {_CATS}) c(a, b, c, d) WHERE c.a = x.pid) AS n_categories FROM (
    SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN m.p ELSE d.profile_id END AS pid FROM docs d JOIN (SELECT d.doc_id, coalesce(max(type) FILTER (WHERE rn = 1), 'unknown') AS t
    FROM docs d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id) b USING (doc_id) JOIN (VALUES {_map}) m(t, p) USING (t)) x JOIN prof p ON p.profile_id = x.pid""")
Q["c02_category_gate"] = (
    lambda s, d: requests(s, d).join(F.broadcast(C.profile_table(s).select("profile_id", "categories")), "profile_id").select(
        "request_id", F.array_join(F.array_sort(C.enabled_categories(F.col("categories"), F.col("enabled_categories"))), ",").alias("categories")),
    _REQS + """SELECT request_id, array_to_string(list_sort(CASE WHEN len(enabled) > 0 THEN list_filter(enabled, lambda c: list_contains(cs, c)) ELSE cs END), ',') AS categories
    FROM req JOIN profs USING (profile_id)""")
_CATALOG = ", ".join(f"({q(r)}, {q(c)}, {p}, {q(k)})" for r, (c, p, k) in C.RULES.items())


def rule_selection(s, d):
    """C03 over a table: how many rules each request runs after gate and pack filter."""
    reqs = requests(s, d).join(F.broadcast(C.profile_table(s).select("profile_id", "categories")), "profile_id").select(
        "request_id", "pack_ids", F.explode_outer(C.enabled_categories(F.col("categories"), F.col("enabled_categories"))).alias("category"))
    kept = reqs.join(F.broadcast(C.rule_table(s)), "category").where(
        (F.col("pack_id") == "") | (F.size("pack_ids") == 0) | F.array_contains("pack_ids", F.col("pack_id")))
    return kept.groupBy("request_id").agg(F.count("*").alias("n_rules"))


Q["c03_pack_filter"] = (
    rule_selection,
    _REQS + f"""SELECT request_id, count(*) AS n_rules FROM (SELECT request_id, pack_ids, unnest(CASE WHEN len(enabled) > 0 THEN list_filter(enabled, lambda c: list_contains(cs, c)) ELSE cs END) AS category
    FROM req JOIN profs USING (profile_id)) JOIN (VALUES {_CATALOG}) r(rule_id, category, priority, pack) USING (category)
    WHERE pack = '' OR len(pack_ids) = 0 OR list_contains(pack_ids, pack) GROUP BY request_id""")
Q["c04_permission_merge"] = (
    lambda s, d: C.permission_rows(s, requests(s, d)),
    _REQS + f"""SELECT request_id, category, max(level) AS level FROM (SELECT request_id, category, level FROM req JOIN (VALUES {_PERM}) p(profile_id, category, level) USING (profile_id)
    UNION ALL SELECT request_id, category, level FROM (SELECT request_id, unnest(pack_ids) AS pack FROM req) JOIN (VALUES {_PACKP}) k(pack, category, level) USING (pack)) GROUP BY ALL""")
Q["c05_pack_config"] = (
    lambda s, d: C.config_rows(s, requests(s, d)),
    _REQS + f"""SELECT request_id, key, max_by(value, pos) AS value FROM (SELECT request_id, unnest(pack_ids) AS pack, generate_subscripts(pack_ids, 1) AS pos FROM req)
    JOIN (VALUES {_PACKC}) k(pack, key, value) USING (pack) GROUP BY ALL""")
RULE_IDS = list(C.RULES)


def overrides(s, d):
    """Overrides taken from parts: the rule or category a part's key points at, with its switch and severity."""
    part = s.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey")
    rules = part.groupBy(pick(RULE_IDS, key * 3).alias("key")).agg(F.max(key).alias("k"))
    cats = part.groupBy(pick(["writing", "citation", "logic"], key).alias("key")).agg(F.max(key).alias("k"))
    shape = lambda df, scope: df.select(
        F.lit(scope).alias("scope"), "key", (F.col("k") % 5 != 0).alias("enabled"),
        F.when(F.col("k") % 2 == 0, pick(["high", "low", "medium"], F.col("k"))).alias("severity"))
    return shape(rules, "rule").unionByName(shape(cats, "category"))


_OV = f"""WITH ov AS (SELECT scope, key, k % 5 <> 0 AS enabled, CASE WHEN k % 2 = 0 THEN {sql_pick(['high', 'low', 'medium'], 'k')} END AS severity FROM (
    SELECT 'rule' AS scope, {sql_pick(RULE_IDS, 'p_partkey * 3')} AS key, max(p_partkey) AS k FROM part GROUP BY ALL
    UNION ALL SELECT 'category', {sql_pick(['writing', 'citation', 'logic'], 'p_partkey')}, max(p_partkey) FROM part GROUP BY ALL))"""
Q["c08_rule_overrides"] = (
    lambda s, d: C.override_rows(C.rule_table(s), overrides(s, d)),
    _OV + f""" SELECT c.rule_id, c.category, coalesce(r.enabled, TRUE) AND coalesce(k.enabled, TRUE) AS enabled, coalesce(r.severity, k.severity) AS severity
    FROM (VALUES {_CATALOG}) c(rule_id, category, priority, pack) LEFT JOIN (SELECT * FROM ov WHERE scope = 'rule') r ON r.key = c.rule_id
    LEFT JOIN (SELECT * FROM ov WHERE scope = 'category') k ON k.key = c.category""")
Q["c10_custom_profiles"] = (
    lambda s, d: C.custom_profiles(requests(s, d).select(
        F.col("request_id").alias("custom_id"), F.col("profile_id").alias("base_profile_id"), "enabled_categories", "scoring")).select(
        "custom_id", F.array_join("categories", ",").alias("categories"),
        F.array_join(F.transform("categories", lambda c: F.col("weights")[c].cast("string")), ",").alias("weights"),
        F.array_join("unknown_categories", ",").alias("unknown")),
    None)
_ORD = ", ".join(f"({q(p[0])}, [{', '.join(q(c) for c in p[2])}], [{', '.join(str(w) for w in p[2].values())}])" for p in P.PROFILES)
Q["c10_custom_profiles"] = (
    Q["c10_custom_profiles"][0],
    _REQS + f"""SELECT request_id AS custom_id, array_to_string(ch, ',') AS categories,
    array_to_string(list_transform(ch, lambda c: CAST(CASE WHEN scoring = 'equal' THEN 1 ELSE coalesce(ws[list_position(cs2, c)], 1) END AS VARCHAR)), ',') AS weights,
    array_to_string(list_sort(list_filter(ch, lambda c: NOT list_contains(cs2, c))), ',') AS unknown
    FROM (SELECT r.*, o.cs2, o.ws, CASE WHEN len(enabled) > 0 THEN enabled ELSE o.cs2 END AS ch FROM req r JOIN (VALUES {_ORD}) o(profile_id, cs2, ws) USING (profile_id))""")
Q["c11_custom_profile_list"] = (
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").alias("p").join(
        s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").alias("t"), F.col("p.o_custkey") == F.col("t.c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.col("c_name").alias("template_name")).orderBy(F.desc("updated_at")),
    "SELECT o_orderkey AS id, o_orderdate AS updated_at, c_name AS template_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
_FOCUS = {p[0]: p for p in P.PROFILES}
_SEM = {p[0]: [c for c in p[2] if c in P.SEMANTIC_CATEGORIES] for p in P.PROFILES}
_LEV = ", ".join(f"({q(k)}, {max((_FOCUS[k][3].get(c, 0) for c in v), default=99)}, {'TRUE' if 'writing' in _FOCUS[k][2] else 'FALSE'})" for k, v in _SEM.items())
Q["c12_model_review_decision"] = (
    lambda s, d: C.model_review_decision(C.attach_profile(documents(s, d))).select("doc_id", "should_run", "reason"),
    f"""WITH {RAW_SQL} SELECT doc_id, reason IS NULL AS should_run, coalesce(reason, 'Document contains high-value writing or logic issues that can benefit from AI assistance.') AS reason FROM (
    SELECT doc_id, CASE WHEN {strip('text')} = '' THEN 'Document is empty.' WHEN profile_id = 'sop' THEN 'SOP profiles disable AI-assisted rewriting and writing enhancement.'
      WHEN level < 2 THEN 'Profile does not allow AI-assisted explanation or rewrite actions.' WHEN {words('text')} < 80 THEN 'Document is too short for AI review to add value.' END AS reason
    FROM raw_docs JOIN (VALUES {_LEV}) l(profile_id, level, w) USING (profile_id))""")

# --- T01-T05 -------------------------------------------------------------------------------


def layout(s, d):
    """Page layout per document in EMU, spread by the document id."""
    k = F.col("doc_id")
    return s.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", (k % 17).alias("template_id"), pick(["Arial", "Times New Roman", "arial", ""], k).alias("body_font"),
        (F.lit(10.0) + (k % 5) * 0.2).alias("body_size"),
        *[(F.lit(914400) * (1 + (k * m % 4) * 0.05)).cast("double").alias(f"margin_{name}") for m, name in enumerate(T.MARGINS, 1)])


_LAY = f"""lay AS (SELECT doc_id, doc_id % 17 AS template_id, {sql_pick(['Arial', 'Times New Roman', 'arial', ''], 'doc_id')} AS body_font, 10.0::DOUBLE + (doc_id % 5) * 0.2::DOUBLE AS body_size,
    {', '.join(f'914400 * (1 + (doc_id * {m} % 4) * 0.05::DOUBLE) AS margin_{name}' for m, name in enumerate(T.MARGINS, 1))} FROM documents)"""
Q["t01_learn_template"] = (
    lambda s, d: T.learn(blocks(s, d), layout(s, d)).select(
        "doc_id", "body_font", F.round("body_size", 2).alias("body_size"), *[f"margin_{m}_in" for m in T.MARGINS],
        F.coalesce(F.array_join("required_sections", "|"), F.lit("")).alias("sections"), F.coalesce(F.size("heading_styles"), F.lit(0)).alias("n_styles"),
        F.coalesce(F.col("heading_styles")[2]["font_name"], F.lit("-")).alias("h2_font"), "table_count", "figure_count"),
    base() + BLOCKS_SQL + f""", {_LAY}, hb AS (SELECT * FROM blk WHERE type = 'heading')
    SELECT l.doc_id, body_font, round(body_size, 2) AS body_size, {', '.join(f'round(margin_{m} / 914400, 2) AS margin_{m}_in' for m in T.MARGINS)},
    coalesce(s.sections, '') AS sections, coalesce(st.n, 0) AS n_styles, coalesce(st.h2, '-') AS h2_font, b.t AS table_count, b.f AS figure_count FROM lay l
    LEFT JOIN (SELECT doc_id, string_agg(title, '|' ORDER BY i) AS sections FROM (SELECT doc_id, min(block_idx) AS i, min_by({strip('text')}, block_idx) AS title FROM hb GROUP BY doc_id, lower({strip('text')})) GROUP BY doc_id) s USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(DISTINCT level) AS n, min_by(font_name, block_idx) FILTER (WHERE level = 2) AS h2 FROM hb GROUP BY doc_id) st USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE type = 'table') AS t, count(*) FILTER (WHERE type = 'figure') AS f FROM blk GROUP BY doc_id) b USING (doc_id)""")


def templates(s, d):
    """The templates in use: the layout of the first document that names a template."""
    cols = ["body_font", "body_size", *[f"margin_{m}" for m in T.MARGINS]]
    return layout(s, d).groupBy("template_id").agg(F.min_by(F.struct(*cols), "doc_id").alias("t")).select(
        "template_id", "t.body_font", "t.body_size",
        *[F.round(F.col(f"t.margin_{m}") / T.EMU_PER_INCH, 2).alias(f"margin_{m}_in") for m in T.MARGINS])


_TPL = "tpl AS (SELECT template_id, body_font AS t_font, body_size AS t_size, " + ", ".join(
    f"round(margin_{m} / 914400, 2) AS t_{m}" for m in T.MARGINS) + " FROM lay QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY doc_id) = 1)"
_short = lambda x: f"regexp_replace(CAST({x} AS VARCHAR), '\\.0+$', '')"
Q["t02_template_margins"] = (
    lambda s, d: T.compare_layout(layout(s, d), templates(s, d)).where(F.col("rule_id").contains("margin")),
    f"WITH {_LAY}, {_TPL} " + " UNION ALL ".join(
        f"SELECT doc_id, 'template.layout.margin_{m}_in' AS rule_id, 'medium' AS severity, 'Page {m} margin is ' || printf('%.2f', margin_{m} / 914400) || ' in; the reference template uses ' || printf('%.2f', t_{m}) || ' in.' AS message "
        f"FROM lay JOIN tpl USING (template_id) WHERE abs(t_{m} - margin_{m} / 914400) > 0.08" for m in T.MARGINS))
Q["t03_template_body"] = (
    lambda s, d: T.compare_layout(layout(s, d), templates(s, d)).where(F.col("rule_id").contains("body")),
    f"""WITH {_LAY}, {_TPL} SELECT doc_id, 'template.body.font' AS rule_id, 'medium' AS severity, 'Body font is ' || body_font || '; the reference template uses ' || t_font || '.' AS message FROM lay JOIN tpl USING (template_id)
    WHERE t_font <> '' AND body_font <> '' AND lower(t_font) <> lower(body_font) UNION ALL SELECT doc_id, 'template.body.font_size', 'low', 'Body font size is ' || {_short('body_size')} || ' pt; the reference template uses ' || {_short('t_size')} || ' pt.'
    FROM lay JOIN tpl USING (template_id) WHERE abs(t_size - body_size) > 0.25""")


def template_sections(s, d):
    """Headings of the first document that names a template."""
    first = layout(s, d).groupBy("template_id").agg(F.min("doc_id").alias("doc_id"))
    return DOC.heading_rows(parsed(s, d)).join(first, "doc_id").select("template_id", F.col("title").alias("section")).distinct()


Q["t04_template_sections"] = (
    lambda s, d: T.missing_sections(parsed(s, d).withColumn("template_id", F.col("doc_id") % 17), template_sections(s, d), blocks(s, d)),
    base() + f"""SELECT d.doc_id, t.section FROM docs d JOIN (SELECT DISTINCT f.t AS template_id, title AS section FROM heads JOIN (SELECT doc_id % 17 AS t, min(doc_id) AS doc_id FROM documents GROUP BY 1) f USING (doc_id)) t ON d.doc_id % 17 = t.template_id
    WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = d.doc_id AND h.key = lower({strip('t.section')}))""")
Q["t05_demirrored_text"] = (
    lambda s, d: blocks(s, d).where("type = 'heading'").select("doc_id", "block_idx", T.demirrored(F.when(
        F.col("block_idx") % 2 == 0, F.concat("text", "text")).otherwise(F.col("text"))).alias("text")),
    base() + BLOCKS_SQL + "SELECT doc_id, block_idx, text FROM blk WHERE type = 'heading'")


def queries() -> dict:
    return {name: pair[0] for name, pair in Q.items()}


def oracles() -> dict[str, str]:
    return {name: pair[1] for name, pair in Q.items() if pair[1]}
