"""DuckDB SQL for every review rule, written per rule from its definition."""

from __future__ import annotations

from quillspark.fixed import words as W

from .sql import any_in, base, count_in, found, has, n, q, strip, words

MAY3, MAY4 = "writing_level >= 3", "writing_level >= 4"


def every(rel: str) -> str:
    return f"(SELECT * FROM {rel})"


def first_pattern(patterns: list[str], x: str, flags: str) -> str:
    whens = " ".join(f"WHEN {has(x, p, flags)} THEN {k}" for k, p in enumerate(patterns, 1))
    return f"CASE {whens} END"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def each_match(pattern: str, flags: str, group: int = 0, x: str = "al", keep: str = "") -> str:
    p = q(f"(?{flags})" + pattern if flags else pattern)
    return (f"(SELECT doc_id, profile_id, profile_name, writing_level, line_no, line, al, low{keep}, "
            f"unnest(regexp_extract_all({x}, {p}, {group})) AS m, "
            f"generate_subscripts(regexp_extract_all({x}, {p}, {group}), 1) AS mpos FROM lines)")


def structure() -> dict[str, list[str]]:
    o: dict[str, list[str]] = {}
    o["structure.title-check"] = [
        found("no-title", "docs", "NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = docs.doc_id)"),
        found("title-not-h1", "heads", "idx = 0 AND level <> 1", line="line_no", fix="TRUE", level="level", title="title")]
    abstract = f"""(SELECT s.doc_id, s.line_no, coalesce(sum({words('l.line')}), 0) AS words FROM
        (SELECT * FROM sects WHERE key IN ({', '.join(q(x) for x in W.ABSTRACT_HEADINGS)})
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1) s
        LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.line_no > s.line_no AND (s.nxt IS NULL OR l.line_no < s.nxt) GROUP BY ALL)"""
    o["structure.abstract-check"] = [
        found("abstract-too-short", abstract, "words < 50", line="line_no", words="words", limit="50"),
        found("abstract-too-long", abstract, "words > 350", line="line_no", words="words", limit="350"),
        found("missing-abstract", "docs", f"profile_id IN ('academic', 'business') AND NOT EXISTS (SELECT 1 FROM heads h "
              f"WHERE h.doc_id = docs.doc_id AND key IN ({', '.join(q(x) for x in W.ABSTRACT_HEADINGS)}))",
              profile="profile_name")]
    o["structure.key-sections-check"] = [
        found("missing-key-section", "docs",
              f"profile_id = 'academic' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = docs.doc_id AND "
              f"(contains(key, {q(key)})" + (f" OR key IN ({', '.join(q(x) for x in others)})" if others else "") + "))",
              key=q(key), display=q(display), severity=q(severity))
        for key, display, severity, others in W.KEY_SECTIONS]
    order = ", ".join(f"({i}, {q(s)})" for i, s in enumerate(W.SECTION_ORDER))
    steps = f"""(SELECT *, lag(rank) OVER w AS prev_rank, lag(name) OVER w AS prev_name, lag(place) OVER w AS prev_at FROM (
        SELECT doc_id, rank, name, min(line_no) AS place FROM (
          SELECT h.doc_id, h.line_no, min(e.i) AS rank, min_by(e.name, e.i) AS name FROM heads h
          JOIN (VALUES {order}) e(i, name) ON contains(h.key, e.name) OR contains(e.name, h.key)
          WHERE h.profile_id = 'academic' GROUP BY ALL) GROUP BY doc_id, rank, name)
        WINDOW w AS (PARTITION BY doc_id ORDER BY place))"""
    title = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    o["structure.section-order"] = [
        found("wrong-order", steps, "rank < prev_rank", line="prev_at", last="place", key="name", current=title("name"),
              previous=title("prev_name"), current_line="place", previous_line="prev_at")]
    empty = f"""(SELECT s.doc_id, s.idx, s.title, s.line_no, coalesce(s.nxt, s.n_lines) AS last,
        coalesce(sum(CASE WHEN EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = s.doc_id AND h.title <> s.title
          AND starts_with(lower(l.bare), lower(h.title))) THEN 0 ELSE {words('l.line')} END), 0) AS words
        FROM sects s LEFT JOIN lines l ON l.doc_id = s.doc_id AND l.line_no > s.line_no
          AND l.line_no <= coalesce(s.nxt, s.n_lines)
        WHERE NOT (s.idx = 0 AND s.level = 1) AND s.key NOT IN ('references', 'bibliography', 'appendix') GROUP BY ALL)"""
    o["structure.empty-section"] = [
        found("empty-section", empty, "words < 10", line="line_no", last="last", index="idx", title="title", words="words")]
    dup = f"""(SELECT doc_id, key, count(*) AS c, min(line_no) AS lo, max(line_no) AS hi,
        string_agg(CAST(line_no AS VARCHAR), ', ' ORDER BY line_no) AS places FROM heads GROUP BY doc_id, key)"""
    o["structure.duplicate-section"] = [
        found("duplicate-section", dup, "c > 1", line="lo", last="hi", slug="replace(key, ' ', '-')", title=title("key"),
              count="c", all_lines="places")]
    sized = f"""(SELECT *, sum(w) OVER (PARTITION BY doc_id) / count(*) OVER (PARTITION BY doc_id) AS mean,
        count(*) OVER (PARTITION BY doc_id) AS c FROM (SELECT s.doc_id, s.title, s.line_no,
        coalesce(sum({words('l.line')}), 0) AS w FROM sects s LEFT JOIN lines l ON l.doc_id = s.doc_id
        AND l.line_no > s.line_no AND l.line_no <= coalesce(s.nxt, s.n_lines) GROUP BY ALL))"""
    o["structure.section-length-variance"] = [
        found("section-too-large", sized, "c >= 3 AND mean >= 20 AND w > mean * 3", slug="replace(left(title, 20), ' ', '-')",
              title="title", words="w", ratio="printf('%.1f', w / mean)", average="printf('%.0f', mean)")]
    kw = "(SELECT * FROM heads WHERE contains(key, 'keyword') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1)"
    o["structure.keywords-check"] = [
        found("missing-keywords", "docs", "profile_id = 'academic' AND NOT EXISTS (SELECT 1 FROM heads h WHERE "
              "h.doc_id = docs.doc_id AND contains(key, 'keyword'))"),
        found("keywords-empty", f"(SELECT k.doc_id, k.line_no, k.n_lines, l.bare FROM {kw} k JOIN lines l ON "
              "l.doc_id = k.doc_id AND l.line_no = k.line_no + 1 WHERE k.profile_id = 'academic')",
              "line_no < n_lines - 1 AND (bare = '' OR starts_with(bare, '#'))", line="line_no")]
    o["structure.sop-required-fields"] = [
        found("sop-missing", "docs", f"profile_id = 'sop' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = docs.doc_id "
              f"AND key IN ({q(k)}, {q(k + 's')}))", key=q(k), display=q(v)) for k, v in W.SOP_FIELDS]
    absent = """(SELECT * FROM (SELECT doc_id, unnest(required) AS section FROM docs) r WHERE NOT EXISTS
        (SELECT 1 FROM heads h WHERE h.doc_id = r.doc_id AND lower(h.title) = lower(r.section)))"""
    for rule, key in (("structure.required-section", "required-section"), ("format.required-sections-depth", "missing-section")):
        o[rule] = [found(key, absent, slug="replace(lower(section), ' ', '-')", section="section")]
    o["structure.heading-hierarchy"] = [
        found("heading-gap", "sects", "next_level > level + 1", fix="TRUE", level="next_level")]
    return o


def writing() -> dict[str, list[str]]:
    o: dict[str, list[str]] = {}
    k = first_pattern([p for p, _ in W.GRAMMAR], "al", "i")
    rel = every(f"(SELECT *, {k} AS k FROM lines) WHERE k IS NOT NULL")
    pats = lst(["(?i)" + p for p, _ in W.GRAMMAR])
    match = "CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(al, {q('(?i)' + p)}, 0)" for i, (p, _) in enumerate(W.GRAMMAR, 1)) + " END"
    o["writing.grammar"] = [
        found("grammar", rel, line="line_no", fix=MAY3, excerpt="line",
              problem=f"{lst([m for _, m in W.GRAMMAR])}[k]", match=f"left({match}, 60)")]
    typos = ", ".join(f"({q(a)}, {q(b)})" for a, b in W.TYPOS.items())
    toks = each_match(r"\w+", "", x="lower(al)")
    o["writing.spelling"] = [
        found("spelling", every(f"{toks} t JOIN (VALUES {typos}) y(typo, fixed) ON t.m = y.typo"),
              line="line_no", fix="TRUE", excerpt="line", word="typo", correction="fixed")]
    k = first_pattern([p if "(?!" not in p else r"(?:^|[^.])(?:\.\.)*\.\.(?:[^.]|$)|\.\.(?:[^.]|$)" for p, _ in W.PUNCTUATION], "line", "")
    o["writing.punctuation"] = [
        found("punctuation", every(f"(SELECT *, {k} AS k FROM lines) WHERE k IS NOT NULL"), line="line_no",
              fix="TRUE", excerpt="line", problem=f"{lst([m for _, m in W.PUNCTUATION])}[k]")]
    read = f"""(SELECT doc_id, 100.0 * long / w AS pct, long, w / nullif(s, 0) AS avg_words, w, s, pieces FROM (SELECT doc_id,
        {n('folded', r'\w+')} AS w, {n('folded', r'\b\w{10,}\b')} AS long,
        len(string_split_regex(text, '[.!?]+\\s+')) AS pieces,
        len(list_filter(string_split_regex(text, '[.!?]+\\s+'), lambda p: {words('p')} >= 2)) AS s FROM docs)
        WHERE w > 0 AND pieces >= 3 AND s > 0)"""
    o["writing.readability"] = [
        found("readability-complex", read, "pct > 25", count="long", percent="printf('%.0f', pct)", limit="25"),
        found("readability-long-sentences", read, "avg_words > 25", average="printf('%.0f', avg_words)", limit="25")]
    pairs = " UNION ALL ".join(
        f"SELECT doc_id, line_no, line, {i} AS k, {q(advice)} AS advice FROM lines WHERE {has('al', p, 'i')}"
        for i, (p, advice) in enumerate(W.OVERUSED, 1))
    o["writing.overused-phrases"] = [
        found("overused", every(f"({pairs})"), line="line_no", excerpt="line", advice="advice")]
    count = lambda w: f"CAST((length(low) - length(replace(low, {q(w)}, ''))) / {len(w)} AS BIGINT)"
    o["writing.terminology"] = [
        found("terminology", f"(SELECT doc_id, {count(a)} AS na, {count(b)} AS nb FROM docs)", "na > 0 AND nb > 0",
              slug=q(a.replace(" ", "-")[:20]), first=q(a), second=q(b), n_first="na", n_second="nb",
              dominant=f"CASE WHEN na >= nb THEN {q(a)} ELSE {q(b)} END", other=f"CASE WHEN na >= nb THEN {q(b)} ELSE {q(a)} END")
        for a, b in W.TERM_VARIANTS]
    ctx = "substr(line, greatest(0, strpos(lower(al), m) - 21) + 1, 100)"
    o["writing.passive-voice"] = [
        found("passive", every(each_match(W.PASSIVE, "i", 1)), line="line_no", fix=MAY3, excerpt=ctx,
              context=strip(ctx))]
    word_re = lambda ws: r"\b(?:" + "|".join(ws) + r")\b"
    o["writing.hedging"] = [
        found("hedging", every(each_match(word_re(W.HEDGING_WORDS), "i")), line="line_no", fix=MAY4,
              excerpt="line", match="m")]
    o["writing.weak-wording"] = [
        found("weak", every(f"{each_match(word_re(W.WEAK_WORDS), 'i')}"), line="line_no",
              fix=MAY3, excerpt="line", match="m")]
    k = first_pattern([p for p, _ in W.VERBOSE], "al", "i")
    o["writing.verbosity"] = [
        found("verbose", f"(SELECT *, {k} AS k FROM lines)", "k IS NOT NULL", line="line_no", fix=MAY3,
              excerpt="line", advice=f"{lst([a for _, a in W.VERBOSE])}[k]")]
    o["writing.contractions"] = [
        found("contraction", each_match(word_re(W.CONTRACTIONS), "i"), "profile_id IN ('academic', 'sop')", line="line_no",
              fix=MAY4, excerpt="line", match="m", profile="profile_name")]
    o["writing.sentence-length"] = [
        found("long-line", "lines", f"{n('al', r'\w+')} > 40", line="line_no", fix=MAY3, excerpt="left(line, 220)")]
    pieces = """(SELECT doc_id, writing_level, line_no, unnest(string_split_regex(line, '[.!?]+')) AS piece,
        unnest(string_split_regex(al, '[.!?]+')) AS folded_piece FROM lines)"""
    o["shadow:writing.sentence-length"] = [
        found("long-sentence", f"(SELECT *, {n('folded_piece', r'\w+')} AS w FROM {pieces})", "w > 40", line="line_no", fix=MAY3,
              words="w", limit="40", excerpt=f"left({strip('piece')}, 200)")]
    rep = f"""(SELECT doc_id, m, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(folded),
        {q(word_re(W.REPETITION_WORDS))})) AS m FROM docs) GROUP BY doc_id, m)"""
    o["writing.repetition"] = [found("repetition", rep, "c > 3", word="m", count="c")]
    inf = f"(SELECT DISTINCT doc_id, writing_level, line_no, line, m FROM {toks} WHERE profile_id = 'academic' AND m IN ({', '.join(q(x) for x in W.INFORMAL_WORDS)}))"
    o["writing.tone-consistency"] = [
        found("informal", inf, line="line_no", fix=MAY3, excerpt="line", word="m"),
        found("business-passive", f"(SELECT *, {n('folded', W.PASSIVE, 'i')} AS c FROM docs)", "profile_id = 'business' AND c > 10", count="c"),
        found("sop-imperative", """(SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^\\p{Lu}')) AS c
              FROM lines WHERE profile_id = 'sop' GROUP BY doc_id)""", "c < 3")]
    return o


def citation() -> dict[str, list[str]]:
    o: dict[str, list[str]] = {}
    total = " + ".join(n("text", p) for p in (W.APA_IN_TEXT, W.APA_NARRATIVE, W.IEEE, W.ET_AL, W.AUTHOR_PAIR))
    cited = f"(SELECT *, {total} AS c FROM nref)"
    o["citation.in-text-reference-mismatch"] = [
        found("missing-reference-list", cited, "profile_id <> 'technical_design' AND c > 0 AND n_refs = 0", count="c"),
        found("orphan-references", cited, "profile_id <> 'technical_design' AND c = 0 AND n_refs > 0", count="n_refs",
              excerpt="left(first_ref, 200)")]
    years = f"""(SELECT doc_id, CAST(y AS BIGINT) AS y FROM (SELECT doc_id, unnest(list_concat(
        regexp_extract_all(text, {q(W.YEAR_IN_PARENS)}, 1), regexp_extract_all(text, {q(W.YEAR_AFTER_AUTHOR)}, 1))) AS y FROM docs))"""
    o["citation.year-validity"] = [
        found("invalid-year", years, "y < 1900 OR y > 2026", year="y"),
        found("future-year", years, "y > 2025 AND y <= 2026", year="y")]
    group = "(SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, '\\([^)]{3,}\\)')) AS g FROM lines)"
    o["citation.apa-format"] = [
        found("apa-format", group, f"{has('g', '[A-Z]')} AND {has('g', r'\d{4}')} AND NOT {has('g', W.APA_IN_TEXT)} AND NOT "
              f"{has('line', W.APA_NARRATIVE)}", line="line_no", excerpt="left(g, 200)")]
    o["citation.apa-heading"] = [
        found("apa-no-heading", "nref", "n_refs > 0 AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = nref.doc_id AND "
              "regexp_matches(title, '(?i)^(references|bibliography)$'))", count="n_refs")]

    def numbers(pattern: str, grp: int = 0) -> str:
        return (f"(SELECT doc_id, CAST(unnest(flatten(list_transform(regexp_extract_all(text, {q(pattern)}, {grp}), "
                f"lambda g: regexp_extract_all(g, '\\d+')))) AS BIGINT) AS v, generate_subscripts(flatten(list_transform("
                f"regexp_extract_all(text, {q(pattern)}, {grp}), lambda g: regexp_extract_all(g, '\\d+'))), 1) AS pos FROM docs)")

    first = lambda p: f"(SELECT doc_id, min_by(v, pos) AS v FROM {numbers(p)} GROUP BY doc_id)"
    lowest = lambda p, g: f"(SELECT doc_id, min(v) AS v FROM {numbers(p, g)} GROUP BY doc_id)"
    seen = f"""(SELECT doc_id, max(CASE WHEN v <> rn THEN 1 ELSE 0 END) AS off FROM (SELECT doc_id, v,
        row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS rn FROM {numbers(W.IEEE)} GROUP BY doc_id, v) GROUP BY doc_id)"""
    shown = f"(SELECT doc_id, string_agg(CAST(v AS VARCHAR), ', ' ORDER BY pos) AS shown FROM {numbers(W.IEEE)} GROUP BY doc_id)"
    o["citation.ieee-format"] = [
        found("ieee-start", first(W.IEEE), "v <> 1", number="v"),
        found("ieee-order", f"{seen} JOIN {shown} USING (doc_id)", "off = 1", numbers="shown")]
    o["citation.doi-validation"] = [
        found("doi-empty", f"(SELECT doc_id, unnest(regexp_extract_all(text, {q(W.DOI_URL)})) AS u FROM docs)",
              "regexp_matches(u, 'doi\\.org/$')", excerpt="left(u, 200)"),
        found("broken-url", f"(SELECT doc_id, unnest(regexp_extract_all(text, {q(W.URL)})) AS u FROM docs)",
              "NOT contains(regexp_extract(u, '^https?://([^/?#]*)', 1), '.')", short="left(u, 60)", excerpt="left(u, 200)")]
    o["citation.acm-format"] = [found("acm-start", lowest(W.ACM_BRACKET, 1), "v <> 1", number="v")]
    o["citation.nature-format"] = [found("nature-start", lowest(W.NATURE_SUPERSCRIPT, 1), "v <> 1", number="v")]
    odd = "(SELECT r.*, n.n_refs FROM refs r JOIN nref n USING (doc_id))"
    o["citation.acm-reference-format"] = [
        found("acm-reference", every(f"{odd} WHERE NOT starts_with(ref, '[') AND NOT (pos + 1 < n_refs AND regexp_matches(ref, "
              f"'^\\p{{Nd}}')) AND NOT {has('ref', W.ACM_INITIALS)}"), index="pos", position="pos + 1", excerpt="left(ref, 200)")]
    o["citation.springer-format"] = [
        found("springer-no-refs", f"(SELECT *, {n('text', W.SPRINGER)} AS c FROM nref)", "c > 0 AND n_refs = 0", count="c")]
    o["citation.elsevier-format"] = [found("elsevier-start", first(W.ELSEVIER), "v <> 1", number="v")]
    styles = ", ".join(f"CASE WHEN {c} > 0 THEN {q(name)} || ' (' || {c} || 'x)' END" for name, c in [
        ("APA", f"({n('text', W.APA_IN_TEXT)} + {n('text', W.APA_NARRATIVE)})"), ("IEEE", n("text", W.IEEE)),
        ("ACM", n("text", W.ACM_BRACKET)), ("Author-Year", n("text", W.SPRINGER))])
    o["citation.style-consistency"] = [
        found("mixed-styles", f"(SELECT doc_id, list_filter([{styles}], lambda s: s IS NOT NULL) AS st FROM docs)",
              "len(st) > 1", styles="array_to_string(st, ', ')")]
    o["citation.duplicate-reference"] = [
        found("duplicate-ref", f"(SELECT *, row_number() OVER (PARTITION BY doc_id, {strip('lower(ref)')} ORDER BY pos) AS rn FROM refs)",
              "rn > 1", index="pos", position="pos + 1", excerpt="left(ref, 200)")]
    loose = f"(SELECT *, {has('text', W.LOOSE_CITATION)} AS cited FROM nref)"
    o["citation.reference-list"] = [
        found("list-missing", loose, "cited AND n_refs = 0"),
        found("list-orphan", loose, "NOT cited AND n_refs > 0", excerpt="left(first_ref, 220)")]
    return o


def layout() -> dict[str, list[str]]:
    """Rules on headings, captions and references to figures; ``blk`` is the block table of the query."""
    o: dict[str, list[str]] = {}
    styles = f"""(SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE s = 'd') AS nd, count(*) FILTER (WHERE s = 'r') AS nr,
        count(*) FILTER (WHERE s = 'u') AS nu, count(DISTINCT s) AS ns FROM (SELECT doc_id, CASE WHEN {has('title', W.NUMBERED_HEADING)}
        THEN 'd' WHEN {has('title', W.ROMAN_HEADING)} THEN 'r' ELSE 'u' END AS s FROM heads) GROUP BY doc_id)"""
    o["format.heading-numbering"] = [
        found("mixed-numbering", styles, "c >= 2 AND ns > 1", numbered="nd", unnumbered="nu", roman="nr")]
    o["format.heading-hierarchy-deep"] = [
        found("heading-skip", "sects", "next_level > level + 1", fix="TRUE", index="idx", position="idx + 2", upper="level",
              lower="next_level", wanted="level + 1"),
        found("heading-too-deep", "(SELECT doc_id, max(level) AS m FROM heads GROUP BY doc_id)", "m > 4", level="m"),
        found("first-heading-not-h1", "heads", "idx = 0 AND level <> 1", fix="TRUE", level="level")]
    sized = f"""(SELECT s.*, coalesce(s.nxt - 1, s.n_lines) AS last, count(*) OVER (PARTITION BY s.doc_id) AS c, coalesce((SELECT
        sum({words('l.line')}) FROM lines l WHERE l.doc_id = s.doc_id AND l.line_no > s.line_no AND l.line_no <= coalesce(s.nxt - 1,
        s.n_lines)), 0) AS w FROM sects s)"""
    at = dict(line="line_no", last="last", index="idx", title="title", words="w")
    o["format.section-length"] = [
        found("short-section", sized, "c >= 2 AND w < 20", limit="20", **at),
        found("long-section", sized, "c >= 2 AND w > 400", limit="400", **at)]
    o["format.block-format"] = [
        found("heading-font", "(SELECT doc_id, count(DISTINCT lower(font_name)) AS c, string_agg(DISTINCT lower(font_name), ', ' ORDER BY "
              "lower(font_name)) AS fonts FROM blk WHERE type = 'heading' AND font_name <> '' GROUP BY doc_id)", "c > 1", fonts="fonts"),
        found("mixed-alignment", "(SELECT doc_id, max(c) AS c, count(DISTINCT alignment) AS nd, string_agg(DISTINCT alignment, ', ' ORDER BY "
              "alignment) AS al FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY "
              "block_idx) AS rn FROM blk WHERE type IN ('paragraph', 'heading')) GROUP BY doc_id)",
              "c >= 3 AND nd > 2", alignments="al")]

    def gaps(kind: str, word: str, key: str) -> list[str]:
        blocks = f"""SELECT doc_id, block_idx AS pos, try_cast(regexp_extract(CASE WHEN type = 'caption' THEN text ELSE caption END, '(\\d+)', 1)
            AS INTEGER) AS v FROM blk WHERE (type = {q(kind)} AND caption <> '') OR (type = 'caption' AND {has('text', word, 'i')})"""
        lines = f"SELECT doc_id, line_no AS pos, number AS v FROM caps WHERE {has('whole', word, 'i')}"
        rel = f"""(SELECT doc_id, v, f + rn - 1 AS e FROM (SELECT doc_id, v, row_number() OVER w AS rn, first_value(v) OVER w AS f FROM (
            SELECT * FROM ({blocks}) WHERE v IS NOT NULL UNION ALL SELECT * FROM ({lines}) c WHERE v IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM ({blocks}) b WHERE b.v IS NOT NULL AND b.doc_id = c.doc_id)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
            WHERE v <> f + rn - 1)"""
        return [found(key, rel, number="v", expected="e")]

    o["figure.numbering-sequential"] = gaps("figure", W.FIGURE_WORD, "figure-gap")
    o["figure.table-numbering"] = gaps("table", W.TABLE_WORD, "table-gap")
    slot = f"""(SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS following FROM lines)"""
    o["figure.missing-caption"] = [
        found("missing-caption", "blk", "type = 'figure' AND caption = ''", line="line_start", last="line_end", node="left(node_id, 8)"),
        found("placeholder", slot, f"{has('line', W.IMAGE)} AND coalesce(following, '') <> '' AND NOT {has('following', 'figure|fig' + chr(92) + '.', 'i')} AND ("
              + " OR ".join(has("line", p, "i") for p in W.PLACEHOLDERS) + ")", line="line_no", excerpt="left(line, 200)")]
    o["figure.missing-table-caption"] = [
        found("missing-table-caption", "blk", "type = 'table' AND caption = ''", line="line_start", last="line_end", node="left(node_id, 8)")]
    fig = """(SELECT doc_id, number AS v FROM caps WHERE number IS NOT NULL AND contains(lower(whole), 'fig') UNION SELECT doc_id,
        try_cast(regexp_extract(caption, '(\\d+)', 1) AS INTEGER) FROM blk WHERE type = 'figure' AND caption <> '')"""
    tab = """(SELECT doc_id, number AS v FROM caps WHERE number IS NOT NULL AND NOT contains(lower(whole), 'fig') AND contains(lower(whole), 'table')
        UNION SELECT doc_id, try_cast(regexp_extract(caption, '(\\d+)', 1) AS INTEGER) FROM blk WHERE type = 'table' AND caption <> '')"""

    def refs_to(pattern: str) -> str:
        return f"(SELECT doc_id, line_no, line, try_cast(m AS INTEGER) AS v FROM {each_match(pattern, 'i', 1, x='line')} WHERE try_cast(m AS INTEGER) IS NOT NULL)"

    def dangling(pattern: str, actual: str, key: str) -> str:
        rel = f"""(SELECT * FROM {refs_to(pattern)} r WHERE EXISTS (SELECT 1 FROM {actual} a WHERE a.v IS NOT NULL AND a.doc_id = r.doc_id)
            AND NOT EXISTS (SELECT 1 FROM {actual} a WHERE a.doc_id = r.doc_id AND a.v = r.v))"""
        return found(key, rel, line="line_no", number="v", excerpt="left(line, 200)")

    unused = f"(SELECT * FROM {fig} a WHERE a.v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {refs_to(W.FIGURE_REF)} r WHERE r.doc_id = a.doc_id AND r.v = a.v))"
    o["figure.cross-reference"] = [
        dangling(W.FIGURE_REF, fig, "figure-ref"), dangling(W.TABLE_REF, tab, "table-ref"), found("figure-unused", unused, number="v")]
    o["figure.caption-format"] = [
        found("caption-empty", "caps", "caption_text = ''", line="line_no", prefix="whole", excerpt="left(line, 200)"),
        found("caption-period", "caps", "caption_text <> '' AND profile_id = 'academic' AND NOT ends_with(caption_text, '.')", line="line_no",
              fix="TRUE", prefix="whole", excerpt="left(caption_text, 200)"),
        found("caption-long", "caps", "length(caption_text) > 300", line="line_no", chars="length(caption_text)", excerpt="left(caption_text, 200)")]
    missing = lambda kind, p, opening: (f"(SELECT *, {n('text', p, 'i')} AS c FROM docs WHERE NOT {has('low', opening, 'm')} AND NOT EXISTS "
                                        f"(SELECT 1 FROM blk WHERE blk.doc_id = docs.doc_id AND blk.type = {q(kind)}))")
    o["figure.cited-missing"] = [found("figures-missing", missing("figure", W.FIGURE_REF, r"^(figure|fig\.)\s+\d"), "c > 0", count="c")]
    o["figure.table-cited-missing"] = [found("tables-missing", missing("table", W.TABLE_REF, r"^(table)\s+\d"), "c > 0", count="c")]
    o["figure.equation-numbering"] = [
        found("equations", "(SELECT doc_id, count(*) AS c, count(*) FILTER (WHERE regexp_matches(text, '\\(\\d+\\)')) AS m FROM blk "
              "WHERE type = 'equation' GROUP BY doc_id)", "c >= 3 AND m = 0", count="c")]
    return o


def logic() -> dict[str, list[str]]:
    o: dict[str, list[str]] = {}
    acr = f"""(SELECT * FROM {each_match(W.ACRONYM, '')} a WHERE length(m) <= 8 AND m NOT IN ({', '.join(q(x) for x in W.ACRONYM_STOP)}) AND NOT EXISTS
        (SELECT 1 FROM docs d WHERE d.doc_id = a.doc_id AND list_contains(regexp_extract_all(d.text, {q(W.ACRONYM_DEFINED)}, 1), a.m)))"""
    o["logic.undefined-acronym"] = [found("acronym", acr, line="line_no", acronym="m", excerpt="left(line, 200)")]
    paras = """(SELECT *, coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS place FROM (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS i, first_line, c FROM (
          SELECT doc_id, g, min_by(low, line_no) AS first_line, count(*) AS c FROM (
            SELECT *, sum(CASE WHEN bare = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM lines) WHERE bare <> '' GROUP BY doc_id, g)))"""
    no_start = " AND ".join(f"NOT starts_with(first_line, {q(t)})" for t in W.TRANSITIONS)
    o["logic.missing-transition"] = [
        found("transition", paras, f"i > 0 AND c >= 3 AND {no_start}", line="place", index="i", position="i + 1", excerpt="left(first_line, 200)")]
    toks = "regexp_extract_all(lower(al), '\\w+')"
    # the fold turns every accented letter into one mark, so the words come from the positions in the raw line
    raw = "regexp_extract_all(low, '[\\p{L}\\p{N}\\p{M}_]+')"
    prints = f"""(SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id, fp ORDER BY line_no) AS seen FROM (SELECT doc_id, line_no, line,
        array_to_string(list_filter({raw}, lambda w: length(w) > 3), ' ') AS fp FROM lines WHERE len({raw}) >= 5))"""
    o["logic.duplicate-content"] = [
        found("duplicate", every(f"{prints} WHERE seen > 1"), line="line_no", excerpt="left(line, 200)")]
    marks = f"CASE WHEN {has('bare', W.CONCLUSION_OPEN, 'i')} THEN 1 WHEN {has('bare', W.CONCLUSION_CLOSE, 'i')} THEN 2 END"
    region = f"""(SELECT doc_id, string_agg(line || ' ', '' ORDER BY line_no) AS t FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id
        ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM (SELECT *, {marks} AS mark FROM lines)) WHERE state = 1 AND mark IS NULL GROUP BY doc_id)"""
    terms = f"""(SELECT r.doc_id, unnest(regexp_extract_all(regexp_replace(t, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][a-z]{{3,}}\\b')) AS term FROM {region} r)"""
    o["logic.scope-mismatch"] = [
        found("scope", f"(SELECT t.doc_id, t.term FROM {terms} t JOIN docs d USING (doc_id) WHERE NOT contains(lower(array_to_string(d.ls[1:d.n_lines // 2], ' ')), lower(t.term)))",
              term="term", term_lower="lower(term)")]
    three = lambda p: f"list_distinct(regexp_extract_all(lower(folded), {q(p)}))"
    both = f"""(SELECT l.doc_id, l.line_no, l.line FROM lines l JOIN (SELECT doc_id, {three(W.ABSOLUTES)} AS a, {three(W.QUALIFIERS)} AS b FROM docs) d USING (doc_id)
        WHERE len(list_filter(d.a, lambda w: regexp_matches(lower(l.al), '\\b' || w || '\\b'))) > 0 AND len(list_filter(d.b, lambda w: regexp_matches(lower(l.al), '\\b' || w || '\\b'))) > 0)"""
    pos = lambda p, which: f"""(SELECT doc_id, {which} AS p FROM (SELECT doc_id, list_transform(range(1, len(regexp_extract_all(lower(folded), {q(p)})) + 1), lambda i:
        length(array_to_string(string_split_regex(lower(folded), {q(p)})[1:i], '')) + length(array_to_string(regexp_extract_all(lower(folded), {q(p)})[1:i - 1], ''))) AS ps FROM docs))"""
    near = f"(SELECT DISTINCT c.doc_id FROM {pos(W.CONTRAST_MARKERS, 'ps[1]')} c JOIN {pos(W.SIMILARITY_MARKERS, 'unnest(ps)')} s USING (doc_id) WHERE abs(c.p - s.p) < 500)"
    o["logic.contradictions"] = [
        found("contradiction", every(both), line="line_no", index="line_no - 1", excerpt="left(line, 200)"),
        found("contrast-mix", every(f"(SELECT l.* FROM lines l JOIN {near} USING (doc_id)) WHERE contains(low, 'in contrast') AND contains(low, 'similarly')"),
              line="line_no", excerpt="left(line, 200)")]
    claim = " OR ".join(has("al", p, "i") for p in W.CLAIMS)
    evid = " OR ".join(has("al", p, "i") for p in W.EVIDENCE_MARKERS)
    o["logic.claim-without-evidence"] = [
        found("claim", every(f"lines WHERE ({claim}) AND NOT ({evid})"), line="line_no", excerpt="left(line, 200)")]
    start = f"(SELECT doc_id, min(line_no) AS place FROM lines WHERE {has('bare', W.CONCLUSION_START, 'i')} GROUP BY doc_id)"
    concl = f"""(SELECT d.doc_id, lower(array_to_string(d.ls[1:s.place - 2], ' ')) AS body, list_filter(regexp_extract_all(regexp_replace(
        array_to_string(d.ls[s.place:], ' '), '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][a-z]{{2,}}\\b'), lambda t: length(t) > 3 AND lower(t) NOT IN
        ({', '.join(q(x) for x in W.CONCLUSION_STOP)})) AS terms FROM docs d JOIN {start} s USING (doc_id) WHERE d.n_lines >= 20 AND s.place - 2 >= 5)"""
    unseen = f"(SELECT doc_id, list_filter(terms, lambda t: NOT contains(body, lower(t))) AS u FROM {concl})"
    o["logic.unsupported-conclusion"] = [
        found("unsupported", unseen, "len(u) > 0", count="len(u)", terms="array_to_string(u, ', ')")]
    used = ", ".join(f"CASE WHEN {n('folded', p)} > 0 THEN {q(name)} || ' (' || {n('folded', p)} || 'x)' END" for name, p in W.DATE_FORMATS)
    dates = f"(SELECT doc_id, u, CASE WHEN len(u) > 1 THEN 1 ELSE 0 END AS nd, mixed FROM (SELECT doc_id, list_filter([{used}], lambda x: x IS NOT NULL) AS u, " \
            f"{n('folded', W.NUMBER_WORDS, 'i')} > 3 AND {n('folded', chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b')} > 10 AS mixed FROM docs))"
    lines = f"(SELECT l.doc_id, l.line_no, l.line, d.nd, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS rn FROM lines l JOIN {dates} d USING (doc_id) WHERE d.mixed AND " \
            f"{has('al', W.NUMBER_WORDS_ON_LINE, 'i')} AND {has('al', chr(92) + 'b' + chr(92) + 'd+' + chr(92) + 'b')})"
    o["logic.number-consistency"] = [
        found("date-formats", dates, "nd = 1", formats="array_to_string(u, ', ')"),
        found("mixed-numbers", lines, "TRUE", line="line_no", fix="TRUE", excerpt="left(line, 200)")]
    return o


def compliance() -> dict[str, list[str]]:
    o: dict[str, list[str]] = {}
    head = lambda ws: f"EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = docs.doc_id AND {any_in('lower(h.title)', ws)})"
    o["compliance.safety-warning"] = [found("no-warning", "docs", f"NOT {any_in('low', ['warning', 'cảnh báo'])}")]
    score = f"(SELECT doc_id, {count_in('low', W.WARNING_WORDS)} + {count_in('text', W.HAZARD_SYMBOLS)} + CASE WHEN {head(['safety', 'warning'])} THEN 2 ELSE 0 END AS s, " \
            f"{head(['safety', 'warning'])} AS sec FROM docs WHERE profile_id = 'sop')"
    o["shadow:compliance.safety-warning"] = [
        found("no-safety", score, "s = 0"), found("little-safety", score, "s > 0 AND s < 3 AND NOT sec", score="s")]
    o["compliance.signatures"] = [
        found("no-signature", "docs", f"profile_id = 'sop' AND NOT {has('low', W.SIGNATURE)} AND NOT {head(['approval'])}"),
        found("no-date", "docs", f"profile_id = 'sop' AND NOT {has('text', W.DATE)}")]
    version = has("low", W.VERSION)
    o["compliance.revision-history"] = [
        found("no-revision-history", "docs", f"profile_id = 'sop' AND NOT {head(W.REVISION_HEADINGS)}", severity=f"CASE WHEN {version} THEN 'medium' ELSE 'high' END"),
        found("no-version-number", "docs", f"profile_id = 'sop' AND NOT {version}")]
    o["compliance.iso9001"] = [
        *[found("iso-missing", "docs", f"NOT contains(low, {q(w)})", slug=q(w.replace(" ", "-")), display=q(d)) for w, d in W.ISO_ELEMENTS],
        found("iso-doc-control", "docs", f"NOT {any_in('low', W.DOCUMENT_CONTROL)}")]
    o["compliance.fda"] = [
        found("fda-gxp", "docs", f"NOT {any_in('low', W.GXP_TERMS)}"),
        found("fda-part11", f"(SELECT doc_id, {count_in('low', W.PART11_ELEMENTS)} AS c FROM docs)", "c < 3", count="c")]
    o["compliance.who"] = [found("who", f"(SELECT doc_id, {count_in('low', W.WHO_ELEMENTS)} AS c FROM docs)", "c < 4", count="c")]
    o["compliance.sop-validation"] = [
        found("sop-no-imperative", "docs", f"profile_id = 'sop' AND NOT {any_in('low', W.OBLIGATION_WORDS)}"),
        found("sop-no-steps", "docs", f"profile_id = 'sop' AND NOT {has('text', W.NUMBERED_STEP)}"),
        found("sop-regulatory", f"(SELECT doc_id, {count_in('low', W.REGULATORY_TERMS)} AS c FROM docs WHERE profile_id = 'sop')", "c < 3", count="c")]
    o["compliance.versioning"] = [
        found("no-versioning", "docs", f"profile_id = 'sop' AND NOT {version}"),
        found("draft-version", f"(SELECT doc_id, unnest(regexp_extract_all(low, {q(W.VERSION)}, 1)) AS v FROM docs WHERE profile_id = 'sop')", "starts_with(v, '0.')", version="v")]
    o["compliance.mandatory-sections"] = [
        found("mandatory", "docs", f"NOT contains(low, {q(w)})", pack="'fda'", pack_upper="'FDA'", slug=q(w.replace(" ", "-")), display=q(d), severity=q(s))
        for w, d, s in W.PACK_SECTIONS["fda"]]
    return o


def all_rules() -> dict[str, str]:
    """rule id -> SQL after the base tables."""
    merged = {**structure(), **writing(), **citation(), **layout(), **logic(), **compliance()}
    return {rule: " UNION ALL ".join(f"({s})" for s in selects) for rule, selects in merged.items()}
