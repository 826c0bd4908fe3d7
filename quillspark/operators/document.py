"""Relations derived from documents, pages and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import words as W
from ..functions import rx
from ..session import stored
from .rules.logic import paragraphs



def line_rows(parsed: DataFrame) -> DataFrame:
    """P01."""
    return parsed.select("doc_id", F.posexplode("lines").alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def heading_rows(parsed: DataFrame) -> DataFrame:
    """P02."""
    return parsed.select("doc_id", F.explode_outer("headings").alias("h")).where("h IS NOT NULL").select(
        "doc_id", "h.level", "h.title", "h.line_no")


def reference_rows(parsed: DataFrame) -> DataFrame:
    """P03."""
    return parsed.select("doc_id", F.posexplode_outer("refs").alias("position", "reference")).where(
        "reference IS NOT NULL")


def section_rows(parsed: DataFrame) -> DataFrame:
    """Both ends of a section, with and without the next heading line."""
    return parsed.select("doc_id", F.explode_outer("sections").alias("s")).where("s IS NOT NULL").select(
        "doc_id", F.col("s.idx").alias("section"), "s.title", F.col("s.line_no").alias("start_line"),
        F.col("s.next_line").alias("structure_end"),
        (F.col("s.next_line") - F.col("s.has_next").cast("int")).alias("format_end"))


def paragraph_rows(parsed: DataFrame) -> DataFrame:
    """P05."""
    return parsed.select("doc_id", F.posexplode_outer(paragraphs(F.col("text"))).alias("paragraph", "p")).where(
        "p IS NOT NULL").select(
        "doc_id", "paragraph", (rx.literal_count(F.col("p"), "\n") + 1).alias("n_lines"),
        F.substring_index("p", "\n", 1).alias("first_line"))


def sentence_array(text: Column) -> Column:
    """Stripped pieces between sentence ends; known abbreviations do not end a sentence."""
    guarded = F.regexp_replace(text, rx.fold(W.ABBREVIATIONS), "$1\u0001")
    pieces = F.split(guarded, r"(?U)(?<=[.!?])\s+(?=[A-Z\"'(])", -1)
    return F.transform(pieces, lambda p: rx.strip(F.replace(p, F.lit("\u0001"), F.lit("."))))


def sentence_rows(docs: DataFrame) -> DataFrame:
    """Offsets count the stripped pieces plus one, as in the reference."""
    def placed(parts: Column) -> Column:
        return rx.let(rx.running(F.transform(parts, lambda p: F.length(p) + 1)), lambda ends: F.transform(parts, lambda p, i: F.struct(
            i.alias("i"), p.alias("text"), (F.get(ends, i) - F.length(p) - 1).cast("int").alias("start"))))

    rows = docs.where(rx.strip(F.col("text")) != "").select(
        "doc_id", F.explode_outer(rx.let(sentence_array(F.col("text")), placed)).alias("s"))
    return rows.where("s.text <> ''").select(
        "doc_id", F.col("s.i").alias("sentence"), "s.text", F.col("s.start").alias("start_char"),
        (F.col("s.start") + F.length("s.text")).alias("end_char"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blank-line paragraphs of page text, typed. Needs ``doc_id, page, text``."""
    text = F.col("p")
    rows = pages.select(
        "doc_id", "page", F.posexplode(F.transform(F.split("text", r"(?U)\n\s*\n", -1), rx.strip)).alias("piece", "p")
    ).where("p <> ''")
    depth = F.size(F.split(F.regexp_extract(text, rx.exact(W.PAGE_NUMBERED), 1), r"\.", -1))
    shout = (F.length(text) < 100) & (F.upper(text) == text) & (F.lower(text) != text) & (rx.word_count(text) <= 8)
    footnote = text.rlike(rx.exact(W.PAGE_FOOTNOTE))
    heading = text.rlike(rx.fold(W.PAGE_CHAPTER))
    numbered = text.rlike(rx.exact(W.PAGE_NUMBERED))
    caption = text.rlike(rx.fold(W.PAGE_FIGURE_CAPTION)) | text.rlike(rx.fold(W.PAGE_TABLE_CAPTION))
    lines = F.filter(F.split(text, "\n", -1), lambda l: rx.strip(l) != "")

    def balanced(line: Column) -> Column:
        left = F.length(line) - F.length(F.ltrim(line))
        right = F.length(F.rtrim(line)) - F.length(rx.strip(line))
        return F.abs(left - right) < 3

    centered = F.size(F.filter(lines, balanced)) / F.size(lines) > 0.7
    return rows.select(
        "doc_id", "page", "piece",
        F.when(footnote, "footnote").when(heading | numbered | shout, "heading").when(caption, "caption")
        .otherwise("paragraph").alias("type"),
        F.when(footnote, F.lit(0)).when(heading, F.lit(1)).when(numbered, depth).when(shout, F.lit(2))
        .otherwise(F.lit(0)).alias("level"),
        F.when(~footnote & centered, "center").otherwise("left").alias("alignment"),
        text.alias("text"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """P10: cells of text that looks like a table (tabs, or a line that opens with a pipe)."""
    lines = F.split(rx.strip(F.col("text")), "\n", -1)
    looks = (F.size(lines) >= 2) & (F.col("text").contains("\t") | F.exists(lines, lambda l: l.startswith("|")))

    def parts(line: Column) -> Column:
        split = F.when(line.contains("|"), F.split(line, r"\|", -1)).when(
            line.contains("\t"), F.split(line, "\t", -1))
        pieces = F.filter(F.transform(split, rx.strip), lambda p: p != "")
        return F.coalesce(pieces, F.array(rx.strip(line)))

    rows = blocks.where(looks).select("doc_id", "page", "piece", F.posexplode(lines).alias("row", "line"))
    return rows.select("doc_id", "page", "piece", "row", F.posexplode(parts(F.col("line"))).alias("col", "text")).where(
        "text <> '' AND text <> '---'")


def citation_rows(parsed: DataFrame) -> DataFrame:
    """Bracket and author-year citations per line."""
    def found(line: Column, pattern: str, kind: str, left: str, right: str) -> Column:
        return F.transform(rx.find_all(line, rx.exact(pattern), 1), lambda m: F.struct(
            F.lit(kind).alias("kind"), F.concat(F.lit(left), m, F.lit(right)).alias("raw")))

    rows = line_rows(parsed).withColumn("c", F.explode_outer(F.concat(
        found(F.col("line"), W.BRACKET_CITATION, "bracket", "[", "]"),
        found(F.col("line"), W.APA_CITATION, "apa", "(", ")"))))
    return rows.where("c IS NOT NULL").select("doc_id", "line_no", "c.kind", "c.raw")


def by_block():
    return Window.partitionBy("doc_id").orderBy("block_idx")


def pages_from_breaks(blocks: DataFrame) -> DataFrame:
    """Page number by the breaks before a block; the break itself belongs to no page."""
    running = F.sum((F.col("type") == "page_break").cast("int")).over(
        by_block().rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("page", running + 1).where("type <> 'page_break'")


def offset_map(blocks: DataFrame) -> DataFrame:
    """Normalized start and end of every non-empty block."""
    before = F.sum(F.length("text") + 1).over(by_block().rowsBetween(Window.unboundedPreceding, -1))
    return blocks.where("text <> ''").select(
        "*", F.coalesce(before, F.lit(0)).alias("start_offset")).withColumn(
        "end_offset", F.col("start_offset") + F.length("text"))


def stabbed(probes: DataFrame, spans: DataFrame, at: str, start: str, end: str, keep: list[str]) -> DataFrame:
    """Each probe (doc_id, ``at``, more) with ``found``: of the spans of its document that hold it, the first by ``keep``; null if none does.

    An as-of merge in place of product and filter. Probes and spans go through one shuffle into one ordered stream of each
    document, spans before the probes at their start; the last span travels along, and the running maximum of ends cuts
    the stream into clusters of overlapping spans. A probe in a cluster of one span, as parsed blocks have them, is answered by it;
    only probes in clusters of several meet that cluster's spans. Rows moved are probes + spans.
    """
    span = F.struct(F.struct(*keep).alias("k"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"))
    begins = spans.where(F.col(start) <= F.col(end)).select("doc_id", F.col(start).cast("long").alias("_at"), F.lit(0).alias("_side"), span.alias("_span"))
    asked = probes.select("*", F.col(at).cast("long").alias("_at"), F.lit(1).alias("_side"))
    order = Window.partitionBy("doc_id").orderBy("_at", "_side", "_span.b")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    merged = asked.unionByName(begins, allowMissingColumns=True).withColumn("_reach", F.max("_span.b").over(before))
    merged = merged.withColumn("_new", ((F.col("_side") == 0) & F.coalesce(F.col("_reach") < F.col("_at"), F.lit(True))).cast("int"))
    merged = merged.withColumns({"_cluster": F.sum("_new").over(upto), "_last": F.last("_span", ignorenulls=True).over(upto)})
    merged = merged.withColumn("_size", F.count("_span").over(Window.partitionBy("doc_id", "_cluster")))
    own = merged.where("_side = 1")
    columns = probes.columns
    inside = F.when(F.col("_last.b") >= F.col("_at"), F.col("_last.k"))
    single = own.where("_size <= 1").select(*columns, inside.alias("found"))
    some = merged.where("_side = 0 AND _size > 1").select(F.col("doc_id").alias("_doc"), F.col("_cluster").alias("_c"), F.col("_span").alias("_s"))
    several = own.where("_size > 1").join(some, (F.col("doc_id") == F.col("_doc")) & (F.col("_cluster") == F.col("_c")), "left").groupBy(*columns).agg(
        F.min(F.when(F.col("_at").between(F.col("_s.a"), F.col("_s.b")), F.col("_s.k"))).alias("found"))
    return single.unionByName(several)


def locate_offsets(probes: DataFrame, mapped: DataFrame) -> DataFrame:
    """First block whose range holds the offset. ``probes(doc_id, offset)``; misses keep nulls, repeated probes come once."""
    found = stabbed(probes.select("doc_id", "offset").distinct(), mapped, "offset", "start_offset", "end_offset", ["block_idx", "page_number"])
    return found.select("doc_id", "offset", "found.block_idx", "found.page_number")


def overlapping(spans: DataFrame, start: str = "start_offset", end: str = "end_offset", previous_only: bool = False) -> DataFrame:
    """Spans with ``overlaps``: whether one begins before an earlier span of its document has ended; ends are exclusive.

    A sweep over the sorted spans with the running maximum of the ends, so a span within an earlier one is seen even when a
    shorter span lies between. The published form compares with the span just before (``previous_only``). Of equal spans all but one overlap.
    """
    order = Window.partitionBy("doc_id").orderBy(start, end)
    reach = F.lag(end).over(order) if previous_only else F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("overlaps", F.coalesce(F.col(start) < reach, F.lit(False)))


def parse_validation(parsed: DataFrame, blocks: DataFrame, max_text: int = 50_000_000, max_blocks: int = 100_000,
                     max_block: int = 100_000, sentences: DataFrame | None = None, offsets: DataFrame | None = None,
                     pages: DataFrame | None = None) -> DataFrame:
    """Errors and warnings per document with the counts behind them, and the parser's statistics.

    ``sentences(doc_id, block_idx, start_char, end_char)``: a block whose sentences cover more than 1.1 times its text is a
    warning. ``offsets(doc_id, start_offset, end_offset)``: so is each span that overlaps an earlier one. ``pages(doc_id, page, n_blocks)``:
    so is a number of blocks on pages that is not the number of blocks. What is not given is not checked.
    """
    def counted(rows: DataFrame | None, **aggregates: Column) -> DataFrame:
        if rows is None:
            return parsed.select("doc_id", *[F.lit(0).cast("bigint").alias(name) for name in aggregates])
        return rows.groupBy("doc_id").agg(*[c.alias(name) for name, c in aggregates.items()])

    kind = lambda name: F.count_if(F.col("type") == name)
    per_doc = counted(
        blocks, blocks=F.count("*"), long_blocks=F.count_if(F.length("text") > max_block), repeated_nodes=F.count("node_id") - F.count_distinct("node_id"),
        tables=kind("table"), figures=kind("figure"), footnotes=kind("footnote"), page_breaks=kind("page_break"),
        hyperlinks=F.sum(rx.count(F.col("text"), r"https?://\S")), nodes=F.count_if((F.col("block_idx") < 5) & (F.col("node_id") != "")))
    wide = None
    if sentences is not None:
        covered = sentences.groupBy("doc_id", "block_idx").agg(F.count("*").alias("n"), F.sum(F.col("end_char") - F.col("start_char")).alias("covered"))
        wide = covered.join(blocks.select("doc_id", "block_idx", F.length("text").alias("size")), ["doc_id", "block_idx"])
    per_sentence = counted(wide, sentences=F.sum("n"), wide_blocks=F.count_if(F.col("covered") * 10 > F.col("size") * 11))
    per_offset = counted(None if offsets is None else overlapping(offsets), offset_spans=F.count("*"), overlapping_offsets=F.count_if("overlaps"))
    per_page = counted(pages, pages=F.count("*"), page_blocks=F.sum("n_blocks"))
    cited = F.aggregate("lines", F.lit(0), lambda n, line: n + rx.count(line, rx.exact(W.BRACKET_CITATION)) + rx.count(line, rx.exact(W.APA_CITATION)))
    joined = parsed.select("doc_id", F.length("text").alias("chars"), "n_lines", F.size("headings").alias("n_headings"), cited.alias("citations"))
    for side in (per_doc, per_sentence, per_offset, per_page):
        joined = joined.join(side, "doc_id", "left").fillna(0, [c for c in side.columns if c != "doc_id"])
    page_mismatch = (F.col("pages") > 0) & (F.col("page_blocks") != F.col("blocks"))
    content = (F.col("chars") > 0) | (F.col("blocks") > 0)
    return joined.select(
        "doc_id", "chars", F.col("n_lines").alias("total_lines"), F.col("n_headings").alias("headings"), "blocks", content.alias("has_content"),
        (F.col("repeated_nodes") == 0).alias("unique_nodes"), (content & (F.col("repeated_nodes") == 0)).alias("valid"),
        ((F.col("chars") > max_text).cast("int") + ((F.col("blocks") < 1) | (F.col("blocks") > max_blocks)).cast("int")
         + F.col("long_blocks").cast("int") + F.col("wide_blocks").cast("int") + F.col("overlapping_offsets").cast("int") + page_mismatch.cast("int")).alias("warnings"),
        F.col("wide_blocks").cast("int").alias("wide_blocks"), F.col("overlapping_offsets").cast("int").alias("overlapping_offsets"), page_mismatch.alias("page_mismatch"),
        *[F.col(c).cast("int").alias(c) for c in ("tables", "figures", "footnotes", "sentences", "hyperlinks", "citations", "pages", "page_breaks")],
        (F.col("offset_spans") > 0).alias("has_offset_map"), (F.col("nodes") > 0).alias("has_node_ids"))


def document_stats(parsed: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """P16 for text documents; tables and figures are counted where blocks are given, and 0 without."""
    words = rx.word_count(F.col("text"))
    if blocks is None:
        parsed = parsed.withColumns({"tables": F.lit(0), "figures": F.lit(0)})
    else:
        counts = blocks.groupBy("doc_id").agg(*[F.count_if(F.col("type") == t).cast("int").alias(f"{t}s") for t in ("table", "figure")])
        parsed = parsed.join(counts, "doc_id", "left").fillna(0, ["tables", "figures"])
    return parsed.select(
        "tables", "figures",
        "doc_id", F.greatest(F.lit(1), F.floor(words / 300)).cast("int").alias("pages"),
        F.size(F.filter(F.split("text", "\n\n", -1), lambda p: rx.strip(p) != "")).alias("paragraphs"),
        F.size("headings").alias("headings"), words.alias("words"), F.size("refs").alias("references"),
        F.length("text").alias("chars"))


def fixed_chunks(docs: DataFrame, size: int = 8000, overlap: int = 500) -> DataFrame:
    """P17 without boundaries: windows of ``size`` characters that step by ``size - overlap``.

    The text is cut once into pieces of a step; a chunk is its piece and the beginning of the next ones, and its lines come from the
    running count of line breaks, so no chunk reads the text before it.
    """
    step = size - overlap
    more = -(-overlap // step)  # pieces that the overlap reaches into

    def cut(pieces: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int"))
        return rx.let(rx.running(F.transform(pieces, lambda p: rx.literal_count(p, "\n"))), lambda breaks: F.transform(
            F.sequence(F.lit(0), last), lambda k: rx.let(
                F.left(F.array_join(F.slice(pieces, k + 1, more + 1), ""), F.lit(size)), lambda body: F.struct(
                    k.alias("chunk"), body.alias("chunk_text"), (F.when(k == 0, 0).otherwise(F.get(breaks, k - 1)) + 1).cast("int").alias("start_line")))))

    rows = docs.select("doc_id", F.explode_outer(rx.let(rx.find_all(F.col("text"), f"(?s).{{1,{step}}}"), cut)).alias("c")).where("c IS NOT NULL")
    start = F.col("c.chunk") * step
    return rows.select(
        "doc_id", "c.chunk", start.alias("start_char"), (start + F.length("c.chunk_text")).alias("end_char"), "c.chunk_text", "c.start_line",
        (F.col("c.start_line") + rx.literal_count(F.col("c.chunk_text"), "\n")).alias("end_line"))


#: Where a chunk may end, best first: after a heading line, a blank line, a line, a sentence.
BREAKS = (r"\n#{1,3}\s+[^\n]+\n", r"\n\n", r"\n", r"[.!?]\s+")
REACH = 500  # characters at the end of a chunk that are searched for a break


def _part(pieces: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text cut into pieces of REACH: only the pieces that hold them are read."""
    first = F.floor(a / REACH).cast("int")
    n = F.greatest(F.lit(0), F.floor((b - 1) / REACH).cast("int") - first + 1)
    return F.substr(F.array_join(F.slice(pieces, first + 1, n), ""), a - first * REACH + 1, b - a)


def chunk_array(text: Column, size: int, overlap: int) -> Column:
    """``start``, ``end`` and ``body`` of chunks of at most ``size`` characters; one ends at the last of the best breaks in its last 500 characters.

    A greedy fold over the text: each step looks for a break in one window alone, so the work grows with the text. Every chunk starts
    after the one before it started; an empty text is one empty chunk.
    """
    def cut(given: Column) -> Column:
        pieces, n = given["pieces"], given["n"]

        def stop(start: Column) -> Column:
            end = F.least(start + size, n)
            low = F.greatest(start + overlap + 1, end - REACH)

            def last(window: Column) -> Column:
                return F.coalesce(*[F.nullif(F.length(F.regexp_extract(window, f"(?sU)^(.*{p})", 1)), F.lit(0)) for p in BREAKS])

            return F.when(end < n, F.coalesce(low + rx.let(_part(pieces, low, end), last), end)).otherwise(end).cast("int")

        def step(acc: Column, _: Column) -> Column:
            def after(end: Column) -> Column:
                return F.struct(
                    F.greatest(acc["start"] + 1, end - overlap).alias("start"), (end >= n).alias("done"),
                    F.concat(acc["all"], F.array(F.struct(acc["start"].alias("start"), end.alias("end")))).alias("all"))

            return F.when(acc["done"], acc).otherwise(rx.let(stop(acc["start"]), after))

        least = max(1, min(size - overlap, max(2, size - REACH - overlap)))  # characters from one start to the next
        steps = F.floor(n / least).cast("int") + 1
        zero = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))
        spans = F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda acc: acc["all"])
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _part(pieces, c["start"], c["end"]).alias("body")))

    return rx.let(F.struct(rx.find_all(text, f"(?s).{{1,{REACH}}}").alias("pieces"), F.length(text).alias("n")), cut)


def _chunk_rows(docs: DataFrame, chunks: Column) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(chunks).alias("chunk", "c")).where("c IS NOT NULL").select(
        "doc_id", "chunk", "c.section", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), F.col("c.body").alias("chunk_text"))


def boundary_chunks(docs: DataFrame, size: int = 8000, overlap: int = 500) -> DataFrame:
    """Chunks that prefer natural breaks. A null text has none."""
    return _chunk_rows(docs, F.transform(chunk_array(F.col("text"), size, overlap), lambda c: F.struct(
        F.lit("").alias("section"), c["start"].alias("start"), c["end"].alias("end"), c["body"].alias("body"))))


SECTION = r"(?mdU)^(#{1,3})\s+(.+)$"


def section_chunks(docs: DataFrame, size: int = 4000, overlap: int = 100) -> DataFrame:
    """One chunk per H1-H3 section, long sections split further; text before the first heading is its own section."""
    text = F.col("text")

    def sections(marks: Column) -> Column:
        head = F.struct(F.lit(0).alias("a"), F.lit("document-start").alias("name"))
        named = F.transform(marks, lambda m: F.struct(m["start"].alias("a"), F.regexp_extract(m["value"], SECTION, 2).alias("name")))
        return rx.let(F.concat(F.array(head), named), lambda all_: F.filter(F.transform(all_, lambda x, i: F.struct(
            x["a"].alias("a"), F.coalesce(F.get(all_, i + 1)["a"], F.length(text)).alias("b"), x["name"].alias("name"))), lambda x: x["b"] > x["a"]))

    def split(pieces: Column) -> Column:
        return F.flatten(F.transform(rx.let(rx.spans(text, SECTION), sections), lambda x: F.transform(
            chunk_array(_part(pieces, x["a"], x["b"]), size, overlap), lambda c: F.struct(
                x["name"].alias("section"), (x["a"] + c["start"]).alias("start"), (x["a"] + c["end"]).alias("end"), c["body"].alias("body")))))

    return _chunk_rows(docs, rx.let(rx.find_all(text, f"(?s).{{1,{REACH}}}"), split))


def token_budget(docs: DataFrame, max_tokens: int, from_start: bool = True) -> DataFrame:
    """Estimate of four characters per token and the text cut to the budget."""
    limit, text = max_tokens * 4, F.col("text")
    cut = (F.concat(F.left(text, F.lit(limit)), F.lit("\n\n[...truncated...]")) if from_start
           else F.concat(F.lit("[...truncated...]\n\n"), F.right(text, F.lit(limit))))
    return docs.select(
        "doc_id", F.floor(F.length(text) / 4).cast("int").alias("tokens"),
        F.when(F.length(text) <= limit, text).otherwise(cut).alias("text"))


def snippet(lines: Column, start: Column, end: Column, context: int = 2, limit: int = 500) -> Column:
    """P20: the evidence lines with context before and after, cut to size."""
    n = F.size(lines)

    def joined(a: Column, b: Column) -> Column:
        """Lines a..b-1, 0-based."""
        return F.array_join(F.slice(lines, a + 1, F.greatest(F.lit(0), b - a)), "\n")

    top = F.greatest(F.lit(0), start - 1)
    body = joined(top, F.least(n, end))
    before = joined(F.greatest(F.lit(0), start - 1 - context), top)
    after = joined(F.least(n, end), F.least(n, end + context))
    return F.struct(
        F.when(F.length(body) > limit, F.concat(F.left(body, F.lit(limit)), F.lit("..."))).otherwise(body).alias("highlighted"),
        F.when(F.length(before) > 200, F.concat(F.lit("..."), F.right(before, F.lit(200)))).otherwise(before).alias("before"),
        F.when(F.length(after) > 200, F.concat(F.left(after, F.lit(200)), F.lit("..."))).otherwise(after).alias("after"))


def multi_range_snippet(lines: Column, ranges: Column, context: int = 1) -> Column:
    """P20 for several ranges (``a``, ``b``: first and last line): joined as listed, with context before the first and after the last alone."""
    n = F.size(lines)

    def joined(a: Column, b: Column) -> Column:
        """Lines a..b-1, 0-based."""
        return F.array_join(F.slice(lines, a + 1, F.greatest(F.lit(0), b - a)), "\n")

    def built(rs: Column) -> Column:
        top = F.greatest(F.lit(0), F.get(rs, F.lit(0))["a"] - 1)
        end = F.least(n, F.get(rs, F.size(rs) - 1)["b"])
        return F.struct(
            F.array_join(F.transform(rs, lambda r: joined(F.greatest(F.lit(0), r["a"] - 1), F.least(n, r["b"]))), "\n...\n").alias("highlighted"),
            F.when(F.size(rs) > 0, joined(F.greatest(F.lit(0), F.get(rs, F.lit(0))["a"] - 1 - context), top)).otherwise("").alias("before"),
            F.when(F.size(rs) > 0, joined(end, F.least(n, end + context))).otherwise("").alias("after"))

    return rx.let(ranges, built)


def category_snippets(reviewed: DataFrame, context: int = 1) -> DataFrame:
    """P20: one snippet for each category of a document, over the lines of all its issues in the order of lines."""
    def one(found: Column, c: Column) -> Column:
        ranges = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda i: i["category"] == c), lambda i: F.struct(i["line_start"].alias("a"), i["line_end"].alias("b")))))
        return F.struct(c.alias("category"), multi_range_snippet(F.col("lines"), ranges, context).alias("s"))

    made = rx.let(F.col("issues"), lambda found: F.transform(F.array_distinct(F.transform(found, lambda i: i["category"])), lambda c: one(found, c)))
    return reviewed.select("doc_id", F.explode_outer(made).alias("x")).where("x IS NOT NULL").select("doc_id", "x.category", "x.s.*")


def issue_snippets(reviewed: DataFrame, context: int = 2) -> DataFrame:
    """P20 for every issue, cut from the row's own lines."""
    made = F.transform("issues", lambda i, n: F.struct(
        n.alias("seq"), i["line_start"].alias("line_start"), i["line_end"].alias("line_end"),
        snippet(F.col("lines"), i["line_start"], i["line_end"], context).alias("s")))
    return reviewed.select("doc_id", F.explode_outer(made).alias("x")).where("x IS NOT NULL").select(
        "doc_id", "x.seq", "x.line_start", "x.line_end", "x.s.highlighted", "x.s.before", "x.s.after")


def jump_targets(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block by index (line_start - 1), else the first block whose lines hold the issue's first line.

    Both sides are read several times, so they are written first: the review and the blocks behind them run once.
    """
    issues = stored(issues.select("doc_id", "seq", "line_start", "line_end"), "jump-issues")
    spans = stored(blocks.select("doc_id", "block_idx", "page_number", "node_id", F.col("line_start").alias("b_start"), F.col("line_end").alias("b_end")), "jump-spans")
    by_index = issues.withColumn("block_idx", F.col("line_start") - 1).join(spans, ["doc_id", "block_idx"], "left")
    direct = by_index.where("node_id IS NOT NULL").select(
        "doc_id", "seq", "block_idx", "page_number", "node_id", F.col("b_start").alias("target_start"), F.col("b_end").alias("target_end"))
    open_issues = by_index.where("node_id IS NULL").select("doc_id", "seq", "line_start", "line_end")
    by_line = stabbed(open_issues, spans, "line_start", "b_start", "b_end", ["block_idx", "page_number", "node_id"]).where("found IS NOT NULL")
    return direct.unionByName(by_line.select("doc_id", "seq", "found.*", F.col("line_start").alias("target_start"), F.col("line_end").alias("target_end")))


def evidence_blocks(issues: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ids of the blocks that start or end inside the issue's lines.

    Issues and the two ends of each block go through one ordered stream of a document with running counts of the ends, which
    give each issue the ranks of the block ends inside it. A document's ends are folded into two arrays by rank, and each issue
    takes its slices of them. Rows moved are issues + blocks, in one shuffle; matches are made within the document's row.
    """
    ends = blocks.select("doc_id", "node_id", F.inline(F.array(
        F.struct(F.lit("start").alias("side"), F.col("line_start").alias("at")), F.struct(F.lit("end").alias("side"), F.col("line_end").alias("at")))))
    asked = issues.select("doc_id", "seq", F.inline(F.array(
        F.struct(F.lit(-1).alias("turn"), F.col("line_start").alias("at")), F.struct(F.lit(1).alias("turn"), F.col("line_end").alias("at")))))
    stream = ends.withColumn("turn", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("doc_id").orderBy("at", "turn", "node_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = stream.withColumns({side: F.count_if(F.col("side") == side).over(upto).cast("int") for side in ("start", "end")})
    own = lambda side, turn: F.max(F.when(F.col("turn") == turn, F.col(side)))
    by_rank = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(F.col(side).alias("rank"), "node_id"))))
    each = counted.groupBy("doc_id", (F.col("turn") == 0).alias("is_block"), "seq").agg(
        *[F.struct(own(s, -1).alias("a"), own(s, 1).alias("b"), by_rank(s).alias("nodes")).alias(s) for s in ("start", "end")])
    documents = each.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("is_block"), F.struct("seq", *[F.struct(f"{s}.a", f"{s}.b").alias(s) for s in ("start", "end")]))).alias("asked"),
        *[F.first(F.when(F.col("is_block"), F.col(f"{s}.nodes")), ignorenulls=True).alias(f"{s}_nodes") for s in ("start", "end")])
    inside = lambda i, s: F.transform(
        F.slice(f"{s}_nodes", i[s]["a"] + 1, F.greatest(F.lit(0), i[s]["b"] - i[s]["a"])), lambda x: x["node_id"])
    found = F.transform("asked", lambda i: F.struct(
        i["seq"].alias("seq"), F.array_sort(F.array_compact(F.array_distinct(F.concat(*[inside(i, s) for s in ("start", "end")])))).alias("node_ids")))
    return documents.select("doc_id", F.explode_outer(found).alias("x")).where(F.size("x.node_ids") > 0).select("doc_id", "x.*")


def table_captions(blocks: DataFrame) -> DataFrame:
    """Caption of a table block from its neighbour that names a table, the one before first."""
    w = by_block()
    named = lambda c: F.when(rx.strip(c).rlike("(?i)table|Bảng"), rx.strip(c))
    return blocks.withColumn("found", F.coalesce(named(F.lag("text").over(w)), named(F.lead("text").over(w)), F.lit(""))).where(
        "type = 'table'").select("doc_id", "block_idx", F.col("found").alias("caption"))
