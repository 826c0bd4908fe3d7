"""Format rules and figure / table rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ...fixed import words as W
from ...functions import rx
from ...functions.findings import issue, none, only_if, present
from ..parse import Doc
from .structure import missing_required


def heading_numbering(d: Doc, cfg: dict) -> Column:
    decimal, roman = rx.exact(W.NUMBERED_HEADING), rx.exact(W.ROMAN_HEADING)
    kinds = F.transform(d.headings, lambda h: (
        F.when(h["title"].rlike(decimal), F.lit("d")).when(h["title"].rlike(roman), F.lit("r")).otherwise(F.lit("u"))))
    return rx.let(kinds, lambda ks: only_if(
        (F.size(ks) >= 2) & (F.size(F.array_distinct(ks)) > 1),
        issue("mixed-numbering",
              numbered=F.size(F.filter(ks, lambda k: k == "d")), unnumbered=F.size(F.filter(ks, lambda k: k == "u")),
              roman=F.size(F.filter(ks, lambda k: k == "r")))))


def heading_hierarchy_deep(d: Doc, cfg: dict) -> Column:
    levels = F.transform(d.headings, lambda h: h["level"])
    jumps = F.filter(
        F.transform(d.headings, lambda h, i: F.struct(
            i.alias("i"), F.get(d.headings, i - 1)["level"].alias("upper"), h["level"].alias("lower"))),
        lambda j: (j["i"] > 0) & (j["lower"] > j["upper"] + 1))
    skips = F.transform(jumps, lambda j: issue(
        "heading-skip", fix=True, index=j["i"] - 1, position=j["i"] + 1, upper=j["upper"], lower=j["lower"],
        wanted=j["upper"] + 1))
    deepest, first = F.array_max(levels), F.get(levels, F.lit(0))
    return F.concat(skips, present(
        F.when(deepest > 4, issue("heading-too-deep", level=deepest)),
        F.when(first != 1, issue("first-heading-not-h1", fix=True, level=first))))


def required_sections_depth(d: Doc, cfg: dict) -> Column:
    return missing_required(d, "missing-section")


def section_length(d: Doc, cfg: dict) -> Column:
    low, high = cfg["min_words"], cfg["max_words"]
    sized = F.transform(d.sections, lambda s: F.struct(
        s.alias("s"),
        F.aggregate(d.section_lines(s, include_next_heading=False), F.lit(0),
                    lambda acc, line: acc + rx.word_count(line)).alias("words")))

    def judge(x: Column) -> Column:
        s = x["s"]
        at = dict(line=s["line_no"], last_line=s["next_line"] - s["has_next"].cast("int"), index=s["idx"],
                  title=s["title"], words=x["words"])
        return F.when(x["words"] < low, issue("short-section", limit=low, **at)).when(
            x["words"] > high, issue("long-section", limit=high, **at))

    return F.when(
        F.size(d.sections) >= 2, F.filter(F.transform(sized, judge), lambda x: x.isNotNull())).otherwise(none())


def block_format(d: Doc, cfg: dict) -> Column:
    fonts = F.array_sort(F.array_distinct(F.transform(
        F.filter(d.blocks, lambda b: (b["type"] == "heading") & (b["font_name"] != "")),
        lambda b: F.lower(b["font_name"]))))
    aligned = F.transform(
        F.filter(d.blocks, lambda b: b["type"].isin("paragraph", "heading")), lambda b: b["alignment"])
    seen = F.array_sort(F.array_distinct(rx.limited(aligned, cfg["max_aligned_blocks"])))
    return present(
        F.when(F.size(fonts) > 1, issue("heading-font", fonts=F.array_join(fonts, ", "))),
        F.when((F.size(aligned) >= 3) & (F.size(seen) > 2),
               issue("mixed-alignment", alignments=F.array_join(seen, ", "))))


# --- figures and tables ----------------------------------------------------------------


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def numbering(d: Doc, kind: str, word: str, key: str, limit: int | None = None) -> Column:
    """Numbers that break the run; block captions count first, caption lines only without them."""
    pattern = rx.fold(word)
    from_blocks = F.transform(d.blocks, lambda b: (
        F.when((b["type"] == kind) & (b["caption"] != ""), first_number(b["caption"]))
        .when((b["type"] == "caption") & b["text"].rlike(pattern), first_number(b["text"]))))
    from_blocks = F.filter(from_blocks, lambda n: n.isNotNull())
    from_lines = F.transform(
        F.filter(d.captions, lambda c: c["whole"].rlike(pattern) & c["number"].isNotNull()), lambda c: c["number"])
    numbers = F.when(F.size(from_blocks) > 0, from_blocks).otherwise(from_lines)

    def judge(ns: Column) -> Column:
        off = F.filter(
            F.transform(ns, lambda n, i: F.struct(n.alias("n"), (F.get(ns, F.lit(0)) + i).alias("expected"))),
            lambda x: x["n"] != x["expected"])
        return F.transform(rx.limited(off, limit), lambda x: issue(key, number=x["n"], expected=x["expected"]))

    return rx.let(numbers, judge)


def figure_numbering(d: Doc, cfg: dict) -> Column:
    return numbering(d, "figure", W.FIGURE_WORD, "figure-gap", cfg["max_gaps"])


def table_numbering(d: Doc, cfg: dict) -> Column:
    return numbering(d, "table", W.TABLE_WORD, "table-gap", cfg["max_gaps"])


def uncaptioned(d: Doc, kind: str, key: str) -> Column:
    return F.transform(
        F.filter(d.blocks, lambda b: (b["type"] == kind) & (b["caption"] == "")),
        lambda b: issue(key, line=b["line_start"], last_line=b["line_end"], node=F.left(b["node_id"], F.lit(8))))


def missing_figure_caption(d: Doc, cfg: dict) -> Column:
    def placeholder(line: Column, i: Column) -> Column:
        following = F.coalesce(F.get(d.lines, i + 1), F.lit(""))
        empty_slot = F.lit(False)
        for pattern in W.PLACEHOLDERS:
            empty_slot = empty_slot | line.rlike(rx.fold(pattern))
        return F.when(
            line.contains("![") & line.rlike(W.IMAGE) & (following != "") & ~following.rlike(rx.fold(r"figure|fig\."))
            & empty_slot,
            issue("placeholder", line=i + 1, excerpt=F.left(line, F.lit(200))))

    slots = F.when(d.text.contains("!["), F.array_compact(F.transform(d.lines, placeholder))).otherwise(none())
    return F.concat(uncaptioned(d, "figure", "missing-caption"), slots)


def missing_table_caption(d: Doc, cfg: dict) -> Column:
    return uncaptioned(d, "table", "missing-table-caption")


def references_to(d: Doc, pattern: str) -> Column:
    """(no, line, k) per reference to a whole number."""
    found = F.transform(d.matches(rx.fold(pattern), 1), lambda h: F.struct(
        h["no"].alias("no"), h["line"].alias("line"), h["k"].try_cast("int").alias("k")))
    return F.filter(found, lambda h: h["k"].isNotNull())


def cross_reference(d: Doc, cfg: dict) -> Column:
    def of_blocks(kind: str) -> Column:
        return F.filter(
            F.transform(F.filter(d.blocks, lambda b: (b["type"] == kind) & (b["caption"] != "")),
                        lambda b: first_number(b["caption"])), lambda n: n.isNotNull())

    numbered = F.filter(d.captions, lambda c: c["number"].isNotNull())
    fig = lambda c: F.lower(c["whole"]).contains("fig")
    tab = lambda c: ~fig(c) & F.lower(c["whole"]).contains("table")
    figures = F.array_union(of_blocks("figure"), F.transform(F.filter(numbered, fig), lambda c: c["number"]))
    tables = F.array_union(of_blocks("table"), F.transform(F.filter(numbered, tab), lambda c: c["number"]))

    def dangling(refs: Column, actual: Column, key: str) -> Column:
        missing = F.filter(refs, lambda h: ~F.array_contains(actual, h["k"]))
        return F.when(F.size(actual) > 0, F.transform(missing, lambda h: issue(
            key, line=h["no"], number=h["k"], excerpt=F.left(h["line"], F.lit(200))))).otherwise(none())

    def judge(x: Column) -> Column:
        unused = F.array_sort(F.filter(
            x["figures"], lambda n: ~F.exists(x["figure_refs"], lambda h: h["k"] == n)))
        return F.concat(
            dangling(x["figure_refs"], x["figures"], "figure-ref"), dangling(x["table_refs"], x["tables"], "table-ref"),
            F.transform(unused, lambda n: issue("figure-unused", number=n)))

    seen = F.struct(
        figures.alias("figures"), tables.alias("tables"), references_to(d, W.FIGURE_REF).alias("figure_refs"),
        references_to(d, W.TABLE_REF).alias("table_refs"))
    return F.when((F.size(figures) > 0) | (F.size(tables) > 0), rx.let(seen, judge)).otherwise(none())


def caption_format(d: Doc, cfg: dict) -> Column:
    def judge(c: Column) -> Column:
        at = dict(line=c["line_no"])
        cut = F.left(c["text"], F.lit(200))
        return (
            F.when(c["text"] == "", F.array(issue(
                "caption-empty", prefix=c["whole"], excerpt=F.left(c["line"], F.lit(200)), **at)))
            .otherwise(present(
                F.when(d.is_profile("academic") & ~F.endswith(c["text"], F.lit(".")),
                       issue("caption-period", fix=True, prefix=c["whole"], excerpt=cut, **at)),
                F.when(F.length(c["text"]) > 300,
                       issue("caption-long", chars=F.length(c["text"]), excerpt=cut, **at)))))

    return F.flatten(F.transform(d.captions, judge))


def cited_but_missing(d: Doc, kind: str, word: str, pattern: str, opening: str, key: str) -> Column:
    refs = F.when(d.lower.contains(word), rx.count(d.text, rx.fold(pattern))).otherwise(F.lit(0))
    exists = F.exists(d.blocks, lambda b: b["type"] == kind) | d.lower.rlike(opening)
    return only_if(~exists & (refs > 0), issue(key, count=refs))


def figure_cited_missing(d: Doc, cfg: dict) -> Column:
    return cited_but_missing(d, "figure", "fig", W.FIGURE_REF, r"(?mU)^(figure|fig\.)\s+\d", "figures-missing")


def table_cited_missing(d: Doc, cfg: dict) -> Column:
    return cited_but_missing(d, "table", "tabl", W.TABLE_REF, r"(?mU)^(table)\s+\d", "tables-missing")


def equation_numbering(d: Doc, cfg: dict) -> Column:
    equations = F.filter(d.blocks, lambda b: b["type"] == "equation")
    return rx.let(equations, lambda e: only_if(
        (F.size(e) >= 3) & ~F.exists(e, lambda b: b["text"].rlike(r"\(\d+\)")),
        issue("equations", count=F.size(e))))


RULES = {
    "format.heading-numbering": heading_numbering, "format.heading-hierarchy-deep": heading_hierarchy_deep,
    "format.required-sections-depth": required_sections_depth, "format.section-length": section_length,
    "format.block-format": block_format,
    "figure.numbering-sequential": figure_numbering, "figure.table-numbering": table_numbering,
    "figure.missing-caption": missing_figure_caption, "figure.missing-table-caption": missing_table_caption,
    "figure.cross-reference": cross_reference, "figure.caption-format": caption_format,
    "figure.cited-missing": figure_cited_missing, "figure.table-cited-missing": table_cited_missing,
    "figure.equation-numbering": equation_numbering,
}
