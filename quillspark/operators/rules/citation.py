"""Citation rules: styles, reference lists, years, links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ...fixed import words as W
from ...functions import rx
from ...functions.findings import issue, none, only_if, present
from ..parse import Doc


def ints(texts: Column) -> Column:
    """Whole numbers of a string array; digit runs too long for a bigint are left out."""
    return F.filter(F.transform(texts, lambda t: t.try_cast("bigint")), lambda n: n.isNotNull())


def numbers_in(groups: Column) -> Column:
    return ints(F.flatten(F.transform(groups, lambda g: rx.find_all(g, r"\d+"))))


def citation_count(d: Doc) -> Column:
    """Five overlapping patterns, summed; a citation may count twice."""
    c = d.cites
    return c["apa"] + c["narrative"] + c["ieee"] + c["et_al"] + c["pair"]


def reference_mismatch(d: Doc, cfg: dict) -> Column:
    n, refs = citation_count(d), F.size(d.refs)
    return (
        F.when(d.is_profile("technical_design"), none())
        .when((refs == 0) & (n > 0), F.array(issue("missing-reference-list", count=n)))
        .when((refs > 0) & (n == 0), F.array(
            issue("orphan-references", count=refs, excerpt=F.left(F.get(d.refs, F.lit(0)), F.lit(200)))))
        .otherwise(none())
    )


def year_validity(d: Doc, cfg: dict) -> Column:
    years = ints(F.concat(rx.find_all(d.text, rx.exact(W.YEAR_IN_PARENS), 1),
                          rx.find_all(d.text, rx.exact(W.YEAR_AFTER_AUTHOR), 1)))
    odd = F.array_compact(F.transform(years, lambda y: (
        F.when((y < W.FIRST_YEAR) | (y > W.CURRENT_YEAR), issue("invalid-year", year=y))
        .when(y > W.CURRENT_YEAR - 1, issue("future-year", year=y)))))
    return F.when(d.text.contains("("), odd).otherwise(none())


def opening(text: Column, chars: int | None) -> Column:
    """The first characters of a text; all of it without a limit."""
    return text if chars is None else F.left(text, F.lit(chars))


def apa_format(d: Doc, cfg: dict) -> Column:
    groups = F.filter(
        d.matches(r"\([^)]{3,}\)"),
        lambda h: h["k"].rlike("[A-Z]") & h["k"].rlike(rx.exact(r"\d{4}"))
        & ~h["k"].rlike(rx.exact(W.APA_IN_TEXT)) & ~opening(h["line"], cfg["narrative_chars"]).rlike(rx.exact(W.APA_NARRATIVE)))
    found = F.transform(groups, lambda h: issue("apa-format", line=h["no"], excerpt=F.left(h["k"], F.lit(200))))
    return F.when(d.text.contains("("), found).otherwise(none())


def apa_heading(d: Doc, cfg: dict) -> Column:
    named = F.exists(d.headings, lambda h: h["title"].rlike(rx.fold(r"^(references|bibliography)$")))
    return only_if((F.size(d.refs) > 0) & ~named, issue("apa-no-heading", count=F.size(d.refs)))


def ieee_format(d: Doc, cfg: dict) -> Column:
    numbers = numbers_in(rx.find_all(d.text, rx.exact(W.IEEE)))

    def judge(n: Column) -> Column:
        first_seen = F.array_distinct(n)
        in_order = first_seen == F.sequence(F.lit(1).cast("bigint"), F.size(first_seen).cast("bigint"))
        return F.when(
            F.size(n) > 0,
            present(
                F.when(F.get(n, F.lit(0)) != 1, issue("ieee-start", number=F.get(n, F.lit(0)))),
                F.when(~in_order, issue(
                    "ieee-order", numbers=F.array_join(rx.limited(n, cfg["max_listed_numbers"]).cast("array<string>"), ", "))),
            ),
        ).otherwise(none())

    return F.when(d.cites["ieee"] > 0, rx.let(numbers, judge)).otherwise(none())


def doi_validation(d: Doc, cfg: dict) -> Column:
    dois = F.filter(rx.find_all(d.text, rx.exact(W.DOI_URL)), lambda x: x.rlike(r"doi\.org/$"))
    urls = F.filter(
        rx.find_all(d.text, rx.exact(W.URL)),
        lambda u: ~F.regexp_extract(u, r"^https?://([^/?#]*)", 1).contains("."))
    return F.when(
        d.text.contains("doi.org/") | d.text.contains("://"),
        F.concat(
            F.transform(dois, lambda x: issue("doi-empty", excerpt=F.left(x, F.lit(200)))),
            F.transform(urls, lambda u: issue(
                "broken-url", short=F.left(u, F.lit(60)), excerpt=F.left(u, F.lit(200))))),
    ).otherwise(none())


def lowest_not_one(numbers: Column, key: str) -> Column:
    return rx.let(F.array_min(numbers), lambda lowest: only_if(
        F.coalesce(lowest != 1, F.lit(False)), issue(key, number=lowest)))


def acm_format(d: Doc, cfg: dict) -> Column:
    return F.when(
        d.cites["bracket"] > 0,
        lowest_not_one(ints(rx.find_all(d.text, rx.exact(W.ACM_BRACKET), 1)), "acm-start")).otherwise(none())


def acm_reference_format(d: Doc, cfg: dict) -> Column:
    unusual = F.filter(
        F.transform(d.refs, lambda r, i: F.struct(r.alias("ref"), i.alias("i"))),
        lambda x: ~x["ref"].startswith("[")
        & ~((x["i"] + 1 < F.size(d.refs)) & x["ref"].rlike(r"^\p{Nd}"))
        & ~x["ref"].rlike(rx.exact(W.ACM_INITIALS)))
    return F.transform(rx.limited(unusual, cfg["max_acm_references"]), lambda x: issue(
        "acm-reference", index=x["i"], position=x["i"] + 1, excerpt=F.left(x["ref"], F.lit(200))))


def nature_format(d: Doc, cfg: dict) -> Column:
    return F.when(
        d.text.contains("^"),
        lowest_not_one(numbers_in(rx.find_all(d.text, rx.exact(W.NATURE_SUPERSCRIPT), 1)), "nature-start"),
    ).otherwise(none())


def springer_format(d: Doc, cfg: dict) -> Column:
    n = d.cites["springer"]
    return only_if((F.size(d.refs) == 0) & (n > 0), issue("springer-no-refs", count=n))


def elsevier_format(d: Doc, cfg: dict) -> Column:
    first = F.get(numbers_in(rx.find_all(d.text, rx.exact(W.ELSEVIER))), F.lit(0))
    return F.when(d.text.contains("["), rx.let(first, lambda n: only_if(
        F.coalesce(n != 1, F.lit(False)), issue("elsevier-start", number=n)))).otherwise(none())


def style_consistency(d: Doc, cfg: dict) -> Column:
    counts = [
        ("APA", d.cites["apa"] + d.cites["narrative"]), ("IEEE", d.cites["ieee"]), ("ACM", d.cites["bracket"]),
        ("Author-Year", d.cites["springer"]),
    ]
    styles = F.array_compact(F.array(*[
        F.when(n > 0, F.concat(F.lit(f"{name} ("), n.cast("string"), F.lit("x)"))) for name, n in counts]))
    return rx.let(styles, lambda s: only_if(F.size(s) > 1, issue("mixed-styles", styles=F.array_join(s, ", "))))


def duplicate_reference(d: Doc, cfg: dict) -> Column:
    keyed = F.transform(d.refs, lambda r, i: F.struct(
        rx.strip(F.lower(opening(r, cfg["reference_key_chars"]))).alias("key"), i.alias("i"), r.alias("ref")))
    later = rx.repeats(keyed, "key", "i")
    return F.transform(later, lambda x: issue(
        "duplicate-ref", index=x["i"], position=x["i"] + 1, excerpt=F.left(x["ref"], F.lit(200))))


def reference_list(d: Doc, cfg: dict) -> Column:
    cited, refs = d.text.rlike(rx.exact(W.LOOSE_CITATION)), F.size(d.refs)
    return (
        F.when((refs == 0) & cited, F.array(issue("list-missing")))
        .when((refs > 0) & ~cited,
              F.array(issue("list-orphan", excerpt=F.left(F.get(d.refs, F.lit(0)), F.lit(220)))))
        .otherwise(none())
    )


RULES = {
    "citation.in-text-reference-mismatch": reference_mismatch, "citation.year-validity": year_validity,
    "citation.apa-format": apa_format, "citation.apa-heading": apa_heading, "citation.ieee-format": ieee_format,
    "citation.doi-validation": doi_validation, "citation.acm-format": acm_format,
    "citation.acm-reference-format": acm_reference_format, "citation.nature-format": nature_format,
    "citation.springer-format": springer_format, "citation.elsevier-format": elsevier_format,
    "citation.style-consistency": style_consistency, "citation.duplicate-reference": duplicate_reference,
    "citation.reference-list": reference_list,
}
