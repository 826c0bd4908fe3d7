"""Structure rules: title, abstract, key sections, order, empty and duplicate sections."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ...fixed import words as W
from ...functions import rx
from ...functions.findings import issue, none, only_if, present
from ..parse import Doc


def title_check(d: Doc, cfg: dict) -> Column:
    first = F.get(d.headings, F.lit(0))
    return (
        F.when(F.size(d.headings) == 0, F.array(issue("no-title")))
        .when(first["level"] != 1,
              F.array(issue("title-not-h1", line=first["line_no"], fix=True, level=first["level"], title=first["title"])))
        .otherwise(none())
    )


def abstract_check(d: Doc, cfg: dict) -> Column:
    """Word count from the abstract heading to the next heading."""
    low, high = cfg["min_abstract_words"], cfg["max_abstract_words"]
    section = F.get(F.filter(d.sections, lambda s: s["key"].isin(W.ABSTRACT_HEADINGS)), F.lit(0))
    body = rx.limited(d.section_lines(section, include_next_heading=False), cfg["max_abstract_lines"])
    words = F.aggregate(body, F.lit(0), lambda acc, line: acc + rx.word_count(line))
    sized = F.transform(F.array(words), lambda n: (
        F.when(n < low, issue("abstract-too-short", line=section["line_no"], words=n, limit=low))
        .when(n > high, issue("abstract-too-long", line=section["line_no"], words=n, limit=high))
    ))
    return (
        F.when(section.isNotNull(), F.array_compact(sized))
        .when(d.is_profile("academic", "business"), F.array(issue("missing-abstract", profile=d.profile_name)))
        .otherwise(none())
    )


def key_sections_check(d: Doc, cfg: dict) -> Column:
    def missing(key: str, display: str, severity: str, others: list[str]) -> Column:
        found = F.exists(d.headings, lambda h: h["key"].contains(key) | (h["key"].isin(others) if others else F.lit(False)))
        return F.when(~found, issue("missing-key-section", key=key, display=display, severity=severity))

    return F.when(d.is_profile("academic"), present(*[missing(*row) for row in W.KEY_SECTIONS])).otherwise(none())


def section_order(d: Doc, cfg: dict) -> Column:
    """Adjacent first occurrences of known sections whose expected position goes down."""
    names = rx.strings(W.SECTION_ORDER)
    mapped = F.transform(
        d.headings,
        lambda h: F.struct(
            F.array_position(
                F.transform(names, lambda name: h["key"].contains(name) | F.contains(name, h["key"])), True
            ).cast("int").alias("rank"),
            h["line_no"].alias("line_no"),
        ),
    )
    known = F.filter(mapped, lambda m: m["rank"] > 0)
    first_seen = rx.let(known, lambda ks: rx.let(
        F.transform(ks, lambda m: m["rank"]),
        lambda ranks: F.filter(ks, lambda m, i: F.array_position(ranks, m["rank"]) == i + 1)))

    def step(seen: Column, current: Column, i: Column) -> Column:
        before = F.get(seen, i - 1)
        name, previous = F.get(names, current["rank"] - 1), F.get(names, before["rank"] - 1)
        return F.when(
            (i > 0) & (current["rank"] < before["rank"]),
            issue("wrong-order", line=before["line_no"], last_line=current["line_no"], key=name,
                  current=rx.title_case(name), previous=rx.title_case(previous),
                  current_line=current["line_no"], previous_line=before["line_no"]),
        )

    return F.when(
        d.is_profile("academic"),
        rx.let(first_seen, lambda seen: F.array_compact(F.transform(seen, lambda current, i: step(seen, current, i)))),
    ).otherwise(none())


def empty_section(d: Doc, cfg: dict) -> Column:
    limit = cfg["min_section_words"]

    titles = F.transform(d.headings, lambda h: F.struct(h["title"].alias("title"), F.lower(h["title"]).alias("low")))

    def words_of(section: Column, names: Column) -> Column:
        def add(total: Column, line: Column) -> Column:
            # bound, or every heading would lower the line again
            names_other = rx.let(F.lower(rx.strip(line)), lambda bare: F.exists(
                names, lambda h: F.startswith(bare, h["low"]) & (h["title"] != section["title"])))
            # a section with enough words stays so
            return F.when(total >= limit, total).otherwise(total + F.when(names_other, F.lit(0)).otherwise(rx.word_count(line)))

        return F.aggregate(d.section_lines(section, include_next_heading=True), F.lit(0), add)

    checked = F.filter(
        d.sections,
        lambda s: ~((s["idx"] == 0) & (s["level"] == 1)) & ~s["key"].isin(W.UNCOUNTED_SECTIONS))
    sized = rx.let(titles, lambda names: F.transform(
        checked, lambda s: F.struct(s.alias("s"), words_of(s, names).alias("words"))))
    return F.transform(
        F.filter(sized, lambda x: x["words"] < limit),
        lambda x: issue("empty-section", line=x["s"]["line_no"], last_line=x["s"]["next_line"], index=x["s"]["idx"],
                        title=x["s"]["title"], words=x["words"]),
    )


def duplicate_section(d: Doc, cfg: dict) -> Column:
    keys = F.transform(d.headings, lambda h: h["key"])
    repeated = F.filter(
        F.transform(
            F.array_distinct(keys),
            lambda k: F.struct(
                k.alias("key"),
                F.transform(F.filter(d.headings, lambda h: h["key"] == k), lambda h: h["line_no"]).alias("at")),
        ),
        lambda x: F.size(x["at"]) > 1,
    )
    return F.transform(
        repeated,
        lambda x: issue("duplicate-section", line=x["at"][0], last_line=F.element_at(x["at"], -1),
                        slug=F.replace(x["key"], F.lit(" "), F.lit("-")), title=rx.title_case(x["key"]),
                        count=F.size(x["at"]), all_lines=F.array_join(x["at"].cast("array<string>"), ", ")),
    )


def section_length_variance(d: Doc, cfg: dict) -> Column:
    sized = F.transform(
        d.sections,
        lambda s: F.struct(
            s["title"].alias("title"),
            F.aggregate(d.section_lines(s, include_next_heading=True), F.lit(0),
                        lambda acc, line: acc + rx.word_count(line)).alias("words")),
    )

    def large(entry: Column) -> Column:
        total = F.aggregate(entry, F.lit(0), lambda acc, x: acc + x["words"])
        mean = total / F.size(entry)
        return F.when(
            mean >= 20,
            F.transform(
                F.filter(entry, lambda x: x["words"] > mean * cfg["variance_ratio"]),
                lambda x: issue("section-too-large", slug=F.replace(F.left(x["title"], F.lit(20)), F.lit(" "), F.lit("-")),
                                title=x["title"], words=x["words"], ratio=rx.half_even(x["words"] / mean, 1),
                                average=rx.half_even(mean)),
            ),
        ).otherwise(none())

    return F.when(
        F.size(d.sections) >= 3, rx.let(sized, large)
    ).otherwise(none())


def keywords_check(d: Doc, cfg: dict) -> Column:
    at = F.get(F.filter(d.headings, lambda h: h["key"].contains("keyword")), F.lit(0))["line_no"]
    following = rx.strip(F.get(d.lines, at))
    return (
        F.when(~d.is_profile("academic"), none())
        .when(at.isNull(), F.array(issue("missing-keywords")))
        .when((at < d.n_lines - 1) & ((following == "") | following.startswith("#")),
              F.array(issue("keywords-empty", line=at)))
        .otherwise(none())
    )


def sop_required_fields(d: Doc, cfg: dict) -> Column:
    def missing(key: str, display: str) -> Column:
        return F.when(~F.exists(d.headings, lambda h: h["key"].isin(key, key + "s")),
                      issue("sop-missing", key=key, display=display))

    return F.when(d.is_profile("sop"), present(*[missing(*row) for row in W.SOP_FIELDS])).otherwise(none())


def missing_required(d: Doc, key: str) -> Column:
    absent = rx.let(
        F.transform(d.headings, lambda h: F.lower(h["title"])),
        lambda titles: F.filter(d.required_sections, lambda s: ~F.array_contains(titles, F.lower(s))))
    return F.transform(
        absent, lambda s: issue(key, slug=F.replace(F.lower(s), F.lit(" "), F.lit("-")), section=s))


def required_section(d: Doc, cfg: dict) -> Column:
    return missing_required(d, "required-section")


def heading_hierarchy(d: Doc, cfg: dict) -> Column:
    jumps = F.filter(d.headings, lambda h, i: (i > 0) & (h["level"] > F.get(d.headings, i - 1)["level"] + 1))
    return F.transform(jumps, lambda h: issue("heading-gap", fix=True, level=h["level"]))


RULES = {
    "structure.title-check": title_check, "structure.abstract-check": abstract_check,
    "structure.key-sections-check": key_sections_check, "structure.section-order": section_order,
    "structure.empty-section": empty_section, "structure.duplicate-section": duplicate_section,
    "structure.section-length-variance": section_length_variance, "structure.keywords-check": keywords_check,
    "structure.sop-required-fields": sop_required_fields, "structure.required-section": required_section,
    "structure.heading-hierarchy": heading_hierarchy,
}
