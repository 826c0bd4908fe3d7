"""Logic rules: acronyms, transitions, repeats, scope, contradictions, claims, numbers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ...fixed import words as W
from ...functions import rx
from ...functions.findings import issue, none, only_if, present
from ..parse import Doc, shows


def cut(line: Column) -> Column:
    return F.left(line, F.lit(200))


def undefined_acronym(d: Doc, cfg: dict) -> Column:
    def judge(defined: Column) -> Column:
        used = F.filter(
            d.matches(rx.led("A-Z", rx.exact(W.ACRONYM))),
            lambda h: (F.length(h["k"]) <= 8) & ~h["k"].isin(W.ACRONYM_STOP) & ~F.array_contains(defined, h["k"]))
        return F.transform(used, lambda h: issue("acronym", line=h["no"], acronym=h["k"], excerpt=cut(h["line"])))

    return F.when(
        d.text.rlike("[A-Z][A-Z]"), rx.let(rx.find_all(d.text, rx.exact(W.ACRONYM_DEFINED), 1), judge)
    ).otherwise(none())


def paragraphs(text: Column) -> Column:
    """Blank-line groups as joined text."""
    pieces = F.split(text, r"(?U)(?:^|\n)(?:[^\S\n]*\n)+|\n[^\S\n]*\z", -1)
    return F.filter(pieces, lambda p: rx.strip(p) != "")


def missing_transition(d: Doc, cfg: dict) -> Column:
    def judge(sized: Column) -> Column:
        starts = lambda p: reduce(or_, [p["first"].startswith(w) for w in W.TRANSITIONS])
        abrupt = F.filter(sized, lambda p: (p["i"] > 0) & (p["n"] >= cfg["min_paragraph_lines"]) & ~starts(p))
        return rx.let(rx.running(F.transform(sized, lambda p: p["n"])), lambda ends: F.transform(abrupt, lambda p: issue(
            "transition", line=(F.get(ends, p["i"] - 1) + 1).cast("int"), index=p["i"], position=p["i"] + 1, excerpt=cut(p["first"]))))

    return rx.let(
        F.transform(paragraphs(d.text), lambda g, i: F.struct(
            i.alias("i"), F.lower(F.substring_index(g, "\n", 1)).alias("first"), (rx.literal_count(g, "\n") + 1).alias("n"))),
        judge)


def duplicate_content(d: Doc, cfg: dict) -> Column:
    def fingerprint(words: Column) -> Column:
        return F.when(
            F.size(words) >= 5,
            F.array_join(rx.limited(F.filter(words, lambda w: F.length(w) > 3), cfg["fingerprint_words"]), " "))

    prints = F.filter(
        F.transform(d.tokens, lambda ws, i: F.struct(fingerprint(ws).alias("p"), (i + 1).alias("no"))), lambda x: x["p"].isNotNull())
    return F.transform(rx.limited(rx.repeats(prints, "p", "no"), cfg["max_duplicates"]), lambda x: issue(
        "duplicate", line=x["no"], excerpt=cut(F.element_at(d.lines, x["no"]))))


def scope_mismatch(d: Doc, cfg: dict) -> Column:
    """Capitalised terms of the plain-text conclusion that the first half never uses."""
    opened, closed = rx.fold(W.CONCLUSION_OPEN), rx.fold(W.CONCLUSION_CLOSE)
    start = F.struct(F.lit(False).alias("inside"), F.lit("").alias("text"))

    def walk(state: Column, line: Column) -> Column:
        bare = rx.strip(line)
        opens, closes = bare.rlike(opened), bare.rlike(closed)
        keep = state["inside"] & ~opens & ~closes
        return F.struct(
            (opens | (state["inside"] & ~closes)).alias("inside"),
            F.when(keep, F.concat(state["text"], line, F.lit(" "))).otherwise(state["text"]).alias("text"))

    half = F.lower(F.array_join(F.slice(d.lines, F.lit(1), F.floor(d.n_lines / 2).cast("int")), " "))

    def judge(text: Column) -> Column:
        terms = rx.limited(rx.find_all(text, rx.exact(r"\b[A-Z][a-z]{3,}\b")), cfg["max_scope_terms"])
        return rx.let(half, lambda body: F.transform(
            F.filter(terms, lambda t: ~F.contains(body, F.lower(t))),
            lambda t: issue("scope", term=t, term_lower=F.lower(t))))

    marked = d.text.rlike("(?m)" + rx.fold(W.CONCLUSION_OPEN.replace("^", r"^\s*")))
    return F.when(
        marked, rx.let(F.aggregate(d.lines, start, walk, lambda s: s["text"]), judge)
    ).otherwise(none())


def contradictions(d: Doc, cfg: dict) -> Column:
    limit = cfg["max_contrast_words"]

    def words_used(pattern: str) -> Column:
        used = rx.limited(rx.find_all(d.lower, rx.exact(pattern)), limit)
        return F.concat(F.lit(r"(?U)\b(?:"), F.array_join(F.array_distinct(used), "|"), F.lit(r")\b"))

    def worth(marks: Column) -> Column:
        return shows(marks, W.ABSOLUTE_WORDS) & shows(marks, W.QUALIFIER_WORDS)

    def on_lines(absolute: Column, qualifier: Column) -> Column:
        both = d.lines_where(lambda line: rx.let(F.lower(line), lambda low: F.when(
            F.rlike(low, absolute) & F.rlike(low, qualifier), F.lit(1))), worth=worth)
        return F.transform(rx.limited(both, cfg["max_contradictions"]), lambda x: issue(
            "contradiction", line=x["no"], index=x["no"] - 1, excerpt=cut(x["line"])))

    if limit is None:  # the words that the text uses find what all words find
        clash = on_lines(F.lit(rx.exact(W.ABSOLUTES)), F.lit(rx.exact(W.QUALIFIERS)))
    else:
        clash = rx.let(F.struct(
            words_used(W.ABSOLUTES).alias("absolute"), words_used(W.QUALIFIERS).alias("qualifier")), lambda p: on_lines(p["absolute"], p["qualifier"]))
        clash = F.when(d.lower.rlike(rx.exact(W.ABSOLUTES)) & d.lower.rlike(rx.exact(W.QUALIFIERS)), clash).otherwise(none())
    clash = F.when(d.uses(W.ABSOLUTE_WORDS) & d.uses(W.QUALIFIER_WORDS), clash).otherwise(none())

    near = rx.let(
        F.split(d.lower, rx.led("icho", rx.exact(W.CONTRAST_MARKERS)), 2),
        lambda pieces: rx.let(F.when(F.size(pieces) > 1, F.length(pieces[0])), lambda contrast: F.exists(
            rx.positions(d.lower, rx.led("sli", rx.exact(W.SIMILARITY_MARKERS))), lambda s: F.abs(s - contrast) < 500)))
    mixed = F.filter(
        F.transform(d.lines, lambda line, i: F.when(
            F.lower(line).contains("in contrast") & F.lower(line).contains("similarly"),
            issue("contrast-mix", line=i + 1, excerpt=cut(line)))),
        lambda x: x.isNotNull())
    mix = F.when(
        d.lower.contains("in contrast") & d.lower.contains("similarly"),
        F.when(near, rx.limited(mixed, cfg["max_contrast_mixes"])).otherwise(none())).otherwise(none())
    return F.concat(clash, mix)


def claim_without_evidence(d: Doc, cfg: dict) -> Column:
    claim = rx.fold("|".join(f"(?:{p})" for p in W.CLAIMS))
    evidence = rx.fold("|".join(f"(?:{p})" for p in W.EVIDENCE_MARKERS))
    hits = d.lines_where(lambda line: F.when(line.rlike(claim) & ~line.rlike(evidence), F.lit(1)), W.CLAIM_WORDS)
    return F.transform(rx.limited(hits, cfg["max_claims"]), lambda h: issue("claim", line=h["no"], excerpt=cut(h["line"])))


def unsupported_conclusion(d: Doc, cfg: dict) -> Column:
    """Off unless ``cfg['unsupported_conclusion']``: the reference lower-cases the text before it looks for capitals."""
    if not cfg.get("unsupported_conclusion"):
        return none()
    starts = rx.fold(W.CONCLUSION_START)
    at = F.get(d.lines_where(lambda line: F.when(rx.strip(line).rlike(starts), F.lit(1))), F.lit(0))["no"] - 1
    body = F.lower(F.array_join(F.slice(d.lines, F.lit(1), F.greatest(F.lit(0), at - 1)), " "))
    conclusion = F.array_join(F.slice(d.lines, at + 1, F.lit(cfg["max_conclusion_lines"]) if cfg["max_conclusion_lines"] else F.size(d.lines)), " ")

    def judge(x: Column) -> Column:
        terms = F.filter(
            rx.find_all(x["conclusion"], rx.exact(r"\b[A-Z][a-z]{2,}\b")),
            lambda t: (F.length(t) > 3) & ~F.lower(t).isin(W.CONCLUSION_STOP))
        unseen = F.filter(rx.limited(terms, cfg["max_conclusion_terms"]), lambda t: ~F.contains(x["body"], F.lower(t)))
        return only_if(F.size(unseen) > 0, issue(
            "unsupported", count=F.size(unseen), terms=F.array_join(rx.limited(unseen, cfg["max_shown_terms"]), ", ")))

    return F.when(
        (d.n_lines >= 20) & (at - 1 >= 5),
        rx.let(F.struct(conclusion.alias("conclusion"), body.alias("body")), judge),
    ).otherwise(none())


def number_consistency(d: Doc, cfg: dict) -> Column:
    starts = {"Month DD, YYYY": "JFMASOND"}
    counts = F.array(*[rx.count(d.text, rx.led(starts.get(name, r"\d"), rx.exact(p))) for name, p in W.DATE_FORMATS])
    used = rx.let(counts, lambda ns: F.array_compact(F.array(*[
        F.when(ns[k] > 0, F.concat(F.lit(f"{name} ("), ns[k].cast("string"), F.lit("x)"))) for k, (name, _) in enumerate(W.DATE_FORMATS)])))
    dates = F.when(
        d.text.rlike("[0-9]{4}"),
        rx.let(used, lambda u: only_if(F.size(u) > 1, issue("date-formats", formats=F.array_join(u, ", "))))
    ).otherwise(none())

    word, digit = rx.led("ft", rx.fold(W.NUMBER_WORDS_ON_LINE)), rx.led(r"\d", rx.exact(r"\b\d+\b"))
    # a number word is a whole token, unless a letter is only by its case one of it
    named = F.aggregate(d.marks, F.lit(0), lambda acc, ws: acc + F.size(F.filter(ws, lambda t: t.isin(W.NUMBER_NAMES))))
    named = F.when(d.odd, rx.count(d.text, rx.fold(W.NUMBER_WORDS))).otherwise(named)
    many = (named > 3) & (rx.count(d.text, digit) > 10)
    mixed = F.transform(
        d.lines_where(lambda line: F.when(line.rlike(digit) & line.rlike(word), F.lit(1))),
        lambda h: issue("mixed-numbers", line=h["no"], fix=True, excerpt=cut(h["line"])))
    # a limit counts the date issue too
    return rx.let(dates, lambda ds: F.when(many, rx.limited(F.concat(ds, mixed), cfg["max_number_issues"])).otherwise(ds))


RULES = {
    "logic.undefined-acronym": undefined_acronym, "logic.missing-transition": missing_transition,
    "logic.duplicate-content": duplicate_content, "logic.scope-mismatch": scope_mismatch,
    "logic.contradictions": contradictions, "logic.claim-without-evidence": claim_without_evidence,
    "logic.unsupported-conclusion": unsupported_conclusion, "logic.number-consistency": number_consistency,
}
