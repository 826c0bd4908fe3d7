"""Writing rules: grammar, spelling, punctuation, readability, voice, wording, tone."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ...fixed import words as W
from ...functions import rx
from ...functions.findings import issue, none, only_if, present
from ..parse import Doc, shows


def excerpt(line: Column, size: int | None = None) -> Column:
    """The evidence of an issue. Fixes read it as the text to change, so a line is whole unless a size is given."""
    return line if size is None else F.left(line, F.lit(size))


def first_pattern_per_line(d: Doc, patterns: list[str], limit: int | None = None,
                           words: list[str] | None = None) -> Column:
    """(no, line, k): k is the 1-based index of the first pattern found on the line."""
    hits = d.lines_where(lambda line: rx.first_match(line, patterns), words)
    return rx.limited(hits, limit)


def grammar(d: Doc, cfg: dict) -> Column:
    patterns = [rx.fold(p) for p, _ in W.GRAMMAR]
    regexes, notes = rx.strings(patterns), rx.strings([n for _, n in W.GRAMMAR])

    def needed(k: int, marks: Column) -> Column:
        ends = W.GRAMMAR_ENDS.get(k)
        if ends is None:
            return shows(marks, W.GRAMMAR_WORDS[k])
        return F.exists(marks, lambda t: reduce(or_, [t.endswith(e) for e in ends]))

    def pick(line: Column, marks: Column, odd: Column) -> Column:
        choice = F
        for k, pattern in enumerate(patterns):
            choice = choice.when((odd | needed(k, marks)) & line.rlike(pattern), F.lit(k + 1))
        return choice

    found = d.marked(lambda line, i, marks, odd: F.struct((i + 1).alias("no"), line.alias("line"), pick(line, marks, odd).alias("k")))
    hits = rx.limited(F.filter(found, lambda h: h["k"].isNotNull()), cfg["max_grammar_issues"])
    return F.transform(hits, lambda h: issue(
        "grammar", line=h["no"], fix=d.may("writing", 3), excerpt=excerpt(h["line"]),
        problem=F.element_at(notes, h["k"]),
        match=F.left(F.regexp_substr(h["line"], F.element_at(regexes, h["k"])), F.lit(60))))


def spelling(d: Doc, cfg: dict) -> Column:
    typos = list(W.TYPOS) if not cfg.get("skip_identical_typos") else [t for t, c in W.TYPOS.items() if t != c]

    def on_line(words: Column, i: Column) -> Column:
        return F.transform(
            F.filter(words, lambda t: t.isin(typos)),
            lambda t: F.struct((i + 1).alias("no"), F.get(d.lines, i).alias("line"), t.alias("k")))

    hits = rx.limited(F.flatten(F.transform(d.marks, on_line)), cfg["max_spelling_issues"])
    fixes = F.create_map(*[F.lit(x) for pair in W.TYPOS.items() for x in pair])
    found = F.transform(hits, lambda h: issue(
        "spelling", line=h["no"], fix=True, excerpt=excerpt(h["line"]), word=h["k"],
        correction=F.element_at(fixes, h["k"])))
    return F.when(F.exists(d.vocabulary, lambda t: t.isin(typos)), found).otherwise(none())


def punctuation(d: Doc, cfg: dict) -> Column:
    notes = rx.strings([n for _, n in W.PUNCTUATION])
    # a literal every match must contain spares most lines the regex
    needs = [[","], [","], ["."], [".."], ["!", "?", ";", ":"], ["("], ["["], ['"'], ["';", ";'"], None]

    def pick(line: Column) -> Column:
        choice = None
        for k, ((pattern, _), literals) in enumerate(zip(W.PUNCTUATION, needs), start=1):
            found = line.rlike(rx.exact(pattern))
            if literals:
                found = rx.contains_any(line, literals) & found
            choice = F.when(found, F.lit(k)) if choice is None else choice.when(found, F.lit(k))
        return choice

    hits = rx.limited(d.lines_where(pick), cfg["max_punctuation_issues"])
    return F.transform(hits, lambda h: issue(
        "punctuation", line=h["no"], fix=True, excerpt=excerpt(h["line"]), problem=F.element_at(notes, h["k"])))


def readability(d: Doc, cfg: dict) -> Column:
    pieces = F.split(d.text, r"(?U)[.!?]+\s+", -1)
    words = F.aggregate(d.tokens, F.lit(0), lambda acc, ws: acc + F.size(ws))
    long_words = F.aggregate(d.tokens, F.lit(0), lambda acc, ws: acc + F.size(F.filter(ws, lambda w: F.length(w) >= 10)))
    measured = rx.let(pieces, lambda ps: F.struct(
        words.alias("words"), F.size(ps).alias("pieces"),
        F.size(F.filter(ps, lambda p: p.rlike(r"(?U)\S\s+\S"))).alias("sentences"), long_words.alias("long")))

    def judge(m: Column) -> Column:
        percent = m["long"] / F.nullif(m["words"], F.lit(0)) * 100
        average = m["words"] / F.nullif(m["sentences"], F.lit(0))
        return F.when(
            (m["words"] > 0) & (m["pieces"] >= 3) & (m["sentences"] > 0),
            present(
                F.when(percent > cfg["max_long_words_pct"],
                       issue("readability-complex", count=m["long"], percent=rx.half_even(percent),
                             limit=cfg["max_long_words_pct"])),
                F.when(average > cfg["max_avg_sentence_words"],
                       issue("readability-long-sentences", average=rx.half_even(average),
                             limit=cfg["max_avg_sentence_words"])),
            ),
        ).otherwise(none())

    return rx.let(measured, judge)


def overused_phrases(d: Doc, cfg: dict) -> Column:
    advice = rx.strings([a for _, a in W.OVERUSED])

    def on_line(line: Column, i: Column, marks: Column, odd: Column) -> Column:
        flags = F.array_compact(F.array(*[
            F.when((odd | shows(marks, W.OVERUSED_WORDS[n])) & line.rlike(rx.fold(p)), F.lit(n + 1))
            for n, (p, _) in enumerate(W.OVERUSED)]))
        return F.transform(flags, lambda k: F.struct((i + 1).alias("no"), line.alias("line"), k.alias("k")))

    return F.transform(rx.limited(F.flatten(d.marked(on_line)), cfg["max_per_phrase"]), lambda h: issue(
        "overused", line=h["no"], excerpt=excerpt(h["line"]), advice=F.element_at(advice, h["k"])))


def terminology(d: Doc, cfg: dict) -> Column:
    def mixed(first: str, second: str) -> Column:
        counts = F.struct(rx.literal_count(d.lower, first).alias("a"), rx.literal_count(d.lower, second).alias("b"))
        return F.when(
            d.lower.contains(first) & d.lower.contains(second),
            rx.let(counts, lambda n: issue(
                "terminology", slug=first.replace(" ", "-")[:20], first=first, second=second, n_first=n["a"], n_second=n["b"],
                dominant=F.when(n["a"] >= n["b"], F.lit(first)).otherwise(F.lit(second)),
                other=F.when(n["a"] >= n["b"], F.lit(second)).otherwise(F.lit(first)))),
        )

    return present(*[mixed(*pair) for pair in W.TERM_VARIANTS])


def passive_voice(d: Doc, cfg: dict) -> Column:
    def worth(marks: Column) -> Column:
        return shows(marks, W.BE_WORDS) & F.exists(marks, lambda t: t.endswith("ed") | t.isin(W.PARTICIPLES))

    hits = rx.limited(d.matches(rx.fold(W.PASSIVE), 1, worth=worth), cfg["max_passive"])
    placed = F.transform(hits, lambda h: F.struct(
        h["no"].alias("no"),
        F.substr(h["line"], F.greatest(F.lit(0), F.instr(F.lower(h["line"]), h["k"]) - 21) + 1, F.lit(100)).alias("context")))
    return F.transform(placed, lambda p: issue(
        "passive", line=p["no"], fix=d.may("writing", 3), excerpt=p["context"], context=rx.strip(p["context"])))


def hedging(d: Doc, cfg: dict) -> Column:
    hits = rx.limited(d.matches(rx.fold(rx.any_word(W.HEDGING_WORDS)), words=W.HEDGING_MARKS), cfg["max_hedging"])
    return F.transform(hits, lambda h: issue(
        "hedging", line=h["no"], fix=d.may("writing", 4), excerpt=excerpt(h["line"]), match=h["k"]))


def weak_wording(d: Doc, cfg: dict) -> Column:
    hits = rx.limited(d.matches(rx.fold(rx.any_word(W.WEAK_WORDS)), per_line=cfg["max_weak_per_line"], words=W.WEAK_WORDS), cfg["max_weak"])
    return F.transform(hits, lambda h: issue(
        "weak", line=h["no"], fix=d.may("writing", 3), excerpt=excerpt(h["line"]), match=h["k"]))


def verbosity(d: Doc, cfg: dict) -> Column:
    advice = rx.strings([a for _, a in W.VERBOSE])
    return F.transform(first_pattern_per_line(d, [rx.fold(p) for p, _ in W.VERBOSE], words=W.VERBOSE_WORDS), lambda h: issue(
        "verbose", line=h["no"], fix=d.may("writing", 3), excerpt=excerpt(h["line"]),
        advice=F.element_at(advice, h["k"])))


def contractions(d: Doc, cfg: dict) -> Column:
    found = F.transform(d.matches(rx.fold(rx.any_word(W.CONTRACTIONS)), words=W.CONTRACTION_MARKS), lambda h: issue(
        "contraction", line=h["no"], fix=d.may("writing", 4), excerpt=excerpt(h["line"]), match=h["k"],
        profile=d.profile_name))
    return F.when(d.is_profile("academic", "sop"), found).otherwise(none())


def long_line(d: Doc, cfg: dict) -> Column:
    """The active sentence-length rule: it counts the words of a line."""
    hits = F.filter(
        F.transform(d.tokens, lambda ws, i: F.struct((i + 1).alias("no"), F.size(ws).alias("n"))),
        lambda h: h["n"] > 40)
    return F.transform(hits, lambda h: issue(
        "long-line", line=h["no"], fix=d.may("writing", 3), excerpt=excerpt(F.element_at(d.lines, h["no"]), 220)))


def long_sentence_piece(d: Doc, cfg: dict) -> Column:
    """The shadowed form of the rule: pieces between sentence marks."""
    limit = cfg["max_sentence_words"]

    def on_line(line: Column, i: Column) -> Column:
        counted = F.transform(F.split(line, r"[.!?]+", -1), lambda p: F.struct(
            (i + 1).alias("no"), p.alias("piece"), rx.count(p, rx.exact(r"\w+")).alias("words")))
        return F.filter(counted, lambda c: c["words"] > limit)

    return F.transform(F.flatten(F.transform(d.lines, on_line)), lambda c: issue(
        "long-sentence", line=c["no"], fix=d.may("writing", 3), words=c["words"], limit=limit,
        excerpt=excerpt(rx.strip(c["piece"]), 200)))


def repetition(d: Doc, cfg: dict) -> Column:
    used = F.flatten(d.on_lines(
        lambda line, i: rx.find_all(F.lower(line), rx.exact(rx.any_word(W.REPETITION_WORDS))), W.REPETITION_MARKS))

    def judge(found: Column) -> Column:
        counted = F.transform(F.array_distinct(found), lambda w: F.struct(
            w.alias("word"), F.size(F.filter(found, lambda x: x == w)).alias("n")))
        return F.transform(
            F.filter(counted, lambda c: c["n"] > cfg["max_repeats"]),
            lambda c: issue("repetition", word=c["word"], count=c["n"]))

    return F.when(d.uses(W.REPETITION_MARKS), rx.let(used, judge)).otherwise(none())


def tone_consistency(d: Doc, cfg: dict) -> Column:
    def informal_on(tokens: Column, i: Column) -> Column:
        words = F.array_distinct(F.filter(tokens, lambda t: t.isin(W.INFORMAL_WORDS)))
        return F.transform(words, lambda w: issue(
            "informal", line=i + 1, fix=d.may("writing", 3), excerpt=excerpt(F.get(d.lines, i)), word=w))

    passive = rx.count(d.text, rx.led("aiwb", rx.fold(W.PASSIVE)))
    direct = F.size(F.filter(rx.limited(d.lines, cfg["max_tone_lines"]), lambda line: line.rlike(r"^\p{Lu}")))
    return (
        F.when(d.is_profile("academic"), F.flatten(F.transform(d.marks, informal_on)))
        .when(d.is_profile("business"), only_if(passive > 10, issue("business-passive", count=passive)))
        .when(d.is_profile("sop"), only_if(direct < 3, issue("sop-imperative")))
        .otherwise(none())
    )


RULES = {
    "writing.grammar": grammar, "writing.spelling": spelling, "writing.punctuation": punctuation,
    "writing.readability": readability, "writing.overused-phrases": overused_phrases,
    "writing.terminology": terminology, "writing.passive-voice": passive_voice, "writing.hedging": hedging,
    "writing.weak-wording": weak_wording, "writing.verbosity": verbosity, "writing.contractions": contractions,
    "writing.sentence-length": long_line, "writing.repetition": repetition,
    "writing.tone-consistency": tone_consistency,
}
SHADOWED = {"writing.sentence-length": long_sentence_piece}
