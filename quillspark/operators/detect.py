"""Document type from file name, title, headings and text, inside the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import detection as D
from ..functions import rx
from .config import profile_of_type

FILENAME, TITLE, HEADINGS, TEXT, THESIS = 1, 2, 3, 4, 5


def _signal(stage: int, document_type: str, value, condition: Column) -> Column:
    value = value if isinstance(value, Column) else F.lit(float(value))
    return F.when(condition, F.struct(
        F.lit(stage).alias("stage"), F.lit(document_type).alias("type"), value.cast("double").alias("value")))


def signals(filename: Column, title: Column, headings: Column, text_lower: Column) -> Column:
    """Every signal that fires, in scoring order."""
    name, title = F.lower(filename), F.lower(title)
    keys = F.transform(headings, lambda h: h["key"])
    found = [_signal(FILENAME, kind, boost, name.rlike(rx.fold(p))) for p, kind, boost in D.FILENAME_SIGNALS]
    found += [_signal(TITLE, kind, boost, title.rlike(rx.fold(p))) for p, kind, boost in D.TITLE_SIGNALS]
    for needed, kind, confidence in D.HEADING_COMBOS:
        complete = F.forall(rx.strings(needed), lambda word: F.exists(keys, lambda k: F.contains(k, word)))
        found.append(_signal(HEADINGS, kind, confidence, complete))
    for needles, kind, step in D.TEXT_SIGNALS:
        n = rx.contained(text_lower, needles)
        found.append(_signal(TEXT, kind, n * F.lit(step), rx.contains_any(text_lower, needles)))
    thesis = title.rlike(rx.fold(D.THESIS_TITLE)) & F.arrays_overlap(keys, rx.strings(D.THESIS_HEADINGS))
    found.append(_signal(THESIS, "thesis", 0.15, thesis))
    return F.array_compact(F.array(*found))


def type_scores(found: Column) -> Column:
    """(score, type) per type, best first; ties keep the type that scored first."""

    def stage_values(kind: Column, *stages: int) -> Column:
        return F.transform(
            F.filter(found, lambda s: (s["type"] == kind) & s["stage"].isin(*stages)), lambda s: s["value"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def largest(values: Column) -> Column:
        return F.coalesce(F.array_max(values), F.lit(0.0))

    def score(kind: Column) -> Column:
        named = F.least(F.lit(1.0), largest(stage_values(kind, FILENAME)) + total(stage_values(kind, TITLE)))
        shaped = F.greatest(named, largest(stage_values(kind, HEADINGS)))
        return F.round(F.least(F.lit(1.0), shaped + total(stage_values(kind, TEXT, THESIS))), 9)

    kinds = F.array_distinct(F.transform(found, lambda s: s["type"]))
    ranked = F.array_sort(F.transform(kinds, lambda k, i: F.struct(
        (-score(k)).alias("neg"), i.alias("i"), k.alias("type"))))
    return F.transform(ranked, lambda r: F.struct((-r["neg"]).alias("score"), r["type"].alias("type")))


def with_signals(parsed: DataFrame, filename: str = "filename", title: str = "meta_title") -> DataFrame:
    return parsed.withColumn(
        "signals", signals(F.col(filename), F.col(title), F.col("headings"), F.col("text_lower")))


def detect(parsed: DataFrame, filename: str = "filename", title: str = "meta_title") -> DataFrame:
    """Adds ``document_type, detected_profile, confidence, alternatives`` to parsed documents."""
    out = with_signals(parsed, filename, title)
    out = out.withColumn("type_scores", type_scores(F.col("signals")))
    best = F.get("type_scores", F.lit(0))
    others = F.slice(F.filter(F.slice("type_scores", 2, len(D.TYPE_PROFILE)), lambda s: s["score"] >= 0.30), 1, 3)
    return out.withColumns({
        "document_type": F.coalesce(best["type"], F.lit("unknown")),
        "confidence": F.round(F.least(F.coalesce(best["score"], F.lit(0.0)), F.lit(1.0)), 4),
        "alternatives": F.transform(others, lambda s: s["type"]),
    }).withColumn("detected_profile", profile_of_type(F.col("document_type")))
