"""Issues: a compact struct inside the document row, texts filled in after the explode.

Rules emit ``ISSUE`` structs that carry a catalogue code and the values for its text slots.
``rendered`` joins the exploded rows with the catalogue (about a hundred rows, broadcast) and
fills the texts there, once per issue, so the rule expressions stay small.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed.catalog import CATEGORY_OF_PREFIX, ISSUES
from . import rx

ISSUE = ("struct<code:int,category:string,severity:string,fix:boolean,line_start:int,line_end:int,"
         "args:array<string>>")
ISSUE_ARRAY = f"array<{ISSUE}>"
TEXTS = ("issue_id", "rule_id", "message", "recommendation", "excerpt", "location")
MAX_ARGS = 8
_SLOT = re.compile(r"(\{\{|\}\}|\{\w+\})")


def texts_of(key: str) -> tuple[str, ...]:
    issue_id, rule_id, _, _, _, message, advice, excerpt, location = ISSUES[key]
    return issue_id, rule_id, message, advice, excerpt, location


def slots(key: str) -> list[str]:
    """Slot names of an issue's texts in order of appearance; the two line numbers are always there."""
    found: list[str] = []
    for text in texts_of(key):
        for piece in _SLOT.split(text):
            name = piece[1:-1]
            if re.fullmatch(r"\{\w+\}", piece) and name not in found and name not in ("line", "last_line"):
                found.append(name)
    return found


def java_format(text: str, names: list[str]) -> str:
    """Catalogue text as a positional format: 1 and 2 are the line numbers, then the slots."""
    order = {"line": 1, "last_line": 2, **{n: i for i, n in enumerate(names, 3)}}
    out = []
    for piece in _SLOT.split(text):
        if piece in ("{{", "}}"):
            out.append(piece[0])
        elif re.fullmatch(r"\{\w+\}", piece):
            out.append(f"%{order[piece[1:-1]]}$s")
        else:
            out.append(piece.replace("%", "%%"))
    return "".join(out)


def category_of(rule_id: str) -> str:
    prefix = rule_id.split(".")[0]
    return CATEGORY_OF_PREFIX.get(prefix, prefix)


def catalog_table(spark: SparkSession) -> DataFrame:
    rows = []
    for code, (key, entry) in enumerate(ISSUES.items()):
        names = slots(key)
        rows.append((code, entry[3], entry[4], *[java_format(t, names) for t in texts_of(key)]))
    fields = ", ".join(f"{t}_format string" for t in TEXTS)
    return spark.createDataFrame(rows, f"code int, confidence int, source string, {fields}")


@rx.once
def none() -> Column:
    return F.array().cast(ISSUE_ARRAY)


def text(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def issue(key: str, /, line=1, last_line=None, fix=False, category: str | None = None, **values) -> Column:
    """One compact issue; ``values`` are its text slots."""
    entry = ISSUES[key]
    start = line if isinstance(line, Column) else F.lit(line)
    severity = values.get("severity", entry[2])
    args = [text(values[name]) for name in slots(key)]
    return F.struct(
        F.lit(list(ISSUES).index(key)),
        F.lit(category or category_of(entry[1])),
        severity if isinstance(severity, Column) else F.lit(severity),
        fix if isinstance(fix, Column) else F.lit(fix),
        start,
        start if last_line is None else last_line,
        F.array(*args) if args else F.array().cast("array<string>"),
    ).cast(ISSUE)


def only_if(condition: Column, *issues: Column) -> Column:
    """The issues when the condition holds, else an empty array."""
    return F.when(condition, F.array(*issues)).otherwise(none())


def present(*issues: Column) -> Column:
    """The non-null issues of a fixed list."""
    return F.array_compact(F.array(*issues))


def rendered(rows: DataFrame, column: str = "issue") -> DataFrame:
    """Exploded issue structs -> flat issue columns with their texts."""
    catalog = F.broadcast(catalog_table(rows.sparkSession))
    values = [F.col(f"{column}.line_start").cast("string"), F.col(f"{column}.line_end").cast("string")]
    values += [F.get(F.col(f"{column}.args"), F.lit(i)) for i in range(MAX_ARGS)]
    keep = [c for c in rows.columns if c != column]
    joined = rows.join(catalog, F.col(f"{column}.code") == F.col("code"))
    return joined.select(
        *keep,
        F.col(f"{column}.category").alias("category"),
        F.col(f"{column}.severity").alias("severity"),
        *[F.printf(F.col(f"{t}_format"), *values).alias(t) for t in TEXTS],
        F.col(f"{column}.line_start").alias("line_start"),
        F.col(f"{column}.line_end").alias("line_end"),
        "confidence", "source",
        F.col(f"{column}.fix").alias("autofix_allowed"),
    )


def rule_of(code: Column) -> Column:
    """Rule id of an issue code, from the catalogue as a literal array."""
    return F.element_at(F.array(*[F.lit(entry[1]) for entry in ISSUES.values()]), code + 1)


def text_of(found: Column, which: str) -> Column:
    """One text (``message``, ``recommendation``, ``excerpt``, ``rule_id``) of an issue struct, filled in the row."""
    at = TEXTS.index(which)
    formats = rx.strings([java_format(texts_of(k)[at], slots(k)) for k in ISSUES])
    values = [found["line_start"].cast("string"), found["line_end"].cast("string")]
    values += [F.get(found["args"], F.lit(i)) for i in range(MAX_ARGS)]
    return F.printf(F.element_at(formats, found["code"] + 1), *values)
