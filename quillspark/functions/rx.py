"""Column helpers: Unicode-aware regexes and small string idioms."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\f\x0b"


def exact(pattern: str) -> str:
    """Case-sensitive pattern with Unicode ``\\w``, ``\\b``, ``\\s``."""
    return "(?U)" + pattern


def fold(pattern: str) -> str:
    """Case-insensitive pattern with Unicode ``\\w``, ``\\b``, ``\\s``."""
    return "(?iU)" + pattern


def any_word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def led(chars: str, pattern: str) -> str:
    """The pattern, tried only where one of the characters stands: every match begins with one. A word boundary costs far more than that look."""
    flags, rest = re.fullmatch(r"(\(\?\w+\))(.*)", pattern, re.DOTALL).groups()
    return f"{flags}(?=[{chars}])(?:{rest})"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def count(col: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(col, F.lit(pattern), F.lit(0)))


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def word_count(col: Column) -> Column:
    """Whitespace separated words."""
    return count(col, r"(?U)\S+")


def tokens(col: Column) -> Column:
    return find_all(col, r"(?U)\w+")


def repeats(items: Column, key: str, place: str) -> Column:
    """Structs whose key an earlier one has, by place. Neighbours of a sorted array are compared, so it is no all-pairs search."""
    ordered = let(F.array_sort(F.transform(items, lambda x: F.struct(x[key].alias("k"), x[place].alias("p"), x.alias("x")))),
                  lambda xs: F.filter(xs, lambda x, i: (i > 0) & (F.get(xs, F.greatest(i - 1, F.lit(0)))["k"] == x["k"])))
    by_place = F.array_sort(F.transform(ordered, lambda x: F.struct(x["p"].alias("p"), x["x"].alias("x"))))
    return F.transform(by_place, lambda x: x["x"])


def limited(array: Column, limit: int | None) -> Column:
    """The first ``limit`` items; all of them without a limit."""
    return array if limit is None else F.slice(array, 1, limit)


def literal_count(col: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def once(build):
    """Keep the columns ``build(*args)`` makes for this Spark application: constants are asked for often."""
    kept: dict[tuple, Column] = {}

    def cached(*args) -> Column:
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return cached


@once
def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strings(values) -> Column:
    """Literal array of strings; an empty list keeps its type."""
    return _strings(*values)


def contains_any(col: Column, needles: list[str]) -> Column:
    """True when the column contains one of the needles."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | col.contains(needle)
    return hit


def contained(col: Column, needles: list[str]) -> Column:
    """How many of the needles the column contains."""
    total = F.lit(0)
    for needle in needles:
        total = total + col.contains(needle).cast("int")
    return total


def first_match(col: Column, patterns: list[str]) -> Column:
    """1-based index of the first pattern found in the column, else null."""
    choice = F.when(col.rlike(patterns[0]), F.lit(1))
    for position, pattern in enumerate(patterns[1:], start=2):
        choice = choice.when(col.rlike(pattern), F.lit(position))
    return choice


def title_case(col: Column) -> Column:
    return F.initcap(col)


def half_even(col: Column, digits: int = 0) -> Column:
    """Number as text with a fixed count of decimals, ties to even. The double itself is rounded, not its shortest decimal: 3.45 is above a tie, 3.15 below."""
    return F.call_function("format_number", col.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def positions(col: Column, pattern: str) -> Column:
    """0-based start of every match."""
    return F.transform(spans(col, pattern), lambda m: m["start"])


def running(counts: Column) -> Column:
    """Running sums of an array of counts. Blocks of about the root of its size are summed first, so n items cost n**1.5 steps at most."""

    def scan(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(part, start, lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all")), lambda acc: acc["all"])

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    def summed(blocks: Column) -> Column:
        return let(scan(F.transform(blocks, total), F.lit(0).cast("bigint")), lambda ends: F.flatten(
            F.transform(blocks, lambda b, i: scan(b, F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get(ends, i - 1))))))

    def blocked(items: Column) -> Column:
        side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
        return let(side, lambda s: F.transform(F.sequence(F.lit(0), s - 1), lambda b: F.slice(items, b * s + 1, s)))

    return let(counts, lambda items: let(blocked(items), summed))


def spans(col: Column, pattern: str) -> Column:
    """``start``, ``end`` (0-based, end exclusive) and ``value`` of every match, in order."""
    both = F.struct(F.split(col, pattern, -1).alias("pieces"), find_all(col, pattern).alias("matches"))

    def placed(b: Column, ends: Column) -> Column:
        return F.transform(b["matches"], lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end"), m.alias("value")))

    return let(both, lambda b: let(running(F.transform(
        b["matches"], lambda m, i: F.length(F.get(b["pieces"], i)) + F.length(m))), lambda ends: placed(b, ends)))
