"""A user's rule as a table function, for logic that no Column expresses.

A rule is a Python class that sees the lines of one document in order and yields issues. It runs either over a table of
lines (``issue_table``: the table argument is partitioned by document and sorted by line, so lines may come from any table)
or laterally over rows that hold the document's lines (``lateral_issues``: no shuffle). Both give the columns of an issue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ...fixed.catalog import ISSUES
from ...functions.findings import category_of, texts_of

TABLE_RULES: dict[str, type] = {}

FIELDS = ["issue_id", "category", "rule_id", "severity", "message", "recommendation", "excerpt", "line_start", "line_end", "location",
          "confidence", "source", "autofix_allowed"]
SCHEMA = ("issue_id string, category string, rule_id string, severity string, message string, recommendation string, excerpt string, "
          "line_start int, line_end int, location string, confidence int, source string, autofix_allowed boolean")


class TableRule:
    """Base of a user's rule; one object sees one document."""

    def line(self, number: int, text: str):
        """Issues that a line gives; lines come in order."""
        return ()

    def end(self):
        """Issues that are known after the last line."""
        return ()


def table_rule(rule_id: str):
    """Registers a TableRule class under an id."""

    def add(cls: type) -> type:
        TABLE_RULES[rule_id] = cls
        return cls

    return add


def stock_issue(key: str, line: int, last_line: int | None = None, fix: bool = False, **values) -> dict:
    """An issue with the texts of the catalogue, filled in."""
    _, _, severity, confidence, source, *_ = ISSUES[key]
    last = line if last_line is None else last_line
    issue_id, rule_id, message, advice, excerpt, location = (t.format(line=line, last_line=last, **values) for t in texts_of(key))
    return dict(zip(FIELDS, [issue_id, category_of(rule_id), rule_id, values.get("severity", severity), message, advice, excerpt, line, last, location,
                             confidence, source, fix], strict=True))


def _row(issue: dict) -> tuple:
    return tuple(issue.get(f) for f in FIELDS)


def table_function(rule_id: str):
    """The rule over a table (doc_id, line_no, line), partitioned by doc_id and ordered by line_no."""
    cls = TABLE_RULES[rule_id]

    class Lines:
        def __init__(self):
            self.rule, self.doc_id = cls(), None

        def eval(self, row):
            self.doc_id = row["doc_id"]
            for issue in self.rule.line(row["line_no"], row["line"]):
                yield (self.doc_id, *_row(issue))

        def terminate(self):
            for issue in self.rule.end():
                yield (self.doc_id, *_row(issue))

    return F.udtf(Lines, returnType=f"doc_id bigint, {SCHEMA}")


def lateral_function(rule_id: str):
    """The rule over an array of a document's lines."""
    cls = TABLE_RULES[rule_id]

    class Document:
        def eval(self, lines: list):
            rule = cls()
            for number, text in enumerate(lines or [], 1):
                for issue in rule.line(number, text):
                    yield _row(issue)
            for issue in rule.end():
                yield _row(issue)

    return F.udtf(Document, returnType=SCHEMA)


def register(spark: SparkSession, rule_id: str) -> tuple[str, str]:
    """Registers both forms for SQL: names of the table form and of the lateral one."""
    name = "rule_" + "".join(c if c.isalnum() else "_" for c in rule_id)
    spark.udtf.register(name, table_function(rule_id))
    spark.udtf.register(f"{name}_of", lateral_function(rule_id))
    return name, f"{name}_of"


def issue_table(lines: DataFrame, rule_id: str) -> DataFrame:
    """Issues of ``lines(doc_id, line_no, line)``: one shuffle by document, then each document's lines through one object.

    A null line reaches the rule as None. Lines with a null doc_id are one document; columns besides these three are not read.
    """
    given = lines.select(F.col("doc_id").cast("bigint").alias("doc_id"), "line_no", "line")
    return table_function(rule_id)(given.asTable().partitionBy("doc_id").orderBy("line_no"))


def lateral_issues(parsed: DataFrame, rule_id: str) -> DataFrame:
    """Issues of ``parsed(doc_id, lines)`` by a lateral call for each row."""
    return parsed.select("doc_id", "lines").lateralJoin(lateral_function(rule_id)(F.col("lines").outer())).drop("lines")
