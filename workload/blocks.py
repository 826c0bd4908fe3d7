"""Typed blocks derived from the drafts, in Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions import rx
from quillspark.operators.parse import parse

from .drafts import drafts, pick, sql_pick
from .sql import HEAD, q

FONTS = ["Arial", "Times New Roman", "Arial", "Georgia", ""]
ALIGNMENTS = ["left", "justify", "left", "center", "left", "right", "justify"]
CAPTION_TEXTS = ["Figure 2: Drawn by hand", "", "Table 4: Typed in", "", "Figure 7"]
CAPTION_START = r"^(?:Figure|Fig\.?|Table)\s*\d"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank draft line; the block number comes from the row's own array, so nothing is shuffled."""
    parsed = parse(drafts(spark, sf_dir)).select("doc_id", "lines")
    heading = r"^(#{1,6})\s+(.+?)\s*$"
    kept = F.filter(
        F.transform("lines", lambda line, i: F.struct(line.alias("line"), (i + 1).alias("line_no"))),
        lambda x: rx.strip(x["line"]) != "")
    rows = parsed.select("doc_id", F.posexplode(kept).alias("block_idx", "b"))
    line, no = F.col("b.line"), F.col("b.line_no")
    kind = (
        F.when(line.rlike(heading), F.lit("heading")).when(line.startswith("!["), F.lit("figure"))
        .when(line.startswith("|"), F.lit("table")).when(line.startswith("Equation"), F.lit("equation"))
        .when(line.rlike(CAPTION_START), F.lit("caption")).when(line.rlike(r"^\d+\."), F.lit("list_item"))
        .otherwise(F.lit("paragraph")))
    key = F.col("doc_id") + no
    return rows.select(
        "doc_id", "block_idx", kind.alias("type"),
        F.when(kind == "heading", F.regexp_extract(line, heading, 2)).otherwise(line).alias("text"),
        F.length(F.regexp_extract(line, heading, 1)).alias("level"),
        pick(FONTS, key * 3).alias("font_name"),
        pick(ALIGNMENTS, key * 2).alias("alignment"),
        F.when(kind.isin("figure", "table"), pick(CAPTION_TEXTS, key)).otherwise(F.lit("")).alias("caption"),
        F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit("-"), F.col("block_idx").cast("string")).alias("node_id"),
        no.alias("line_start"), no.alias("line_end"),
        (F.floor(F.col("block_idx") / 10) + 1).cast("int").alias("page_number"),
        (F.lit(10.0) + F.pmod(key, F.lit(3))).alias("font_size"),
        (kind == "heading").alias("bold"),
        F.concat(F.lit("Style "), F.length(F.regexp_extract(line, heading, 1)).cast("string")).alias("style_name"),
    )


_KIND = (f"CASE WHEN regexp_matches(line, {HEAD}) THEN 'heading' WHEN starts_with(line, '![') THEN 'figure' "
         f"WHEN starts_with(line, '|') THEN 'table' WHEN starts_with(line, 'Equation') THEN 'equation' "
         f"WHEN regexp_matches(line, {q(CAPTION_START)}) THEN 'caption' WHEN regexp_matches(line, '^\\d+\\.') THEN 'list_item' "
         f"ELSE 'paragraph' END")
BLOCKS_SQL = f""", blk AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS block_idx, kind AS type,
    CASE WHEN kind = 'heading' THEN regexp_extract(line, {HEAD}, 2) ELSE line END AS text, length(regexp_extract(line, {HEAD}, 1)) AS level,
    {sql_pick(FONTS, '(doc_id + line_no) * 3')} AS font_name, {sql_pick(ALIGNMENTS, '(doc_id + line_no) * 2')} AS alignment,
    CASE WHEN kind IN ('figure', 'table') THEN {sql_pick(CAPTION_TEXTS, 'doc_id + line_no')} ELSE '' END AS caption,
    'n' || doc_id || '-' || (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) AS node_id,
    line_no AS line_start, line_no AS line_end,
    CAST((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 10 + 1 AS INTEGER) AS page_number,
    10.0::DOUBLE + (doc_id + line_no) % 3 AS font_size, kind = 'heading' AS bold,
    'Style ' || length(regexp_extract(line, {HEAD}, 1)) AS style_name
  FROM (SELECT *, {_KIND} AS kind FROM lines WHERE bare <> ''))
"""
