"""Learn a format template from blocks and layout, compare documents with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rx

EMU_PER_INCH = 914400.0
MARGINS = ("top", "bottom", "left", "right")


def demirrored(text: Column) -> Column:
    """Text made of two equal halves is halved."""
    bare = rx.strip(text)
    half = F.floor(F.length(bare) / 2).cast("int")
    mirrored = (F.length(bare) % 2 == 0) & (F.left(bare, half) == F.right(bare, half)) & (bare != "")
    return F.when(mirrored, rx.strip(F.left(bare, half))).otherwise(bare)


def learn(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """One template row per document: layout in inches, body, first style per heading level, sections.

    ``min_by`` keeps the first block per key with map-side combine.
    """
    headings = blocks.where("type = 'heading'").withColumn("title", demirrored(F.col("text"))).where("title <> ''")
    styles = headings.groupBy("doc_id", F.when(F.col("level") > 0, F.col("level")).otherwise(F.lit(1)).alias("lvl")).agg(
        F.min_by(F.struct("style_name", "font_name", F.round("font_size", 2).alias("font_size"), "bold", "alignment"),
                 "block_idx").alias("style"))
    per_doc_styles = styles.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("lvl", "style")))).alias("heading_styles"))
    sections = headings.groupBy("doc_id", F.lower("title").alias("key")).agg(
        F.min(F.struct("block_idx", "title")).alias("first"))
    per_doc_sections = sections.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list("first")), lambda s: s["title"]).alias("required_sections"))
    signals = blocks.groupBy("doc_id").agg(
        F.count_if(F.col("type") == "table").alias("table_count"),
        F.count_if(F.col("type") == "figure").alias("figure_count"))
    inches = [F.round(F.col(f"margin_{m}") / EMU_PER_INCH, 2).alias(f"margin_{m}_in") for m in MARGINS]
    return (
        layout.select("doc_id", "body_font", F.round("body_size", 2).alias("body_size"), *inches)
        .join(per_doc_styles, "doc_id", "left").join(per_doc_sections, "doc_id", "left").join(signals, "doc_id", "left"))


def compare_layout(layout: DataFrame, template: DataFrame) -> DataFrame:
    """One row per deviation. ``template``: one row per template_id; documents name theirs.

    The template table has a row per uploaded template; Spark broadcasts it while it is below the session's
    threshold and shuffles on template_id otherwise.
    """
    t = template.select(
        "template_id", F.col("body_font").alias("t_font"), F.col("body_size").alias("t_size"),
        *[F.col(f"margin_{m}_in").alias(f"t_{m}") for m in MARGINS])
    joined = layout.join(t, "template_id")

    def margin(m: str) -> Column:
        actual, expected = F.col(f"margin_{m}") / EMU_PER_INCH, F.col(f"t_{m}")
        return F.when(
            (expected != 0) & (actual != 0) & (F.abs(expected - actual) > 0.08),
            F.struct(F.lit(f"template.layout.margin_{m}_in").alias("rule_id"), F.lit("medium").alias("severity"),
                     F.concat(F.lit(f"Page {m} margin is "), rx.half_even(actual, 2), F.lit(" in; the reference template uses "),
                              rx.half_even(expected, 2), F.lit(" in.")).alias("message")))

    font = F.when(
        (F.col("t_font") != "") & (F.col("body_font") != "") & (F.lower("t_font") != F.lower("body_font")),
        F.struct(F.lit("template.body.font").alias("rule_id"), F.lit("medium").alias("severity"),
                 F.concat(F.lit("Body font is "), F.col("body_font"), F.lit("; the reference template uses "),
                          F.col("t_font"), F.lit(".")).alias("message")))
    size = F.when(
        (F.col("t_size") != 0) & (F.col("body_size") != 0) & (F.abs(F.col("t_size") - F.col("body_size")) > 0.25),
        F.struct(F.lit("template.body.font_size").alias("rule_id"), F.lit("low").alias("severity"),
                 F.concat(F.lit("Body font size is "), shortest(F.col("body_size")), F.lit(" pt; the reference template uses "),
                          shortest(F.col("t_size")), F.lit(" pt.")).alias("message")))
    found = F.array_compact(F.array(*[margin(m) for m in MARGINS], font, size))
    return joined.select("doc_id", F.explode_outer(found).alias("i")).where("i IS NOT NULL").select("doc_id", "i.*")


def shortest(number: Column) -> Column:
    """Number without trailing zeros."""
    return F.regexp_replace(number.cast("string"), r"\.0+$", "")


def missing_sections(documents: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Template sections absent from a document's headings and heading blocks.

    ``documents(doc_id, template_id, headings)``, ``sections(template_id, section)``.
    """
    wanted = documents.select("doc_id", "template_id").join(sections, "template_id").withColumn(
        "key", F.lower(rx.strip(F.col("section"))))
    own = documents.select("doc_id", F.explode("headings").alias("h")).select("doc_id", F.col("h.key").alias("key"))
    blocky = blocks.where("type = 'heading'").select("doc_id", F.lower(demirrored(F.col("text"))).alias("key"))
    return wanted.join(own.unionByName(blocky), ["doc_id", "key"], "left_anti").select("doc_id", "section")
