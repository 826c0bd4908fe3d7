"""Files to documents, dispatch by suffix, corruption check before parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- fixed values: suffixes ------------------------------------------------------------
CONTENT_TYPES = {
    ".txt": "text/plain", ".md": "text/plain", ".markdown": "text/plain", ".tex": "text/x-tex", ".html": "text/html",
    ".htm": "text/html", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pdf": "application/pdf",
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def content_type(path: Column) -> Column:
    """Content type of a supported suffix, else null."""
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return kinds[suffix(path)]


def corruption(content: Column, path: Column) -> Column:
    """What is wrong with the bytes, or null."""
    kind, size = suffix(path), F.length(content)
    head = lambda n: F.hex(F.substring(content, 1, n))
    tail = F.hex(F.substring(content, -100, 100))
    return (
        F.when((kind == ".pdf") & (size < 10), "File too small to be a valid PDF")
        .when((kind == ".pdf") & (head(5) != "255044462D"), "File does not start with PDF header")
        .when((kind == ".pdf") & ~tail.contains("2525454F46"), "PDF missing end-of-file marker")
        .when((kind == ".docx") & (size < 22), "File too small to be a valid DOCX")
        .when((kind == ".docx") & (head(2) != "504B"), "File does not start with ZIP header (invalid DOCX)"))


def decoded(content: Column) -> Column:
    """UTF-8 text with bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def dispatch(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content) rows to text documents and to a quarantine of rejects."""
    checked = files.withColumns({
        "content_type": content_type(F.col("path")), "problem": corruption(F.col("content"), F.col("path"))})
    readable = F.col("content_type").isNotNull() & F.col("problem").isNull()
    documents = checked.where(readable & F.col("content_type").isin("text/plain", "text/x-tex", "text/html")).select(
        "path", "content_type", decoded(F.col("content")).alias("text"))
    rejects = checked.where(~readable).select(
        "path", F.coalesce("problem", F.lit("Supported formats: TXT, Markdown, HTML, LaTex, DOCX and PDF.")).alias("reason"))
    return documents, rejects


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return dispatch(files.select("path", "content"))
