"""The corpus pipeline: from raw documents to the rows of a training mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import minhash, mixture, profiles, suffixes, wu_manber
from quillspark.llm.store import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; those without (null texts, no letters, no n-gram of a known language) go."""
    docs = docs.select(*COLUMNS)
    return profiles.identify(docs, profiles.learn(docs)).where("lang_pred <> 'und' AND score > 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, the one of the smallest doc_id.

    Rows of one doc_id and one text are one document, of which one row stays; other texts of that doc_id go only if they are
    copies themselves. Rows with a null doc_id all stay. Texts of one doc_id are told apart by a hash of 64 bits.
    """
    docs = docs.select(*COLUMNS)
    kept = minhash.survivors(docs.select("doc_id", "text"), size=5, percent=80)
    own = docs.where("doc_id IS NOT NULL").withColumn("mark", F.xxhash64("text")).join(kept, ["doc_id", "mark"], "left_semi")
    own = own.dropDuplicates(["doc_id", "mark"]).drop("mark")
    return own.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice are cut out of the texts; documents with nothing left of their text go."""
    cut = suffixes.without_repeats(docs.select(*COLUMNS), length=200, text=True)
    return (cut.where(r"n_removed = 0 OR text RLIKE '[^\\s]'")
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return wu_manber.contamination(docs.select(*COLUMNS), items).where("NOT contaminated").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order and number that the target weights of their sources ask for."""
    return mixture.mixed(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language), ("minhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", benchmark), ("source_mixing", mixed)]

#: No SQL tells near copies by signatures or cuts texts by bytes: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
