"""The registered queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, lattice, minhash, mixture, ordinal, pitman_yor, profiles, sanitize, suffixes, viterbi, warc, whitening, wu_manber

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=3, percent=85)


def op2_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def op3_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = profiles.learn(docs.where(_remainder(3) != 1))
    return (profiles.identify(docs.select("doc_id", "text"), learned)
            .select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score"))


def op4_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op5_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return wu_manber.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (_remainder(10) == 0).alias("held_out"), "text")
    return pitman_yor.scores(docs, pitman_yor.fit(docs.where("NOT held_out").select("text")))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op8_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixture.mixed(docs).drop("text")


def op9_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return viterbi.token_counts(docs, PIECES).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    model = ordinal.learn(docs, labels.select("doc_id", grade.alias("grade")), levels=3)
    return ordinal.graded(docs, model, at_least=2).drop("text")


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


def op12_information_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize.sanitised(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text", "clean_text")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}
