"""ST1-ST3: incremental review, windowed metrics, first-seen texts; session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.review import issue_rows, review_rows
from ..session import shared_dir


def incremental_review(docs: DataFrame, out: str, checkpoint: str | None = None, **options):
    """ST1: new documents through the stateless review, issues appended. Exactly-once by the file sink."""
    issues = issue_rows(review_rows(docs, **options))
    folder = checkpoint or f"{shared_dir(docs.sparkSession)}/incremental-review"
    return issues.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder).trigger(availableNow=True).start()


def windowed_metrics(samples: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """ST2: counts and sums per window and name; late samples are dropped after the watermark.

    Spark combines partial sums before the shuffle, so a hot name costs one row per task and window.
    """
    return samples.withWatermark("ts", delay).groupBy(F.window("ts", width), "name").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak")).select(
        F.col("window.start").alias("window_start"), "name", "n", "total", "peak")


def first_seen(docs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST3: the first copy of every text within the watermark.

    Only the hash and id travel; copies of one text meet in one state entry.
    """
    return docs.withColumn("text_hash", F.sha2("text", 256)).drop("text").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["text_hash"])


def first_seen_table(docs: DataFrame, out: str, horizon: str = "1 day", checkpoint: str | None = None):
    """ST3 for hot texts: the first copies as a table, one ``epoch`` folder per micro-batch.

    Copies inside a batch fold by partial aggregation before the shuffle, so a text that makes up a third of the
    input costs one row per task; what is left is unique and meets the texts seen within the horizon in an
    anti-join. A repeated epoch overwrites its own folder.
    """
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "text_hash string, doc_id bigint, ts timestamp")
    empty.write.mode("ignore").parquet(f"{out}/epoch=-1")

    def fold(batch: DataFrame, epoch: int) -> None:
        firsts = batch.groupBy(F.sha2("text", 256).alias("text_hash")).agg(
            F.min(F.struct("ts", "doc_id")).alias("f")).select("text_hash", "f.doc_id", "f.ts")
        seen = spark.read.schema("text_hash string, doc_id bigint, ts timestamp, epoch bigint").parquet(out).where(
            F.col("epoch") != epoch).select("text_hash", F.col("ts").alias("seen_at"))
        recent = (firsts["text_hash"] == seen["text_hash"]) & (seen["seen_at"] >= firsts["ts"] - F.expr(f"INTERVAL {horizon}"))
        firsts.join(seen, recent, "left_anti").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    folder = checkpoint or f"{shared_dir(spark)}/first-seen"
    return docs.writeStream.foreachBatch(fold).option("checkpointLocation", folder).trigger(availableNow=True).start()


def first_seen_batch(docs: DataFrame) -> DataFrame:
    """The batch form: partial aggregation folds copies inside each task before the shuffle."""
    return docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def user_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Review sessions: events of a user with no gap longer than ``gap``."""
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        "user_id", F.col("session_window.start").alias("session_start"), "n", "total")
