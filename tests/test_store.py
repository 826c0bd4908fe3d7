"""Store queries, operations and streams on small inputs, against brute force."""

import hashlib
import json
import math
import random
import tempfile

from pyspark.sql import functions as F

from quillspark.operators import ops as O
from quillspark.plans import store as S
from quillspark.streaming import jobs


def test_percentiles_match_a_sort(spark):
    rnd = random.Random(7)
    groups = {"flat": [3.0] * 50, "one": [1.5], "skewed": [rnd.paretovariate(0.5) for _ in range(400)], "tie": [1.0] * 99 + [2.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "name string, value double")
    got = {(r.name, r.quantile): r.value for r in O.nearest_rank(rows, [0.5, 0.95, 0.99], bins=8).collect()}
    for name, values in groups.items():
        for q in (0.5, 0.95, 0.99):
            assert got[name, q] == sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def chain(n, tamper=None):
    previous, rows = "GENESIS", []
    for seq in range(1, n + 1):
        event = {"id": f"e{seq}", "occurred_at": f"2024-01-0{seq}", "actor_id": "ann", "action": "read", "resource_type": "doc",
                 "resource_id": "1", "outcome": "success", "metadata": {"city": 'Zü"rich', "a": "1"}, "previous_hash": previous}
        text = json.dumps(event, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append({**event, "chain": 1, "seq": seq, "event_hash": "bad" if seq == tamper else digest})
        previous = digest
    return rows


SCHEMA = ("chain bigint, seq int, id string, occurred_at string, actor_id string, action string, resource_type string, "
          "resource_id string, outcome string, metadata map<string,string>, previous_hash string, event_hash string")


def test_audit_chain(spark):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    frame = lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    assert O.chain_status(O.verify_chain(frame(chain(5)))).first().valid
    broken = O.chain_status(O.verify_chain(frame(chain(5, tamper=3)))).first()
    assert not broken.valid and broken.first_broken == 3


def test_retention_and_hold(spark):
    rows = spark.createDataFrame([("document", "2024-01-01", False), ("document", "2024-01-01", True), ("audit", "2024-01-01", False)],
                                 "data_class string, c string, legal_hold boolean").select("data_class", F.col("c").cast("timestamp").alias("created_at"), "legal_hold")
    assert [r.expired for r in O.retention(rows, F.lit("2024-06-01").cast("timestamp")).collect()] == [True, False, False]


def test_histogram_bucket(spark):
    got = {r.le: r.bucket for r in O.histogram(spark.createDataFrame([("d", 0.08)], "name string, value double")).collect()}
    assert got["0.05"] == 0 and got["0.1"] == 1 and got["+Inf"] == 1


def test_timeline_over_months(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 3), f"2024-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}", rnd.randint(0, 100)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id bigint, document_id bigint, d string, score int").withColumn("created_at", F.col("d").cast("timestamp"))
    got = {r.id: (r.position, r.score_change) for r in S.timeline(frame).collect()}
    for doc in (1, 2, 3):
        ordered = sorted((r for r in rows if r[1] == doc), key=lambda r: (r[2], r[0]))
        for n, r in enumerate(ordered):
            assert got[r[0]] == (n + 1, None if n == 0 else r[3] - ordered[n - 1][3])


def test_compare_two_runs(spark):
    issues = spark.createDataFrame([(1, "a", "high"), (1, "b", "low"), (2, "b", "low"), (2, "c", "high"), (2, "c", "high")],
                                   "session_id bigint, issue_id string, severity string")
    pairs = spark.createDataFrame([(9, 1, 2)], "pair_id bigint, first_session bigint, second_session bigint")
    row = S.compare_runs(issues, pairs).first()
    assert (row.improved, row.new, row.remaining, row.issue_change, row.high_change) == (1, 1, 1, 1, 1)


def test_streams(spark):
    source, out, check = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    rows = [(i, "general", t, f"2024-01-01 00:0{i}:00") for i, t in enumerate(["plain , text", "# T\nfine", "plain , text"])]
    frame = spark.createDataFrame(rows, "doc_id bigint, profile_id string, text string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    frame.write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    jobs.incremental_review(stream, f"{out}/issues", f"{check}/review", rule_ids=["writing.punctuation", "structure.title-check"]).awaitTermination()
    got = sorted((r.doc_id, r.issue_id) for r in spark.read.parquet(f"{out}/issues").collect())
    assert got == [(0, "structure.no-title"), (0, "writing.punctuation-1"), (2, "structure.no-title"), (2, "writing.punctuation-1")]
    seen = jobs.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{check}/seen").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("seen").count() == 2
    for _ in range(2):
        jobs.first_seen_table(stream, f"{out}/firsts", checkpoint=f"{check}/firsts").awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/firsts").collect()) == [0, 1]
    frame.withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(source)
    jobs.first_seen_table(stream, f"{out}/firsts", checkpoint=f"{check}/firsts").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/firsts").collect()) == [0, 1]
