"""Structures that keep old rows from being read again, and plans for hot owners, against plain forms."""

import collections
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ops as O
from quillspark.plans import store as S
from quillspark.session import shared_dir


def _folder(spark, what):
    return f"{shared_dir(spark)}/{what}-{time.time_ns()}"


def test_snapshot_and_deltas_equal_the_full_fold(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["issue", "session"]), str(rnd.randint(0, 9)), rnd.choice([None, "a", "b"]), rnd.choice(["open", "resolved", "ignored"]), t) for t in range(400)]
    events = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "target string, key string, category string, status string, at long, n int")
    plain = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = plain(S.newest_events(events))
    log = S.StatusLog(spark, _folder(spark, "status"))
    with pytest.raises(ValueError):
        log.state()
    order = [3, 0, 2, 1, 4]  # late batches: time does not follow the batch
    for batch, part in enumerate(order):
        log.add(events.where(F.col("n") % 5 == part), batch)
        log.add(events.where(F.col("n") % 5 == part), batch)
        if batch in (1, 3):
            log.compact()
            log.compact()
    assert plain(log.state()) == want and log._numbers("snapshot") == [1, 3]
    read = log.state().inputFiles()
    assert all("snapshot/3" in f or "delta/4" in f for f in read)
    with pytest.raises(ValueError):
        log.add(events, 2)


@pytest.fixture(scope="module")
def library(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcXé_%") for _ in range(rnd.randint(0, 6)))
    documents = spark.createDataFrame([(i, word()) for i in range(60)] + [(60, None), (61, "b")], "id long, original_name string")
    sessions = spark.createDataFrame([(i, word(), f"{word()} {word()}") for i in range(60)], "id long, filename string, summary string")
    issues = spark.createDataFrame([(f"i{i}", f"Item {i % 5} of abc", word()) for i in range(90)], "id string, message string, recommendation string")
    index = S.SearchIndex(spark, _folder(spark, "search"), parts=8)
    index.build(documents, sessions, issues)
    return (documents, sessions, issues), index


@pytest.mark.parametrize("needle", ["abc", "ABC", "item 3", "a", "bx", "é", "_", "a_c", "a%b", "zzz", "abcabcabc", "of abc", ""])
def test_the_index_finds_what_the_scan_finds(spark, library, needle):
    tables, index = library
    count = lambda df: collections.Counter(tuple(r) for r in df.collect())
    assert count(index.search(needle)) == count(S.search(*tables, needle))


def test_a_search_reads_few_partitions(spark, library):
    plan = library[1].search("item 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "part#" in plan.split("PartitionFilters")[1]


def test_percentiles_from_sketches_of_days(spark):
    rnd = random.Random(3)
    rows = [(n, float(rnd.randint(0, 500)) if n == "a" else rnd.paretovariate(0.3), f"2024-01-0{rnd.randint(1, 9)} 10:00:00") for n in "aab" for _ in range(1500)]
    rows += [("a", None, None), ("a", float("nan"), "2024-01-01 00:00:00"), ("one", 7.0, "2024-01-01 00:00:00")]
    samples = spark.createDataFrame(rows, "name string, value double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    days = O.sketch_days(samples, bins=128)
    quantiles = [0.0, 0.01, 0.5, 0.95, 1.0]
    for given in (days, None):
        got = {(r.name, r.quantile): (r.value, r.max) for r in O.nearest_rank(samples, quantiles, bins=128, days=given).collect()}
        for name in ("a", "b", "one"):
            values = sorted(v for n, v, _ in rows if n == name and v is not None and not math.isnan(v))
            assert all(got[name, q] == (values[max(0, math.ceil(q * len(values)) - 1)], values[-1]) for q in quantiles)
    for r in O.approximate_rank(days, [0.5, 0.95]).collect():
        values = sorted(v for n, v, _ in rows if n == r.name and v is not None and not math.isnan(v))
        assert values[max(0, int((r.quantile - 0.06) * len(values)) - 1)] <= r.value <= values[min(len(values) - 1, int((r.quantile + 0.06) * len(values)))]


def test_a_hot_owner_is_split_over_runs(spark):
    rnd = random.Random(4)
    rows = [(i, 1 if i % 10 else rnd.choice([2, 3, None]), rnd.randint(0, 100), 5 if i % 3 else rnd.randint(0, 9)) for i in range(3000)]
    sessions = spark.createDataFrame(rows, "id long, document_id long, score int, s int").select("id", "document_id", "score", F.timestamp_seconds("s").alias("created_at"))
    got = {r.id: (r.position, r.score_change, r.seconds_since) for r in S.timeline(sessions.repartition(6), ranges=16).collect()}
    want, last, place = {}, {}, collections.Counter()
    for i, owner, score, s in sorted(rows, key=lambda r: (r[3], r[0])):
        place[owner] += 1
        before = last.get(owner)
        want[i] = (place[owner], score - before[0] if before else None, s - before[1] if before else None)
        last[owner] = (score, s)
    assert got == want
    # two thirds of the hot owner's rows have one time: ranges split them by id all the same
    order = ["document_id", "created_at", "id"]
    runs = sorted(r["count"] for r in sessions.repartitionByRange(16, *order).withColumn("run", F.spark_partition_id()).groupBy("document_id", "run").count().collect())
    assert runs[-1] < 5 * 3000 / 16
