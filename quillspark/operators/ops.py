"""Metrics, alerts, audit chain, retention, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import fixes as X
from ..session import stored


def histogram(samples: DataFrame, *labels: str) -> DataFrame:
    """Cumulative bucket counts, sum and count per metric and label.

    Every sample adds to one partial aggregate with a counter per bound; nothing is exploded before the shuffle.
    """
    bounds = [*[f"{b:g}" for b in X.HISTOGRAM_BOUNDS], "+Inf"]
    counters = [F.count_if(F.col("value") <= b).alias(f"le_{i}") for i, b in enumerate(X.HISTOGRAM_BOUNDS)]
    grouped = samples.groupBy("name", *labels).agg(
        *counters, F.count("value").alias(f"le_{len(X.HISTOGRAM_BOUNDS)}"), F.sum("value").alias("total"), F.count("*").alias("n"))
    buckets = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("bucket")) for i, b in enumerate(bounds)])
    return grouped.select("name", *labels, "total", "n", F.explode(buckets).alias("b")).select(
        "name", *labels, "b.le", "b.bucket", "total", "n")


def counters(samples: DataFrame, *labels: str) -> DataFrame:
    """O02."""
    return samples.groupBy("name", *labels).agg(F.sum("value").alias("value"))


def route_label(path: Column, segments: int | None = None) -> Column:
    """Long ids become ``{id}``; the first ``segments`` only where a number is given."""
    parts = F.split(F.btrim(path, F.lit("/")), "/", -1)
    parts = parts if segments is None else F.slice(parts, 1, segments)
    return F.concat(F.lit("/"), F.array_join(F.transform(
        parts, lambda p: F.when((F.length(p) >= 24) & p.rlike("^[A-Za-z0-9-]+$"), F.lit("{id}")).otherwise(p)), "/"))


def alerts(snapshots: DataFrame) -> DataFrame:
    """Alert rows of every snapshot. ``snapshots(snapshot_id, values MAP<STRING, DOUBLE>)``."""
    v = F.col("values")
    found = [F.when(v[code] > limit, F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), v[code].alias("value"), F.lit(limit).alias("threshold")))
        for code, limit, severity in X.ALERT_LIMITS]
    found.append(F.when(v["ai_available"] < 1, F.struct(
        F.lit("ai_available").alias("code"), F.lit("warning").alias("severity"), v["ai_available"].alias("value"), F.lit(1.0).alias("threshold"))))
    return snapshots.select("snapshot_id", F.explode_outer(F.array_compact(F.array(*found))).alias("a")).where(
        "a IS NOT NULL").select("snapshot_id", "a.*")


def json_text(value: Column) -> Column:
    """A JSON string literal with non-ASCII left as is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_event() -> Column:
    """Keys in order, no spaces; ``metadata`` is a map of strings, sorted."""
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    meta = F.concat(F.lit("{"), F.array_join(F.transform(
        entries, lambda e: F.concat(json_text(e["k"]), F.lit(":"), json_text(e["v"]))), ","), F.lit("}"))
    plain = lambda name: F.concat(F.lit(f'"{name}":'), json_text(F.col(name)))
    return F.concat(
        F.lit("{"), plain("action"), F.lit(","), plain("actor_id"), F.lit(","), plain("id"), F.lit(',"metadata":'), meta,
        F.lit(","), plain("occurred_at"), F.lit(","), plain("outcome"), F.lit(","), plain("previous_hash"), F.lit(","),
        plain("resource_id"), F.lit(","), plain("resource_type"), F.lit("}"))


def verify_chain(log: DataFrame) -> DataFrame:
    """Per event, does its hash match and does it name its predecessor's hash.

    The predecessor comes from a join on (chain, seq - 1), not from a window: one chain may hold most of the log,
    and the join keys still spread it over all tasks.
    """
    before = log.select("chain", (F.col("seq") + 1).alias("seq"), F.col("event_hash").alias("expected"))
    joined = log.join(before, ["chain", "seq"], "left")
    return joined.select(
        "chain", "seq", (F.sha2(canonical_event(), 256) == F.col("event_hash")).alias("hash_ok"),
        (F.col("previous_hash") == F.when(F.col("seq") == 1, F.lit("GENESIS")).otherwise(F.col("expected"))).alias("link_ok"))


def chain_status(verified: DataFrame) -> DataFrame:
    """One row per chain: valid, or the first broken event."""
    good = F.coalesce(F.col("hash_ok") & F.col("link_ok"), F.lit(False))
    return verified.groupBy("chain").agg(
        F.bool_and(good).alias("valid"), F.min(F.when(~good, F.col("seq"))).alias("first_broken"), F.count("*").alias("events"))


def redacted_metadata(metadata: Column, chars: int | None = None) -> Column:
    """Secret keys hidden; other values cut only where a length is given."""
    return F.transform_values(metadata, lambda k, v: F.when(
        F.lower(k).isin(X.SECRET_KEYS), F.lit("[REDACTED]")).otherwise(v if chars is None else F.left(v, F.lit(chars))))


def retention(records: DataFrame, now: Column, days: dict[str, int] | None = None) -> DataFrame:
    """Expiry time and whether a record is expired; negative days and a legal hold never expire."""
    days = days or X.RETENTION_DAYS
    kept = None
    for name, n in days.items():
        kept = F.when(F.col("data_class") == name, F.lit(n)) if kept is None else kept.when(F.col("data_class") == name, F.lit(n))
    expiry = F.when(kept >= 0, F.col("created_at") + F.make_dt_interval(days=kept))
    return records.withColumn("expires_at", expiry).withColumn(
        "expired", F.coalesce(~F.col("legal_hold") & (now >= F.col("expires_at")), F.lit(False)))


def _clean(samples: DataFrame) -> DataFrame:
    return samples.where("value IS NOT NULL AND NOT isnan(value)")


def sketch_days(samples: DataFrame, at: str = "ts", bins: int = 1024) -> DataFrame:
    """One mergeable quantile sketch for each name and day, with count, sum and maximum.

    Days are written once, by batches or a stream; any range of days then merges its sketches without reading samples again.
    """
    return _clean(samples).groupBy("name", F.to_date(at).alias("day")).agg(
        F.kll_sketch_agg_double("value", bins).alias("sketch"), F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("hi"))


def approximate_rank(days: DataFrame, quantiles: list[float]) -> DataFrame:
    """O08 from the sketches of days alone: ``value`` is within the sketches' rank error of the nearest-rank percentile."""
    whole = days.groupBy("name").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return whole.select("name", "n", F.explode(F.array(*[
        F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in quantiles])).alias("x")).select("name", "n", "x.*")


def nearest_rank(samples: DataFrame, quantiles: list[float], bins: int = 1024, days: DataFrame | None = None) -> DataFrame:
    """Exact nearest-rank percentiles per name without sorting a group in one task.

    Null and NaN values are no samples. A sketch of each name (merged from ``days``, where those of the same samples are given) tells
    two values around each percentile. These few cuts part the name's values into ranges; the counts by range tell which one holds
    each rank, and only its values are counted one by one. Cuts that miss make that range longer, never the answer wrong.
    """
    clean = _clean(samples)
    if days is None:
        span = clean.groupBy("name").agg(
            F.kll_sketch_agg_double("value", bins).alias("sketch"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("hi"))
    else:
        span = days.groupBy("name").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("hi").alias("hi"))
    error = 4.6 / bins**0.9  # twice the sketch's rank error
    ranks = [F.lit(float(r)) for q in quantiles for r in (max(0.0, q - error), min(1.0, q + error))]
    span = span.withColumn("cuts", F.array_sort(F.array_distinct(F.array(*[F.kll_sketch_get_quantile_double("sketch", r) for r in ranks])))).drop("sketch")
    span = stored(span, "percentiles")  # a sketch is random: what the ranges and their counts see must be the same cuts
    # 2 k: between the cuts k - 1 and k; 2 k + 1: at cut k
    ranged = clean.join(span.select("name", "cuts"), "name").select(
        "name", "value", (2 * F.size(F.filter("cuts", lambda c: c < F.col("value"))) + F.array_contains("cuts", F.col("value")).cast("int")).alias("bin"))
    counts = ranged.groupBy("name", "bin").agg(F.count("*").alias("size"))
    running = Window.partitionBy("name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    wanted = span.select("name", "n", "mean", "hi", F.explode(F.array(*[F.lit(q) for q in quantiles])).alias("quantile")).withColumn(
        "rank", F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("n"))))
    targets = counts.join(wanted, "name").where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("size")))
    values = ranged.join(targets.select("name", "bin").distinct(), ["name", "bin"], "left_semi").groupBy("name", "bin", "value").agg(F.count("*").alias("c"))
    placed = values.withColumn("upto", F.sum("c").over(Window.partitionBy("name", "bin").orderBy("value")))
    hits = placed.join(targets, ["name", "bin"]).where(F.col("before") + F.col("upto") >= F.col("rank"))
    return hits.groupBy("name", "quantile").agg(
        F.min("value").alias("value"), F.round(F.first("mean"), 2).alias("mean"), F.first("hi").alias("max"))
