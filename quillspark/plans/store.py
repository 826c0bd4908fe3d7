"""Q-01 to Q-14: queries over the review store (sessions, issues, documents)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored


def _ilike(needle: str | None, *columns: str) -> Column:
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{needle}%")
    return hit


def _equal(**filters) -> Column:
    keep = F.lit(True)
    for column, value in filters.items():
        if value is not None:
            keep = keep & (F.col(column) == value)
    return keep


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0, total: bool = False) -> DataFrame:
    """Ordered page of ``limit`` rows, of which Spark keeps only the top rows of each partition; all rows, unordered, without a limit.

    ``total`` adds the number of rows of all pages to each row of this one: a count beside the page, one row to every task.
    """
    if total:
        return page(df, order, limit, offset).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
    if limit is None:
        if offset:
            raise ValueError("an offset needs a limit: without one all rows would go through one task")
        return df
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def list_sessions(sessions: DataFrame, search: str | None = None, score_min: int | None = None,
                  score_max: int | None = None, limit: int | None = None, offset: int = 0, total: bool = False, **equal) -> DataFrame:
    """Q-01; with ``total``, the number of sessions that match beside each row."""
    keep = _equal(**equal) & _ilike(search, "filename", "summary")
    if score_min is not None:
        keep = keep & (F.col("score") >= score_min)
    if score_max is not None:
        keep = keep & (F.col("score") <= score_max)
    return page(sessions.where(keep), [F.desc("created_at"), "id"], limit, offset, total)


def severity_order(other: int = 2) -> Column:
    return F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(other)


def list_issues(issues: DataFrame, session_id, search: str | None = None, limit: int | None = None, offset: int = 0,
                **equal) -> DataFrame:
    """Q-02: issues of one session."""
    keep = (F.col("session_id") == session_id) & _equal(**equal) & _ilike(search, "message", "recommendation")
    return page(issues.where(keep), [severity_order(), F.desc("created_at"), "id"], limit, offset)


def with_session(issues: DataFrame, sessions: DataFrame, *columns: str) -> DataFrame:
    """Issues joined with columns of their session."""
    side = sessions.select(F.col("id").alias("session_id"), *columns)
    return issues.join(side, "session_id")


def list_all_issues(issues: DataFrame, sessions: DataFrame, search: str | None = None, limit: int | None = None,
                    offset: int = 0, total: bool = False, **equal) -> DataFrame:
    """Q-03; with ``total``, the number of issues that match beside each row."""
    joined = with_session(issues.where(_ilike(search, "message", "recommendation")), sessions,
                          F.col("filename").alias("session_filename"), "profile_id", "user_id").where(_equal(**equal))
    return page(joined, [severity_order(), F.desc("created_at"), "id"], limit, offset, total)


def issue_evidence(issues: DataFrame, sessions: DataFrame, issue_ids: DataFrame) -> DataFrame:
    """Q-04: evidence and file name of the issues asked for."""
    asked = issues.join(issue_ids, "id", "left_semi").select(
        "id", "session_id", "evidence_excerpt", "evidence_line_start", "evidence_line_end", "evidence_location")
    return with_session(asked, sessions, "filename")


def issue_history(issues: DataFrame, sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """Q-05: the same issue id in other sessions of the same document. ``asked(session_id, issue_id)``."""
    origin = asked.join(sessions.select(F.col("id").alias("session_id"), "document_id"), "session_id").select(
        F.col("session_id").alias("asked_session"), "issue_id", "document_id")
    scans = with_session(issues, sessions, "document_id", F.col("created_at").alias("session_created_at"),
                         F.col("score").alias("session_score"))
    return scans.join(origin, ["document_id", "issue_id"]).where("session_id <> asked_session").select(
        "asked_session", "issue_id", "session_id", "id", "severity", "status", "session_created_at", "session_score")


def sessions_of_document(sessions: DataFrame, document_id, user_id=None) -> DataFrame:
    """Q-06."""
    return sessions.where(_equal(document_id=document_id, user_id=user_id)).select(
        "id", "created_at", "profile_id", "status", "score", "summary")


EVENT_KEYS = ["target", "key", "category"]


def newest_events(events: DataFrame) -> DataFrame:
    """(target, key, category, last, closed): the latest event of each key, and the time of its last closing one."""
    category = F.when(F.col("target") == "session", F.col("category"))  # has no meaning for one issue
    closing = F.col("status").isin("resolved", "ignored")
    return events.groupBy("target", "key", category.alias("category")).agg(
        F.max(F.struct("at", "status")).alias("last"), F.max(F.when(closing, F.col("at"))).alias("closed"))


class StatusLog:
    """Q-07 over a growing log of updates: a compacted snapshot, the latest event of each key, and the batches since then.

    A batch is folded when it comes and written as its own delta; a repeated batch replaces it. ``compact`` folds the snapshot and the
    deltas since then into a new one, in a folder that counts once it is complete, so old events are never folded again and a failed
    compaction leaves the state as it was. Batch numbers grow.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, what: str) -> list[int]:
        """Numbers of the complete tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        made = [f.getPath() for f in files.listStatus(path)]
        return sorted(int(p.getName()) for p in made if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def add(self, events: DataFrame, batch: int) -> None:
        done = self._numbers("snapshot")
        if done and batch <= done[-1]:
            raise ValueError(f"batch {batch} is in the snapshot already")
        newest_events(events).write.mode("overwrite").parquet(f"{self.folder}/delta/{batch}")

    def state(self) -> DataFrame:
        """The latest event of each key: the snapshot and the deltas since then, merged."""
        done = self._numbers("snapshot")[-1:]
        parts = [f"{self.folder}/snapshot/{n}" for n in done] + [f"{self.folder}/delta/{n}" for n in self._numbers("delta") if not done or n > done[0]]
        if not parts:
            raise ValueError("no events yet")
        return self.spark.read.parquet(*parts).groupBy(*EVENT_KEYS).agg(F.max("last").alias("last"), F.max("closed").alias("closed"))

    def compact(self) -> None:
        """Makes the state the new snapshot. Older snapshots and deltas are not read any more and may be removed."""
        upto = self._numbers("delta")[-1:]
        if upto and upto != self._numbers("snapshot")[-1:]:
            self.state().write.mode("overwrite").parquet(f"{self.folder}/snapshot/{upto[0]}")


def current_status(issues: DataFrame, events: DataFrame) -> DataFrame:
    """Q-07: status after all update events; the latest event wins, a resolve time once set is kept.

    ``events(target, key, category, status, at)``: target ``issue`` updates one issue, ``session`` all of a session,
    of one category when given (the category of an ``issue`` event has no meaning). Events fold to the newest per key before they meet the issues.
    """
    return status_of(issues, newest_events(events))


def status_of(issues: DataFrame, state: DataFrame) -> DataFrame:
    """Q-07 from the latest event of each key, as ``newest_events`` or a StatusLog gives them."""
    def side(where: str, name: str, *keys) -> DataFrame:
        return state.where(where).select(*keys, F.col("last").alias(name), F.col("closed").alias(f"{name}_closed"))

    own = side("target = 'issue'", "a", F.col("key").alias("id"))
    any_cat = side("target = 'session' AND category IS NULL", "b", F.col("key").alias("session_id"))
    one_cat = side("target = 'session' AND category IS NOT NULL", "c", F.col("key").alias("session_id"), "category")
    joined = issues.withColumn("session_id", F.col("session_id").cast("string")).join(own, "id", "left").join(
        any_cat, "session_id", "left").join(one_cat, ["session_id", "category"], "left")
    last = F.greatest("a", "b", "c")
    return joined.select(
        "id", "session_id", "category", F.coalesce(last["status"], F.col("status")).alias("status"),
        F.greatest("a_closed", "b_closed", "c_closed").alias("resolved_at"))


def dashboard(sessions: DataFrame, issues: DataFrame, top: int = 5) -> DataFrame:
    """Q-08 as (section, key, value, position) rows: two passes, one over each table."""
    joined = issues
    totals = sessions.agg(F.count("*").alias("n"), F.bround(F.coalesce(F.avg("score"), F.lit(0))).alias("mean")).select(
        F.explode(F.array(
            F.struct(F.lit("total_reviews").alias("key"), F.col("n").cast("double").alias("value")),
            F.struct(F.lit("average_score").alias("key"), F.col("mean").cast("double").alias("value")))).alias("x")
    ).select(F.lit("summary").alias("section"), "x.key", "x.value")
    # one scan: totals, severities and categories come from the same grouping sets
    cube = joined.groupingSets([[], [F.col("severity")], [F.col("category")]], "severity", "category").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "resolved").alias("resolved"), F.grouping_id().alias("g"))
    counts = cube.select(F.explode(
        F.when(F.col("g") == 3, F.array(
            F.struct(F.lit("summary").alias("section"), F.lit("total_issues").alias("key"), F.col("n").cast("double").alias("value")),
            F.struct(F.lit("summary").alias("section"), F.lit("open_issues").alias("key"), F.col("open").cast("double").alias("value")),
            F.struct(F.lit("summary").alias("section"), F.lit("resolved_issues").alias("key"), F.col("resolved").cast("double").alias("value"))))
        .when(F.col("g") == 1, F.array(F.struct(
            F.lit("by_severity").alias("section"), F.col("severity").alias("key"), F.col("n").cast("double").alias("value"))))
        .otherwise(F.array(F.struct(
            F.lit("category").alias("section"), F.col("category").alias("key"), F.col("n").cast("double").alias("value"))))).alias("x")).select("x.*")
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "key"))
    bounded = counts.withColumn("rank", rank).where((F.col("section") != "category") | (F.col("rank") <= top))
    return totals.unionByName(bounded.select("section", "key", "value"))


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    """Q-08: newest sessions."""
    return page(sessions, [F.desc("created_at"), "id"], n).select("id", "filename", "profile_id", "score", "created_at")


def category_shares(issues: DataFrame) -> DataFrame:
    """Q-09: share of issues per category in percent, one decimal."""
    counts = issues.groupBy("category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per category
    return counts.select("category", "n", F.round(F.col("n") / total * 100, 1).alias("percent"))


def score_trend(sessions: DataFrame, n: int = 10) -> DataFrame:
    """Q-09: the newest scores, oldest first."""
    return page(sessions, [F.desc("created_at"), F.desc("id")], n).select("created_at", "id", "score").orderBy("created_at", "id")


def _sides(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (pair, issue id) the issues of either session, in all and by severity; no set is gathered anywhere."""
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.col("first_session").alias("session_id"), F.lit(1).alias("side")),
        F.struct(F.col("second_session").alias("session_id"), F.lit(2).alias("side")))).alias("s")).select("pair_id", "s.*")
    hits = issues.select("session_id", "issue_id", "severity").join(sides, "session_id")
    return hits.groupBy("pair_id", "issue_id").agg(
        *[F.count_if((F.col("side") == side) & (F.col("severity") == sev)).alias(f"{sev}_{side}")
          for side in (1, 2) for sev in ("high", "medium", "low")],
        F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))


def compared_ids(issues: DataFrame, pairs: DataFrame) -> DataFrame:
    """Q-10: the issue ids of every pair as rows, each ``improved``, ``new`` or ``remaining``."""
    kind = F.when(F.col("n2") == 0, "improved").when(F.col("n1") == 0, "new").otherwise("remaining")
    return _sides(issues, pairs).select("pair_id", kind.alias("kind"), "issue_id")


def compare_runs(issues: DataFrame, pairs: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Q-10: counts of improved, new and remaining issue ids per session pair, and with ``sessions`` both scores.

    ``pairs(pair_id, first_session, second_session)``.
    """
    counts = _sides(issues, pairs).groupBy("pair_id").agg(
        F.sum("n1").alias("issues_1"), F.sum("n2").alias("issues_2"), (F.sum("n2") - F.sum("n1")).alias("issue_change"),
        F.count_if((F.col("n1") > 0) & (F.col("n2") == 0)).alias("improved"),
        F.count_if((F.col("n1") == 0) & (F.col("n2") > 0)).alias("new"),
        F.count_if((F.col("n1") > 0) & (F.col("n2") > 0)).alias("remaining"),
        *[(F.sum(f"{sev}_2") - F.sum(f"{sev}_1")).alias(f"{sev}_change") for sev in ("high", "medium", "low")])
    if sessions is None:
        return counts
    first = sessions.select(F.col("id").alias("first_session"), F.col("score").alias("score_1"))
    second = sessions.select(F.col("id").alias("second_session"), F.col("score").alias("score_2"))
    scores = pairs.join(first, "first_session").join(second, "second_session").select(
        "pair_id", "score_1", "score_2", (F.col("score_2") - F.col("score_1")).alias("score_change"))
    return counts.join(scores, "pair_id")


def search(documents: DataFrame, sessions: DataFrame, issues: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Q-11: three searches under one schema."""
    def kind(df: DataFrame, name: str, label: str, *fields: str) -> DataFrame:
        hits = df.where(_ilike(needle, *fields)).select(F.lit(name).alias("kind"), F.col("id").cast("string").alias("id"), F.col(label).alias("label"))
        return hits if limit is None else hits.orderBy("id").limit(limit)

    return kind(documents, "document", "original_name", "original_name").unionByName(
        kind(sessions, "session", "filename", "filename", "summary")).unionByName(
        kind(issues, "issue", "message", "message", "recommendation"))


class SearchIndex:
    """Q-11 without a scan: character trigrams of the texts, written by partitions, select the texts that ILIKE then confirms.

    Texts are kept once however many rows share them. Three tables: ``grams`` (gram, text key), ``texts`` and ``rows`` (the rows of each
    text), partitioned by hashes of the gram or of the key, so a search reads the partitions of a few grams and of the texts found.
    """

    def __init__(self, spark, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts

    def _part(self, of) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.parts)).cast("int").alias("part")

    @staticmethod
    def _grams(text: Column) -> Column:
        """Distinct trigrams of the lower-case text between two marks, so a text of one letter has one."""
        marked = F.concat(F.lit("\u0002"), F.lower(text), F.lit("\u0003"))
        return F.array_distinct(F.filter(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - 2)), lambda i: F.substr(marked, i, F.lit(3))), lambda g: F.length(g) == 3))

    def build(self, documents: DataFrame, sessions: DataFrame, issues: DataFrame) -> None:
        """Writes the index of the searched columns; a repeated call replaces it."""
        def rows(df: DataFrame, kind: str, label: str, *fields: str) -> DataFrame:
            keys = F.array_distinct(F.array_compact(F.array(*[F.col(f) for f in fields])))
            own = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), F.col(label).alias("label"), F.monotonically_increasing_id().alias("row"), keys.alias("texts"))
            return own.withColumn("text", F.explode_outer("texts")).drop("texts").withColumn("key", F.md5("text"))

        every = rows(documents, "document", "original_name", "original_name").unionByName(rows(sessions, "session", "filename", "filename", "summary")).unionByName(
            rows(issues, "issue", "message", "message", "recommendation"))
        self._write(every.select(self._part("key"), "key", "kind", "id", "label", "row"), "rows", "key")
        texts = every.where("key IS NOT NULL").select("key", "text").distinct()
        self._write(texts.select(self._part("key"), "key", "text"), "texts", "key")
        texts = self.spark.read.parquet(f"{self.folder}/texts")
        grams = texts.select("key", F.explode(self._grams(F.col("text"))).alias("gram"))
        self._write(grams.select(self._part("gram"), "gram", "key"), "grams", "gram")
        grams = self.spark.read.parquet(f"{self.folder}/grams")
        grams.groupBy("part", "gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/sizes")

    def _write(self, rows: DataFrame, name: str, order: str) -> None:
        # a partition is spread over tasks by its keys; within a file they are sorted, so row groups can be passed over
        rows.repartition("part", F.pmod(F.xxhash64(order, F.lit(1)), F.lit(4))).sortWithinPartitions("part", order).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}")

    def texts_like(self, needle: str, most: int = 3) -> DataFrame:
        """(part, key) of the texts that hold the needle: the rarest ``most`` of its trigrams select, ILIKE confirms."""
        texts = self.spark.read.parquet(f"{self.folder}/texts")
        literal = [p for p in re.split(r"[%_\\]", needle.lower()) if p]
        grams = sorted({p[i:i + 3] for p in literal for i in range(len(p) - 2)})
        table = self.spark.read.parquet(f"{self.folder}/grams")
        if grams:
            parts = {r.gram: r.part for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", self._part("gram")).collect()}
            sizes = self.spark.read.parquet(f"{self.folder}/sizes").where(F.col("gram").isin(grams)).collect()  # at most the needle's own
            rarest = [r.gram for r in sorted(sizes, key=lambda r: (r.n, r.gram))[:most]] if len(sizes) == len(grams) else []
            own = table.where(F.col("part").isin([parts[g] for g in rarest]) & F.col("gram").isin(rarest))
            found = own.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key")
        elif literal:  # one or two letters: every trigram that holds them
            found = table.where(F.col("gram").contains(max(literal, key=len))).select("key").distinct()
        else:  # wildcards alone
            found = texts.select("key")
        keyed = found.select(self._part("key"), "key")
        return texts.join(keyed, ["part", "key"]).where(F.col("text").ilike(f"%{needle}%")).select("part", "key")

    def search(self, needle: str) -> DataFrame:
        """(kind, id, label): the rows that ``search`` finds by a scan, each once; all rows for an empty needle."""
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        found = rows.join(self.texts_like(needle), ["part", "key"]) if needle else rows
        return found.select("kind", "id", "label", "row").dropDuplicates(["kind", "row"]).drop("row")


def issue_stats(issues: DataFrame, rows: int = 500_000) -> DataFrame:
    """Q-12: counts by severity, category and status per session; the fixed severities and statuses show zeros.

    The few combinations of a session are counted first, and each then adds to its three values. Rows are dealt before they are
    hashed, about ``rows`` to a task, so that what a task holds does not grow with the table; a hot session is dealt by combinations.
    """
    keys = ["session_id", "severity", "category", "status"]
    parts = max(issues.sparkSession.sparkContext.defaultParallelism, -(-issues.count() // rows))
    combined = issues.select(*keys).repartition(parts, *keys).groupBy(*keys).agg(F.count("*").alias("n")).repartition(parts, "session_id")
    entry = lambda dimension, value, n: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"), n.alias("n"))
    zero = F.lit(0).cast("bigint")
    entries = [entry(d, F.col(d), F.col("n")) for d in ("severity", "category", "status")]
    entries += [entry("severity", F.lit(v), zero) for v in ("high", "medium", "low")]
    entries += [entry("status", F.lit(v), zero) for v in ("open", "resolved", "ignored")]
    return combined.select("session_id", F.explode(F.array(*entries)).alias("x")).select("session_id", "x.*").groupBy(
        "session_id", "dimension", "value").agg(F.sum("n").alias("n"))


def without_deleted(sessions: DataFrame, issues: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q-13: sessions and issues that survive a delete. ``deleted(session_id)``."""
    gone = deleted.select("session_id").distinct()
    kept = sessions.join(gone.withColumnRenamed("session_id", "id"), "id", "left_anti")
    return kept, issues.join(gone, "session_id", "left_anti")


def timeline(sessions: DataFrame, owner: str = "document_id", ranges: int | None = None) -> DataFrame:
    """Q-14: score change and time since the previous session of the same owner.

    Sessions are dealt by ranges of (owner, time, id), so those of one hot owner, of whatever times, make several runs. The window
    runs within a run; the last row and the size of each run are handed to the next run of the owner in a second, small window over runs.
    The dealt rows are written, so that both see the same runs. ``ranges`` sets the number of ranges, else Spark's own is taken.
    """
    order = [owner, "created_at", "id"]
    base = sessions.select(owner, "id", "created_at", "score")
    dealt = base.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("run", F.spark_partition_id())
    dealt = stored(dealt, "timeline")
    inner = Window.partitionBy(owner, "run").orderBy("created_at", "id")
    ranked = dealt.withColumns({"prev": F.lag(F.struct("created_at", "score")).over(inner), "n": F.row_number().over(inner)})
    runs = dealt.groupBy(owner, "run").agg(F.max(F.struct("created_at", "id", "score")).alias("tail"), F.count("*").alias("size"))
    outer = Window.partitionBy(owner).orderBy("run")
    carried = runs.select(
        F.col(owner).alias("_owner"), F.col("run").alias("_run"), F.lag(F.struct(F.col("tail.created_at").alias("created_at"), F.col("tail.score").alias("score"))).over(outer).alias("carried"),
        F.coalesce(F.sum("size").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = ranked.join(carried, ranked[owner].eqNullSafe(carried["_owner"]) & (ranked["run"] == carried["_run"])).withColumn("p", F.coalesce("prev", "carried"))
    return joined.select(
        owner, "id", "created_at", "score", (F.col("before") + F.col("n")).alias("position"),
        (F.col("score") - F.col("p.score")).alias("score_change"),
        (F.unix_timestamp("created_at") - F.unix_timestamp("p.created_at")).alias("seconds_since"))
