"""Safety, operations, source, sink and streaming queries with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.fixed import fixes as X, profiles as P
from quillspark.functions import rx
from quillspark.operators import config as C, document as DOC, fix as FX, ops as O, safety as L, template as T
from quillspark.operators.fix import stable_id
from quillspark.session import shared_dir
from quillspark.sources import files as SF, store as SS
from quillspark.streaming import jobs

from .blocks import BLOCKS_SQL, blocks
from .document_queries import _LAY, chunked, layout
from .drafts import PROFILE_CYCLE, RAW_SQL, documents, drafts, pick, sql_pick
from .sql import any_in, ascii_fold, base, has, q, strip, words
from .store_queries import _BEST, _SO, _STORE, CATS, issue_table, issues, iss, scored, sessions, stored_documents, suggested

Q: dict[str, tuple] = {}
RAW = f"WITH {RAW_SQL} "
_LOCAL = [(k, p) for k, p in X.PII]

# --- L01-L05 -----------------------------------------------------------------------------
# ASCII \b and \w decide the ends of a match; folding keeps one character per letter, so values are cut from the raw text


# every fifth text also holds a key of letters alone
KEY = " key sk-abcdefghijklmnopqrstuvwxyz end"
keyed = lambda s, d: documents(s, d).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit(KEY)).otherwise(F.lit(""))))
_KEYED = f"(SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN {q(KEY)} ELSE '' END AS text FROM raw_docs)"


def pii_sql() -> str:
    return RAW + " UNION ALL ".join(
        f"SELECT DISTINCT doc_id, {q(k)} AS kind, unnest(regexp_extract_all(t, {q(p)})) AS value FROM (SELECT doc_id, {ascii_fold('text')} AS t FROM {_KEYED})"
        for k, p in X.PII)


Q["l01_pii"] = (lambda s, d: L.pii_rows(keyed(s, d)), pii_sql())
_RED = "t"
for _k, _p in X.PII:
    _RED = f"regexp_replace({_RED}, {q(_p)}, '[REDACTED_{_k.upper()}]', 'g')"
Q["l02_redaction"] = (
    lambda s, d: keyed(s, d).select("doc_id", F.length(L.redacted(F.col("text"))).alias("chars"), rx.literal_count(L.redacted(F.col("text")), "[REDACTED_").alias("redactions"),
                                    F.array_join(rx.find_all(L.redacted(F.col("text")), r"\[REDACTED_[A-Z_]+\]"), ",").alias("kinds")),
    RAW + f"SELECT doc_id, array_to_string(regexp_extract_all(r, '\\[REDACTED_[A-Z_]+\\]'), ',') AS kinds, length(r) AS chars, (length(r) - length(replace(r, '[REDACTED_', ''))) // 10 AS redactions FROM (SELECT doc_id, {_RED} AS r FROM (SELECT doc_id, {ascii_fold('text')} AS t FROM {_KEYED}))")
topical = lambda s, d: drafts(s, d).select("doc_id", "profile_id", F.concat("text", pick(["", " Confidential data.", " Keep it internal only, a trade secret.", ""], F.col("doc_id"))).alias("text"))
_TOP = base() + f", top AS (SELECT doc_id, profile_id, text || {sql_pick(['', ' Confidential data.', ' Keep it internal only, a trade secret.', ''], 'doc_id')} AS text FROM docs)"
_TOPICS = f"array_to_string(list_filter([{', '.join(q(t) for t in X.SENSITIVE_TOPICS)}], lambda t: contains(lower(text), t)), ',')"
Q["l03_sensitive_topics"] = (
    lambda s, d: topical(s, d).select("doc_id", F.array_join(L.topics(F.col("text")), ",").alias("topics")), _TOP + f" SELECT doc_id, {_TOPICS} AS topics FROM top")
_KINDS = "list_filter([" + ", ".join(f"CASE WHEN {has('f', p)} THEN {q(k)} END" for k, p in X.PII) + "], lambda x: x IS NOT NULL)"
Q["l04_input_gate"] = (
    lambda s, d: L.input_gate(topical(s, d)).withColumn("redacted_text", rx.count(F.col("redacted_text"), r"\[REDACTED_[A-Z_]+\]")),
    _TOP + f" SELECT doc_id, len(k) = 0 AS allowed, CASE WHEN len(k) > 0 THEN 'PII detected: ' || array_to_string(k, ', ') || '.' ELSE '' END AS reason, {_TOPICS} AS topics, CASE WHEN len(k) > 0 THEN len(regexp_extract_all({_RED.replace("(t,", "(f,")}, '\\[REDACTED_[A-Z_]+\\]')) END AS redacted_text FROM (SELECT doc_id, text, f, {_KINDS} AS k FROM (SELECT *, {ascii_fold('text')} AS f FROM top))")
ADVICE = [" We could rephrase it.", " Omit the annex.", " Please simplify language here.", " Fine as it is.", " Add a step."]
answers = lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(
    F.col("conv_id").alias("doc_id"), pick(PROFILE_CYCLE, F.col("conv_id")).alias("profile_id"), F.concat("text", pick(ADVICE, F.col("conv_id") + F.col("turn"))).alias("text"))
_hit = lambda ws: "profile_id = 'sop' AND " + any_in("lower(text)", ws)
Q["l05_output_gate"] = (
    lambda s, d: L.output_gate(answers(s, d)),
    f"""WITH ans AS (SELECT conv_id AS doc_id, {sql_pick(PROFILE_CYCLE, 'conv_id')} AS profile_id, text || {sql_pick(ADVICE, 'conv_id + turn')} AS text FROM conversations), g AS (SELECT doc_id, CASE """
    + " ".join(f"WHEN {_hit(ws)} THEN {q(why)}" for _, ws, sev, why in X.SOP_RESTRICTED if sev == "high")
    + " END AS reason, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_hit(ws)} THEN {q(name)} END" for name, ws, _, _ in X.SOP_RESTRICTED)
    + "], lambda x: x IS NOT NULL), ',') AS actions FROM ans) SELECT doc_id, reason IS NULL AS allowed, coalesce(reason, '') AS reason, actions FROM g")

# --- S16, L06-L11: model replies derived from the documents --------------------------------------


def replies(s, d):
    """A reply about every turn of the conversations in one of six shapes: fenced, bare array, issues object, repairable, partly broken, prose.

    The turn's own text is the message of its items, and the prose.
    """
    turns = s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "turn", "text")

    def item(severity: str, confidence: int):
        return F.to_json(F.struct(F.lit("writing").alias("category"), F.lit("ai.tone").alias("rule_id"), F.lit(severity).alias("severity"),
                                  F.col("text").alias("message"), F.lit("Vary it").alias("recommendation"), F.lit(confidence).alias("confidence")))

    short = F.lit('{"category": "logic", "message": "No rule"}')
    k = (F.col("conv_id") + F.col("turn")) % 6
    return turns.select("doc_id", F.when(k == 0, F.concat(F.lit("Here:\n```json\n["), item("high", 80), F.lit(", "), item("odd", 20), F.lit("]\n```\nDone")))
                        .when(k == 1, F.concat(F.lit("Found ["), item("low", 400), F.lit("] only")))
                        .when(k == 2, F.concat(F.lit('{"issues": ['), item("medium", 55), F.lit(", "), item("low", 60), F.lit("]}")))
                        .when(k == 3, F.concat(F.lit("```\n["), item("high", 70), F.lit(",]\n```")))
                        .when(k == 4, F.concat(F.lit("["), item("high", 70), F.lit(", "), short, F.lit("]")))
                        .otherwise(F.col("text")).alias("reply"))


_REP = """WITH it AS (SELECT conv_id * 1000 + turn AS doc_id, (conv_id + turn) % 6 AS k, text FROM conversations), x AS (
    SELECT doc_id, k, text AS message, 0 AS item, 'high' AS sev, 80 AS c, '' AS m FROM it WHERE k = 0 UNION ALL SELECT doc_id, k, text, 1, 'medium', 20, '' FROM it WHERE k = 0 UNION ALL SELECT doc_id, k, text, 0, 'low', 50, '' FROM it WHERE k = 1
    UNION ALL SELECT doc_id, k, text, 0, 'medium', 55, '' FROM it WHERE k = 2 UNION ALL SELECT doc_id, k, text, 1, 'low', 60, '' FROM it WHERE k = 2 UNION ALL SELECT doc_id, k, text, 0, 'high', 70, '' FROM it WHERE k = 3
    UNION ALL SELECT doc_id, k, text, 0, 'high', 70, '' FROM it WHERE k = 4 UNION ALL SELECT doc_id, k, 'No rule', 1, 'medium', 50, 'rule_id,severity,recommendation' FROM it WHERE k = 4)
"""
Q["s16_reply_items"] = (lambda s, d: L.reply_items(replies(s, d)).select("doc_id", "item", *[F.get_json_object("json", f"$.{k}").alias(k) for k in ("message", "category")]),
                        _REP + "SELECT doc_id, item, message, CASE WHEN message = 'No rule' THEN 'logic' ELSE 'writing' END AS category FROM x")
Q["l06_validated_items"] = (
    lambda s, d: L.validated_items(L.reply_items(replies(s, d))).select("doc_id", "item", "message", "severity", "confidence", "missing", "reply_valid"),
    _REP + "SELECT doc_id, item, message, sev AS severity, c AS confidence, m AS missing, k <> 4 AS reply_valid FROM x")
Q["l07_valid_fixes"] = (
    lambda s, d: documents(s, d).select("doc_id", L.valid_fix(F.col("text"), F.when(F.col("doc_id") % 3 > 0, F.substring_index("text", "\n", 1)).otherwise(F.lit(""))).alias("valid")),
    "SELECT doc_id, text <> '' AND doc_id % 3 > 0 AND string_split(text, chr(10))[1] <> '' AS valid FROM documents")
Q["l08_sanitized"] = (
    lambda s, d: documents(s, d).select("doc_id", F.sha2(L.sanitized(F.concat(F.lit("\u0001"), F.replace("text", F.lit(" the "), F.lit("\u0007 the ")))), 256).alias("digest")),
    "SELECT doc_id, sha256(t) AS digest FROM (SELECT doc_id, replace(text, ' the ', ' the ') AS t FROM documents)")


def quotes(s, d):
    """A quote of every document: a middle slice, for every fourth document one that is not there."""
    return documents(s, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("no such quote here")).otherwise(
        F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(60))).alias("quote"))


_BQ = strip("CASE WHEN doc_id % 4 = 0 THEN 'no such quote here' ELSE substr(text, length(text) // 2 + 1, 60) END")
_NL = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
Q["l09_located_quotes"] = (
    lambda s, d: L.locate_quotes(quotes(s, d), documents(s, d)).drop("quote"),
    f"SELECT doc_id, CASE WHEN p > 0 THEN {_NL('left(text, p - 1)')} + 1 ELSE 0 END AS line_start, CASE WHEN p > 0 THEN {_NL('left(text, p - 1)')} + 1 + {_NL('bq')} ELSE 0 END AS line_end, CASE WHEN p > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence "
    f"FROM (SELECT *, CASE WHEN bq = '' THEN 0 ELSE strpos(text, bq) END AS p FROM (SELECT doc_id, text, {_BQ} AS bq FROM documents))")
Q["l10_bounded_context"] = (
    lambda s, d: L.bounded_context(issue_table(s, d)).select("doc_id", (rx.literal_count(F.col("context"), "\n") + 1).alias("n_lines")),
    iss() + "SELECT doc_id, least(count(*), 20) AS n_lines FROM iss GROUP BY doc_id")
Q["l10_truncated_text"] = (
    lambda s, d: documents(s, d).select("doc_id", L.truncated_at_word(F.col("text"), 300).alias("text")),
    "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE CASE WHEN contains(left(text, 300), ' ') THEN regexp_replace(left(text, 300), '(?s) [^ ]*$', '') ELSE left(text, 300) END || chr(10) || chr(10) || '...[truncated]...' END AS text FROM documents")
Q["l11_model_chunks"] = (
    lambda s, d: L.model_chunks(documents(s, d)),
    f"WITH RECURSIVE {RAW_SQL}, src AS (SELECT doc_id AS k, text FROM raw_docs WHERE length(text) > 6000), " + chunked("src", 4000, 300)
    + """ SELECT k AS doc_id, chunk, '' AS section, start AS start_char, stop AS end_char, substr(text, start + 1, stop - start) AS chunk_text FROM chunks
    UNION ALL SELECT doc_id, 0, '', 0, length(text), text FROM raw_docs WHERE length(text) <= 6000""")
_MERGED = ["doc_id", "category", "rule_id", "severity", "message", "recommendation", "confidence"]
Q["l11_merged_issues"] = (
    lambda s, d: L.merged_issues(issue_table(s, d), L.validated_items(L.reply_items(replies(s, d)))).select(*_MERGED, (F.col("source") == "ai").alias("is_ai")),
    iss() + _REP.replace("WITH it", ", it") + f"""SELECT {', '.join(_MERGED)}, FALSE AS is_ai FROM iss
    UNION ALL SELECT doc_id, 'writing', 'ai.tone', sev, message, 'Vary it', c, TRUE FROM x WHERE k <> 4""")

# --- O01-O08 on the event log ---------------------------------------------------------------------
events = lambda s, d: s.read.parquet(f"{d}/events.parquet")
samples = lambda s, d: events(s, d).select(F.col("event_type").alias("name"), (F.col("value") / 100).alias("value"), (F.col("user_id") % 3).cast("string").alias("route"), "ts")
_SAM = "WITH sam AS (SELECT event_type AS name, value / 100 AS value, CAST(user_id % 3 AS VARCHAR) AS route, ts FROM events)"
_BND = ", ".join(f"({b!r}::DOUBLE, '{b:g}')" for b in X.HISTOGRAM_BOUNDS) + ", ('inf'::DOUBLE, '+Inf')"
Q["o01_histogram"] = (
    lambda s, d: O.histogram(samples(s, d), "route").select("name", "route", "le", "bucket", "n", F.round("total", 4).alias("total")),
    _SAM + f"SELECT name, route, le, count(*) FILTER (WHERE value <= b) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM sam CROSS JOIN (VALUES {_BND}) t(b, le) GROUP BY name, route, le")
Q["o02_counters"] = (
    lambda s, d: O.counters(samples(s, d), "route").select("name", "route", F.round("value", 4).alias("value")), _SAM + "SELECT name, route, round(sum(value), 4) AS value FROM sam GROUP BY ALL")
Q["o03_routes"] = (
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", O.route_label(F.concat(F.regexp_extract("url", r"://([^?#]*)", 1), F.lit("/"), F.md5("url"), F.lit("/a/b/c/d/"))).alias("route")),
    "SELECT page_id, '/' || array_to_string(list_transform(string_split(trim(regexp_extract(url, '://([^?#]*)', 1) || '/' || md5(url) || '/a/b/c/d/', '/'), '/'), lambda p: CASE WHEN length(p) >= 24 AND regexp_full_match(p, '[A-Za-z0-9-]+') THEN '{id}' ELSE p END), '/') AS route FROM pages")


def snapshots(s, d):
    """One snapshot per hour of the event log."""
    e = events(s, d)
    return e.groupBy(F.date_trunc("hour", "ts").alias("snapshot_id")).agg(F.create_map(
        F.lit("api_error_rate"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4), F.lit("api_p95_seconds"), F.round(F.max("value") / 100, 4),
        F.lit("queue_depth"), F.count("*") * 60.0, F.lit("ai_available"), F.when(F.count_if(F.col("event_type") == "signup") > 0, 1.0).otherwise(0.0)).alias("values"))


Q["o04_alerts"] = (
    lambda s, d: O.alerts(snapshots(s, d)),
    """WITH sn AS (SELECT date_trunc('hour', ts) AS snapshot_id, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 4) AS er, round(max(value) / 100, 4) AS p95, count(*) * 60.0::DOUBLE AS qd, CASE WHEN count(*) FILTER (WHERE event_type = 'signup') > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ai FROM events GROUP BY 1)
    SELECT snapshot_id, 'api_error_rate' AS code, 'critical' AS severity, er AS value, 0.05::DOUBLE AS threshold FROM sn WHERE er > 0.05 UNION ALL SELECT snapshot_id, 'api_p95_seconds', 'warning', p95, 2.0 FROM sn WHERE p95 > 2.0
    UNION ALL SELECT snapshot_id, 'queue_depth', 'warning', qd, 1000.0 FROM sn WHERE qd > 1000 UNION ALL SELECT snapshot_id, 'ai_available', 'warning', ai, 1.0 FROM sn WHERE ai < 1""")


def audit_log(s, d):
    """A log per user: each event names the hash its predecessor would have as a first event, so only the first two
    events of a chain link up; every seventh hash is tampered with."""
    from pyspark.sql import Window

    e = events(s, d)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select(
        F.col("user_id").alias("chain"), F.row_number().over(order).alias("seq"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("action"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor_id"), F.lit("session").alias("resource_type"), F.col("event_id").cast("string").alias("resource_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("occurred_at"), F.lit("success").alias("outcome"), F.create_map(F.lit("props"), F.col("props"), F.lit("city"), F.lit("Zürich")).alias("metadata"), F.lit("GENESIS").alias("previous_hash"))
    first = rows.withColumn("h0", F.sha2(O.canonical_event(), 256))
    linked = first.withColumn("previous_hash", F.coalesce(F.lag("h0").over(Window.partitionBy("chain").orderBy("seq")), F.lit("GENESIS"))).drop("h0")
    return linked.withColumn("event_hash", F.when(F.col("id").cast("int") % 7 == 3, F.lit("tampered")).otherwise(F.sha2(O.canonical_event(), 256)))


_js = lambda x: f"'\"' || replace({x}, '\"', '\\\"') || '\"'"
_canon = lambda prev: (f"'{{\"action\":' || {_js('event_type')} || ',\"actor_id\":\"user-' || user_id || '\",\"id\":\"' || event_id || '\",\"metadata\":{{\"city\":\"Zürich\",\"props\":' || {_js('props')} || '}},\"occurred_at\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || "
                       f"'\",\"outcome\":\"success\",\"previous_hash\":\"' || {prev} || '\",\"resource_id\":\"' || event_id || '\",\"resource_type\":\"session\"}}'")
_LOG = f"""WITH a AS (SELECT *, row_number() OVER w AS seq, sha256({_canon("'GENESIS'")}) AS h0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(lag(h0) OVER w, 'GENESIS') AS prev FROM a WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
c AS (SELECT *, CASE WHEN event_id % 7 = 3 THEN 'tampered' ELSE sha256({_canon('prev')}) END AS h FROM b),
v AS (SELECT user_id AS chain, seq, event_id % 7 <> 3 AS hash_ok, prev = CASE WHEN seq = 1 THEN 'GENESIS' ELSE lag(h) OVER (PARTITION BY user_id ORDER BY seq) END AS link_ok FROM c)
"""
Q["o05_audit_events"] = (lambda s, d: O.verify_chain(audit_log(s, d)), _LOG + "SELECT * FROM v")
Q["o05_audit_chains"] = (
    lambda s, d: O.chain_status(O.verify_chain(audit_log(s, d))),
    _LOG + "SELECT chain, bool_and(hash_ok AND link_ok) AS valid, min(seq) FILTER (WHERE NOT (hash_ok AND link_ok)) AS first_broken, count(*) AS events FROM v GROUP BY chain")
Q["o06_audit_redaction"] = (
    lambda s, d: documents(s, d).select("doc_id", O.redacted_metadata(F.create_map(F.lit("Token"), F.lit("abc"), F.lit("document_text"), F.col("text"), F.lit("note"), F.col("text"))).alias("m")).select(
        "doc_id", F.col("m")["Token"].alias("token"), F.col("m")["document_text"].alias("body"), F.col("m")["note"].alias("note")),
    "SELECT doc_id, '[REDACTED]' AS token, '[REDACTED]' AS body, text AS note FROM documents")
CLASSES = list(X.RETENTION_DAYS)
records = lambda s, d: events(s, d).select("event_id", pick(CLASSES, F.col("event_id")).alias("data_class"), F.col("ts").alias("created_at"), (F.col("user_id") % 5 == 0).alias("legal_hold"))
Q["o07_retention"] = (
    lambda s, d: O.retention(records(s, d), F.lit("2025-01-10 00:00:00").cast("timestamp")).select("event_id", "expires_at", "expired"),
    f"SELECT event_id, x AS expires_at, user_id % 5 <> 0 AND TIMESTAMP '2025-01-10 00:00:00' >= x AS expired FROM (SELECT *, ts + to_days([90, 365, 730, 365][CAST(event_id % 4 + 1 AS INTEGER)]) AS x FROM events)")
Q["o08_percentiles"] = (
    lambda s, d: O.nearest_rank(events(s, d).select(F.col("event_type").alias("name"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("value")), [0.5, 0.95, 0.99]),
    """WITH v AS (SELECT event_type, value FROM events WHERE event_id % 11 > 0), r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM v)
    SELECT r.name, q::DOUBLE AS quantile, r.value, m.mean, m.mx AS max FROM r JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(q) ON r.rn = greatest(1, ceil(q * n)) JOIN (SELECT event_type AS name, round(avg(value), 2) AS mean, max(value) AS mx FROM v GROUP BY 1) m ON m.name = r.name""")

# --- S01-S15 ----------------------------------------------------------------------------------------
EXT = ["a.md", "b.TXT", "c.tex", "d.html", "e.pdf", "f.docx", "g.csv"]


def file_rows(s, d):
    """Documents as files of seven kinds; the binary kinds have a good or a broken header."""
    k = F.col("doc_id")
    body = F.when(k % 7 == 4, F.when(k % 2 == 0, F.concat(F.lit("%PDF-1.7 "), F.col("text"), F.lit(" %%EOF"))).otherwise(F.col("text"))).when(
        k % 7 == 5, F.when(k % 2 == 0, F.concat(F.lit("PK"), F.col("text"))).otherwise(F.col("text"))).otherwise(F.col("text"))
    return documents(s, d).select(F.concat(F.lit("/data/"), k.cast("string"), F.lit("-"), pick(EXT, k)).alias("path"), body.cast("binary").alias("content"))


_FILES = f"WITH f AS (SELECT '/data/' || doc_id || '-' || {sql_pick(EXT, 'doc_id')} AS path, doc_id, doc_id % 7 AS k, text, octet_length(encode(text)) AS nb FROM documents)"
Q["s01_s03_documents"] = (
    lambda s, d: SF.dispatch(file_rows(s, d))[0].select("path", "content_type", F.sha2("text", 256).alias("digest")),
    _FILES + "SELECT path, CASE k WHEN 2 THEN 'text/x-tex' WHEN 3 THEN 'text/html' ELSE 'text/plain' END AS content_type, sha256(text) AS digest FROM f WHERE k < 4")
Q["s05_rejects"] = (
    lambda s, d: SF.dispatch(file_rows(s, d))[1],
    _FILES + """SELECT path, CASE WHEN k = 6 THEN 'Supported formats: TXT, Markdown, HTML, LaTex, DOCX and PDF.' WHEN k = 4 AND nb < 10 THEN 'File too small to be a valid PDF' WHEN k = 4 THEN 'File does not start with PDF header'
    WHEN nb < 22 THEN 'File too small to be a valid DOCX' ELSE 'File does not start with ZIP header (invalid DOCX)' END AS reason FROM f WHERE k = 6 OR (k IN (4, 5) AND doc_id % 2 = 1) OR (k = 5 AND nb + 2 < 22)""")
Q["s02_inline_text"] = (
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select(
        "conv_id", F.sha2(F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("t", lambda x: F.concat(
            F.lit("## "), x["role"], F.lit(" "), x["turn"].cast("string"), F.lit("\n"), x["text"])), "\n")), 256).alias("digest")),
    "SELECT conv_id, sha256('# Conversation ' || conv_id || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
Q["s06_profiles_in_use"] = (
    lambda s, d: documents(s, d).groupBy("profile_id").agg(F.count("*").alias("n")).join(F.broadcast(C.profile_table(s)), "profile_id").select("profile_id", "profile_name", "n", F.array_join("required_sections", ",").alias("required")),
    RAW + "SELECT profile_id, name AS profile_name, count(*) AS n, req AS required FROM raw_docs JOIN (VALUES " + ", ".join(f"({q(p[0])}, {q(p[1])}, {q(','.join(p[4]))})" for p in P.PROFILES) + ") t(profile_id, name, req) USING (profile_id) GROUP BY ALL")
Q["s07_packs_for_documents"] = (
    lambda s, d: documents(s, d).select("doc_id", "profile_id").join(F.broadcast(C.pack_table(s).select("pack_id", "profile_id")), "profile_id"),
    RAW + "SELECT doc_id, profile_id, pack_id FROM raw_docs JOIN (VALUES " + ", ".join(f"({q(p[0])}, {q(p[2])})" for p in P.PACKS) + ") t(pack_id, profile_id) USING (profile_id)")
Q["s08_session_rows"] = (
    lambda s, d: SS.session_rows(scored(s, d), "run-1", F.lit("2024-05-01").cast("timestamp")).select("id", "document_id", "profile_id", "status", "score"),
    iss() + "SELECT sha256('run-1|' || t.doc_id) AS id, t.doc_id AS document_id, d.profile_id, 'completed' AS status, t.score FROM totals t JOIN docs d USING (doc_id)")
_STORED = ["session_id", "issue_id", "category", "rule_id", "severity", "message", "recommendation", "evidence_excerpt", "evidence_line_start",
           "evidence_line_end", "evidence_location", "confidence", "autofix_allowed", "status"]


def stored_twice(s, d):
    """Every batch of a run is saved, one of them again; what is read back has each issue once."""
    folder = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    for batch in (0, 1, 0):
        SS.save_batch(SS.stored_issues(issue_table(s, d).where(F.pmod("doc_id", F.lit(2)) == batch), "run-1"), f"{folder}/issues", "run-1", f"half-{batch}")
    return s.read.parquet(f"{folder}/issues").select(*_STORED)


Q["s08_issue_rows"] = (
    stored_twice,
    iss() + """SELECT sha256('run-1|' || doc_id) AS session_id, issue_id, category, rule_id, severity, message, recommendation, excerpt AS evidence_excerpt,
    line_start AS evidence_line_start, line_end AS evidence_line_end, location AS evidence_location, confidence, autofix_allowed, 'open' AS status FROM iss""")


def fix_actions(s, d):
    """The fixes of every document are applied and their actions saved, the same batch twice."""
    folder = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    fixed = FX.fixed_documents(drafts(s, d), suggested(s, d))
    for _ in range(2):
        SS.save_actions(fixed, folder, "run-1", F.lit("2024-05-01").cast("timestamp"))
    return s.read.parquet(f"{folder}/fix_actions").select(
        "id", "session_id", "suggestion_id", "issue_id", "rule_id", "action_type", "original_text", "patched_text", "line_start", "line_end", "patched_hash")


Q["s11_fix_actions"] = (
    fix_actions,
    _BEST + """, new AS (SELECT doc_id, sha256(string_agg(t, chr(10) ORDER BY line_no)) AS patched_hash FROM (
        SELECT l.doc_id, l.line_no, CASE WHEN s.id IS NOT NULL THEN s.suggested || substr(l.line, length(s.original) + 1) ELSE l.line END AS t FROM lines l LEFT JOIN best s ON s.doc_id = l.doc_id AND s.line_start = l.line_no) GROUP BY doc_id)
    SELECT sha256(sha256('run-1|' || b.doc_id) || '|' || b.id || '|apply') AS id, sha256('run-1|' || b.doc_id) AS session_id, b.id AS suggestion_id, issue_id, rule_id, 'apply' AS action_type,
    original AS original_text, suggested AS patched_text, line_start, line_end, patched_hash FROM best b JOIN new USING (doc_id)""")
Q["s09_list_documents"] = (
    lambda s, d: SS.list_documents(stored_documents(s, d), search="9", content_type="text/html", limit=40, total=True).select("id", "original_name", "created_at", "total"),
    _STORE + "SELECT id, original_name, created_at, count(*) OVER () AS total FROM dcs WHERE (original_name ILIKE '%9%' OR id ILIKE '%9%') AND content_type = 'text/html' ORDER BY created_at DESC, id LIMIT 40")
Q["s10_template_rows"] = (
    lambda s, d: SS.template_rows(T.learn(blocks(s, d), layout(s, d)), drafts(s, d).select("doc_id", F.col("filename").alias("source_filename"))).select(
        "doc_id", "source_filename", *[F.get_json_object("analysis", f"$.{k}").alias(k) for k in ("source_filename", "version", "body_font", "table_count", "figure_count")][1:],
        F.coalesce(F.get_json_object("analysis", "$.required_sections"), F.lit("[]")).alias("sections")),
    base() + BLOCKS_SQL + f""", {_LAY}, hb AS (SELECT * FROM blk WHERE type = 'heading')
    SELECT l.doc_id, d.filename AS source_filename, '1' AS version, body_font, b.t::VARCHAR AS table_count, b.f::VARCHAR AS figure_count, coalesce(s.sections, '[]') AS sections FROM lay l JOIN drafts d USING (doc_id)
    LEFT JOIN (SELECT doc_id, to_json(list(title ORDER BY i))::VARCHAR AS sections FROM (SELECT doc_id, min(block_idx) AS i, min_by({strip('text')}, block_idx) AS title FROM hb GROUP BY doc_id, lower({strip('text')})) GROUP BY doc_id) s USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE type = 'table') AS t, count(*) FILTER (WHERE type = 'figure') AS f FROM blk GROUP BY doc_id) b USING (doc_id)""")
EXPORTED = "2024-05-01 10:30:00"


def exported(make):
    """An export of every session, with its category scores."""
    def run(s, d):
        with_scores = sessions(s, d).withColumn("category_scores", F.create_map(
            F.lit("structure"), F.col("score"), F.lit("writing"), (F.col("id") % 101).cast("int")))
        return make(with_scores, issues(s, d), F.lit(EXPORTED))
    return run


_DATE = "strftime(s.created_at, '%Y-%m-%d %H:%M:%S')"
_SES = _STORE + f", s AS (SELECT *, id % 101 AS w FROM ses), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_SO}, created_at DESC, id) AS n FROM isu)"
_cell = lambda x: f"CASE WHEN regexp_matches({x}::VARCHAR, '[,\"\\r\\n]') THEN '\"' || replace({x}::VARCHAR, '\"', '\"\"') || '\"' ELSE {x}::VARCHAR END"
_esc = lambda x: f"replace(replace(replace(replace({x}::VARCHAR, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_bars = lambda v: f"repeat('█', ({v} // 10)::BIGINT) || repeat('░', (10 - {v} // 10)::BIGINT)"
_FIELDS = ["id", "issue_id", "category", "rule_id", "severity", "message", "recommendation", "evidence_excerpt", "evidence_location", "confidence", "status"]
Q["s12_json_export"] = (
    exported(lambda a, b, at: SS.as_json(a, b, at)),
    _SES + f""", b AS (SELECT session_id, '[' || string_agg(to_json(struct_pack({', '.join(f'{c} := {c}' for c in _FIELDS)}))::VARCHAR, ',' ORDER BY n) || ']' AS t FROM o GROUP BY session_id)
    SELECT s.id AS session_id, '{{"session":' || to_json(struct_pack(id := s.id, document_id := document_id, user_id := user_id, created_at := {_DATE}, filename := filename, profile_id := profile_id, status := status,
      score := score, summary := summary, category_scores := struct_pack(structure := score, writing := w)))::VARCHAR || ',"issues":' || coalesce(t, '[]') || ',"exported_at":"2024-05-01 10:30 UTC"}}' AS body FROM s LEFT JOIN b ON b.session_id = s.id""")
Q["s13_csv_export"] = (
    exported(lambda a, b, at: SS.as_csv(a, b)),
    _SES + f""", b AS (SELECT session_id, string_agg(concat_ws(',', {', '.join(_cell(c) for c in SS.CSV_COLUMNS)}) || chr(13) || chr(10), '' ORDER BY n) AS t FROM o GROUP BY session_id)
    SELECT s.id AS session_id, '{','.join(SS.CSV_HEADER)}' || chr(13) || chr(10) || concat_ws(',', left(s.id::VARCHAR, 8), {_cell('profile_id')}, {_cell('filename')}, {_DATE}, score, {_cell('summary')}) || chr(13) || chr(10) || chr(13) || chr(10)
      || '{','.join(SS.CSV_TITLES)}' || chr(13) || chr(10) || coalesce(t, '') AS body FROM s LEFT JOIN b ON b.session_id = s.id""")
_BAD = "CASE severity WHEN 'high' THEN '🔴 HIGH' WHEN 'medium' THEN '🟡 MEDIUM' ELSE '🟢 LOW' END"
_MD = _SES + f""", b AS (SELECT session_id, string_agg('### ' || n || '. ' || {_BAD} || ' — ' || message || chr(10) || '- **Category:** ' || category || chr(10) || '- **Rule:** `' || rule_id || '`' || chr(10)
    || '- **Confidence:** ' || confidence || '%' || chr(10) || '- **Status:** ' || status || chr(10) || '- **Evidence:** "' || evidence_excerpt || '"' || chr(10) || '- **Location:** ' || evidence_location || chr(10) || '- **Recommendation:** ' || recommendation || chr(10), chr(10) ORDER BY n) AS t FROM o GROUP BY session_id),
    md AS (SELECT s.id AS session_id, array_to_string(['# Review Report', '', '**Session:** ' || left(s.id::VARCHAR, 8), '**Profile:** ' || profile_id, '**Document:** ' || filename, '**Date:** ' || {_DATE}, '**Overall Score:** ' || score || '/100', '',
      '## Category Scores', '- **structure:** ' || score || '/100  `' || {_bars('score')} || '`', '- **writing:** ' || w || '/100  `' || {_bars('w')} || '`', '', '## Summary', '', summary, '', '## Issues', coalesce(t, 'No issues found.'), '---', '*Generated by Review Report on 2024-05-01 10:30 UTC*'], chr(10)) AS body
    FROM s LEFT JOIN b ON b.session_id = s.id)"""
Q["s14_markdown_export"] = (exported(lambda a, b, at: SS.as_markdown(a, b, exported_at=at)), _MD + " SELECT * FROM md")
Q["s15_html_export"] = (
    exported(lambda a, b, at: SS.as_html(a, b, exported_at=at)),
    _SES + f""", b AS (SELECT session_id, count(*) AS c, string_agg('<div class="issue ' || severity || '"><p><b>' || CASE severity WHEN 'high' THEN '🔴 ' WHEN 'medium' THEN '🟡 ' ELSE '🟢 ' END || upper(severity) || '</b> <span>' || category || '</span> <span>' || confidence
      || '% confidence</span> <span>' || status || '</span></p><h4>' || {_esc('message')} || '</h4><blockquote>&quot;' || {_esc('evidence_excerpt')} || '&quot;</blockquote><p><b>Recommendation:</b> ' || {_esc('recommendation')} || '</p><p>Rule: <code>' || rule_id
      || '</code> &middot; Location: ' || {_esc('evidence_location')} || '</p></div>', '' ORDER BY n) AS t FROM o GROUP BY session_id)
    SELECT s.id AS session_id, '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Review Report — ' || left(s.id::VARCHAR, 8) || '</title><style>{SS.STYLE}</style></head><body><h1>Review Report</h1><p>' || {_esc('filename')} || ' &middot; ' || profile_id
      || ' profile</p><p><b style="color:' || CASE WHEN score >= 80 THEN '#22c55e' WHEN score >= 50 THEN '#eab308' ELSE '#ef4444' END || '">' || score || '</b></p><p>' || {_esc('summary')} || '</p><h2>Category Scores</h2>'
      || '<div><span>structure</span><div class="bar"><div class="fill" style="width:' || score || '%"></div></div><b>' || score || '</b></div><div><span>writing</span><div class="bar"><div class="fill" style="width:' || w || '%"></div></div><b>' || w || '</b></div>'
      || '<h2>Issues (' || coalesce(c, 0) || ')</h2>' || coalesce(t, '<p>No issues found.</p>') || '<hr><p>Generated by Review Report on 2024-05-01 10:30 UTC</p></body></html>' AS body FROM s LEFT JOIN b ON b.session_id = s.id""")

# --- batch forms of the streaming jobs ----------------------------------------------------------
Q["st2_windowed_metrics"] = (
    lambda s, d: jobs.windowed_metrics(samples(s, d)).select("window_start", "name", "n", F.round("total", 4).alias("total"), "peak"),
    _SAM + "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, name, count(*) AS n, round(sum(value), 4) AS total, max(value) AS peak FROM sam GROUP BY 1, 2")
Q["st3_first_seen"] = (
    lambda s, d: jobs.first_seen_batch(documents(s, d)), "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
Q["st4_user_sessions"] = (
    lambda s, d: jobs.user_sessions(events(s, d)).select("user_id", "session_start", "n", F.round("total", 4).alias("total")),
    """SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, g""")


def queries() -> dict:
    return {name: pair[0] for name, pair in Q.items()}


def oracles() -> dict[str, str]:
    return {name: pair[1] for name, pair in Q.items() if pair[1]}
