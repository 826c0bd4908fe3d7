"""Personal data, topics, gates and model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import fixes as X
from ..functions import rx

REPLY_ITEM = ("category string, rule_id string, severity string, message string, recommendation string, "
              "evidence_excerpt string, confidence string")


def found_values(text: Column, pattern: str, limit: int | None = None) -> Column:
    """Distinct full matches in order; at most ``limit`` where one is given."""
    values = F.array_distinct(rx.find_all(text, rx.exact(pattern)))
    return values if limit is None else F.slice(values, 1, limit)


# what every match of a kind contains; the last kind can be letters alone and has no such test
PII_NEEDS = {"email": "@", "phone": r"(?U)\d", "ssn": r"(?U)\d", "credit_card": r"(?U)\d", "ip_address": r"(?U)\d"}


def pii_rows(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per document, kind and value. A text without what a kind needs is spared its regex."""
    def named(kind: str, pattern: str) -> Column:
        found = F.transform(found_values(F.col("text"), pattern, limit),
                            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
        return F.when(F.col("text").rlike(PII_NEEDS[kind]), found).otherwise(F.array().cast("array<struct<kind:string,value:string>>")) if kind in PII_NEEDS else found

    kinds = F.concat(*[named(k, p) for k, p in X.PII])
    rows = docs.select("doc_id", F.explode_outer(kinds).alias("x"))
    return rows.where("x IS NOT NULL").select("doc_id", "x.*")


def redacted(text: Column) -> Column:
    """Every full match replaced, kind by kind."""
    for kind, pattern in X.PII:
        text = F.regexp_replace(text, rx.exact(pattern), f"[REDACTED_{kind.upper()}]")
    return text


def topics(text: Column) -> Column:
    """L03."""
    low = F.lower(text)
    return F.filter(rx.strings(X.SENSITIVE_TOPICS), lambda t: F.contains(low, t))


def input_gate(docs: DataFrame, allow_sensitive: bool = False) -> DataFrame:
    """Allowed flag, reason and topics per document, and the redacted text of one that is blocked."""
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(rx.exact(p)), F.lit(k)) for k, p in X.PII]))
    blocked = F.lit(not allow_sensitive) & (F.size("kinds") > 0)
    return docs.withColumn("kinds", kinds).select(
        "doc_id", (~blocked).alias("allowed"),
        F.when(blocked, F.concat(F.lit("PII detected: "), F.array_join("kinds", ", "), F.lit("."))).otherwise(F.lit("")).alias("reason"),
        F.array_join(topics(F.col("text")), ",").alias("topics"), F.when(blocked, redacted(F.col("text"))).alias("redacted_text"))


def output_gate(texts: DataFrame) -> DataFrame:
    """Replies about an sop document that propose a restricted action. Needs ``doc_id, profile_id, text``."""
    low = F.lower("text")
    sop = F.col("profile_id") == "sop"
    reason = None
    for _, needles, severity, why in X.SOP_RESTRICTED:
        if severity == "high":
            hit = sop & rx.contains_any(low, needles)
            reason = F.when(hit, F.lit(why)) if reason is None else reason.when(hit, F.lit(why))
    noted = F.array_compact(F.array(*[
        F.when(sop & rx.contains_any(low, needles), F.lit(name)) for name, needles, _, _ in X.SOP_RESTRICTED]))
    return texts.select("doc_id", reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("")).alias("reason"),
                        F.array_join(noted, ",").alias("actions"))


def repaired(block: Column) -> Column:
    """Trailing commas, single quotes and bare keys made valid JSON."""
    text = F.regexp_replace(rx.strip(block), r",\s*([}\]])", "$1")
    text = F.replace(text, F.lit("'"), F.lit('"'))
    return F.regexp_replace(text, r"(\s+)(\w+)(\s*):", '$1"$2"$3:')


def valid_json(text: Column) -> Column:
    """The text when it is JSON, else null."""
    return F.when(F.try_parse_json(text).isNotNull(), text)


def json_items(block: Column) -> Column:
    """Array of JSON texts in a block: the items of an array, or the object itself."""
    source = F.coalesce(valid_json(block), valid_json(repaired(block)))
    is_array = rx.strip(source).startswith("[")
    return F.when(source.isNull(), rx.strings([])).when(
        is_array, F.coalesce(F.from_json(source, "array<string>"), rx.strings([]))).otherwise(F.array(source))


def reply_items(replies: DataFrame) -> DataFrame:
    """JSON items of model replies: fenced blocks, else the outermost array, else the outermost object.

    An object with an ``issues`` list is unwrapped when it is found without a fence.
    """
    text = F.col("reply")
    fenced = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), json_items))
    array = json_items(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")))
    whole = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    good = F.coalesce(valid_json(whole), valid_json(repaired(whole)))
    listed = F.get_json_object(good, "$.issues")
    unwrapped = F.when(listed.startswith("["), F.from_json(listed, "array<string>")).otherwise(
        F.when(good.isNotNull(), F.array(good)).otherwise(rx.strings([])))
    array, unwrapped = F.coalesce(array, rx.strings([])), F.coalesce(unwrapped, rx.strings([]))
    chosen = F.when(F.size(fenced) > 0, fenced).when(F.size(array) > 0, array).otherwise(unwrapped)
    return replies.select("doc_id", F.posexplode_outer(chosen).alias("item", "json")).where("json IS NOT NULL")


def validated_items(items: DataFrame) -> DataFrame:
    """Required fields, defaults for bad severity and confidence; one bad item fails its whole reply."""
    parsed = items.withColumn("i", F.from_json("json", REPLY_ITEM))
    missing = F.array_compact(F.array(*[
        F.when(F.get_json_object("json", f"$.{f}").isNull(), F.lit(f)) for f in X.REPLY_FIELDS]))
    confidence = F.col("i.confidence").try_cast("double")
    checked = parsed.select(
        "doc_id", "item", "i.category", "i.rule_id",
        F.when(F.col("i.severity").isin("high", "medium", "low"), F.col("i.severity")).otherwise(F.lit("medium")).alias("severity"),
        "i.message", "i.recommendation", F.coalesce("i.evidence_excerpt", F.lit("")).alias("evidence_excerpt"),
        F.when(confidence.between(0, 100), confidence.cast("int")).otherwise(F.lit(50)).alias("confidence"),
        F.array_join(missing, ",").alias("missing"))
    return checked.withColumn("reply_valid", F.bool_and(F.col("missing") == "").over(Window.partitionBy("doc_id")))  # the items of one reply


def valid_fix(original: Column, suggested: Column) -> Column:
    """L07."""
    return F.coalesce((original != "") & (suggested != ""), F.lit(False))


def sanitized(text: Column, limit: int | None = None) -> Column:
    """Without control characters; shortened only to a given limit."""
    clean = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    if limit is None:
        return clean
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit)), F.lit("\n\n[...response truncated...]"))).otherwise(clean)


def locate_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Line range of an exact quote. ``quotes(doc_id, quote)``."""
    quote = rx.strip(F.col("quote"))
    at = F.when(quote == "", F.lit(0)).otherwise(F.position(quote, F.col("text")))
    first = rx.literal_count(F.left(F.col("text"), at - 1), "\n") + 1
    last = first + rx.literal_count(quote, "\n")
    return quotes.join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", "quote", F.when(at > 0, first).otherwise(F.lit(0)).alias("line_start"),
        F.when(at > 0, last).otherwise(F.lit(0)).alias("line_end"),
        F.when(at > 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("confidence"))


def truncated_at_word(text: Column, limit: int) -> Column:
    """Text cut to the limit without a broken last word."""
    cut = F.left(text, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(
        F.when(cut.contains(" "), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut), F.lit("\n\n...[truncated]...")))


def bounded_context(reviewed_issues: DataFrame, first: int = 20) -> DataFrame:
    """The first issues of every document as text lines. Needs ``doc_id, seq, severity, rule_id, message``.

    ``first`` is the feature: a prompt has room for that many. The rank filter prunes before the shuffle.
    """
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("rule_id"), F.lit(": "), F.left("message", F.lit(100)))
    return reviewed_issues.where(F.col("seq") < first).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def model_chunks(docs: DataFrame, threshold: int = 6000, size: int = 4000, overlap: int = 300) -> DataFrame:
    """Texts over the threshold are split at boundaries, the others stay whole."""
    from .document import boundary_chunks

    whole = docs.where(F.length("text") <= threshold).select(
        "doc_id", F.lit(0).alias("chunk"), F.lit("").alias("section"), F.lit(0).alias("start_char"),
        F.length("text").alias("end_char"), F.col("text").alias("chunk_text"))
    return whole.unionByName(boundary_chunks(docs.where(F.length("text") > threshold), size, overlap))


def merged_issues(rule_issues: DataFrame, items: DataFrame) -> DataFrame:
    """Validated model items appended to the rule issues."""
    cols = ["doc_id", "category", "rule_id", "severity", "message", "recommendation", "confidence", "source"]
    model = items.where("reply_valid").withColumn("source", F.lit("ai"))
    return rule_issues.select(*cols).unionByName(model.select(*cols))
