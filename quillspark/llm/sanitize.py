"""Information-theoretic sanitisation of texts with DataFrame functions only.

Personal data of four kinds is found by patterns; its values are the protected entities. Corpus co-occurrence tells how
strongly a word reveals one: of the entity's information log2(1 / P(e)), the word t leaves log2(1 / P(e | t)). A word that
leaves at most `bits` and gives at least `gain` bits (pointwise mutual information) discloses the entity, and in documents
that hold the entity it is generalised to the class of words with its first letters if that class does not disclose, or
else removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rx
from .store import discard, written

KINDS = ("email", "ip", "card", "phone")
PARTS = 3  # letters of a class of words

#: The patterns, written so that no start is tried within a run that has failed, and without backtracking: the same leftmost matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PATTERNS = {
    "email": EMAIL, "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]++"

SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(_digits(value)), i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(value))), F.lit(0), step) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a match has to be besides its pattern."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """(start, end, kind 1 to 4, value) of personal data, by start and kind; code points, end exclusive."""
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}

    def of(i: int, kind: str) -> Column:
        kept = F.filter(rx.spans(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        found = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(i).alias("kind"), m["value"].alias("value")))
        return F.when(needs[kind], found.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(KINDS, 1)]))


def _entities(base: Column) -> Column:
    """Distinct protected values: e-mail addresses in lower case, numbers as digits."""
    def value(s: Column) -> Column:
        return F.concat(s["kind"].cast("string"), F.lit(":"), F.when(s["kind"] == 1, F.lower(s["value"])).when(s["kind"] == 2, s["value"]).otherwise(_digits(s["value"])))

    return F.array_distinct(F.transform(base, value))


def _low(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _class(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(PARTS)), F.lit("*"))


def _terms(text: Column) -> Column:
    """Distinct words outside e-mail addresses, and their classes."""
    tokens = F.array_distinct(F.transform(F.filter(rx.find_all(text, f"{EMAIL}|{WORD}"), lambda w: ~w.contains("@")), _low))
    return rx.let(tokens, lambda ws: F.concat(ws, F.array_distinct(F.transform(ws, _class))))


def disclosing(docs: DataFrame, support: int = 3, bits: int = 1, gain: int = 3) -> DataFrame:
    """(entity, term, removed) from docs(entities, terms): words that disclose an entity, and whether their class does too.

    Counts are of documents, over the whole corpus; an entity and a term count together from `support` documents on.
    """
    n = docs.count()
    held = docs.where(F.size("entities") > 0).select("key", "key2", "entities", "terms")
    held = written(held, "held")
    entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    entity = written(entity, "entities")
    rows = held.select("key", "key2", F.explode("entities").alias("entity")).distinct().join(entity, "entity")
    own = rows.groupBy("key", "key2").agg(F.collect_list(F.struct("entity", "n_entity")).alias("own"))
    both = held.select("key", "key2", "terms").join(own, ["key", "key2"]).select(F.explode("own").alias("e"), "terms")
    pairs = (both.select("e.*", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.first("n_entity").alias("n_entity"))
             .where(F.col("n_both") >= support))
    pairs = written(pairs, "pairs")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    counts = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    told = pairs.join(counts, "term").where(
        (wide("n_both") * F.lit(2**bits).cast("decimal(10,0)") >= wide("n_term"))
        & (wide("n_both") * F.lit(n).cast("decimal(18,0)") >= wide("n_entity") * wide("n_term") * F.lit(2**gain).cast("decimal(2,0)")))
    told = written(told.select("entity", "term"), "told")
    discard(pairs)
    classes = told.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("class"), F.lit(True).alias("removed"))
    words = told.where(~F.col("term").endswith("*")).withColumn("class", _class(F.col("term")))
    found = written(words.join(classes, ["entity", "class"], "left").select("entity", "term", F.coalesce("removed", F.lit(False)).alias("removed")), "disclosing")
    for table in (held, entity, told):
        discard(table)
    return found


def _term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, key2, more): spans of the words that disclose an entity of their document; kind 5 generalised, 6 removed."""
    one = docs.where(F.size("entities") > 0).select("key", "key2", "text", "entities").dropDuplicates(["key", "key2"])
    marks = one.select("key", "key2", F.explode("entities").alias("entity")).join(found, "entity").groupBy("key", "key2", "term").agg(F.max("removed").alias("removed"))
    marks = written(marks, "marks")
    own = one.join(marks.select("key", "key2").distinct(), ["key", "key2"], "left_semi")
    tokens = own.select("key", "key2", F.inline(F.filter(rx.spans(F.coalesce("text", F.lit("")), f"{EMAIL}|{WORD}"), lambda m: ~m["value"].contains("@"))))
    hit = tokens.withColumn("term", _low(F.col("value"))).join(marks, ["key", "key2", "term"])
    kind = F.when(F.col("removed"), 6).otherwise(5).alias("kind")
    return hit.groupBy("key", "key2").agg(F.collect_list(F.struct("start", "end", kind, "value")).cast(SPAN).alias("more"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "generalised", "removed")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with marks in place of its spans; a span that begins within an earlier one goes with it."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term", "term")])
    mark = lambda s: F.when(s["kind"] == 5, _class(_low(s["value"]))).otherwise(F.element_at(marks, s["kind"]))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["upto"]
        return F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            F.when(inside, acc["cut"]).otherwise(F.concat(acc["cut"], F.array(F.struct(acc["upto"].alias("a"), s["start"].alias("b"), mark(s).alias("m"))))).alias("cut"))

    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int,m:string>>").alias("cut"))
    def built(chars: Column, done: Column) -> Column:
        part = lambda a, b: F.array_join(F.slice(chars, a + 1, b - a), "")
        return F.concat(F.array_join(F.transform(done["cut"], lambda c: F.concat(part(c["a"], c["b"]), c["m"])), ""), part(done["upto"], F.size(chars)))

    return rx.let(F.split(text, "", -1), lambda chars: rx.let(F.aggregate(spans, start, step), lambda done: built(chars, done)))


def sanitised(docs: DataFrame, support: int = 3, bits: int = 1, gain: int = 3) -> DataFrame:
    """docs(doc_id, text) with n_email, n_ip, n_card, n_phone, base_sha256, spans and clean_text; columns of these names are replaced.

    Personal data: e-mail addresses, ip addresses (parts up to 255), card numbers (14 to 19 digits, Luhn) and phone
    numbers (10 to 15 digits), leftmost non-overlapping for each kind; spans of two kinds may overlap. spans lists
    kind:start:end by start, then kind, in code points with the end exclusive; generalised and removed words follow the
    base kinds. base_sha256 is the hash of the base ones. In clean_text personal data is its kind in brackets, generalised
    words their first three letters and *, removed words [TERM].

    Words are runs of letters outside e-mail addresses, A-Z lowered; they are taken only from documents that hold the entity
    they disclose (see disclosing). A document without personal data has no spans and keeps its text. A null text is an
    empty one, but clean_text stays null; null and repeated doc_ids, ties and repeated rows are rows of their own, which
    count each. An empty table gives no rows. A document costs its recurring entities times its words.
    """
    added = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"]
    others = [c for c in docs.columns if c not in added]
    given = docs.select(F.struct(*others).alias("row"), F.col("doc_id"), F.col("text"))
    text = F.coalesce("text", F.lit(""))
    keyed = given.select("row", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id", F.lit(1)).alias("key2"), base_spans(text).alias("base"))
    known = keyed.select("key", "key2", "text", _entities(F.col("base")).alias("entities"))
    found = disclosing(known.select("key", "key2", "entities", _terms(text).alias("terms")), support, bits, gain)
    more = written(_term_spans(known, found), "spans")
    none = F.array().cast(SPAN)
    with_data = keyed.where(F.size("base") > 0).join(more, ["key", "key2"], "left").select("row", "text", "base", F.coalesce("more", none).alias("more"))
    rows = with_data.unionByName(keyed.where(F.size("base") == 0).select("row", "text", "base", none.alias("more")))
    rows = rows.withColumn("all", F.array_sort(F.concat("base", "more")))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return rows.select(
        "row.*", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"), F.when(F.col("text").isNotNull(), _rewritten(F.col("text"), F.col("all"))).alias("clean_text"))
