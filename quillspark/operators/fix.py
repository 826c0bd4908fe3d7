"""Suggested fixes, exact location, conflicts, applying, reverting, diffs, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import fixes as X
from ..functions import rx
from .score import gain

SUGGESTION = ("struct<id:string,issue_id:string,rule_id:string,severity:string,category:string,original:string,"
              "suggested:string,line_start:int,line_end:int,confidence:int,fix_type:string>")


def each_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), change), "\n")


def heading_style(text: Column, published: bool = False) -> Column:
    """one space after a heading's marks where there is none.

    The published form knows two levels and takes ``## Title`` for a first-level heading of ``# Title``.
    """
    if not published:
        return each_line(text, lambda line: F.when(
            rx.strip(line).rlike(r"^#+[^#\s]"), F.regexp_replace(rx.strip(line), r"^(#+)", "$1 ")).otherwise(line))

    def change(line: Column) -> Column:
        bare = rx.strip(line)
        two, one = rx.strip(F.substring(bare, 3, 1 << 30)), rx.strip(F.substring(bare, 2, 1 << 30))
        return (
            F.when(bare.startswith("##") & ~bare.startswith("## "),
                   F.when(two != "", F.concat(F.lit("## "), two)).otherwise(line))
            .when(bare.startswith("#") & ~bare.startswith("# ") & ~bare.startswith("##"),
                  F.when(one != "", F.concat(F.lit("# "), one)).otherwise(line))
            .when(bare.startswith("## "), F.concat(F.lit("# "), one))
            .otherwise(line))

    return each_line(text, change)


def line_spacing(text: Column) -> Column:
    """F04."""
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def reference_format(text: Column) -> Column:
    """F05."""
    return F.regexp_replace(F.regexp_replace(text, r"(?iU)DOI:\s*", "doi:"), r"(?mU)^References\s*$", "References")


def url_prefix(text: Column) -> Column:
    """F06."""
    return F.regexp_replace(text, r"(?<!:)//", "://")


def bullets(text: Column) -> Column:
    """``* `` becomes ``- ``, the indent stays."""
    def change(line: Column) -> Column:
        bare = rx.strip(line)
        indent = F.regexp_extract(line, r"^(\s*)", 1)
        return F.when(
            bare.startswith("* ") | bare.startswith("- "),
            F.concat(indent, F.lit("- "), F.substring(bare, 3, 1 << 30))).otherwise(line)

    return each_line(text, change)


def period_spacing(text: Column) -> Column:
    """F08."""
    return F.replace(F.regexp_replace(text, r"\.([A-Z])", ". $1"), F.lit(".  "), F.lit(". "))


def citation_order(text: Column) -> Column:
    """numbers of every bracket group in ascending order, each in its own brackets."""
    pattern = r"\[[\d,\s]*\d[\d,\s]*\]"
    between, groups = F.split(text, pattern, -1), rx.find_all(text, pattern)

    def ordered(group: Column) -> Column:
        numbers = F.array_sort(F.transform(rx.find_all(group, r"\d+"), lambda n: n.try_cast("bigint")))
        return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")

    return F.array_join(F.transform(between, lambda b, i: F.concat(
        b, F.coalesce(ordered(F.get(groups, i)), F.lit("")))), "")


def bullet_capitals(text: Column, corrected: bool = False) -> Column:
    """without effect as published, because it tests the dash; ``corrected`` capitalizes the item."""
    if not corrected:
        return text

    def change(line: Column) -> Column:
        return F.when(
            line.rlike(r"^\s*- \p{Ll}"),
            F.concat(F.regexp_extract(line, r"^(\s*- )", 1),
                     F.upper(F.regexp_extract(line, r"^\s*- (\p{Ll})", 1)), F.regexp_extract(line, r"^\s*- \p{Ll}(.*)$", 1))
        ).otherwise(line)

    return each_line(text, change)


def spelling(text: Column) -> Column:
    """F11."""
    for pattern, word in X.SPELLING_FIXES:
        text = F.regexp_replace(text, rx.fold(pattern), word)
    return text


def hedging(text: Column) -> Column:
    """F12."""
    for pattern, word in X.HEDGING_FIXES:
        text = F.regexp_replace(text, rx.fold(pattern if word else pattern + r"\s*"), word or " ")
    return text


def short_rule(rule_id: Column) -> Column:
    """last segment of the id, lower case, dashes."""
    return F.element_at(F.split(F.replace(F.lower(rule_id), F.lit("_"), F.lit("-")), r"\.", -1), -1)


def suggested_text(original: Column, rule_id: Column, category: Column) -> Column:
    """the fixed text, or null where no fixer applies."""
    rule = short_rule(rule_id)
    return (
        F.when(rule == "heading-numbering", heading_style(original))
        .when(rule == "line-spacing", line_spacing(original))
        .when(rule.contains("reference"), reference_format(original))
        .when((rule == "broken-hyperlinks") | rule.contains("url"), url_prefix(original))
        .when(rule == "bullet-list", bullets(original))
        .when(rule.isin("punctuation", "period-spacing"), period_spacing(original))
        .when(rule.contains("citation-order"), citation_order(original))
        .when((category == "grammar") | (rule == "spelling"), spelling(original))
        .when((category == "writing") & rule.contains("passive"), original)
        .when((category == "writing") & rule.contains("hedging"), hedging(original))
        .when(category == "format", period_spacing(original)))


def has_fixer(rule_id: str, category: str) -> bool:
    """whether ``suggested_text`` changes anything for a rule: a review for fixes alone needs no other rules."""
    rule = rule_id.lower().replace("_", "-").split(".")[-1]
    return (rule in ("heading-numbering", "line-spacing", "broken-hyperlinks", "bullet-list", "punctuation", "period-spacing", "spelling")
            or any(part in rule for part in ("reference", "url", "citation-order")) or category in ("grammar", "format")
            or category == "writing" and "hedging" in rule)


def fix_type(rule_id: Column) -> Column:
    """F13."""
    rule = short_rule(rule_id)
    return F.when(rule.isin(X.SAFE_TYPE), F.lit("safe")).when(rule.isin(X.AI_TYPE), F.lit("ai")).otherwise(F.lit("manual"))


def fix_confidence(rule_id: Column, category: Column, kind: Column, severity: Column, by_segment: bool = False) -> Column:
    """F14. The rule lists hold short ids: stock ids reach them only with ``by_segment``."""
    rule = short_rule(rule_id) if by_segment else rule_id
    base = F.when(rule.isin(X.CONFIDENCE_SAFE), F.lit(100)).when(rule.isin(X.CONFIDENCE_HIGH), F.lit(92)).when(
        rule.isin(X.CONFIDENCE_MEDIUM), F.lit(72)).when(rule.isin(X.CONFIDENCE_LOW), F.lit(45))
    for name, points in X.CATEGORY_CONFIDENCE.items():
        base = base.when(category == name, F.lit(points))
    base = base.otherwise(F.lit(60))
    typed = F.when(kind == "safe", F.least(F.lit(100), base + 5)).when(
        kind == "ai", F.greatest(F.lit(20), base - 10)).otherwise(base)
    final = F.when(severity == "high", F.greatest(F.lit(30), typed - 5)).when(
        severity == "low", F.least(F.lit(100), typed + 3)).otherwise(typed)
    return F.greatest(F.lit(5), F.least(F.lit(100), final))


def confidence_label(score: Column) -> Column:
    text = score.cast("string")
    return (
        F.when(score >= 95, F.concat(F.lit("🟢 "), text, F.lit("% Safe"))).when(score >= 80, F.concat(F.lit("🟢 "), text, F.lit("%")))
        .when(score >= 60, F.concat(F.lit("🟡 "), text, F.lit("%"))).when(score >= 40, F.concat(F.lit("🟠 "), text, F.lit("%")))
        .otherwise(F.lit("🔴 Suggestion Only")))


def confirm_level(score: Column) -> Column:
    """F15."""
    return F.when(score >= 95, F.lit("safe")).when(score >= 60, F.lit("confirm")).when(
        score >= 30, F.lit("review")).otherwise(F.lit("manual"))


def stable_id(*parts: Column) -> Column:
    """the same suggestion keeps its id across preview, apply and history."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def suggestions(issues: DataFrame) -> DataFrame:
    """fixable issues whose fixed text differs from the evidence."""
    made = issues.where(F.col("autofix_allowed") & (rx.strip(F.col("excerpt")) != "")).withColumn(
        "suggested", suggested_text(F.col("excerpt"), F.col("rule_id"), F.col("category")))
    kept = made.where("suggested IS NOT NULL AND suggested <> '' AND suggested <> excerpt")
    return kept.select(
        "doc_id", "issue_id", "rule_id", "severity", "category", F.col("excerpt").alias("original"), "suggested",
        "line_start", "line_end", "confidence", fix_type(F.col("rule_id")).alias("fix_type"),
    ).withColumn("id", stable_id(*[F.col(c) for c in (
        "doc_id", "issue_id", "rule_id", "line_start", "line_end", "original", "suggested")]))


def plan(suggested: DataFrame) -> DataFrame:
    """F16: counts, time and success estimate per document, and its suggestions by category."""
    score = fix_confidence(F.col("rule_id"), F.col("category"), F.col("fix_type"), F.col("severity"))
    level = confirm_level(score)
    by_category = suggested.groupBy("doc_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category")).agg(
        F.count("*").alias("n"), F.count_if(level == "safe").alias("safe_fixes"),
        F.count_if(level.isin("confirm", "review")).alias("need_confirmation"), F.count_if(level == "manual").alias("manual_only"))
    counted = by_category.groupBy("doc_id").agg(
        F.sum("n").alias("total"), *[F.sum(c).alias(c) for c in ("safe_fixes", "need_confirmation", "manual_only")],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    return counted.withColumns({
        "seconds": F.floor(F.col("safe_fixes") * 0.5 + F.col("need_confirmation") * 2 + F.col("manual_only") * 5).cast("int"),
        "success_rate": F.floor((F.col("safe_fixes") * 99 + F.col("need_confirmation") * 80 + F.col("manual_only") * 30)
                                / F.col("total")).cast("int")})


def issue_plan(issues: DataFrame) -> DataFrame:
    """actions per document and the expected gain, at most 40."""
    fixable = F.col("autofix_allowed")
    return issues.groupBy("doc_id").agg(
        F.count("*").alias("actions"), F.count_if(fixable & (F.col("source") != "ai")).alias("safe_actions"),
        F.count_if(fixable & (F.col("source") == "ai")).alias("ai_actions"), F.count_if(~fixable).alias("manual_actions"),
        F.least(F.coalesce(F.sum(F.when(fixable, gain(F.col("severity")))), F.lit(0)), F.lit(40)).alias("score_gain"))


# --- exact replacement, inside the document row -----------------------------------------


def occurrences(text: Column, needle: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def with_lines(text: Column, use) -> Column:
    """Hands ``use`` the text's ``lines`` and their ``ends`` (offset after each line and its break): one pass over the text."""
    return rx.let(F.split(text, "\n", -1), lambda ls: rx.let(F.struct(
        ls.alias("lines"), rx.running(F.transform(ls, lambda l: F.length(l) + 1)).alias("ends")), use))


def line_begin(table: Column, line: Column) -> Column:
    """Offset at which a 0-based line begins; the text's length beyond the last line."""
    return F.when(line <= 0, F.lit(0)).otherwise(F.coalesce(F.get(table["ends"], line - 1), F.element_at(table["ends"], -1) - 1)).cast("int")


PLACE = "struct<start:int,line:int,col:int,end_line:int,end_col:int>"


def placed(text: Column, table: Column, original: Column, line_start: Column, line_end: Column) -> Column:
    """where the text to replace is: offset, line and column of both ends, 0-based; start -1 when it is gone, -2 when ambiguous.

    The lines of the evidence are searched first; the whole text only where they do not hold it once.
    """
    first = F.greatest(F.lit(1), line_start)
    last = F.greatest(first, line_end)
    window = F.concat(F.array_join(F.slice(table["lines"], first, last - first + 1), "\n"), F.when(last < F.size(table["lines"]), "\n").otherwise(""))

    def at(start: Column, line: Column) -> Column:
        """Both ends from the start and its line."""
        col = start - line_begin(table, line)
        breaks = rx.literal_count(original, "\n")
        end_col = F.when(breaks == 0, col + F.length(original)).otherwise(F.length(F.substring_index(original, "\n", -1)))
        return F.struct(start.alias("start"), line.alias("line"), col.alias("col"), (line + breaks).alias("end_line"), end_col.alias("end_col")).cast(PLACE)

    def none(code: int) -> Column:
        return F.struct(*[F.lit(code).alias(n) for n in ("start", "line", "col", "end_line", "end_col")]).cast(PLACE)

    def inside(w: Column) -> Column:
        here = F.position(original, w) - 1
        return at(line_begin(table, first - 1) + here, first - 1 + rx.literal_count(F.left(w, here), "\n"))

    def anywhere() -> Column:
        return rx.let(F.position(original, text) - 1, lambda p: at(p, F.size(F.filter(table["ends"], lambda e: e <= p))))

    whole = rx.let(occurrences(text, original), lambda n: F.when(n == 0, none(-1)).when(n > 1, none(-2)).otherwise(anywhere()))
    return rx.let(window, lambda w: F.when(occurrences(w, original) == 1, inside(w)).otherwise(whole))


def located(text: Column, original: Column, line_start: Column, line_end: Column) -> Column:
    """F20 for a single text to replace: its start."""
    return with_lines(text, lambda table: placed(text, table, original, line_start, line_end)["start"])


def spliced(text: Column, start: Column, original: Column, suggested: Column) -> Column:
    return F.concat(F.left(text, start), suggested, F.substr(text, start + F.length(original) + 1, F.lit(1 << 30)))


def between(table: Column, line: Column, col: Column, end_line: Column, end_col: Column) -> Column:
    """The text from one place to another."""
    of = lambda i: F.get(table["lines"], i)
    inner = F.slice(table["lines"], line + 2, F.greatest(F.lit(0), end_line - line - 1))
    return F.when(line == end_line, F.substr(of(line), col + 1, end_col - col)).otherwise(F.array_join(
        F.concat(F.array(F.substr(of(line), col + 1, F.lit(1 << 30))), inner, F.array(F.left(of(end_line), end_col))), "\n"))


def gathered(suggested: DataFrame, name: str = "s") -> DataFrame:
    """(doc_id, array of its suggestions by line and id)."""
    fields = [f.split(":")[0] for f in SUGGESTION[7:-1].split(",")]
    rows = F.array_sort(F.collect_list(F.struct("line_start", "id", F.struct(*fields).cast(SUGGESTION).alias("s"))))
    return suggested.groupBy("doc_id").agg(F.transform(rows, lambda k: k["s"]).alias(name))


def previews(docs: DataFrame, suggested: DataFrame) -> DataFrame:
    """one verified replacement per suggestion on the original text.

    ``docs(doc_id, text)`` meets its suggestions folded into one array: a document's text crosses the shuffle once, is split
    and hashed once, and is never copied into the rows of its suggestions. ``diff`` holds the lines a fix changes, before and after.
    """
    text = F.col("text")

    def preview(table: Column, before: Column, s: Column, p: Column) -> Column:
        ok = p["start"] >= 0
        after = F.concat(between(table, F.lit(0), F.lit(0), p["line"], p["col"]), s["suggested"],
                         between(table, p["end_line"], p["end_col"], F.size(table["lines"]) - 1, F.length(F.element_at(table["lines"], -1))))
        old = F.slice(table["lines"], p["line"] + 1, p["end_line"] - p["line"] + 1)
        new = F.split(F.concat(F.left(F.get(table["lines"], p["line"]), p["col"]), s["suggested"], F.substr(
            F.get(table["lines"], p["end_line"]), p["end_col"] + 1, F.lit(1 << 30))), "\n", -1)
        marked = lambda mark, lines: F.transform(lines, lambda l: F.concat(F.lit(mark), l))
        back = rx.let(after, lambda a: F.struct(F.sha2(a, 256).alias("after"), F.sha2(reverted(a, s), 256).alias("back")))
        return rx.let(F.when(ok, back), lambda h: F.struct(
            s["id"].alias("id"), s["line_start"].alias("line_start"), p["start"].alias("start"),
            F.when(p["start"] == -1, "stale").when(p["start"] == -2, "ambiguous").when(s["original"] == s["suggested"], "no change").otherwise("ok").alias("status"),
            before.alias("before_hash"), F.coalesce(h["after"], before).alias("after_hash"), h["back"].alias("reverted_hash"),
            ((s["fix_type"] != "safe") | (s["confidence"] < 95)).alias("needs_confirmation"),
            F.when(ok, F.array_join(F.concat(marked("-", old), marked("+", new)), "\n")).otherwise("").alias("diff")))

    each = with_lines(text, lambda table: rx.let(F.sha2(text, 256), lambda before: F.transform(
        "s", lambda s: rx.let(placed(text, table, s["original"], s["line_start"], s["line_end"]), lambda p: preview(table, before, s, p)))))
    return docs.join(gathered(suggested), "doc_id").select("doc_id", F.explode_outer(each).alias("p")).where("p IS NOT NULL").select("doc_id", "p.*")


def priority_of(kind: Column) -> Column:
    return F.when(kind == "safe", F.lit(3)).when(kind == "assisted", F.lit(2)).when(kind == "ai", F.lit(1)).otherwise(F.lit(0))


def accepted(candidates: Column) -> Column:
    """F21 over a document's suggestion array: greedy by type, confidence, earlier line; overlaps are blocked."""
    order = F.array_sort(F.transform(candidates, lambda s, i: F.struct(
        (-priority_of(s["fix_type"])).alias("p"), (-s["confidence"]).alias("c"), s["line_start"].alias("l"),
        i.alias("i"), s.alias("s"))))
    ordered = F.transform(order, lambda o: o["s"])

    def take(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: ~((k["line_end"] < s["line_start"]) | (s["line_end"] < k["line_start"])))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(ordered, F.slice(candidates, 1, 0), take)


def apply_all(text: Column, chosen: Column) -> Column:
    """the text with the accepted fixes, each located in the text as it came, and those that were applied.

    A piece table: the text is split into lines once, the fixes are placed in them and sorted, and the new text is put
    together once from the pieces between them. A fix that begins within an earlier one stays out.
    """
    def kept(places: Column) -> Column:
        by_place = F.array_sort(F.filter(places, lambda x: x["p"]["start"] >= 0))
        start = F.struct(F.lit(-1).alias("upto"), F.slice(by_place, 1, 0).alias("all"))

        def step(acc: Column, x: Column) -> Column:
            end = x["p"]["start"] + F.length(x["s"]["original"])
            return F.when(x["p"]["start"] < acc["upto"], acc).otherwise(F.struct(end.alias("upto"), F.concat(acc["all"], F.array(x)).alias("all")))

        return rx.let(by_place, lambda xs: F.aggregate(xs, start, step, lambda acc: acc["all"]))

    def built(table: Column, xs: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            last = F.get(xs, i - 1)["p"]
            return F.concat(between(table, F.when(i == 0, 0).otherwise(last["end_line"]), F.when(i == 0, 0).otherwise(last["end_col"]), x["p"]["line"], x["p"]["col"]),
                            x["s"]["suggested"])

        end = F.get(xs, F.size(xs) - 1)["p"]
        rest = between(table, F.coalesce(end["end_line"], F.lit(0)), F.coalesce(end["end_col"], F.lit(0)), F.size(table["lines"]) - 1, F.length(F.element_at(table["lines"], -1)))
        return F.struct(F.array_join(F.concat(F.transform(xs, piece), F.array(rest)), "").alias("text"), F.transform(xs, lambda x: x["s"]).alias("actions"))

    return with_lines(text, lambda table: rx.let(kept(F.transform(chosen, lambda s: F.struct(
        placed(text, table, s["original"], s["line_start"], s["line_end"]).alias("p"), s.alias("s")))), lambda xs: built(table, xs)))


def accepted_rows(suggested: DataFrame) -> DataFrame:
    """(doc_id, s, chosen) of every document: its suggestions, and those that win their conflicts.

    Suggestions whose lines touch directly or through others form a cluster; the greedy choice runs in each cluster alone,
    so a document of many fixes costs no pair of all of them.
    """
    fields = [f.split(":")[0] for f in SUGGESTION[7:-1].split(",")]
    by_line = Window.partitionBy("doc_id").orderBy("line_start", "line_end", "id")
    before = F.max("line_end").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    new = suggested.select("doc_id", *fields).withColumn("new", (before.isNull() | (F.col("line_start") > before)).cast("int"))
    numbered = new.withColumn("cluster", F.sum("new").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.array_sort(F.collect_list(F.struct("line_start", "id", F.struct(*fields).cast(SUGGESTION).alias("s"))))
    clusters = numbered.groupBy("doc_id", "cluster").agg(F.transform(own, lambda k: k["s"]).alias("s"))
    chosen = clusters.withColumn("chosen", F.when(F.size("s") == 1, F.col("s")).otherwise(accepted(F.col("s"))))
    return chosen.groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("chosen")).alias("chosen"))


def fixed_documents(docs: DataFrame, suggested: DataFrame) -> DataFrame:
    """F21 + F22: fixed text, the applied fixes with their ids, and the ids of blocked suggestions per document."""
    rows = docs.join(accepted_rows(suggested), "doc_id").select("doc_id", "text", "s", "chosen")
    rows = rows.withColumn("done", apply_all(F.col("text"), F.col("chosen")))
    return rows.select(
        "doc_id", "text", F.col("done.text").alias("fixed_text"), F.transform("done.actions", lambda s: s["id"]).alias("applied"),
        F.array_except(F.transform("s", lambda s: s["id"]), F.transform("chosen", lambda s: s["id"])).alias("blocked"),
        F.size("s").alias("n_suggestions"), F.col("done.actions").alias("actions"))


def reverted(text: Column, fix: Column) -> Column:
    """swap the texts and apply."""
    at = located(text, fix["suggested"], fix["line_start"], fix["line_end"])
    return rx.let(at, lambda a: F.when(a >= 0, spliced(text, a, fix["suggested"], fix["original"])).otherwise(text))


# --- diffs ---------------------------------------------------------------------------

DIFF_SCHEMA = "doc_id bigint, position int, kind string, old_line int, new_line int, old_text string, new_text string"


def diff_rows(doc_id, before: str, after: str, unit: str):
    """Rows of a matching-block diff; ``unit`` is line, word or paragraph."""
    import difflib
    import re

    split = {
        "line": lambda t: t.split("\n"), "word": lambda t: re.findall(r"\S+\s*", t),
        "paragraph": lambda t: [p.strip() for p in t.split("\n\n") if p.strip()]}[unit]
    a, b = split(before), split(after)
    n = 0
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if op == "equal":
            for i, j in zip(range(i1, i2), range(j1, j2)):
                yield doc_id, n, "same", i + 1, j + 1, a[i], b[j]
                n += 1
            continue
        for i in range(i1, i2):
            yield doc_id, n, "removed", i + 1, None, a[i], ""
            n += 1
        for j in range(j1, j2):
            yield doc_id, n, "added", None, j + 1, "", b[j]
            n += 1


ROWS, CHARS = 8192, 1 << 20  # what leaves Python at once: so many rows, or the row that reaches so many characters


def per_pair(pairs: DataFrame, schema: str, rows) -> DataFrame:
    """Rows ``rows(doc_id, text, fixed_text)`` of each document pair. One pair is opened at a time and rows leave in slices,
    so a worker holds one pair and one slice, however many documents a batch has."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [f.split()[1] for f in schema.split(", ")]

    def compare(batches):
        import pyarrow as pa

        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        held = [[] for _ in names]
        size = 0

        def slice_of():
            arrays = [pa.array(column, arrow[k]) for column, k in zip(held, kinds)]
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows(*(batch.column(c)[i].as_py() for c in range(3))):
                    for column, value in zip(held, row):
                        column.append(value)
                        size += len(value) if isinstance(value, str) else 0
                    if len(held[0]) >= ROWS or size >= CHARS:
                        yield slice_of()
                        size = 0
        if held[0]:
            yield slice_of()

    return pairs.select("doc_id", "text", "fixed_text").mapInArrow(compare, schema)


def diffs(pairs: DataFrame, unit: str = "line") -> DataFrame:
    """diff per document pair (doc_id, text, fixed_text)."""
    return per_pair(pairs, DIFF_SCHEMA, lambda d, a, b: diff_rows(d, a, b, unit))


def diff_statistics(rows: DataFrame) -> DataFrame:
    """added, removed and unchanged counts per document."""
    return rows.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "same")])


def unified_diffs(pairs: DataFrame, context: int = 3) -> DataFrame:
    """unified diff text and change count per document."""

    def unified(d, a, b):
        import difflib

        out = list(difflib.unified_diff(
            a.splitlines(keepends=True), b.splitlines(keepends=True), fromfile="original", tofile="fixed", n=context))
        plus = sum(x.startswith("+") and not x.startswith("++") for x in out)
        minus = sum(x.startswith("-") and not x.startswith("--") for x in out)
        yield d, "".join(out), plus + minus, plus, minus

    return per_pair(pairs, "doc_id bigint, unified string, changes int, additions int, deletions int", unified)


def line_set_diff(pairs: DataFrame) -> DataFrame:
    """Lines only before or only after, with counts: the relational form of a diff, by line hash inside a document."""
    def lines(column: str, sign: int) -> DataFrame:
        return pairs.select("doc_id", F.explode(F.split(column, "\n", -1)).alias("line"), F.lit(sign).alias("n"))

    return lines("text", -1).unionByName(lines("fixed_text", 1)).groupBy("doc_id", "line").agg(
        F.sum("n").alias("balance")).where("balance <> 0")


# --- history -----------------------------------------------------------------------------


def change_summary(applied: DataFrame) -> DataFrame:
    """applied fixes by category, rule and severity in one pass."""
    dims = ["category", "rule_id", "severity"]
    grouped = applied.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return grouped.select(
        F.when(F.col("_g") == 3, F.lit("category")).when(F.col("_g") == 5, F.lit("rule")).otherwise(F.lit("severity")).alias("dimension"),
        F.coalesce(F.when(F.col("_g") == 3, F.col("category")), F.when(F.col("_g") == 5, F.col("rule_id")),
                   F.when(F.col("_g") == 6, F.col("severity"))).alias("value"), "n")


def cumulative_diff(actions: DataFrame) -> DataFrame:
    """one row per apply event and one per revert event."""
    base = ["action_id", "session_id", "suggestion_id", "rule_id"]
    applies = actions.where("action_type = 'apply'").select(
        *base, F.lit("apply").alias("action"), F.col("original_text").alias("before"), F.col("patched_text").alias("after"),
        F.col("applied_at").alias("at"))
    reverts = actions.where("reverted_at IS NOT NULL").select(
        *base, F.lit("revert").alias("action"), F.col("patched_text").alias("before"), F.col("original_text").alias("after"),
        F.col("reverted_at").alias("at"))
    return applies.unionByName(reverts)


def suggestion_status(suggested: DataFrame, actions: DataFrame) -> DataFrame:
    """applied / reverted flags from the latest action of a suggestion (an aggregate, no window)."""
    latest = actions.groupBy("suggestion_id").agg(
        F.max_by(F.struct("applied_at", "reverted_at"), F.struct("applied_at", "reverted_at", "action_id")).alias("last"))
    return suggested.join(latest, suggested["id"] == latest["suggestion_id"], "left").select(
        suggested["*"], (F.col("last").isNotNull() & F.col("last.reverted_at").isNull()).alias("applied"),
        F.col("last.reverted_at").alias("reverted_at"))


def one_click(suggested: DataFrame) -> DataFrame:
    """pending safe fixes with a confidence of 90 or more."""
    return suggested.where("NOT applied AND fix_type = 'safe' AND confidence >= 90")
