"""Text to document model: lines, headings, sections, references, captions.

Everything a rule needs about one document sits in that document's row, so the
rules that follow are a narrow projection: no shuffle, whatever the corpus size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import words as W
from ..functions import rx

CAPTION_WORDS = ["figure", "fig", "table", "tabl", "equation", "eq"]
EMPTY_BLOCKS = (
    "array<struct<block_idx:int,type:string,text:string,level:int,font_name:string,alignment:string,caption:string,"
    "node_id:string,line_start:int,line_end:int>>"
)


def normalized(text: Column) -> Column:
    """Line ends as ``\\n`` only."""
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def heading_array(lines: Column) -> Column:
    pattern = rx.exact(W.HEADING)

    def heading(line: Column, i: Column) -> Column:
        title = F.regexp_extract(line, pattern, 2)
        return F.when(
            line.startswith("#") & line.rlike(pattern),
            F.struct(
                F.length(F.regexp_extract(line, pattern, 1)).alias("level"),
                title.alias("title"),
                F.lower(rx.strip(title)).alias("key"),
                (i + 1).alias("line_no"),
            ),
        )

    return F.filter(F.transform(lines, heading), lambda h: h.isNotNull())


def section_array(headings: Column, n_lines: Column) -> Column:
    """Headings with their 0-based index and the line of the next heading (last: the line count)."""
    return F.transform(
        headings,
        lambda h, i: F.struct(
            i.alias("idx"), h["level"].alias("level"), h["title"].alias("title"), h["key"].alias("key"),
            h["line_no"].alias("line_no"),
            F.coalesce(F.get(headings, i + 1)["line_no"], n_lines).alias("next_line"),
            (i + 1 < F.size(headings)).alias("has_next"),
        ),
    )


def reference_array(lines: Column, sections: Column) -> Column:
    """Stripped non-blank lines under a reference heading."""
    is_list = rx.fold(W.REFERENCE_HEADING)
    entries = F.flatten(
        F.transform(
            F.filter(sections, lambda s: s["title"].rlike(is_list)),
            lambda s: F.slice(
                lines, s["line_no"] + 1,
                F.greatest(F.lit(0), s["next_line"] - s["line_no"] - s["has_next"].cast("int"))),
        )
    )
    return F.filter(F.transform(entries, rx.strip), lambda x: x != "")


def caption_array(lines: Column) -> Column:
    pattern = rx.led("fte", rx.fold(W.CAPTION))
    return F.filter(
        F.transform(
            lines,
            lambda line, i: F.when(
                line.rlike(pattern),
                F.struct(
                    (i + 1).alias("line_no"), line.alias("line"),
                    F.regexp_extract(line, pattern, 0).alias("whole"),
                    F.regexp_extract(line, pattern, 1).try_cast("int").alias("number"),
                    rx.strip(F.regexp_extract(line, pattern, 2)).alias("text"),
                ),
            ),
        ),
        lambda c: c.isNotNull(),
    )


def citation_counts(text: Column) -> Column:
    """Matches per citation pattern; a text without the opening bracket skips the regex."""
    patterns = [("apa", W.APA_IN_TEXT, "("), ("narrative", W.APA_NARRATIVE, "("), ("ieee", W.IEEE, "["),
                ("et_al", W.ET_AL, "("), ("pair", W.AUTHOR_PAIR, "("), ("bracket", W.ACM_BRACKET, "["),
                ("springer", W.SPRINGER, "(")]
    return F.struct(*[
        F.when(text.contains(opening), rx.count(text, rx.exact(pattern))).otherwise(F.lit(0)).alias(name)
        for name, pattern, opening in patterns])


def sought(token: Column) -> Column:
    """True for the tokens that a stock rule looks for on a line."""
    found = token.isin(W.LINE_WORDS)
    for end in W.ENDINGS:
        found = found | token.endswith(end)
    return found


def parse(docs: DataFrame, text: str = "text") -> DataFrame:
    """The document model as columns of the document row.

    ``tokens`` holds the lower-case words of every line and ``vocabulary`` the distinct ones of the
    document: most rules look there first and run their regexes only where a needed word occurs. ``marks`` are the
    tokens of every line that some rule looks for. ``odd`` documents have a letter that matches i or s in a pattern of any case
    without being one in lower case: their lines are all looked at.
    """
    out = docs.withColumn("text", normalized(F.col(text)))
    out = out.withColumns({"lines": F.split("text", "\n", -1), "text_lower": F.lower("text")})
    out = out.withColumns({
        "n_lines": F.size("lines"),
        "headings": heading_array(F.col("lines")),
        "tokens": F.transform("lines", lambda line: rx.tokens(F.lower(line))),
    })
    out = out.withColumns({
        "sections": section_array(F.col("headings"), F.col("n_lines")),
        "vocabulary": F.array_distinct(F.flatten("tokens")),
        "marks": F.transform("tokens", lambda words: F.filter(words, lambda t: sought(t))),
        "odd": F.col("text").rlike("[\u0130\u0131\u017f]"),
        "cites": citation_counts(F.col("text")),
    })
    return out.withColumns({
        "refs": reference_array(F.col("lines"), F.col("sections")),
        "captions": F.when(
            F.arrays_overlap("vocabulary", rx.strings(CAPTION_WORDS))
            | F.col("text").rlike(rx.led("fte", rx.fold(r"(?:figure|fig|tabl|equation|eq)\w*\.?\s*\d"))),
            caption_array(F.col("lines"))).otherwise(caption_array(F.array().cast("array<string>"))),
    })


def with_blocks(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Attach each document's blocks, in order, as one array column.

    One document is the unit of work everywhere, so the group is bounded by the document size.
    """
    grouped = blocks.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("block_idx").cast("int").alias("block_idx"), "type", "text",
                    F.col("level").cast("int").alias("level"), "font_name", "alignment", "caption", "node_id",
                    F.col("line_start").cast("int").alias("line_start"),
                    F.col("line_end").cast("int").alias("line_end"),
                )
            )
        ).alias("blocks")
    )
    return parsed.join(grouped, "doc_id", "left").withColumn(
        "blocks", F.coalesce("blocks", F.array().cast(EMPTY_BLOCKS)))


def shows(tokens: Column, words: list[str]) -> Column:
    """True when one of the tokens of a line is one of the words."""
    return F.exists(tokens, lambda t: t.isin(words))


@dataclass(frozen=True)
class Doc:
    """The columns of a parsed document row, as the rules see them."""

    text: Column
    lower: Column
    lines: Column
    n_lines: Column
    headings: Column
    sections: Column
    refs: Column
    captions: Column
    tokens: Column
    vocabulary: Column
    marks: Column
    odd: Column
    cites: Column
    blocks: Column
    profile_id: Column
    profile_name: Column
    required_sections: Column
    permissions: Column

    @classmethod
    def of(cls, parsed: DataFrame) -> "Doc":
        def has(name: str, fallback: Column) -> Column:
            return F.col(name) if name in parsed.columns else fallback

        return cls(
            F.col("text"), F.col("text_lower"), F.col("lines"), F.col("n_lines"), F.col("headings"),
            F.col("sections"), F.col("refs"), F.col("captions"), F.col("tokens"), F.col("vocabulary"),
            F.col("marks"), F.col("odd"), F.col("cites"),
            has("blocks", F.array().cast(EMPTY_BLOCKS)),
            has("profile_id", F.lit("general")), has("profile_name", F.lit("General Review")),
            has("required_sections", F.array().cast("array<string>")),
            has("permissions", F.create_map().cast("map<string,int>")),
        )

    def is_profile(self, *ids: str) -> Column:
        return self.profile_id.isin(*ids)

    def may(self, category: str, level: int) -> Column:
        return F.coalesce(self.permissions[category], F.lit(0)) >= level

    def uses(self, words: list[str]) -> Column:
        """True when the document has one of the words as a token."""
        return self.odd | F.arrays_overlap(self.vocabulary, rx.strings(words))

    def on_lines(self, use, words: list[str] | None = None, worth=None) -> Column:
        """The array of what ``use(line, index)`` gives for the lines that have one of the words, or of which ``worth(marks)`` holds.

        The tokens are bound first: a column read only inside a lambda is moved into it by the optimizer, and would be made
        anew for every line.
        """
        if words is None and worth is None:
            return F.transform(self.lines, use)
        has = worth or (lambda marks: shows(marks, words))
        tokens = self.marks if worth or set(words) <= set(W.LINE_WORDS) else self.tokens
        return self._kept(tokens, lambda line, i, marks, odd: F.when(odd | has(marks), use(line, i)))

    def marked(self, use) -> Column:
        """The array of what ``use(line, index, marks, odd)`` gives for the lines that have marks."""
        return self._kept(self.marks, lambda line, i, marks, odd: F.when(odd | (F.size(marks) > 0), use(line, i, marks, odd)))

    def _kept(self, tokens: Column, use) -> Column:
        bound = F.struct(tokens.alias("tokens"), self.odd.alias("odd"))
        return rx.let(bound, lambda b: F.filter(
            F.transform(self.lines, lambda line, i: use(line, i, F.get(b["tokens"], i), b["odd"])), lambda x: x.isNotNull()))

    def lines_where(self, pick, words: list[str] | None = None, worth=None) -> Column:
        """(no, line, k) for the lines on which ``pick(line)`` is not null, in line order.

        ``words``: tokens a line must have for ``pick`` to be worth a look.
        """

        def on_line(line: Column, i: Column) -> Column:
            return F.struct((i + 1).alias("no"), line.alias("line"), pick(line).alias("k"))

        return F.filter(self.on_lines(on_line, words, worth), lambda hit: hit["k"].isNotNull())

    def matches(self, pattern: str, group: int = 0, per_line: int | None = None,
                words: list[str] | None = None, worth=None) -> Column:
        """(no, line, k) for every regex match, in order; at most ``per_line`` of each line."""

        def on_line(line: Column, i: Column) -> Column:
            found = rx.find_all(line, pattern, group)
            if per_line is not None:
                found = F.slice(found, 1, per_line)
            return F.transform(found, lambda m: F.struct((i + 1).alias("no"), line.alias("line"), m.alias("k")))

        return F.flatten(self.on_lines(on_line, words, worth))

    def section_lines(self, section: Column, include_next_heading: bool) -> Column:
        """Lines after a heading; the structure rules count the next heading line in, the format rules do not."""
        length = section["next_line"] - section["line_no"]
        if not include_next_heading:
            length = length - section["has_next"].cast("int")
        return F.slice(self.lines, section["line_no"] + 1, F.greatest(F.lit(0), length))
