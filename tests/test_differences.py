"""Queries and their SQL on rows where they once differed."""

import duckdb
from pyspark.sql import functions as F

from quillspark.functions import rx
from tests.compare import difference
from workload import registry


def differs(spark, folder, name, documents=(), pages=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    for table, rows in (("documents", [(i, t, "en", "src1", len(t)) for i, t in documents]), ("pages", [(i, "u", h) for i, h in pages])):
        if rows:
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    return difference(registry.queries()[name](spark, str(folder)), con, registry.oracles()[name])


def test_capitals_of_several_characters(spark, tmp_path):
    assert differs(spark, tmp_path, "f10_bullet_capitals", [(1, "ßungber und\nŉor\nab"), (2, "ﬁne\nÄrger")]) is None


def test_character_references_without_semicolon(spark, tmp_path):
    pages = [(1, "<title>a &amp;&amp</title><h1>x</h1>"), (2, "<title>&copy b &quot;c&quot</title><h1>y</h1>"), (3, "<title>&amp;amp &amp;copy;</title><p>z</p>")]
    assert differs(spark, tmp_path, "p08_html_metadata", pages=pages) is None


def test_short_files_with_a_good_header(spark, tmp_path):
    assert differs(spark, tmp_path, "s05_rejects", [(12, "x" * 19), (26, "x" * 20), (40, "short"), (5, "y"), (4, "z"), (6, "csv")]) is None


def test_decimals_of_the_double_itself(spark):
    values = spark.createDataFrame([(207 / 60, 1), (189 / 60, 1), (2.25, 1), (0.05, 1), (12345.65, 1), (1.005, 2), (2.5, 0), (3.5, 0), (0.49999999999999994, 0)], "x double, d int")
    for digits in (0, 1, 2):
        got = [(r.x, r.t) for r in values.where(F.col("d") == digits).select("x", rx.half_even(F.col("x"), digits).alias("t")).collect()]
        assert got and all(t == f"{x:.{digits}f}" for x, t in got), got
