"""Queries of scalar functions against their SQL over texts that the tables lack: none, empty ones, white space of all kinds."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelens.functions import text as T
from tracelens.plans import catalogue

TEXTS = [
    None, "", " ", "\n", "\n\n", "\r\n", "\r", "one", "one\n", " one \nmore", "a\n  a", "  a\na  \n", "a\nb\nb", "\t\n\n", "\n\t\n", "a\t\na", "a \n a", "　\n \nx", "x\r\n\r\n  x", "x\rx\x0bx", "\x85a a",
    "\x00\n\x00", "é\n é", "​\n​ ", "\x1c\x1cx\x1d", "a\n" + " " * 5000 + "a", "x\n" * 300 + "y", "﻿a\na", "\n a\n" * 2, "A\na", "$1\n\\$1", "### Code\n\n### Code",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    some = [None, "", "en", "web"]
    rows = [(n, text, some[k % 4], some[(k // 2) % 4]) for k, text in enumerate(TEXTS * 4) for n in (2 * k, 2 * k + 1)] + [(None, "a\nb", None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


def as_its_sql(spark, odd, name):
    got = [tuple(r) for r in catalogue.queries()[name](spark, str(odd)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet/*.parquet')")
    assert sorted(got, key=repr) == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall(), key=repr)
    return got


def test_snippets_of_odd_texts(spark, odd):
    got = dict(as_its_sql(spark, odd, "f10_find_snippet_line"))
    at = lambda text: got[2 * TEXTS.index(text)]
    assert at(None) is None and at("") is None and at("\n") == 1 and at("one") == 1 and at("a\n  a") == 1 and at("a\nb\nb") == 2


def test_a_snippet_is_stripped_of_all_white_space(spark):
    rows = [("a\n\tb \nb", "b", 2), ("a", "", None), ("a", None, None), (None, "a", None), ("", "a", None), ("a\n\n", "\n", 2), ("a\n b", "b \nc", 2), ("a", "c", None), ("b\n b", " b", 1)]
    df = spark.createDataFrame(rows, "text string, snippet string, want long")
    assert [r[0] for r in df.select(T.find_snippet_line("text", "snippet")).collect()] == [want for *_, want in rows]
    assert [r[0] for r in df.select(T.find_snippet_line("text", "snippet", F.trim)).collect()] == [3, *[want for *_, want in rows[1:]]]


def test_sections_of_odd_texts(spark, odd):
    got = as_its_sql(spark, odd, "f37_prompt_sections")
    assert (0, None) in got and len(got) == 8 * len(TEXTS) + 1


def test_sections(spark):
    rows = [
        ("a", True, "b", "### X\na\n\n### Y\nb"), ("a", False, "b", "### Y\nb"), ("a", None, "b", "### Y\nb"), (None, False, "b", "### Y\nb"), (None, True, "b", None), ("", True, "", "### X\n\n\n### Y\n"),
        ("a", True, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a string, asked boolean, b string, want string")
    assert [r[0] for r in df.select(T.sections(("X", F.col("a"), F.col("asked")), ("Y", F.col("b")))).collect()] == [want for *_, want in rows]
