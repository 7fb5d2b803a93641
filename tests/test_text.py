import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.ids import canonical_id, is_blank


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_strip_removes_every_white_space_character(spark):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    rows = [(c + "x y" + c,) for c in blanks] + [(None,), ("",), (" \x1c ",)]
    got = [r[0] for r in one(spark, rows, "t string", T.strip("t"))]
    assert got == ["x y"] * len(blanks) + [None, "", ""]


def test_blank_texts_are_invalid(spark):
    rows = [(None,), ("",), (" ",), ("\xa0",), ("\x1c",), ("a",)]
    assert [r[0] for r in one(spark, rows, "t string", T.is_valid_text("t"))] == [False] * 5 + [True]


def test_canonical_id(spark):
    cases = {
        "12": "12", " 12": "12", "12\n": "12", "\xa012": "12", "0012": "12", "12.0": "12", "12.00": "12", "12.": "12", "１２": "12", "٣٤": "34", "0": "0", "000": "0", "0.0": "0",
        "1x2": None, "12.5": None, "": None, " ": None, "-5": None, "1 2": None, None: None, "9" * 30: "9" * 30,
    }
    got = one(spark, [(k,) for k in cases], "t string", canonical_id("t"), is_blank("t"))
    assert [g[0] for g in got] == list(cases.values())
    assert [g[1] for g in got] == [k is None or not k.strip() for k in cases]


def test_titles(spark):
    rows = [("", " a "), ("T", " a "), (None, "a")]
    got = one(spark, rows, "title string, text string", T.title_or_none("title"), T.document_titled("text", "title"), T.document_by_title("text", "title"))
    assert got == [("none", "a", "title: none | text:  a"), ("T", "T a", "title: T | text:  a"), ("none", "a", "title: none | text: a")]


def test_query_prompts(spark):
    rows = [(" q ", None), ("q", " find ")]
    got = [r[0] for r in one(spark, rows, "text string, i string", T.query_instruct("text", "i"))]
    assert got == [f"Instruct: {T.GENERIC_INSTRUCTION}\nQuery:q", "Instruct: find\nQuery:q"]


def test_unknown_task_type_is_an_error(spark):
    df = spark.createDataFrame([("q", "STS")], "text string, k string")
    assert df.select(T.query_by_task("text", "k")).first()[0] == "task: sentence similarity | query: q"
    with pytest.raises(Exception, match="no prompt for task type"):
        df.withColumn("k", F.lit("Other")).select(T.query_by_task("text", "k")).collect()


def test_format_instruction(spark):
    assert one(spark, [("a{instruction}",)], "i string", T.format_instruction("<{instruction}>", "i")) == [("<a{instruction}>",)]
    with pytest.raises(ValueError):
        T.format_instruction("no place", "i")


def test_resolve_prompt(spark):
    rows = [("o", "p", {"query": "m"}), (None, "p", {"query": "m"}), (None, "p", {"document": "m"}), (None, "p", None), (None, "", None)]
    got = one(spark, rows, "o string, p string, m map<string,string>", T.resolve_prompt(F.col("o"), F.col("p"), F.col("m"), F.lit("query"), F.lit("d")))
    assert [g[0] for g in got] == ["o", "m", "", "p", "d"]
