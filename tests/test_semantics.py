"""PostgreSQL meanings that Spark spells differently."""

import datetime

import pytest
from pyspark.sql import functions as F

from querytally.functions.numeric import int_div, safe_ratio
from querytally.functions.ordering import pg_asc, pg_desc
from querytally.functions.temporal import iso_timestamp, lap_seconds, mean_interval, seconds_between, year_gap, year_text
from querytally.functions.text import (
    double_to_single_quotes, embedding_with_provider, is_blank, postgres_type, question_with_evidence,
    sentence, split_key, split_table_name, with_provider)
from querytally.functions.vectors import cosine


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_null_order(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r.a for r in df.orderBy(pg_asc("a")).collect()] == [1, 2, None]
    assert [r.a for r in df.orderBy(pg_desc("a")).collect()] == [None, 2, 1]


def test_numbers(spark):
    assert one(spark, int_div(F.lit(-7), F.lit(2))) == -3
    assert one(spark, safe_ratio(F.lit(1), F.lit(0))) is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(spark, F.lit(1) / F.lit(0))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, F.lit("x").cast("int"))


def test_times(spark):
    a, b = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:30.5").cast("timestamp")
    assert one(spark, seconds_between(a, b)) == 90.5
    assert one(spark, seconds_between(b, a)) == -90.5
    n, m = (F.lit(t).cast("timestamp_ntz") for t in ("2024-03-30 12:00:00", "2024-04-02 13:00:00.25"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    assert one(spark, seconds_between(n, m)) == 3 * 86400 + 3600.25
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert one(spark, mean_interval(a, b)) == datetime.timedelta(seconds=90.5)
    assert one(spark, lap_seconds(F.lit("1:27.4"))) == pytest.approx(87.4)
    assert one(spark, lap_seconds(F.lit("+2 laps"))) is None
    assert one(spark, year_text(F.lit("2010-07-19 19:12:12"))) == "2010"
    assert one(spark, year_gap(F.lit("2024-01-01").cast("date"), F.lit("1999-12-31").cast("date"))) == 25
    assert one(spark, F.unix_micros(iso_timestamp(F.lit("2024-05-01T10:00:00.25+02:00")))) == 1714550400250000
    assert one(spark, iso_timestamp(F.lit("never"))) is None


@pytest.mark.parametrize("declared, want", [
    ("int", "INTEGER"), ("INT(11)", "INTEGER"), ("varchar(20)", "VARCHAR(20)"), ("VARCHAR2(30)", "VARCHAR(30)"),
    ("number(8,2)", "NUMERIC(8,2)"), ("", "TEXT"), ("real", "DOUBLE PRECISION"), ("datetime", "TIMESTAMP"), ("Text", "TEXT"), (None, "TEXT"),
    ("double precision", "DOUBLE PRECISION"), ("char(3) (x) y", "CHAR(3) (x)"), ("char(3", "CHAR"), ("enum [a]", "ENUM")])
def test_types(spark, declared, want):
    assert one(spark, postgres_type(F.lit(declared))) == want


@pytest.mark.parametrize("declared", ["(10)", " int", "[x]"])
def test_type_without_a_name(spark, declared):
    with pytest.raises(Exception, match="no type name"):
        one(spark, postgres_type(F.lit(declared)))


def test_texts(spark):
    assert one(spark, sentence(F.lit(" id of x "), F.lit(""))) == "id of x."
    assert one(spark, sentence(F.lit("id"), F.lit("0 or 1 "))) == "id. 0 or 1."
    assert one(spark, question_with_evidence(F.lit("q"), F.lit(None).cast("string"))) == "q\n"
    assert one(spark, double_to_single_quotes(F.lit('a = "b"'))) == "a = 'b'"
    assert one(spark, split_key(F.lit("ollama:smollm:135m"), 1)) == "smollm:135m"
    assert one(spark, split_table_name(F.lit("flights"), 0)) == "public"
    assert one(spark, split_table_name(F.lit("air.flights"), 1)) == "flights"
    assert one(spark, with_provider(F.lit("o4-mini"))) == "openai:o4-mini"
    assert one(spark, with_provider(F.lit("other:x"))) == "other:x"
    assert one(spark, embedding_with_provider(F.lit("nomic-ai/e"))) == "sentence_transformers:nomic-ai/e"
    for text in ("", " ", "\t\r", "  ", "\x1c", "x ", "_"):
        assert one(spark, is_blank(F.lit(text))) == (text.strip() == "")


def test_cosine(spark):
    assert one(spark, cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5 ** 0.5)
    assert one(spark, cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
