import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import cleaning as C


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression.alias("x")).collect()]


def test_text_normalisers(spark):
    values = ["   ", " proc4 ", None, "", "x"]
    assert column(spark, values, C.trim_to_null("v")) == [None, "proc4", None, None, "x"]
    assert column(spark, values, C.code("v")) == [None, "PROC4", None, None, "X"]


def test_titles_restore_acronyms_only_as_words(spark):
    values = ["  dr patel ", "rn pa do np ent ob/gyn md", "entitlement medical", "DR. A (MD)"]
    assert column(spark, values, C.title("v")) == [
        "Dr Patel", "RN PA DO NP ENT OB/GYN MD", "Entitlement Medical", "Dr. A (MD)"]


def test_decimals(spark):
    got = column(spark, ["28733.0", "abc", " 1.005 ", "-2.345", "", None], C.decimal_or_null("v"))
    assert got == [Decimal("28733.00"), None, Decimal("1.01"), Decimal("-2.35"), None, None]


def test_dates_are_strict(spark):
    got = column(spark, ["2024-02-22", "2024/02/22", "2024-02-30", " 2024-01-05 ", "x", None], C.date_or_null("v"))
    assert got == [datetime.date(2024, 2, 22), None, None, datetime.date(2024, 1, 5), None, None]


def test_booleans(spark):
    got = column(spark, ["1", " true", "Yes", "y", "0", "FALSE", "no ", "N", "maybe", "", None], C.bool_or_null("v"))
    assert got == [True] * 4 + [False] * 4 + [None] * 3


def test_flags(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    one = spark.range(1)
    flags = C.quality_flags({"missing_billed_amount": t, "missing_procedure_code": f, "provider_location_unknown": t, "x": n})
    assert one.select(flags.alias("x")).first()[0] == ["missing_billed_amount", "provider_location_unknown"]
    empty = one.select(C.quality_flags({}).alias("x"))
    assert empty.schema["x"].dataType.simpleString() == "array<string>"
    assert empty.first()[0] == []


@pytest.mark.parametrize("n, d, expected", [(1, 3, 33.33), (0, 5, 0.0), (1, 0, None), (None, 1, None), (1, None, None)])
def test_percent(spark, n, d, expected):
    got = spark.range(1).select(C.percent(F.lit(n).cast("long"), F.lit(d).cast("long")).alias("x")).first()[0]
    assert got == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=4, allow_nan=False), min_size=20, max_size=60))
def test_decimal_rounding_matches_half_up(spark, numbers):
    got = column(spark, [str(n) for n in numbers], C.decimal_or_null("v"))
    assert got == [n.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) for n in numbers]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" abXY19-", max_size=12), min_size=20, max_size=60))
def test_codes_match_plain_python(spark, texts):
    assert column(spark, texts, C.code("v")) == [(t.strip(" ").upper() or None) for t in texts]
