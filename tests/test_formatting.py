import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from accountlens.functions import formatting as fmt


def one(spark, schema, value, expression):
    return spark.createDataFrame([(value,)], f"x {schema}").select(expression(F.col("x"))).first()[0]


def test_rounding_is_python_rounding(spark):
    rng = random.Random(3)
    values = [rng.randint(1, 5000) / rng.randint(1, 400) for _ in range(20000)]
    values += [k / 1000 for k in range(5000)] + [2.675, 12.25, 0.125, 1e9 + 0.005]
    rows = [(x, round(x, 2), f"{x:.1f}%", f"${x:,.2f}") for x in values if x]
    frame = spark.createDataFrame(rows, "x double, r double, p string, m string")
    wrong = frame.where(
        (fmt.python_round(F.col("x"), 2) != F.col("r"))
        | (fmt.percent(F.col("x")) != F.col("p"))
        | (fmt.money_cents(F.col("x")) != F.col("m"))
    )
    assert wrong.count() == 0


@pytest.mark.parametrize(
    "value,text", [(None, "TBD"), (0, "TBD"), (2499, "$2,499"), (1234567890, "$1,234,567,890"), (-5, "$-5")]
)
def test_money(spark, value, text):
    assert one(spark, "long", value, fmt.money) == text


@pytest.mark.parametrize("value,text", [(None, "0%"), (0.0, "0%"), (12.25, "12.2%"), (1234.56, "1234.6%")])
def test_percent(spark, value, text):
    assert one(spark, "double", value, fmt.percent) == text


@pytest.mark.parametrize("value", [datetime(2024, 1, 5), datetime(2024, 1, 5, 3, 4, 5, 60), datetime(1999, 12, 31, 23, 59, 59, 999999)])
def test_dates(spark, value):
    assert one(spark, "timestamp", value, fmt.iso_text) == value.isoformat() + "+00:00"
    assert one(spark, "timestamp", value, fmt.datetime_text) == value.strftime("%Y-%m-%d %H:%M:%S")
    assert one(spark, "timestamp", value, fmt.day_label) == value.strftime("%b %d")
    assert one(spark, "timestamp", value, fmt.short_date) == value.strftime("%m/%d")


def test_missing_values(spark):
    assert one(spark, "timestamp", None, fmt.datetime_text) == ""
    assert one(spark, "timestamp", None, fmt.short_date) == "No date"
    assert one(spark, "timestamp", None, lambda c: fmt.age_text(c, datetime(2024, 1, 1))) == ""
    assert one(spark, "string", None, fmt.initial) == "?"


def test_names_and_numbers(spark):
    assert one(spark, "string", "ann@x.com", fmt.user_name) == "ann"
    assert one(spark, "string", "ann", fmt.user_name) == "ann"
    assert one(spark, "string", "ann", fmt.initial) == "A"
    assert one(spark, "long", 1234567, fmt.thousands) == "1,234,567"
