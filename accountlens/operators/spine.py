"""The dense calendar of a series."""

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.functions.dates import as_date


def calendar_spine(
    companies: DataFrame, as_of_date: date | str | None = None, days: int = 30
) -> DataFrame:
    """One row per company and day, `days` days up to and including the as-of date.

    `companies` has one row per company. The calendar is a constant array exploded in
    place, so nothing is joined or shuffled.
    """
    last = as_date(as_of_date)
    first = last - timedelta(days=days - 1)
    calendar = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))
    return companies.select("company", F.explode(calendar).alias("day"))
