"""As-of arguments and the column expressions built from them.

Every literal is a constant when the plan is made, so bounds reach the Parquet scan and
the partition filter.
"""

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlens.session import require_utc


def as_date(value: date | datetime | str | None) -> date:
    """The UTC day of an instant, or the day itself. Default: today."""
    if isinstance(value, date) and not isinstance(value, datetime):
        return value
    return as_instant(value).date()


def as_instant(value: datetime | str | None) -> datetime:
    """UTC without offset. Default: now."""
    if value is None:
        value = datetime.now(timezone.utc)
    elif isinstance(value, str):
        value = datetime.fromisoformat(value)
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def instant(value: datetime) -> Column:
    # Through text: the session zone (UTC) decides, never the zone of the Python process.
    return F.lit(value.isoformat(sep=" ")).cast("timestamp")


def midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp")


def event_day(events: DataFrame) -> Column:
    """The stored day where there is one."""
    return F.col("event_date") if "event_date" in events.columns else F.to_date("timestamp")


def within_days(events: DataFrame, first: date | None, last: date | None) -> Column:
    """Calendar days `first..last`, both inclusive; None leaves that side open.

    On a stored table `event_date` decides alone, so `timestamp` need not be read, and the
    bounds of the periods skip those without such days.
    """
    require_utc(events.sparkSession)
    stored = "event_date" in events.columns
    bounds = []
    if first is not None:
        bounds.append(
            F.col("event_date") >= F.lit(first) if stored else F.col("timestamp") >= midnight(first)
        )
    if last is not None:
        end = last + timedelta(days=1)
        bounds.append(
            F.col("event_date") <= F.lit(last) if stored else F.col("timestamp") < midnight(end)
        )
    return _all([*bounds, *_overlapping(events, first, last)])


def _overlapping(events: DataFrame, first: date | None, last: date | None) -> list[Column]:
    if "last_day" not in events.columns:
        return []
    after = [] if first is None else [F.col("last_day") >= F.lit(first)]
    return after if last is None else [*after, F.col("first_day") <= F.lit(last)]


def since(events: DataFrame, moment: datetime) -> Column:
    """At or after an instant, without an upper bound."""
    require_utc(events.sparkSession)
    bounds = [F.col("timestamp") >= instant(moment)]
    if "event_date" in events.columns:
        bounds += [F.col("event_date") >= F.lit(moment.date()), *_overlapping(events, moment.date(), None)]
    return _all(bounds)


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result
