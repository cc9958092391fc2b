"""Display text, as column expressions.

`format_number` rounds the exact binary value half to even, which is what Python's
`round` and `format` do; `bround` and `printf` round the shortest decimal text instead
and differ on values such as 2.675.
"""

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from accountlens.functions.dates import instant


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed number of decimals, no grouping."""
    return F.translate(F.format_number(value, digits), ",", "")


def python_round(value: Column, digits: int) -> Column:
    return fixed_text(value, digits).cast("double")


def day_label(day: Column) -> Column:
    """`Jan 05`"""
    return F.date_format(day, "MMM dd")


def short_date(*candidates: Column) -> Column:
    """`01/05` of the first date present, else `No date`."""
    return F.coalesce(*[F.date_format(c, "MM/dd") for c in candidates], F.lit("No date"))


def iso_text(ts: Column) -> Column:
    """ISO 8601 with offset; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(fraction)


def datetime_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def money(amount: Column) -> Column:
    """`$1,234`, or `TBD` for nothing and zero."""
    text = F.concat(F.lit("$"), F.format_number(amount, 0))
    return F.when(amount != 0, text).otherwise("TBD")


def money_cents(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def percent(value: Column) -> Column:
    """`12.2%`, or `0%` for nothing and zero."""
    return F.when(value != 0, F.concat(fixed_text(value, 1), F.lit("%"))).otherwise("0%")


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def user_name(user: Column) -> Column:
    """The part of an e-mail address before the `@`."""
    return F.substring_index(user, "@", 1)


def initial(name: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.left(name, F.lit(1))), F.lit("")), F.lit("?"))


def age_text(ts: Column, now: datetime) -> Column:
    """`3d ago`, `5h ago`, `Just now`; whole hours of a millisecond difference."""
    elapsed = F.unix_millis(instant(now)) - F.unix_millis(ts)
    hours = F.floor(elapsed / 3_600_000)
    days = F.floor(hours / 24)
    return (
        F.when(ts.isNull(), "")
        .when(days > 0, F.concat(days.cast("string"), F.lit("d ago")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise("Just now")
    )
