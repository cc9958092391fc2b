"""One wide row per company: the headline of every card."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.functions import formatting as fmt
from accountlens.functions.dates import as_date, within_days
from accountlens.model import EventModel
from accountlens.operators.windows import (
    at_last_day,
    at_last_nonnull,
    daily_series,
    headline,
    is_summed,
    trailing_distinct,
)
from accountlens.plans.cards import (
    ACTIVE_TYPES,
    PROVISIONED,
    PURCHASED,
    provisioned_pct,
    user_activity,
)
from accountlens.schemas import CONTRACT_VALUE_PER_BOX

ACTIVITY_NAMES = ("calls", "dialins", "support_tickets", "total_registered")


def company_scorecard(
    model: EventModel,
    as_of_date: date | str | None = None,
    company_as_of_date: date | str | None = None,
    days: int = 30,
) -> DataFrame:
    """Every headline from three scans of user events and one of company events.

    The scans of user events read the look-back days, the registrations of all time, and the
    7 days that active users need. All parts are one row per company and partitioned by it
    before they are joined.
    """
    last = as_date(as_of_date)
    activity = user_activity(model, as_of_date=last, days=days)
    activity = activity.groupBy("company").agg(
        *at_last_day(*ACTIVITY_NAMES), *at_last_nonnull("avg_rating", "avg_rating", "num_rating")
    )
    active = trailing_distinct(
        model.user_events, model.companies, "sdau", "user", ACTIVE_TYPES, last, days=1
    ).drop("day")
    boxes = box_totals(model, as_date(company_as_of_date or last))
    wide = activity.join(active, "company").join(boxes, "company", "left")
    zero = F.lit(0)
    purchased = F.coalesce("purchased", zero)
    return wide.select(
        "company",
        purchased.alias("purchased"),
        (purchased * CONTRACT_VALUE_PER_BOX).alias("acv"),
        F.coalesce(PURCHASED.name, zero).alias(PURCHASED.name),
        provisioned_pct().alias("pct_provisioned"),
        fmt.python_round(F.col("avg_rating"), 2).alias("avg_rating"),
        "num_rating",
        F.coalesce(PROVISIONED.name, zero).alias(PROVISIONED.name),
        "sdau",
        "dialins",
        "total_registered",
        "calls",
        "support_tickets",
    )


def box_totals(model: EventModel, last: date) -> DataFrame:
    """Purchases of all time, and both totals up to the as-of day."""
    events = model.company_sums
    summed = is_summed(events)
    bought = F.when((F.col("type") == "purchased"), F.col("sum_purchased" if summed else "purchased"))
    installed = F.when((F.col("type") == "provisioned"), F.col("sum_provisioned" if summed else "provisioned"))
    in_time = within_days(events, None, last)
    zero = F.lit(0)
    return (
        events.where(F.col("type").isin("purchased", "provisioned"))
        .groupBy("company")
        .agg(
            F.sum(bought).alias("purchased"),
            F.coalesce(F.sum(F.when(in_time, bought)), zero).alias(PURCHASED.name),
            F.coalesce(F.sum(F.when(in_time, installed)), zero).alias(PROVISIONED.name),
        )
    )


def headline_values(
    model: EventModel,
    as_of_date: date | str | None = None,
    company_as_of_date: date | str | None = None,
    days: int = 30,
) -> DataFrame:
    """Last-day value of each dense series, taken from the series themselves."""
    span = {"as_of_date": as_date(as_of_date), "days": days}
    boxes = daily_series(
        model.company_sums,
        model.companies,
        [PURCHASED, PROVISIONED],
        as_date(company_as_of_date or as_of_date),
        days,
    ).withColumn("pct_provisioned", provisioned_pct())
    active = trailing_distinct(
        model.user_events, model.companies, "sdau", "user", ACTIVE_TYPES, **span
    )
    return (
        headline(boxes, PURCHASED.name, PROVISIONED.name, "pct_provisioned")
        .join(headline(user_activity(model, **span), *ACTIVITY_NAMES), "company")
        .join(headline(active, "sdau"), "company")
    )
