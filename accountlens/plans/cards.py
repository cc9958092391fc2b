"""Dashboard cards, each for all companies in one plan or for one company by name."""

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountlens.functions import formatting as fmt
from accountlens.functions.dates import as_instant, event_day, since
from accountlens.model import EventModel
from accountlens.operators.windows import (
    Measure,
    daily_series,
    is_summed,
    ratio,
    trailing_avg,
    trailing_distinct,
)
from accountlens.schemas import CONTRACT_VALUE_PER_BOX

PURCHASED = Measure("total_purchased", ("purchased",), "purchased", "sum", cumulative=True)
PROVISIONED = Measure("total_provisioned", ("provisioned",), "provisioned", "sum", cumulative=True)
REGISTERED = Measure("total_registered", ("register",), cumulative=True)
CALLS = Measure("calls", ("call",))
DIALINS = Measure("dialins", ("dialin",))
TICKETS = Measure("support_tickets", ("support_ticket",))
RATING_TOTAL = Measure("rating_total", ("rating",), "rating", "sum")
RATING_COUNT = Measure("num_rating", ("rating",), "rating")
ACTIVE_TYPES = ("call", "dialin")

COMMENT_LIMIT = 50
RECENT_COMMENTS = 3


def labelled(series: DataFrame) -> DataFrame:
    return series.withColumn("label", fmt.day_label(F.col("day")))


def by_day(series: DataFrame) -> DataFrame:
    """A series with each day's `position` in its company's; a position outlasts any shuffle, an order does not."""
    place = Window.partitionBy("company").orderBy("day")
    return series.withColumn("position", F.row_number().over(place).cast("long"))


def provisioned_pct() -> Column:
    bought, installed = F.col(PURCHASED.name), F.col(PROVISIONED.name)
    return F.when(bought > 0, F.round(installed / bought * 100, 2))


def customer_overview(model: EventModel) -> DataFrame:
    """Boxes purchased over all time and their contract value."""
    events = model.company_sums
    bought = Measure("purchased", ("purchased",), "purchased", "sum")
    summed = is_summed(events)
    totals = events.where(bought.wanted(summed)).groupBy("company").agg(bought.total(F.lit(True), summed))
    purchased = F.coalesce("purchased", F.lit(0)).alias("purchased")
    overview = model.companies.join(totals, "company", "left").select("company", purchased)
    acv = F.col("purchased") * CONTRACT_VALUE_PER_BOX
    return overview.withColumn("acv", acv).withColumn("acv_text", fmt.money_cents(F.col("acv")))


def _series(model: EventModel, measure: Measure, **span) -> DataFrame:
    of_company = measure in (PURCHASED, PROVISIONED)
    events = model.company_sums if of_company else model.user_sums
    return labelled(daily_series(events, model.companies, [measure], **span))


def boxes_purchased(model: EventModel, **span) -> DataFrame:
    return _series(model, PURCHASED, **span)


def boxes_provisioned(model: EventModel, **span) -> DataFrame:
    return _series(model, PROVISIONED, **span)


def boxes_provisioned_pct(model: EventModel, **span) -> DataFrame:
    """Both totals from one scan; not capped at 100, NULL while nothing is purchased."""
    totals = daily_series(model.company_sums, model.companies, [PURCHASED, PROVISIONED], **span)
    return labelled(totals.select("company", "day", provisioned_pct().alias("pct_provisioned")))


def users_registered(model: EventModel, **span) -> DataFrame:
    return _series(model, REGISTERED, **span)


def calls_count(model: EventModel, **span) -> DataFrame:
    return _series(model, CALLS, **span)


def dialin_count(model: EventModel, **span) -> DataFrame:
    return _series(model, DIALINS, **span)


def support_tickets(model: EventModel, **span) -> DataFrame:
    return _series(model, TICKETS, **span)


def users_active(model: EventModel, **span) -> DataFrame:
    return labelled(
        trailing_distinct(model.user_events, model.companies, "sdau", "user", ACTIVE_TYPES, **span)
    )


def ratings_average(model: EventModel, **span) -> DataFrame:
    series = trailing_avg(
        model.user_sums, model.companies, "rating", ("rating",), "avg_rating", "num_rating", **span
    )
    return labelled(series.withColumn("avg_rating", fmt.python_round(F.col("avg_rating"), 2)))


def calls_breakdown(model: EventModel, as_of_ts: datetime | str | None = None) -> DataFrame:
    """Calls of the rolling 7 days by type, number of users and operating system.

    Events are counted once per combination of the three; only those counts are unpivoted.
    """
    week_ago = as_instant(as_of_ts) - timedelta(days=7)
    events = model.user_events
    combos = (
        events.where((F.col("type") == "call") & since(events, week_ago))
        .groupBy("company", "call_type", "call_num_users", "call_os")
        .agg(F.count("*").alias("n"))
    )
    keys = {"type": "call_type", "users": "call_num_users", "os": "call_os"}
    dimensions = F.array(
        *[
            F.struct(F.lit(dimension).alias("dimension"), F.col(column).cast("string").alias("key"))
            for dimension, column in keys.items()
        ]
    )
    return (
        combos.where(F.col("company").isNotNull())
        .select("company", "n", F.inline(dimensions))
        .where(F.col("key").isNotNull())
        .groupBy("company", "dimension", "key")
        .agg(F.sum("n").alias("calls"))
    )


def by_dimension(breakdown: DataFrame) -> DataFrame:
    """A breakdown with each key's `position` in its dimension: user numbers as numbers, the others by falling count."""
    is_users = F.col("dimension") == "users"
    order = [F.when(is_users, F.col("key").cast("long")), F.when(~is_users, -F.col("calls")), F.col("key")]
    place = Window.partitionBy("company", "dimension").orderBy(*order)
    return breakdown.withColumn("position", F.row_number().over(place).cast("long"))


def comments_recent(model: EventModel, as_of_ts: datetime | str | None = None) -> DataFrame:
    """The newest 50 comments of the rolling 7 days per company, with display columns.

    The rank limit is applied map-side before the shuffle by company.
    """
    now = as_instant(as_of_ts)
    events = model.user_events
    newest = Window.partitionBy("company").orderBy(F.desc("timestamp"), "user", "comment")
    ranked = (
        events.where(
            (F.col("type") == "comment")
            & F.col("comment").isNotNull()
            & F.col("company").isNotNull()
            & since(events, now - timedelta(days=7))
        )
        .select("company", "user", "comment", "timestamp", event_day(events).alias("comment_date"))
        .withColumn("rank", F.row_number().over(newest).cast("long"))
        .where(F.col("rank") <= COMMENT_LIMIT)
    )
    ts, name = F.col("timestamp"), fmt.user_name(F.col("user"))
    return ranked.select(
        "company",
        "rank",
        "comment_date",
        "user",
        "comment",
        "timestamp",
        fmt.iso_text(ts).alias("posted_at"),
        name.alias("user_name"),
        fmt.initial(name).alias("user_initial"),
        fmt.age_text(ts, now).alias("age"),
        (F.col("rank") <= RECENT_COMMENTS).alias("recent"),
    )


# Card name -> function, and which as-of argument it takes.
SERIES_CARDS: dict[str, Callable[..., DataFrame]] = {
    "boxes_purchased_cumulative_30d": boxes_purchased,
    "boxes_provisioned_pct_cumulative_30d": boxes_provisioned_pct,
    "ratings_average_7d_window_30d": ratings_average,
    "boxes_provisioned_cumulative_30d": boxes_provisioned,
    "users_active_7d_window_30d": users_active,
    "dialin_count_7d_window_30d": dialin_count,
    "users_registered_cumulative_30d": users_registered,
    "calls_count_7d_window_30d": calls_count,
    "support_tickets_7d_window_30d": support_tickets,
}
ROLLING_CARDS: dict[str, Callable[..., DataFrame]] = {
    "calls_breakdown_7d": calls_breakdown,
    "comments_recent_7d": comments_recent,
}


def card(
    name: str,
    model: EventModel,
    as_of_date: date | str | None = None,
    as_of_ts: datetime | str | None = None,
    company: str | None = None,
    days: int = 30,
) -> DataFrame:
    """One card by name, for every company or for `company`."""
    scope = model if company is None else model.only(company)
    if name in SERIES_CARDS:
        return SERIES_CARDS[name](scope, as_of_date=as_of_date, days=days)
    if name in ROLLING_CARDS:
        return ROLLING_CARDS[name](scope, as_of_ts=as_of_ts)
    raise ValueError(f"Unknown card type: {name}")


def user_activity(model: EventModel, **span) -> DataFrame:
    """Every additive user series together: calls, dial-ins, tickets, registrations, ratings."""
    measures = [CALLS, DIALINS, TICKETS, REGISTERED, RATING_TOTAL, RATING_COUNT]
    series = daily_series(model.user_sums, model.companies, measures, **span)
    average = ratio(RATING_TOTAL.name, RATING_COUNT.name)
    return series.withColumn("avg_rating", average).drop(RATING_TOTAL.name)
