"""Shaping of calls, purchases, registrations and tickets into the two wide event tables."""

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.functions import formatting as fmt
from accountlens.functions.dates import as_date, as_instant, instant
from accountlens.model import EventModel
from accountlens.operators.numbering import running_number
from accountlens.operators.shaping import normalise_events
from accountlens.operators.windows import trailing_distinct, trailing_window
from accountlens.plans.cards import ACTIVE_TYPES
from accountlens.schemas import COMPANY_EVENTS, CONTRACT_VALUE_PER_BOX, USER_EVENTS

TREND_OFFSETS = (0, 7, 14, 21, 28)


def fan_out_calls(calls: DataFrame) -> DataFrame:
    """One call record -> its `call`, `load`, `rating`, `comment` and `dialin` events.

    `load` comes a minute before the call. A missing or empty rating, comment or dial-in
    length gives no event. The dial-in length is stored in `call_duration`.
    """
    ts = F.col("timestamp")
    own = {
        "call": ("call_duration", "call_type", "call_num_users", "call_os", "session_id"),
        "load": (),
        "rating": ("rating", "session_id"),
        "comment": ("comment", "session_id"),
        "dialin": ("call_duration",),
    }
    present = {
        "rating": F.col("rating") != 0,
        "comment": F.col("comment") != "",
        "dialin": F.col("dialin_length") != 0,
    }
    measures = [f for f in USER_EVENTS if f.name not in ("timestamp", "type", "user", "company")]

    def event(kind: str):
        source = {"call_duration": "dialin_length"} if kind == "dialin" else {}
        values = [
            (F.col(source.get(f.name, f.name)) if f.name in own[kind] else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in measures
        ]
        when = ts - F.expr("interval 1 minute") if kind == "load" else ts
        name = F.when(present[kind], kind) if kind in present else F.lit(kind)
        return F.struct(when.alias("timestamp"), name.alias("type"), *values)

    fanned = calls.select("user", "company", F.inline(F.array(*[event(k) for k in own])))
    return normalise_events(fanned.where(F.col("type").isNotNull()), USER_EVENTS)


def provision_devices(purchases: DataFrame) -> DataFrame:
    """One `provisioned` row per device unit, `lag_days` after the purchase."""
    units = purchases.where(F.col("qty") > 0).select(
        "company",
        "timestamp",
        "purchase_id",
        "lag_days",
        F.explode(F.sequence(F.lit(1), F.col("qty"))).alias("unit"),
    )
    shaped = units.select(
        (F.col("timestamp") + F.make_dt_interval(F.col("lag_days"))).alias("timestamp"),
        F.lit("provisioned").alias("type"),
        "company",
        F.lit(1).alias("provisioned"),
        F.concat_ws("-", F.concat(F.lit("A"), "purchase_id"), "unit").alias("serial_number"),
    )
    return normalise_events(shaped, COMPANY_EVENTS)


def name_boxes(provisioned: DataFrame) -> DataFrame:
    """`<company>.room.NN` by running device number per company in time order.

    At least two digits, never cut.
    """
    numbered = running_number(provisioned, ["company"], ["timestamp", "serial_number"], "_n")
    number = F.col("_n").cast("string")
    padded = F.when(F.col("_n") < 10, F.concat(F.lit("0"), number)).otherwise(number)
    return numbered.withColumn("box_name", F.concat("company", F.lit(".room."), padded)).drop("_n")


def enrich_users(directory: DataFrame, as_of_ts: datetime | str | None = None) -> DataFrame:
    """Registration instant from days (`offset`) and minutes (`delay_minutes`) before the as-of instant."""
    before = F.make_dt_interval(F.col("offset"), F.lit(0), F.col("delay_minutes"))
    return directory.select("email", "company", (instant(as_instant(as_of_ts)) - before).alias("reg_date"))


def build_companies(users: DataFrame) -> DataFrame:
    """One document per company with its earliest registration and zero totals."""
    none = F.lit(0).cast("long")
    return users.groupBy(F.col("company").alias("name")).agg(
        F.min("reg_date").alias("earliest_reg"), none.alias("boxes_bought"), none.alias("boxes_prov")
    )


def registration_events(users: DataFrame) -> DataFrame:
    """One `register` event per user."""
    registered = users.select(
        F.col("reg_date").alias("timestamp"),
        F.lit("register").alias("type"),
        F.col("email").alias("user"),
        "company",
    )
    return normalise_events(registered, USER_EVENTS)


def number_tickets(tickets: DataFrame) -> DataFrame:
    """`<user>-<n>`, n from 0 per user in time order."""
    numbered = running_number(tickets, ["user"], ["timestamp"], "_n")
    number = (F.col("_n") - 1).cast("string")
    return numbered.withColumn("ticket_number", F.concat_ws("-", "user", number)).drop("_n")


def company_totals(company_events: DataFrame) -> DataFrame:
    """Boxes purchased and provisioned per company; a missing side is 0."""
    kind = F.col("type")
    zero = F.lit(0)
    bought = F.sum(F.when(kind == "purchased", F.col("purchased")))
    installed = F.sum(F.when(kind == "provisioned", F.col("provisioned")))
    return (
        company_events.where(kind.isin("purchased", "provisioned"))
        .groupBy("company")
        .agg(F.coalesce(bought, zero).alias("purchased"), F.coalesce(installed, zero).alias("provisioned"))
    )


def totals_as_updates(totals: DataFrame) -> DataFrame:
    """Company totals as the fields they set in `companies`, keyed by `name`."""
    return totals.select(
        F.col("company").alias("name"),
        F.col("purchased").alias("boxes_bought"),
        F.col("provisioned").alias("boxes_prov"),
    )


def build_renewals(totals: DataFrame, inputs: DataFrame) -> DataFrame:
    """One renewal per company with events; `due` and `health` come from `inputs`."""
    amount = F.col("purchased") * CONTRACT_VALUE_PER_BOX
    return totals.join(inputs, "company", "left").select(
        F.col("company").alias("id"), "company", amount.alias("amount"), "health", "due"
    )


def trending_snapshot(model: EventModel, as_of_date: date | str | None = None) -> DataFrame:
    """Weekly active users and calls per week on the as-of day and 7, 14, 21, 28 days before."""
    last = as_date(as_of_date)
    span = {"as_of_date": last, "days": max(TREND_OFFSETS) + 1}
    events, companies = model.user_events, model.companies
    metrics = {
        "7DAU": trailing_distinct(events, companies, "value", "user", ACTIVE_TYPES, **span),
        "CPW": trailing_window(events, companies, "value", ("call",), **span),
    }
    snapshots = [
        series.where(F.col("day").isin([last - timedelta(days=n) for n in TREND_OFFSETS])).select(
            F.concat_ws(":", "company", F.lit(metric), "day").alias("id"),
            F.lit(metric).alias("metric"),
            "company",
            fmt.python_round(F.col("value"), 2).alias("value"),
            F.col("day").cast("timestamp").alias("date"),
        )
        for metric, series in metrics.items()
    ]
    return snapshots[0].unionByName(snapshots[1])
