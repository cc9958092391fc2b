"""Full reload of a store from source frames."""

import logging
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlens.functions.dates import as_instant
from accountlens.model import EventModel
from accountlens.operators.shaping import clamp_future, union_events
from accountlens.operators.updates import update_by_field
from accountlens.plans.etl import (
    build_companies,
    build_renewals,
    company_totals,
    enrich_users,
    fan_out_calls,
    name_boxes,
    number_tickets,
    provision_devices,
    registration_events,
    totals_as_updates,
    trending_snapshot,
)
from accountlens.schemas import COMPANY_EVENTS, EVENT_TABLES, USER_EVENTS
from accountlens.sources.store import Draft
from accountlens.sources.tables import first_users

log = logging.getLogger(__name__)


def reload_all(
    root: str,
    directory: DataFrame,
    calls: DataFrame,
    tickets: DataFrame,
    purchases: DataFrame,
    projects: DataFrame,
    renewal_inputs: DataFrame,
    as_of_ts: datetime | str | None = None,
    user_limit: int | None = None,
) -> dict[str, int]:
    """Users, companies, projects, events, totals, renewals, trends; returns rows per table.

    All seven tables change in one commit: until then readers see the store as it was, and so they do if the reload
    fails. Each stage reads what the stage before it wrote, so no stage is computed twice and a lost executor costs one
    stage at most. With a user limit, only calls and tickets of the listed users and purchases, projects and renewals
    of their companies are loaded.
    """
    spark = directory.sparkSession
    now = as_instant(as_of_ts)
    draft, counts = Draft(spark, root), {}

    chosen = first_users(directory, user_limit) if user_limit else directory
    counts["users"] = draft.replace(enrich_users(chosen, now), "users")
    if counts["users"] == 0:
        raise ValueError("no user records: cannot load without source users")
    users = draft.read("users")

    counts["companies"] = draft.replace(build_companies(users), "companies")
    if user_limit:
        names = draft.read("companies").select(F.col("name").alias("company")).where("company IS NOT NULL").distinct()
        emails = users.select(F.col("email").alias("user"))
        calls, tickets = (df.join(emails, "user", "left_semi") for df in (calls, tickets))
        purchases, projects = (df.join(names, "company", "left_semi") for df in (purchases, projects))
    counts["projects"] = draft.replace(projects, "projects")

    for table in EVENT_TABLES:
        draft.truncate(table)
    bought = purchases.select(
        "timestamp", F.lit("purchased").alias("type"), "company", F.col("qty").alias("purchased")
    )
    boxes = union_events(bought, name_boxes(provision_devices(purchases)), schema=COMPANY_EVENTS)
    counts["company_events"] = draft.append(boxes, "company_events")

    totals = company_totals(draft.read("company_events"))
    updated, unmatched = update_by_field(draft.read("companies"), totals_as_updates(totals), "name")
    missing = unmatched.count()
    if missing:
        log.warning("%d companies have events but no document, their totals are skipped", missing)
    draft.replace(updated, "companies")
    counts["renewals"] = draft.replace(build_renewals(totals, renewal_inputs), "renewals")

    events = union_events(
        registration_events(users), number_tickets(tickets), fan_out_calls(clamp_future(calls, now)),
        schema=USER_EVENTS,
    )
    counts["user_events"] = draft.append(events, "user_events")

    companies = draft.read("companies").select(F.col("name").alias("company")).where("company IS NOT NULL").distinct()
    model = EventModel(draft.read("user_events"), draft.read("company_events"), companies)
    counts["trending"] = draft.replace(trending_snapshot(model, now.date()), "trending")
    draft.commit()
    return counts
