"""Every operator as a query over the given tables."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlens.functions import formatting as fmt
from accountlens.model import EventModel
from accountlens.operators.shaping import clamp_future, union_events
from accountlens.operators.spine import calendar_spine
from accountlens.operators.updates import update_by_field, upsert_by_id
from accountlens.operators.windows import headline_last_nonnull
from accountlens.plans import cards, etl, home
from accountlens.plans.scorecard import company_scorecard, headline_values
from accountlens.schemas import CONTRACT_VALUE_PER_BOX, USER_EVENTS
from accountlens.session import new_shared_path, pin_utc
from accountlens.sources import staging, store, tables
from accountlens.sources.reload import reload_all
from accountlens.streaming import ingest

AS_OF_DATE = date(2024, 1, 30)
AS_OF_TS = "2024-01-30 12:00:00"
COMPANY_AS_OF_DATE = date(2001, 8, 1)
SHORT = {"as_of_date": date(2024, 1, 20), "days": 10}
ONE_COMPANY = "NATION_3"
BODIES_PER_FILE = 200_000

Query = Callable[[SparkSession, str], DataFrame]


def _cards(name: str, as_of_date: date = AS_OF_DATE, **span) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = staging.event_model(spark, sf_dir)
        return cards.card(name, model, as_of_date=as_of_date, as_of_ts=AS_OF_TS, **span)

    return query


def _series_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.by_day(_cards("calls_count_7d_window_30d")(spark, sf_dir)).drop("label")


def _breakdown_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.by_dimension(_cards("calls_breakdown_7d")(spark, sf_dir))


def _project_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project dates as text; of the projects without a date, every other one has the older `due` instead."""
    number = F.col("id").cast("long")
    due = F.when(F.col("date").isNull() & (number % 2 == 0), F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((number % 300).cast("int")))
    return home.project_dates(staging.projects(spark, sf_dir).withColumn("due", due)).select("id", "company", "formatted_date")


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.customer_overview(staging.event_model(spark, sf_dir))


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return company_scorecard(staging.event_model(spark, sf_dir), AS_OF_DATE, COMPANY_AS_OF_DATE)


def _headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headline_values(staging.event_model(spark, sf_dir), AS_OF_DATE, COMPANY_AS_OF_DATE)


def _headline_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cards.ratings_average(staging.event_model(spark, sf_dir), as_of_date=AS_OF_DATE)
    return headline_last_nonnull(series, "avg_rating", "avg_rating", "num_rating")


# The calls-per-week card of one company as SQL text with a bound name.
ONE_COMPANY_SQL = """
WITH daily AS (
  SELECT to_date(timestamp) AS day, count(*) AS n
  FROM {user_events}
  WHERE company = :customer_name AND type = 'call'
    AND timestamp >= date_sub(CAST(:as_of AS DATE), 35)
    AND timestamp < date_add(CAST(:as_of AS DATE), 1)
  GROUP BY ALL
), spine AS (
  SELECT explode(sequence(date_sub(CAST(:as_of AS DATE), 29), CAST(:as_of AS DATE))) AS day
), windowed AS (
  SELECT day, on_spine,
    sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS calls
  FROM (SELECT day, 0 AS n, true AS on_spine FROM spine UNION ALL SELECT day, n, false FROM daily)
)
SELECT :customer_name AS company, day, calls, date_format(day, 'MMM dd') AS label
FROM windowed WHERE on_spine
"""


def _single_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = {"customer_name": ONE_COMPANY, "as_of": AS_OF_DATE.isoformat()}
    events = staging.user_events(spark, sf_dir)
    return tables.run_query(spark, ONE_COMPANY_SQL, args, user_events=events)


def _spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_spine(staging.companies(spark, sf_dir), AS_OF_DATE)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.enrich_users(staging.user_directory(spark, sf_dir), AS_OF_TS)


def _provisioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.company_events(spark, sf_dir).where(F.col("type") == "provisioned")


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.user_events(spark, sf_dir).where(F.col("type") == "support_ticket")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.company_totals(staging.company_events(spark, sf_dir))


def _renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.build_renewals(_totals(spark, sf_dir), staging.renewal_inputs(spark, sf_dir))


def _trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.trending_snapshot(staging.event_model(spark, sf_dir), AS_OF_DATE)


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of event, each with its own few columns, as one wide frame."""
    events = staging.user_events(spark, sf_dir)
    base = ["timestamp", "type", "user", "company"]
    return union_events(
        events.where(F.col("type") == "register").select(*base),
        events.where(F.col("type") == "support_ticket").select(*base, "ticket_number", "ticket_driver"),
        events.where(F.col("type") == "rating").select(*base, "rating", "session_id"),
        events.where(F.col("type") == "call").select(
            *base, "call_duration", "call_type", "call_num_users", "call_os", "session_id"
        ),
        events.where(F.col("type") == "dialin").select(*base, "call_duration", "session_id"),
        events.where(F.col("type") == "comment").select(*base, "comment", "session_id"),
        schema=USER_EVENTS,
    )


def _update_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies = etl.build_companies(_users(spark, sf_dir)).withColumn("id", F.col("name"))
    updates = etl.totals_as_updates(_totals(spark, sf_dir))
    return update_by_field(companies, updates, "name")[0]


def _seen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen registering."""
    return (
        staging.user_events(spark, sf_dir)
        .where(F.col("type") == "register")
        .groupBy(F.col("user").alias("id"))
        .agg(F.max("company").alias("company"), F.min("timestamp").alias("reg_date"))
    )


def _unmatched_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory entries of users never seen registering."""
    seen = _seen_users(spark, sf_dir).withColumn("email", F.col("id"))
    given = staging.user_directory(spark, sf_dir).select("email", "company")
    return update_by_field(seen, given, "email")[1]


def _upsert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen registering, merged with the directory; a zero offset clears the company."""
    seen = _seen_users(spark, sf_dir)
    given = staging.user_directory(spark, sf_dir).select(
        F.col("email").alias("id"), "email", F.when(F.col("offset") != 0, F.col("company")).alias("company")
    )
    return upsert_by_id(seen, given)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_status(
        {
            "company_events": staging.company_events(spark, sf_dir),
            "companies": staging.companies(spark, sf_dir).withColumnRenamed("company", "name"),
            "projects": staging.projects(spark, sf_dir),
            "renewals": staging.renewal_inputs(spark, sf_dir),
            "user_events": staging.user_events(spark, sf_dir),
            "users": staging.user_directory(spark, sf_dir),
        }
    )


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.event_bodies(staging.stg_events(spark, sf_dir))


def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate_events(_bodies(spark, sf_dir)).select("event_id", "body", "error")


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.route_events(_bodies(spark, sf_dir)).select("event_id", "error", "target")


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.typed_events(ingest.route_events(_bodies(spark, sf_dir)), "user_events")


def _body_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(staging.table(spark, sf_dir, "events").schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return staging.event_bodies(staging.stg_events(spark, sf_dir, events))


def _ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the ingest stream over the events file to its end and read both stored tables."""
    root = new_shared_path(spark, "ingest")
    store.create_event_tables(spark, root)
    ingest.start_ingest(_body_stream(spark, sf_dir), root, f"{root}-checkpoint").awaitTermination()
    users = tables.user_events(spark, f"{root}/user_events")
    boxes = tables.company_events(spark, f"{root}/company_events")
    return users.unionByName(boxes, allowMissingColumns=True).select(
        "type", "user", "company", "call_duration", "purchased", "provisioned"
    )


def _ingest_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a body, streamed from files in several micro-batches with compaction between them."""
    root = new_shared_path(spark, "ingest")
    store.create_event_tables(spark, root)
    # As many files as tasks, and more: a few files would be written by a few tasks, and bodies be shuffled to these.
    staging.whole_bodies(spark, sf_dir).write.option("maxRecordsPerFile", BODIES_PER_FILE).text(f"{root}-bodies")
    files = len(spark.read.text(f"{root}-bodies").inputFiles())
    stream = tables.event_body_stream(spark, f"{root}-bodies", files_per_batch=-(-files // 4))
    ingest.start_ingest(stream, root, f"{root}-checkpoint", compact_every=3).awaitTermination()
    users = tables.user_events(spark, f"{root}/user_events")
    boxes = tables.company_events(spark, f"{root}/company_events")
    return users.unionByName(boxes, allowMissingColumns=True)


def _rejected(spark: SparkSession, sf_dir: str) -> str:
    """A store that took in the given bodies; its root."""
    root = new_shared_path(spark, "rejects")
    store.create_event_tables(spark, root)
    ingest.start_ingest(_body_stream(spark, sf_dir), root, f"{root}-checkpoint").awaitTermination()
    return root


def _ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ingest stream turned away, with the reasons."""
    return tables.rejected_events(spark, f"{_rejected(spark, sf_dir)}/rejects")


def _replayed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects mended by giving those without a type one: what the company events then hold, and what is still rejected."""
    root = _rejected(spark, sf_dir)
    rejects = tables.rejected_events(spark, f"{root}/rejects").where(F.col("error") == ingest.NO_TYPE)
    typed = F.concat(F.lit('{"type":"purchased",'), F.substring("body", 2, 10_000))
    repairs = rejects.select("body").distinct().withColumn("repaired", typed)
    store.replay_rejects(repairs, root, ingest.frames)
    boxes = tables.company_events(spark, f"{root}/company_events").select("type", "company", "purchased", F.lit(None).cast("string").alias("error"))
    left = tables.rejected_events(spark, f"{root}/rejects")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("type", "string"), ("company", "string"), ("purchased", "long"))]
    return boxes.unionByName(left.select(*none, "error"))


def _reload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per table after a full reload of a store from the given tables."""
    root = new_shared_path(spark, "reload")
    tickets = staging.user_events(spark, sf_dir).where(F.col("type") == "support_ticket")
    reload_all(
        root, staging.user_directory(spark, sf_dir), staging.call_records(spark, sf_dir), tickets,
        staging.purchase_records(spark, sf_dir), staging.projects(spark, sf_dir), staging.renewal_inputs(spark, sf_dir), AS_OF_TS,
    )
    return tables.store_status(spark, root).select("table_name", F.col("total_documents").alias("rows"))


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events appended in batches, folded into one part, and one batch appended once more."""
    root = new_shared_path(spark, "compacted")
    store.create_event_tables(spark, root)
    events = staging.user_events(spark, sf_dir)
    parts = [events.where(F.pmod(F.xxhash64(*events.columns), F.lit(4)) == i) for i in range(4)]
    for i, part in enumerate(parts):
        store.append_events(part, root, "user_events", batch=f"part-{i}")
    store.compact(spark, root, "user_events")
    store.append_events(parts[1], root, "user_events", batch="part-1")
    return tables.user_events(spark, f"{root}/user_events")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen registering, stored, then merged with the directory bucket by bucket."""
    root = new_shared_path(spark, "merged")
    store.replace_collection(_seen_users(spark, sf_dir), root, "users")
    given = staging.user_directory(spark, sf_dir).select(
        F.col("email").alias("id"), "email", F.when(F.col("offset") != 0, F.col("company")).alias("company")
    )
    store.merge_collection(given, root, "users")
    return tables.collection(spark, root, "users")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events after a round trip through the stored table."""
    root = new_shared_path(spark, "events")
    store.create_event_tables(spark, root)
    store.append_events(staging.user_events(spark, sf_dir), root, "user_events")
    return tables.user_events(spark, f"{root}/user_events")


def _stored(plan: Callable[[EventModel], DataFrame], *names: str) -> Query:
    """A plan over the named event tables, stored whole, by day, and read back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = new_shared_path(spark, "stored")
        model = staging.event_model(spark, sf_dir)
        store.create_event_tables(spark, root)
        for name in names:
            store.append_events(getattr(model, name), root, name)
        store.replace_collection(model.companies.withColumnRenamed("company", "name"), root, "companies")
        return plan(tables.event_model(spark, root))

    return query


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after a round trip through their collection; generated ids are left out."""
    root = new_shared_path(spark, "users")
    store.replace_collection(_users(spark, sf_dir), root, "users")
    return tables.collection(spark, root, "users").drop("id")


def _truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the user events table as appended, and after it is truncated."""
    root = new_shared_path(spark, "truncated")
    store.create_event_tables(spark, root)
    appended = store.append_events(staging.user_events(spark, sf_dir), root, "user_events")
    store.truncate_table(spark, root, "user_events")
    left = tables.user_events(spark, f"{root}/user_events").agg(F.count("*").alias("remaining"))
    return left.select(F.lit(appended).cast("long").alias("appended"), "remaining")


def _cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the users collection as cleared, and after."""
    root = new_shared_path(spark, "cleared")
    store.replace_collection(_users(spark, sf_dir), root, "users")
    deleted = store.clear_collection(spark, root, "users")
    left = tables.collection(spark, root, "users").agg(F.count("*").alias("remaining"))
    return left.select(F.lit(deleted).cast("long").alias("deleted"), "remaining")


def _display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every display format over every user event."""
    ts, name = F.col("timestamp"), fmt.user_name(F.col("user"))
    duration = F.col("call_duration")
    ratio = (F.col("rating") * 1000 + F.col("rating")) / 16
    return staging.user_events(spark, sf_dir).select(
        "timestamp",
        "user",
        fmt.datetime_text(ts).alias("datetime_text"),
        fmt.iso_text(ts).alias("iso_text"),
        fmt.day_label(ts).alias("day_label"),
        fmt.short_date(ts).alias("short_date"),
        name.alias("user_name"),
        fmt.initial(name).alias("user_initial"),
        fmt.thousands(duration * CONTRACT_VALUE_PER_BOX).alias("thousands"),
        fmt.money(duration * CONTRACT_VALUE_PER_BOX).alias("money"),
        fmt.money_cents(duration * CONTRACT_VALUE_PER_BOX).alias("money_cents"),
        fmt.percent(ratio).alias("percent"),
        fmt.python_round(ratio, 2).alias("rounded"),
    )


def _rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies collection, stored and then updated in place with its totals."""
    root = new_shared_path(spark, "companies")
    companies = etl.build_companies(_users(spark, sf_dir)).withColumn("id", F.col("name"))
    store.replace_collection(companies, root, "companies")
    stored = tables.collection(spark, root, "companies")
    updates = etl.totals_as_updates(_totals(spark, sf_dir))
    store.rewrite_collection(update_by_field(stored, updates, "name")[0], root, "companies")
    return tables.collection(spark, root, "companies")


def _totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the totals stream over the events file to its end and read the totals."""
    bodies = _body_stream(spark, sf_dir)
    folder = new_shared_path(spark, "company-sums")
    ingest.start_company_totals(bodies, folder).awaitTermination()
    return ingest.current_totals(spark, folder, etl.build_companies(_users(spark, sf_dir)))


def _on(frame: Query, plan: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(frame(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "stg_user_events": staging.user_events,
    "stg_company_events": staging.company_events,
    "calendar_spine": _spine,
    "calls_count_7d_window_30d": _cards("calls_count_7d_window_30d"),
    "dialin_count_7d_window_30d": _cards("dialin_count_7d_window_30d"),
    "support_tickets_7d_window_30d": _cards("support_tickets_7d_window_30d"),
    "users_registered_cumulative_30d": _cards("users_registered_cumulative_30d"),
    "boxes_purchased_cumulative_30d": _cards("boxes_purchased_cumulative_30d", COMPANY_AS_OF_DATE),
    "boxes_provisioned_cumulative_30d": _cards("boxes_provisioned_cumulative_30d", COMPANY_AS_OF_DATE),
    "boxes_provisioned_pct_cumulative_30d": _cards(
        "boxes_provisioned_pct_cumulative_30d", COMPANY_AS_OF_DATE
    ),
    "ratings_average_7d_window_30d": _cards("ratings_average_7d_window_30d"),
    "users_active_7d_window_30d": _cards("users_active_7d_window_30d"),
    "headline_ratings": _headline_ratings,
    "headline_values": _headlines,
    "calls_count_short_spine": _cards("calls_count_7d_window_30d", **SHORT),
    "users_active_short_spine": _cards("users_active_7d_window_30d", **SHORT),
    "ratings_average_short_spine": _cards("ratings_average_7d_window_30d", **SHORT),
    "users_registered_short_spine": _cards("users_registered_cumulative_30d", **SHORT),
    "users_active_long_spine": _cards("users_active_7d_window_30d", days=90),
    "calls_breakdown_7d": _cards("calls_breakdown_7d"),
    "calls_count_in_order": _series_in_order,
    "calls_breakdown_in_order": _breakdown_in_order,
    "comments_recent_7d": _cards("comments_recent_7d"),
    "customer_overview": _overview,
    "single_company_card": _single_company,
    "company_scorecard": _scorecard,
    "fan_out_calls": _on(staging.call_records, etl.fan_out_calls),
    "provision_devices": _on(staging.purchase_records, etl.provision_devices),
    "name_boxes": _on(_provisioned, etl.name_boxes),
    "enrich_users": _users,
    "build_companies": _on(_users, etl.build_companies),
    "registration_events": _on(_users, etl.registration_events),
    "number_tickets": _on(_tickets, etl.number_tickets),
    "company_totals": _totals,
    "build_renewals": _renewals,
    "trending_snapshot": _trends,
    "clamp_future": _on(staging.user_events, lambda events: clamp_future(events, AS_OF_TS)),
    "normalise_events": _normalised,
    "home_projects": _on(staging.projects, home.home_projects),
    "project_dates": _project_dates,
    "home_renewals": _on(_renewals, home.home_renewals),
    "home_trends": _on(_trends, home.home_trends),
    "update_by_field": _update_by_field,
    "update_by_field_unmatched": _unmatched_updates,
    "upsert_by_id": _upsert_by_id,
    "append_events": _appended,
    "stored_scorecard": _stored(
        lambda model: company_scorecard(model, AS_OF_DATE, COMPANY_AS_OF_DATE), "user_events", "company_events"
    ),
    "stored_boxes_provisioned_pct": _stored(
        lambda model: cards.boxes_provisioned_pct(model, as_of_date=COMPANY_AS_OF_DATE), "company_events"
    ),
    "stored_users_active": _stored(lambda model: cards.users_active(model, as_of_date=AS_OF_DATE), "user_events"),
    "stored_comments": _stored(lambda model: cards.comments_recent(model, AS_OF_TS), "user_events"),
    "replace_collection": _replaced,
    "rewrite_collection": _rewritten,
    "truncate_table": _truncated,
    "clear_collection": _cleared,
    "display_texts": _display_texts,
    "user_directory": _on(staging.user_directory, tables.user_directory),
    "user_directory_first_100": _on(
        staging.user_directory, lambda directory: tables.user_directory(directory, 100)
    ),
    "table_status": _status,
    "validate_events": _validate,
    "route_events": _route,
    "ingested_user_events": _ingested,
    "ingest_stream": _ingest_stream,
    "company_totals_stream": _totals_stream,
    "ingest_whole_bodies": _ingest_whole,
    "ingest_rejects": _ingest_rejects,
    "replayed_rejects": _replayed_rejects,
    "reload_counts": _reload_counts,
    "compacted_events": _compacted,
    "merge_collection": _merged,
}


def _without_zone(df: DataFrame) -> DataFrame:
    """UTC instants as plain timestamps, which compare equal in any client."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def _runnable(query: Query) -> Query:
    return lambda spark, sf_dir: _without_zone(query(pin_utc(spark), sf_dir))


def queries() -> dict[str, Query]:
    return {name: _runnable(query) for name, query in QUERIES.items()}
