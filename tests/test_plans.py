"""What the plans must and must not contain."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from accountlens.plans import cards
from accountlens.plans.scorecard import company_scorecard
from accountlens.registry import queries
from accountlens.sources import staging, store, tables

AS_OF = date(2024, 1, 30)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def whole_filters(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"company_totals_stream", "ingest_stream"}))
def test_no_pairing_and_no_python(name, spark, sf_dir):
    plan = plan_of(spark_entry.queries()[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"):
        assert node not in plan


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    return staging.event_model(spark, sf_dir)


@pytest.fixture(scope="module")
def root(spark, staged, tmp_path_factory):
    """The staged tables stored in many periods, each table in two batches."""
    root = str(tmp_path_factory.mktemp("plans") / "store")
    store.create_event_tables(spark, root)
    store.create_collections(spark, root)
    before, store.PERIOD_ROWS = store.PERIOD_ROWS, 50
    try:
        for part in (0, 1):
            for table in ("user_events", "company_events"):
                events = getattr(staged, table)
                store.append_events(events.where(F.pmod(F.xxhash64(*events.columns), F.lit(2)) == part), root, table)
    finally:
        store.PERIOD_ROWS = before
    names = staged.companies.withColumnRenamed("company", "name")
    store.replace_collection(names, root, "companies")
    return root


@pytest.fixture(scope="module")
def stored(spark, root):
    return tables.event_model(spark, root)


def scans(df) -> list[str]:
    return [line for line in plan_of(df).splitlines() if "FileScan" in line and "_events" in line]


def columns_read(scan: str) -> set[str]:
    return set(re.findall(r"(\w+):", scan.split("ReadSchema: struct<")[1]))


def partition_filters(scan: str) -> str:
    return scan.split("PartitionFilters: [")[1].split("]")[0]


def test_trailing_cards_prune_periods_and_columns(stored):
    (scan,) = scans(cards.calls_count(stored, as_of_date=AS_OF))
    assert "/user_events_daily/" in scan and "last_day" in partition_filters(scan) and "first_day" in partition_filters(scan)
    assert ">= 2023-12-26" in scan and "<= 2024-01-30" in scan
    assert columns_read(scan) == {"type", "company", "event_date", "n"}
    assert "EqualTo(type,call)" in scan
    (scan,) = scans(cards.users_active(stored, as_of_date=AS_OF))
    assert "/user_events/" in scan and columns_read(scan) == {"type", "company", "user", "event_date"}
    assert "In(type, [call,dialin])" in scan and "last_day" in partition_filters(scan)


def test_rolling_cards_prune_periods(stored):
    for card in (cards.calls_breakdown, cards.comments_recent):
        (scan,) = scans(card(stored, "2024-01-30 12:00:00"))
        assert "last_day" in partition_filters(scan)
        assert "GreaterThanOrEqual(timestamp" in scan


ADDITIVE = sorted(set(cards.SERIES_CARDS) - {"users_active_7d_window_30d"})


@pytest.mark.parametrize("name", ADDITIVE)
def test_additive_cards_read_daily_sums_only(stored, name):
    found = scans(cards.card(name, stored, as_of_date=AS_OF))
    assert found and all("_events_daily/" in scan for scan in found)
    assert all("_events_daily/" in scan for scan in scans(cards.customer_overview(stored)))


def test_daily_sums_are_those_of_the_events(spark, root):
    for table, columns in (("user_events", ["rating", "call_duration"]), ("company_events", ["purchased", "provisioned"])):
        sums = tables.daily_events(spark, root, table)
        events = getattr(tables, table)(spark, f"{root}/{table}")
        keys = ["company", "type", "event_date"]
        got = sums.groupBy(*keys).agg(F.sum("n"), *[F.sum(f"{how}_{c}") for c in columns for how in ("n", "sum")])
        want = events.groupBy(*keys).agg(F.count("*"), *[how(c) for c in columns for how in (F.count, F.sum)])
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("name", [*cards.SERIES_CARDS, *cards.ROLLING_CARDS])
@pytest.mark.parametrize("user_day,company_day", [("2024-01-30", "2001-08-01"), ("2024-01-12", "2001-07-10")])
def test_stored_tables_give_what_the_source_frames_give(staged, stored, name, user_day, company_day):
    when = {
        "as_of_date": company_day if name.startswith("boxes") else user_day,
        "as_of_ts": f"{user_day} 12:00:00",
    }
    got, want = (cards.card(name, model, **when) for model in (stored, staged))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stored_scorecard_equals_source_frames(staged, stored):
    got, want = (company_scorecard(model, AS_OF, date(2001, 8, 1)) for model in (stored, staged))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scorecard_reads_events_for_distinct_users_only(stored):
    found = scans(company_scorecard(stored, AS_OF, date(2001, 8, 1)))
    (users,) = [s for s in found if "_daily/" not in s]
    assert "/user_events/" in users and "last_day" in partition_filters(users)
    (daily,) = [s for s in found if "/user_events_daily/" in s]
    assert columns_read(daily) == {"type", "company", "event_date", "n", "n_rating", "sum_rating"}
    assert sum("/company_events_daily/" in s for s in found) == 1


def test_top_comments_are_limited_before_the_shuffle(stored):
    plan = plan_of(cards.comments_recent(stored, "2024-01-30 12:00:00"))
    below = plan[plan.index("Exchange hashpartitioning(company"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_aggregates_combine_before_the_shuffle(stored):
    for series in (cards.calls_count, cards.users_registered, cards.users_active):
        plan = plan_of(series(stored, as_of_date=AS_OF))
        for exchange in re.findall(r"Exchange hashpartitioning\(company[^\n]*\n[^\n]*", plan):
            assert "partial_" in exchange or "functions=[]" in exchange or "Union" in exchange


def test_company_events_of_one_type_read_lines_and_orders_once(spark, sf_dir):
    for name, scans_of_lines in (("boxes_purchased_cumulative_30d", 1), ("boxes_provisioned_cumulative_30d", 1), ("name_boxes", 0), ("stg_company_events", 2)):
        plan = plan_of(spark_entry.queries()[name](spark, sf_dir))
        assert "collect_list" not in plan
        assert len(re.findall(r"FileScan[^\n]*/lineitem\.parquet", plan)) == scans_of_lines


def test_home_lists_are_top_k(spark, sf_dir):
    for name in ("home_projects", "home_renewals", "home_trends", "user_directory_first_100"):
        assert "TakeOrderedAndProject" in plan_of(spark_entry.queries()[name](spark, sf_dir))
