"""ETL operators, running numbers and keyed updates on literal frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accountlens.operators.numbering import running_number
from accountlens.operators.shaping import clamp_future
from accountlens.operators.updates import update_by_field, upsert_by_id
from accountlens.plans import etl, home

T0 = datetime(2024, 1, 30, 12)


def test_fan_out(spark):
    schema = (
        "timestamp timestamp, user string, company string, call_duration long, call_type string, "
        "call_num_users long, call_os string, session_id string, rating long, comment string, dialin_length long"
    )
    full = (T0, "u", "a", 9, "Web", 2, "ios", "s1", 5, "Good", 7)
    bare = (T0, "v", "a", 0, "Web", 2, "ios", "s2", 0, "", 0)
    nothing = (T0, "w", "a", 0, "Web", 2, "ios", "s3", None, None, None)
    out = etl.fan_out_calls(spark.createDataFrame([full, bare, nothing], schema)).collect()
    kinds = {u: sorted(r["type"] for r in out if r["user"] == u) for u in "uvw"}
    assert kinds == {"u": ["call", "comment", "dialin", "load", "rating"], "v": ["call", "load"], "w": ["call", "load"]}
    of = {r["type"]: r for r in out if r["user"] == "u"}
    assert of["load"]["timestamp"] == T0 - timedelta(minutes=1)
    assert all(of["load"][c] is None for c in of["load"].asDict() if c not in ("timestamp", "type", "user", "company"))
    assert (of["dialin"]["call_duration"], of["dialin"]["dialin_duration"], of["dialin"]["session_id"]) == (7, None, None)
    assert (of["rating"]["rating"], of["rating"]["session_id"], of["rating"]["call_os"]) == (5, "s1", None)


def test_provisioning_skips_zero_and_numbers_units(spark):
    purchases = spark.createDataFrame(
        [("a", T0, 1, 0, 2), ("a", T0, 2, 1, 2), ("a", T0, 3, 3, 5)],
        "company string, timestamp timestamp, purchase_id long, qty int, lag_days int",
    )
    rows = etl.provision_devices(purchases).collect()
    assert sorted((r["serial_number"], r["timestamp"].day, r["provisioned"]) for r in rows) == [
        ("A2-1", 1, 1), ("A3-1", 4, 1), ("A3-2", 4, 1), ("A3-3", 4, 1),
    ]


def boxes(spark, n):
    rows = [("a" if i % 3 else None, T0 + timedelta(seconds=i // 5), f"s{i:04d}", i) for i in range(n)]
    return spark.createDataFrame(rows, "company string, timestamp timestamp, serial_number string, x long")


def test_running_number_matches_a_sorted_list(spark):
    rows = running_number(boxes(spark, 1000).repartition(7), ["company"], ["timestamp", "serial_number"], "n").collect()
    assert len(rows) == 1000
    for company in ("a", None):
        own = sorted((r["serial_number"], r["n"]) for r in rows if r["company"] == company)
        assert [n for _, n in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("order", [["timestamp"], ["timestamp", "other"]])
def test_numbering_spreads_one_group_of_one_time_over_tasks(spark, order):
    hot = spark.range(200_000).select(
        F.lit("a").alias("company"), F.lit(T0.isoformat()).cast("timestamp").alias("timestamp"),
        (F.col("id") % 3).alias("other"), "id",
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = running_number(hot, ["company"], order, "n")
        sizes = numbered.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 2 and max(r["count"] for r in sizes) < 150_000
        spread = numbered.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
        assert tuple(spread) == (1, 200_000, 200_000)
        if "other" in order:
            ends = numbered.groupBy("other").agg(F.min("n").alias("first"), F.max("n").alias("last")).orderBy("other").collect()
            assert [r["first"] for r in ends[1:]] == [r["last"] + 1 for r in ends[:-1]]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_number_without_keys_and_of_nothing(spark):
    frame = boxes(spark, 200)
    rows = running_number(frame, [], ["company", "x"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 201))
    assert [r["x"] for r in rows] == sorted(range(200), key=lambda x: (x % 3 > 0, x))
    assert running_number(frame.where("false"), ["company"], ["x"], "n").collect() == []


def test_running_number_is_stored_sorted_by_ranges_and_joins_its_counts_only(spark):
    plan = running_number(boxes(spark, 100), ["company"], ["timestamp", "serial_number"], "n")._jdf.queryExecution().optimizedPlan().toString()
    # The rows are read as stored, next to one aggregate of their places; no window runs over them.
    assert plan.count("Relation") == 2 and plan.count("Window") == 1 and plan.index("Window") < plan.index("Aggregate")


def test_box_names_keep_three_digits(spark):
    frame = boxes(spark, 330).where("company = 'a'")
    names = {r["box_name"] for r in etl.name_boxes(frame).collect()}
    assert {"a.room.01", "a.room.09", "a.room.10", "a.room.99", "a.room.100", "a.room.219"} <= names
    assert len(names) == frame.count()


def test_tickets_are_numbered_from_zero(spark):
    rows = [("u", T0 + timedelta(hours=h)) for h in (3, 1, 2)] + [("v", T0)]
    out = etl.number_tickets(spark.createDataFrame(rows, "user string, timestamp timestamp")).collect()
    assert sorted((r["user"], r["timestamp"].hour, r["ticket_number"]) for r in out) == [
        ("u", 13, "u-0"), ("u", 14, "u-1"), ("u", 15, "u-2"), ("v", 12, "v-0"),
    ]


def test_clamping_keeps_null(spark):
    rows = [(T0 + timedelta(days=1),), (T0 - timedelta(days=1),), (None,)]
    out = [r[0] for r in clamp_future(spark.createDataFrame(rows, "timestamp timestamp"), T0).collect()]
    assert out == [T0, T0 - timedelta(days=1), None]


def test_company_totals_keep_one_sided_companies(spark):
    rows = [("purchased", "a", 3, None), ("purchased", "a", None, None), ("provisioned", "b", None, 1), ("other", "c", 9, 9)]
    frame = spark.createDataFrame(rows, "type string, company string, purchased long, provisioned long")
    totals = etl.company_totals(frame)
    assert {tuple(r) for r in totals.collect()} == {("a", 3, 0), ("b", 0, 1)}
    due = spark.createDataFrame([("a", T0, 50)], "company string, due timestamp, health int")
    renewals = {r["company"]: (r["amount"], r["health"]) for r in etl.build_renewals(totals, due).collect()}
    assert renewals == {"a": (7497, 50), "b": (0, None)}


def documents(spark):
    rows = [("1", "a", 1, 10), ("2", "dup", 2, 20), ("3", "dup", 3, 30), ("4", None, 4, 40)]
    return spark.createDataFrame(rows, "id string, name string, bought long, prov long")


def test_update_by_field_touches_the_first_match_only(spark):
    updates = spark.createDataFrame(
        [("dup", 99, None), ("nobody", 5, None), ("a", None, "x")], "name string, bought long, note string"
    )
    updated, unmatched = update_by_field(documents(spark), updates, "name")
    assert {tuple(r) for r in updated.select("id", "name", "bought", "prov", "note").collect()} == {
        ("1", "a", None, 10, "x"), ("2", "dup", 99, 20, None), ("3", "dup", 3, 30, None), ("4", None, 4, 40, None),
    }
    assert [r["name"] for r in unmatched.collect()] == ["nobody"]


def test_upsert_merges_and_inserts(spark):
    updates = spark.createDataFrame([("2", None, 7), ("9", "new", 1)], "id string, name string, bought long")
    out = upsert_by_id(documents(spark), updates)
    assert {tuple(r) for r in out.select("id", "name", "bought", "prov").collect()} == {
        ("1", "a", 1, 10), ("2", None, 7, 20), ("3", "dup", 3, 30), ("4", None, 4, 40), ("9", "new", 1, None),
    }


def test_home_lists(spark):
    rows = [("3", "p", None, T0), ("2", "p", T0, None), ("1", "p", T0, None), ("4", "p", T0 - timedelta(days=900), None), ("5", "p", T0 + timedelta(days=1), None)]
    projects = spark.createDataFrame(rows, "id string, name string, date timestamp, due timestamp")
    assert [(r["id"], r["formatted_date"]) for r in home.home_projects(projects).collect()] == [
        ("4", "08/13"), ("1", "01/30"), ("2", "01/30"),
    ]
    renewals = spark.createDataFrame([("1", T0, 0), ("2", None, 5), ("3", T0, 5000)], "id string, due timestamp, amount long")
    assert [(r["id"], r["formatted_amount"]) for r in home.home_renewals(renewals).collect()] == [("1", "TBD"), ("3", "$5,000")]
    trends = spark.createDataFrame([("1", T0, 0.0), ("2", T0 + timedelta(days=9), 12.25)], "id string, date timestamp, value double")
    assert [(r["id"], r["change"]) for r in home.home_trends(trends).collect()] == [("2", "12.2%"), ("1", "0%")]


def test_numbers_are_joined_without_a_sort(spark):
    """Next to nothing may be read of the rows, which then are very many to a task."""
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1), (None, 1)], "k string, v int")
    numbered = running_number(rows, ["k"], ["v"], "n")
    assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert {tuple(row) for row in numbered.collect()} == {("a", 1, 1), ("a", 2, 2), ("b", 1, 1), (None, 1, 1)}
