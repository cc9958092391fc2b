"""Rolling 7-day cards: instant bounds, ranks, breakdown order."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from accountlens.model import EventModel
from accountlens.operators.shaping import normalise_events
from accountlens.plans import cards
from accountlens.schemas import COMPANY_EVENTS, USER_EVENTS

NOW = datetime(2024, 1, 30, 12)


def model(spark, rows, schema):
    frame = normalise_events(spark.createDataFrame(rows, schema), USER_EVENTS)
    companies = spark.createDataFrame([("a",)], "company string")
    return EventModel(frame, spark.createDataFrame([], COMPANY_EVENTS), companies)


def test_breakdown_counts_from_the_exact_instant_and_into_the_future(spark):
    schema = "timestamp timestamp, type string, company string, call_type string, call_num_users long, call_os string"
    week = timedelta(days=7)
    rows = [
        (NOW - week, "call", "a", "Web", 10, "Linux"),
        (NOW - week - timedelta(microseconds=1), "call", "a", "Web", 10, "Linux"),
        (NOW + timedelta(days=3), "call", "a", "Web", 2, None),
        (NOW, "call", "a", None, 3, "ios"),
        (NOW, "call", "a", "Presentation", None, "ios"),
        (NOW, "dialin", "a", "Web", 2, "Linux"),
    ]
    breakdown = cards.by_dimension(cards.calls_breakdown(model(spark, rows, schema), NOW))
    assert [(r["dimension"], r["key"], r["calls"]) for r in breakdown.orderBy("dimension", "position").collect()] == [
        ("os", "ios", 2), ("os", "Linux", 1),
        ("type", "Web", 2), ("type", "Presentation", 1),
        ("users", "2", 1), ("users", "3", 1), ("users", "10", 1),
    ]


def test_newest_fifty_comments_with_display_columns(spark):
    schema = "timestamp timestamp, type string, company string, user string, comment string"
    rows = [(NOW - timedelta(minutes=i), "comment", "a", f"u{i}@x.com", f"c{i}") for i in range(60)]
    rows += [
        (NOW + timedelta(hours=2), "comment", "a", "plain", "future"),
        (NOW + timedelta(hours=2), "comment", "a", "Abe@x.com", "tie"),
        (NOW, "comment", "a", "u@x.com", None),
        (NOW - timedelta(days=8), "comment", "a", "u@x.com", "old"),
    ]
    got = cards.comments_recent(model(spark, rows, schema), NOW).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 51))
    assert [r["comment"] for r in got[:3]] == ["tie", "future", "c0"]
    assert [(r["user_name"], r["user_initial"], r["age"], r["recent"]) for r in got[:4]] == [
        ("Abe", "A", "Just now", True), ("plain", "P", "Just now", True),
        ("u0", "U", "Just now", True), ("u1", "U", "Just now", False),
    ]
    assert got[2]["posted_at"] == "2024-01-30T12:00:00+00:00"


def test_comment_ages(spark):
    schema = "timestamp timestamp, type string, company string, user string, comment string"
    ages = {
        timedelta(minutes=59): "Just now",
        timedelta(hours=1): "1h ago",
        timedelta(hours=23, minutes=59): "23h ago",
        timedelta(hours=24): "1d ago",
        timedelta(days=6, hours=23): "6d ago",
    }
    rows = [(NOW - age, "comment", "a", "", text) for age, text in ages.items()]
    rows.append((NOW - timedelta(microseconds=5), "comment", "a", "@x", "Just now"))
    got = cards.comments_recent(model(spark, rows, schema), NOW)
    assert all(r["age"] == r["comment"] and r["user_initial"] == "?" for r in got.collect())
    assert got.where(F.col("posted_at") == "2024-01-30T11:59:59.999995+00:00").count() == 1
