"""Edge cases of the daily series on small literal frames."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accountlens.model import EventModel
from accountlens.operators.shaping import normalise_events
from accountlens.operators.windows import (
    _distinct_by_change,
    _distinct_by_mask,
    cumulative_to_day,
    headline,
    headline_last_nonnull,
    trailing_avg,
    trailing_distinct,
    trailing_window,
)
from accountlens.plans import cards
from accountlens.schemas import COMPANY_EVENTS, USER_EVENTS

AS_OF = date(2024, 1, 30)


def at(day: int, hour: int = 12, month: int = 1) -> datetime:
    return datetime(2024, month, day, hour)


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame([("a",), ("b",), ("quiet",)], "company string")


def events(spark, rows, schema="timestamp timestamp, type string, user string, company string, rating long"):
    return normalise_events(spark.createDataFrame(rows, schema), USER_EVENTS)


def by_day(series, name, company):
    rows = series.where(F.col("company") == company).orderBy("day").collect()
    return [r[name] for r in rows]


def test_trailing_window_bounds(spark, companies):
    frame = events(
        spark,
        [
            (at(23, 23), "call", "u", "a", None),  # day 7 before the last: out
            (at(24, 0), "call", "u", "a", None),  # day 6 before the last: in
            (datetime(2024, 1, 30, 23, 59, 59, 999999), "call", "u", "a", None),  # last microsecond: in
            (at(31, 0), "call", "u", "a", None),  # future: out
            (datetime(2023, 12, 26), "call", "u", "b", None),  # first look-back day
            (datetime(2023, 12, 25, 23), "call", "u", "b", None),  # before the look-back
            (None, "call", "u", "a", None),
            (at(30), "load", "u", "a", None),
            (at(30), "call", "u", "other", None),
            (at(30), "call", "u", None, None),
        ],
    )
    series = trailing_window(frame, companies, "calls", ("call",), as_of_date=AS_OF)
    assert series.count() == 90
    assert by_day(series, "calls", "a")[-8:] == [1, 2, 2, 2, 2, 2, 2, 2]
    assert by_day(series, "calls", "b") == [1] + [0] * 29
    assert by_day(series, "calls", "quiet") == [0] * 30


def test_cumulative_counts_history_and_not_the_future(spark, companies):
    frame = events(
        spark,
        [
            (datetime(2001, 5, 5), "register", "u", "a", None),
            (datetime(2023, 12, 31, 23), "register", "u", "a", None),
            (at(15), "register", "u", "a", None),
            (at(1, month=2), "register", "u", "a", None),
        ],
    )
    series = cumulative_to_day(frame, companies, "n", ("register",), as_of_date=AS_OF)
    assert by_day(series, "n", "a") == [2] * 14 + [3] * 16
    assert by_day(series, "n", "b") == [0] * 30


def test_average_of_window_not_of_daily_averages(spark, companies):
    frame = events(
        spark,
        [
            (at(28), "rating", "u", "a", 1),
            (at(29), "rating", "u", "a", 5),
            (at(29), "rating", "v", "a", 5),
            (at(29), "rating", "v", "a", None),
            (at(3), "rating", "u", "b", 4),
        ],
    )
    series = trailing_avg(frame, companies, "rating", ("rating",), "avg", "num", as_of_date=AS_OF)
    assert by_day(series, "avg", "a")[-3:] == [1.0, 11 / 3, 11 / 3]
    assert by_day(series, "num", "a")[-3:] == [1, 3, 3]
    assert by_day(series, "avg", "quiet") == [None] * 30
    assert by_day(series, "num", "quiet") == [0] * 30
    last = {r["company"]: (r["avg"], r["num"]) for r in headline(series, "avg", "num").collect()}
    assert last == {"a": (11 / 3, 3), "b": (None, 0), "quiet": (None, 0)}
    known = headline_last_nonnull(series, "avg", "avg", "num")
    assert {r["company"]: (r["avg"], r["num"]) for r in known.collect()} == {
        "a": (11 / 3, 3),
        "b": (4.0, 1),
        "quiet": (None, None),
    }


def test_distinct_counts_a_user_once_across_types(spark, companies):
    frame = events(
        spark,
        [
            (at(20), "call", "u", "a", None),
            (at(20), "dialin", "u", "a", None),
            (at(22), "dialin", "u", "a", None),
            (at(22), "call", "v", "a", None),
            (at(22), "call", None, "a", None),
            (at(22), "load", "w", "a", None),
            (at(22), "call", "u", "b", None),
        ],
    )
    series = trailing_distinct(frame, companies, "sdau", "user", ("call", "dialin"), as_of_date=AS_OF)
    assert by_day(series, "sdau", "a")[-11:] == [1, 1, 2, 2, 2, 2, 2, 2, 2, 0, 0]
    assert by_day(series, "sdau", "quiet") == [0] * 30


@pytest.mark.parametrize("days,width", [(30, 7), (10, 7), (1, 7), (5, 1), (57, 7), (40, 20)])
def test_both_distinct_forms_agree_with_brute_force(spark, companies, days, width):
    rows = [
        (datetime(2024, 1, 30) - timedelta(days=(i * i * 7 + i) % 75, hours=i % 24), "call", f"u{i % 9}", "ab"[i % 2], None)
        for i in range(120)
    ]
    frame = events(spark, rows)
    first = AS_OF - timedelta(days=days - 1)
    want = {}
    for company in ("a", "b", "quiet"):
        for n in range(days):
            day = first + timedelta(days=n)
            want[company, day] = len(
                {u for t, _, u, c, _ in rows if c == company and day - timedelta(days=width - 1) <= t.date() <= day}
            )
    lookback = first - timedelta(days=width - 1)
    seen = frame.where(F.to_date("timestamp").between(F.lit(lookback), F.lit(AS_OF)))
    for form in (_distinct_by_mask, _distinct_by_change):
        series = form(seen, companies, "n", "user", AS_OF, days, width)
        assert {(r["company"], r["day"]): r["n"] for r in series.collect()} == want


def test_all_user_series_against_brute_force(spark, companies):
    rng = random.Random(11)
    kinds = ["call", "dialin", "support_ticket", "register", "rating", "load", None]
    rows = [
        (
            datetime(2024, 2, 5) - timedelta(minutes=rng.randrange(100 * 24 * 60)),
            rng.choice(kinds),
            rng.choice(["u", "v", None]),
            rng.choice(["a", "a", "b", "elsewhere", None]),
            rng.choice([None, 1, 2, 5]),
        )
        for _ in range(800)
    ]
    model = EventModel(events(spark, rows), spark.createDataFrame([], COMPANY_EVENTS), companies)
    for days, width in ((30, 7), (4, 2), (45, 1)):
        got = cards.user_activity(model, as_of_date=AS_OF, days=days, width=width).collect()
        assert len(got) == 3 * days
        for r in got:
            own = [(t.date(), k, x) for t, k, _, c, x in rows if c == r["company"] and t.date() <= r["day"]]
            week = [(k, x) for d, k, x in own if d > r["day"] - timedelta(days=width)]
            rated = [x for k, x in week if k == "rating" and x is not None]
            assert r["calls"] == sum(k == "call" for k, _ in week)
            assert r["dialins"] == sum(k == "dialin" for k, _ in week)
            assert r["support_tickets"] == sum(k == "support_ticket" for k, _ in week)
            assert r["total_registered"] == sum(k == "register" for _, k, _ in own)
            assert r["num_rating"] == len(rated)
            assert r["avg_rating"] == (sum(rated) / len(rated) if rated else None)


def test_pct_is_null_before_any_purchase_and_not_capped(spark, companies):
    rows = [
        (at(10), "provisioned", "a", None, 2),
        (at(11), "purchased", "a", 1, None),
        (at(12), "purchased", "a", None, None),
        (at(13), "purchased", "a", 2, None),
    ]
    frame = normalise_events(
        spark.createDataFrame(
            rows, "timestamp timestamp, type string, company string, purchased long, provisioned long"
        ),
        COMPANY_EVENTS,
    )
    model = EventModel(events(spark, [(at(1), "call", "u", "a", None)]), frame, companies)
    series = cards.boxes_provisioned_pct(model, as_of_date=AS_OF)
    assert by_day(series, "pct_provisioned", "a")[8:14] == [None, None, 200.0, 200.0, 66.67, 66.67]
    overview = {r["company"]: (r["purchased"], r["acv"], r["acv_text"]) for r in cards.customer_overview(model).collect()}
    assert overview == {"a": (3, 7497, "$7,497.00"), "b": (0, 0, "$0.00"), "quiet": (0, 0, "$0.00")}


def test_relations_between_series(spark, sf_dir):
    from accountlens.sources import staging

    model = staging.event_model(spark, sf_dir)
    span = {"as_of_date": date(2024, 1, 30)}
    registered = {(r["company"], r["day"]): r["total_registered"] for r in cards.users_registered(model, **span).collect()}
    weekly = trailing_window(model.user_events, model.companies, "n", ("register",), **span).collect()
    for r in weekly:
        before = registered.get((r["company"], r["day"] - timedelta(days=7)))
        if before is not None:
            assert r["n"] == registered[r["company"], r["day"]] - before
    assert all(
        registered[c, d] >= registered.get((c, d - timedelta(days=1)), 0) for c, d in registered
    )
    calls = {(r["company"], r["day"]): r["calls"] for r in cards.calls_count(model, **span).collect()}
    dialins = {(r["company"], r["day"]): r["dialins"] for r in cards.dialin_count(model, **span).collect()}
    active = cards.users_active(model, **span).collect()
    assert all(r["sdau"] <= calls[r["company"], r["day"]] + dialins[r["company"], r["day"]] for r in active)


@pytest.mark.parametrize("name", [*cards.SERIES_CARDS, *cards.ROLLING_CARDS])
def test_one_company_is_a_slice_of_all(spark, sf_dir, name):
    from accountlens.sources import staging

    model = staging.event_model(spark, sf_dir)
    when = {"as_of_date": date(2024, 1, 30), "as_of_ts": "2024-01-30 12:00:00"}
    everyone = cards.card(name, model, **when).where(F.col("company") == "NATION_3")
    one = cards.card(name, model, company="NATION_3", **when)
    assert sorted(map(str, one.collect())) == sorted(map(str, everyone.collect()))


CORRELATED = """
SELECT c.company, d.day, (
  SELECT {measure} FROM {{events}} e WHERE e.company = c.company AND {types}
    AND to_date(e.timestamp) >= date_sub(d.day, 6) AND to_date(e.timestamp) <= d.day) AS {name}
FROM {{companies}} c LATERAL VIEW explode(sequence(DATE'2024-01-01', DATE'2024-01-30')) d AS day
"""


@pytest.mark.parametrize(
    "card,name,measure,types",
    [
        (cards.calls_count, "calls", "count(*)", "e.type = 'call'"),
        (cards.users_active, "sdau", "count(DISTINCT e.user)", "e.type IN ('call', 'dialin')"),
    ],
)
def test_windowed_form_equals_correlated_text(spark, sf_dir, card, name, measure, types):
    from accountlens.sources import staging, tables

    model = staging.event_model(spark, sf_dir)
    text = CORRELATED.format(measure=measure, types=types, name=name)
    want = tables.run_query(spark, text, events=model.user_events, companies=model.companies)
    got = card(model, as_of_date=AS_OF).drop("label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_unknown_company_and_unknown_card(spark, sf_dir):
    from accountlens.sources import staging

    model = staging.event_model(spark, sf_dir)
    rows = cards.card("calls_count_7d_window_30d", model, as_of_date=AS_OF, company="nobody").collect()
    assert [r["calls"] for r in rows] == [0] * 30
    assert cards.customer_overview(model.only("nobody")).collect()[0]["acv"] == 0
    with pytest.raises(ValueError, match="Unknown card type"):
        cards.card("nothing", model)
