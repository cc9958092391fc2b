"""Time every card on stored event tables of SCALE_COPIES times the given events.

A third of all events is moved to one company. The correlated text of two cards runs next
to them, so the plans can be compared. Prints one JSON line.
"""

import json
import os
import time
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.plans import cards, etl
from accountlens.plans.scorecard import company_scorecard
from accountlens.session import new_shared_path
from accountlens.sources import staging, store, tables
from bench import session

AS_OF = {"as_of_date": date(2024, 1, 30), "as_of_ts": "2024-01-30 12:00:00"}
HOT = "NATION_3"

CORRELATED = """
SELECT c.company, d.day, (
  SELECT {measure} FROM user_events e WHERE e.company = c.company AND {types}
    AND to_date(e.timestamp) >= date_sub(d.day, 6) AND to_date(e.timestamp) <= d.day) AS value
FROM companies c LATERAL VIEW explode(sequence(DATE'2024-01-01', DATE'2024-01-30')) d AS day
"""


def copies(events: DataFrame, n: int, user: str | None = None) -> DataFrame:
    """`n` shifted copies; every third belongs to the hot company."""
    many = events.repartition(32).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    hot = F.when(F.col("copy") % 3 == 0, HOT).otherwise(F.col("company"))
    many = many.withColumn("company", hot)
    if user:
        many = many.withColumn(user, F.concat_ws(".", F.col("copy") % 50, user))
    return many.drop("copy")


def build(spark: SparkSession, sf_dir: str, root: str, n: int) -> dict[str, int]:
    store.create_event_tables(spark, root)
    model = staging.event_model(spark, sf_dir)
    documents = model.companies.select(F.col("company").alias("name"))
    store.replace_collection(documents, root, "companies")
    purchases = copies(model.company_events, max(1, n // 8))
    return {
        "user_events": store.append_events(copies(model.user_events, n, "user"), root, "user_events"),
        "company_events": store.append_events(purchases, root, "company_events"),
    }


def seconds(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 2)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    root = os.environ.get("SCALE_ROOT") or new_shared_path(spark, "scale")
    rows = {}
    if not os.environ.get("SCALE_ROOT"):
        rows = build(spark, sf_dir, root, int(os.environ.get("SCALE_COPIES", "150")))
    model = tables.event_model(spark, root)
    company_day = {**AS_OF, "as_of_date": date(2001, 8, 1)}
    plans = {
        name: cards.card(name, model, **(company_day if name.startswith("boxes") else AS_OF))
        for name in [*cards.SERIES_CARDS, *cards.ROLLING_CARDS]
    }
    plans["users_active_long_spine"] = cards.users_active(model, as_of_date=date(2024, 1, 30), days=90)
    plans["customer_overview"] = cards.customer_overview(model)
    plans["company_scorecard"] = company_scorecard(model, date(2024, 1, 30), date(2001, 8, 1))
    plans["company_totals"] = etl.company_totals(model.company_events)
    plans["name_boxes"] = etl.name_boxes(model.company_events.where("type = 'provisioned'"))
    timings = {name: seconds(plan) for name, plan in plans.items()}
    if os.environ.get("SCALE_CORRELATED"):
        model.user_events.createOrReplaceTempView("user_events")
        model.companies.createOrReplaceTempView("companies")
        for name, measure, types in (
            ("calls_correlated", "count(*)", "e.type = 'call'"),
            ("active_correlated", "count(DISTINCT e.user)", "e.type IN ('call', 'dialin')"),
        ):
            timings[name] = seconds(spark.sql(CORRELATED.format(measure=measure, types=types)))
    print(json.dumps({"root": root, "rows": rows, "seconds": timings}))


if __name__ == "__main__":
    main()
