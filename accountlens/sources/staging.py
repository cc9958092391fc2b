"""The given test tables reshaped into the event model.

Timestamps are declared as instants in the read schema, so filters on them reach the scan.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.model import EventModel

_READ = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_READ[name]).parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    named = customer.join(nation, F.expr("c_nationkey = n_nationkey"))
    return named.selectExpr("c_custkey", "n_name AS company")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _customers(spark, sf_dir)
    return table(spark, sf_dir, "orders").join(customers, F.expr("o_custkey = c_custkey"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_name AS company")


def stg_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    return events.join(_customers(spark, sf_dir), F.expr("user_id = c_custkey")).selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "company",
        "concat('user', user_id, '@example.com') AS email",
        """CASE WHEN event_id % 20 < 7 THEN 'Web' WHEN event_id % 20 < 14 THEN 'Presentation'
           WHEN event_id % 20 < 18 THEN 'Room-and-Web' ELSE 'Multi-room-and-Web' END AS c_type""",
        """CASE WHEN event_id % 17 < 6 THEN 2 WHEN event_id % 17 < 12 THEN 3 WHEN event_id % 17 < 16 THEN 4
           ELSE 10 + CAST(user_id % 5 AS INT) END AS c_users""",
        """CASE user_id % 5 WHEN 0 THEN 'Mac OSX' WHEN 1 THEN 'Windows' WHEN 2 THEN 'Linux'
           WHEN 3 THEN 'ios' ELSE 'Android' END AS c_os""",
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are calls, views dial-ins, errors tickets, signups registrations, purchases feedback."""
    return stg_events(spark, sf_dir).selectExpr(
        "ts AS timestamp",
        """CASE event_type WHEN 'click' THEN 'call' WHEN 'view' THEN 'dialin' WHEN 'error' THEN 'support_ticket'
           WHEN 'signup' THEN 'register'
           WHEN 'purchase' THEN CASE WHEN k % 3 <> 0 THEN 'rating' ELSE 'comment' END END AS type""",
        "email AS user",
        "company",
        "CAST(CASE WHEN event_type IN ('click', 'view') THEN k END AS BIGINT) AS call_duration",
        "CASE WHEN event_type = 'click' AND k <> 0 THEN c_type END AS call_type",
        "CAST(CASE WHEN event_type = 'click' THEN c_users END AS BIGINT) AS call_num_users",
        "CASE WHEN event_type = 'click' AND k <> 1 THEN c_os END AS call_os",
        "CAST(CASE WHEN event_type = 'purchase' AND k % 3 <> 0 THEN 1 + k % 5 END AS BIGINT) AS rating",
        """CASE WHEN event_type = 'purchase' AND k % 3 = 0 AND k <> 99 THEN concat('comment ', k) END
           AS comment""",
        "CASE WHEN event_type IN ('click', 'purchase') THEN CAST(event_id AS STRING) END AS session_id",
        "CAST(NULL AS BIGINT) AS dialin_duration",
        "CASE WHEN event_type = 'error' THEN concat(email, '-', event_id) END AS ticket_number",
        """CASE WHEN event_type = 'error'
           THEN CASE k % 3 WHEN 0 THEN 'Video' WHEN 1 THEN 'Audio' ELSE 'Network' END END AS ticket_driver""",
    )


def company_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One `purchased` event per order, one `provisioned` event per line not returned.

    Each type is a branch of its own, so a reader of one type computes that one only.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = _orders(spark, sf_dir).select("o_orderkey", "o_orderdate", "company")
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    purchased = per_order.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "o_orderdate AS timestamp", "'purchased' AS type", "company", "n AS purchased",
        "CAST(NULL AS BIGINT) AS provisioned", "CAST(NULL AS STRING) AS serial_number", "CAST(NULL AS STRING) AS box_name",
    )
    kept = lines.where("l_returnflag <> 'R'").select("l_orderkey", "l_shipdate")
    provisioned = kept.join(orders, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "l_shipdate AS timestamp", "'provisioned' AS type", "company", "CAST(NULL AS BIGINT) AS purchased",
        "1L AS provisioned", "concat('A', 100000 + l_orderkey) AS serial_number", "CAST(NULL AS STRING) AS box_name",
    )
    return purchased.unionByName(provisioned)


def event_model(spark: SparkSession, sf_dir: str) -> EventModel:
    return EventModel(
        lambda: user_events(spark, sf_dir),
        lambda: company_events(spark, sf_dir),
        lambda: companies(spark, sf_dir),
    )


def user_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).selectExpr(
        "concat('user', c_custkey, '@example.com') AS email",
        "company",
        "CAST(c_custkey % 365 AS INT) AS offset",
        "CAST(c_custkey % 121 AS INT) AS delay_minutes",
    )


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stg_events(spark, sf_dir).where("event_type = 'click'").selectExpr(
        "ts AS timestamp",
        "email AS user",
        "company",
        "CAST(k AS BIGINT) AS call_duration",
        "c_type AS call_type",
        "CAST(c_users AS BIGINT) AS call_num_users",
        "c_os AS call_os",
        "CAST(event_id AS STRING) AS session_id",
        "CAST(CASE WHEN k % 2 = 0 THEN 1 + k % 5 END AS BIGINT) AS rating",
        "CASE WHEN k % 7 = 0 THEN concat('comment ', k) WHEN k % 7 = 1 THEN '' END AS comment",
        "CAST(CASE WHEN k < 40 THEN k END AS BIGINT) AS dialin_length",
    )


def purchase_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).selectExpr(
        "company",
        "o_orderdate AS timestamp",
        "o_orderkey AS purchase_id",
        "CAST(o_orderkey % 16 AS INT) AS qty",
        "CAST(2 + o_orderkey % 13 AS INT) AS lag_days",
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").selectExpr(
        "CAST(o_orderkey AS STRING) AS id",
        """CASE o_orderkey % 5 WHEN 0 THEN 'Pilot' WHEN 1 THEN 'Pro Eval' WHEN 2 THEN 'Global Launch'
           WHEN 3 THEN 'QBR' ELSE 'Case Study' END AS name""",
        "company",
        "CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate END AS date",
    )


def renewal_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS company",
        "CAST(date_add(DATE'2024-01-30', 30 + (n_nationkey * 37) % 91) AS TIMESTAMP) AS due",
        "10 + (n_nationkey * 29) % 91 AS health",
    )


def event_bodies(staged: DataFrame) -> DataFrame:
    """JSON bodies, five invalid and three valid classes; also of a stream of staged events."""
    return staged.selectExpr(
        "event_id",
        "ts",
        """CASE event_id % 8
           WHEN 0 THEN '{}'
           WHEN 1 THEN concat('{"company":"', company, '","purchased":', k, '}')
           WHEN 2 THEN concat('{"type":"purchased","purchased":', k, '}')
           WHEN 3 THEN concat('{"type":"purchased","company":"', company, '"}')
           WHEN 4 THEN concat('{"type":"provisioned","company":"', company, '"}')
           WHEN 5 THEN concat('{"type":"purchased","company":"', company, '","purchased":', k, '}')
           WHEN 6 THEN concat('{"type":"provisioned","company":"', company, '","provisioned":null}')
           ELSE concat('{"type":"call","user":"', email, '","company":"', company, '","call_duration":', k, '}')
           END AS body""",
    )


def whole_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user and company event as a JSON body with all its fields, timestamps in ISO form; nulls are left out."""
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    frames = [events.select(F.to_json(F.struct(*events.columns), iso).alias("body")) for events in (user_events(spark, sf_dir), company_events(spark, sf_dir))]
    return frames[0].unionByName(frames[1])
