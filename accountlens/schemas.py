"""Types of the two event tables and the five document collections."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _INT, _REAL, _INSTANT = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

USER_EVENTS = _struct(
    timestamp=_INSTANT, type=_TEXT, user=_TEXT, company=_TEXT,
    call_duration=_INT, call_type=_TEXT, call_num_users=_INT, call_os=_TEXT,
    rating=_INT, comment=_TEXT, session_id=_TEXT, dialin_duration=_INT,
    ticket_number=_TEXT, ticket_driver=_TEXT,
)

COMPANY_EVENTS = _struct(
    timestamp=_INSTANT, type=_TEXT, company=_TEXT, purchased=_INT, provisioned=_INT,
    serial_number=_TEXT, box_name=_TEXT,
)

EVENT_TABLES = {"user_events": USER_EVENTS, "company_events": COMPANY_EVENTS}

# Columns that a stored event table has beside the declared ones: the UTC day of `timestamp`, and, as directories, the
# bounds of the period that a row lies in, by which readers skip periods.
STORED = _struct(event_date=T.DateType(), first_day=T.DateType(), last_day=T.DateType())

# The tables of daily sums, one row per company, type and day of a batch; and the bodies that were turned away.
DAILY = {table: f"{table}_daily" for table in EVENT_TABLES}
REJECTED = "rejects"
REJECTS = _struct(body=_TEXT, error=_TEXT)


def daily_schema(schema: T.StructType) -> T.StructType:
    numbers = [f.name for f in schema if isinstance(f.dataType, T.LongType)]
    sums = {f"{how}_{c}": _INT for c in numbers for how in ("n", "sum")}
    return _struct(company=_TEXT, type=_TEXT, event_date=T.DateType(), n=_INT, **sums)


DAILY_TABLES = {DAILY[table]: daily_schema(schema) for table, schema in EVENT_TABLES.items()}


COLLECTIONS = {
    "users": _struct(id=_TEXT, email=_TEXT, company=_TEXT, reg_date=_INSTANT),
    "companies": _struct(
        id=_TEXT, name=_TEXT, earliest_reg=_INSTANT, boxes_bought=_INT, boxes_prov=_INT
    ),
    "projects": _struct(id=_TEXT, name=_TEXT, company=_TEXT, date=_INSTANT),
    "trending": _struct(id=_TEXT, metric=_TEXT, company=_TEXT, value=_REAL, date=_INSTANT),
    "renewals": _struct(id=_TEXT, company=_TEXT, amount=_INT, health=T.IntegerType(), due=_INSTANT),
}

# The field every real row of a table has.
IDENTITY = {
    "user_events": "type", "company_events": "type", "users": "email", "companies": "name",
    "projects": "name", "trending": "metric", "renewals": "company",
}

# Event types with a table of their own, and the contract value of one box.
COMPANY_EVENT_TYPES = ("purchased", "provisioned")
CONTRACT_VALUE_PER_BOX = 2499
