"""Column-level shaping of event frames."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlens.functions.dates import as_instant, instant


def normalise_events(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of `schema`; missing ones become typed NULLs."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def union_events(*frames: DataFrame, schema: T.StructType) -> DataFrame:
    """Several event sets as one frame of the wide schema."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return normalise_events(merged, schema)


def clamp_future(events: DataFrame, as_of_ts: datetime | str | None = None) -> DataFrame:
    """Timestamps after the as-of instant become that instant; NULL stays NULL."""
    now = instant(as_instant(as_of_ts))
    ts = F.col("timestamp")
    return events.withColumn("timestamp", F.when(ts > now, now).otherwise(ts))
