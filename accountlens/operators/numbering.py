"""Running numbers per group that survive a group holding a large share of the rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountlens.session import stored

#: monotonically_increasing_id() has a partition's number above so many bits, a row's number in it below.
ROW_BITS = 33


def running_number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1, 2, 3, ... per `keys` in ascending `order`, nulls first; without keys over all rows.

    Rows are dealt out and sorted by ranges of keys, order and a digest of the whole row, so that a group, and a
    single value of the order within it, spreads over as many tasks as it needs; the digest makes the order total
    but for rows equal in every column. They are stored once with their places. A range then has for each group
    its first place and its count; added up over the ranges of the group, that gives what the place must be
    lowered by. Only rows equal in every column stay together.
    """
    at, part, tie, first, shift = "_at", "_part", "_tie", "_first", "_shift"
    tied = df.withColumn(tie, F.xxhash64(*[F.col(c) for c in df.columns]))
    sort = [*keys, *order, tie]
    ranged = tied.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = stored(ranged.select(*df.columns, F.monotonically_increasing_id().alias(at)), "numbered")
    # In a struct a NULL is a value like any other, to a join as well.
    group, whole = "_group", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    placed = placed.withColumns({group: whole, part: F.shiftright(at, ROW_BITS)})
    ranges = placed.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias("_count"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_count").over(earlier), F.lit(0))
    shifts = ranges.select(group, part, (before - F.col(first) + 1).alias(shift))
    # Shifts are few beside the rows and looked up by hash: the rows, of which a reader may need next to nothing and
    # which then are many to a task, are not sorted for it.
    joined = placed.join(shifts.hint("shuffle_hash"), [group, part])
    return joined.select(*df.columns, (F.col(at) + F.col(shift)).alias(name))
