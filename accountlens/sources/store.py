"""Writing event tables and collections as versions of one store.

Every write adds Parquet folders and commits a manifest (`versions.py`) that names them; several tables may change in
one commit. Event rows lie in periods whose length follows the volume, so that a file has a useful size whether a day
has a hundred rows or a billion; collections lie in buckets of their ids, so that a merge rewrites those it touches.
"""

import uuid
from collections import defaultdict
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlens.operators.shaping import normalise_events
from accountlens.operators.updates import first_of_key, upsert_by_id
from accountlens.schemas import COLLECTIONS, DAILY, EVENT_TABLES, REJECTED
from accountlens.session import require_utc
from accountlens.sources import tables, versions
from accountlens.sources.versions import Manifest, Part

#: Rows from which a day, a month or a year is a period of its own.
PERIOD_ROWS = 2_000_000
#: Parts with fewer rows than this are folded by compaction.
SMALL_PART = 16 * PERIOD_ROWS
#: Documents of a bucket.
BUCKET_ROWS = 1_000_000


def event_schema(table: str) -> T.StructType:
    if table not in EVENT_TABLES:
        raise ValueError(f"unknown event table {table!r}, expected one of {sorted(EVENT_TABLES)}")
    return EVENT_TABLES[table]


def periods(counts: dict[date | None, int], target: int) -> dict[date, tuple[date, date]]:
    """The first and last day of the period of each day.

    A day with `target` rows is a period. The other days of a month are one if they have as many together, then those
    of a year, and the rest is one. So there is one more period than rows / target at most, however many days.
    """
    left = {day: n for day, n in counts.items() if day is not None}
    out: dict[date, tuple[date, date]] = {}
    for unit in (lambda d: d, lambda d: (d.year, d.month), lambda d: d.year, lambda d: None):
        groups: dict[object, list[date]] = defaultdict(list)
        for day in left:
            groups[unit(day)].append(day)
        for days in groups.values():
            if unit(days[0]) is None or sum(left[day] for day in days) >= target:
                out |= dict.fromkeys(days, (min(days), max(days)))
        left = {day: n for day, n in left.items() if day not in out}
    return out


def daily_sums(events: DataFrame, table: str) -> DataFrame:
    """Rows per company, type and day, and for each number column how many have it and their sum."""
    numbers = [f.name for f in event_schema(table) if isinstance(f.dataType, T.LongType)]
    sums = [x for c in numbers for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"sum_{c}"))]
    bounds = [c for c in ("first_day", "last_day") if c in events.columns]
    return events.groupBy("company", "type", "event_date", *bounds).agg(F.count("*").alias("n"), *sums)


class Draft:
    """The next version of a store. What is written shows in `read` at once, and to others with `commit`."""

    def __init__(self, spark: SparkSession, root: str):
        require_utc(spark)
        self.spark, self.root = spark, root.rstrip("/")
        self.base = self.next = versions.current(spark, root)
        self.changes: list[Callable[[Manifest], Manifest]] = []

    def change(self, step: Callable[[Manifest], Manifest]) -> None:
        self.changes.append(step)
        self.next = step(self.next)

    def commit(self) -> Manifest:
        return versions.commit(self.spark, self.root, lambda newest: reduce(lambda m, step: step(m), self.changes, newest))

    def read(self, name: str) -> DataFrame:
        parts = self.next.parts(name)
        return tables.collection_parts(self.spark, self.root, name, parts) if name in COLLECTIONS else tables.event_parts(self.spark, self.root, name, parts)

    def truncate(self, table: str) -> None:
        event_schema(table)
        self.change(lambda m: m.emptied(table).emptied(DAILY[table]))

    def append(self, df: DataFrame, table: str, batch: str | None = None) -> int:
        """Rows of a batch in place of those it had; a batch that was folded into others is there already."""
        event_schema(table)
        batch = batch or uuid.uuid4().hex
        if self.next.holds(table, batch):
            return 0
        part, daily = self.written(df, table, batch)
        self.change(lambda m: m if m.holds(table, batch) else m.with_batch(table, part).with_batch(DAILY[table], daily))
        return part.rows

    def written(self, df: DataFrame, table: str, batch: str | None) -> tuple[Part, Part]:
        """Rows as files of even size, sorted so that readers skip row groups, and their daily sums.

        The days are counted first: one column of the input, and at most a number for each day of the calendar.
        """
        folder = f"ingest_batch={uuid.uuid4().hex}"
        rows = normalise_events(df, event_schema(table)).withColumn("event_date", F.to_date("timestamp"))
        counts = {row.event_date: row["count"] for row in rows.groupBy("event_date").count().collect()}
        bounds = periods(counts, PERIOD_ROWS)
        whole = ["first_day", "last_day"]
        sort = [*whole, "type", "event_date", "company"]
        # Nothing but the writer above the sort: observed there, rows lose their order for it and are held and sorted twice.
        placed = self.placed(rows, bounds).hint("rebalance", *whole, "type").sortWithinPartitions(*sort)
        placed.write.partitionBy(*whole).parquet(f"{self.root}/{table}/{folder}")
        stored = tables.event_parts(self.spark, self.root, table, (Part(folder, batch, 0),), bounds=True)
        part = Part(folder, batch, stored.count())
        sums = daily_sums(stored, table).hint("rebalance", *whole, "type").sortWithinPartitions(*sort)
        sums.write.partitionBy(*whole).parquet(f"{self.root}/{DAILY[table]}/{folder}")
        return part, Part(folder, batch, part.rows)

    def placed(self, rows: DataFrame, bounds: dict[date, tuple[date, date]]) -> DataFrame:
        if len(set(bounds.values())) < 2:
            first, last = next(iter(bounds.values()), (None, None))
            return rows.withColumns({"first_day": F.lit(first).cast("date"), "last_day": F.lit(last).cast("date")})
        listed = self.spark.createDataFrame([(d, *ends) for d, ends in bounds.items()], "event_date date, first_day date, last_day date")
        # One row for each day of the calendar at most.
        return rows.join(F.broadcast(listed), "event_date", "left")

    def append_plain(self, df: DataFrame, table: str, batch: str) -> int:
        """Rows of a table without days, such as the rejects."""
        if self.next.holds(table, batch):
            return 0
        folder, observed = f"ingest_batch={uuid.uuid4().hex}", Observation()
        df.observe(observed, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/{table}/{folder}")
        part = Part(folder, batch, observed.get.get("rows", 0))
        self.change(lambda m: m.with_batch(table, part))
        return part.rows

    def replace(self, df: DataFrame, name: str) -> int:
        """All documents of a collection; a missing id is generated."""
        schema = tables.collection_schema(name)
        if "id" not in df.columns:
            df = df.withColumn("id", F.uuid())
        documents = normalise_events(df, schema)
        folder, observed = f"version={uuid.uuid4().hex}", Observation()
        counted = documents.observe(observed, F.count(F.lit(1)).alias("rows"))
        counted.write.parquet(f"{self.root}/{name}/{folder}")
        rows = observed.get.get("rows", 0)
        parts: tuple[Part, ...] = (Part(folder, "0/1", rows),) if rows else ()
        if rows > BUCKET_ROWS:  # only now their number is known
            parts = self.bucketed(tables.collection_parts(self.spark, self.root, name, parts), name, 1 + rows // BUCKET_ROWS)
        self.change(lambda m: m.with_parts(name, parts))
        return rows

    def bucketed(self, documents: DataFrame, name: str, buckets: int) -> tuple[Part, ...]:
        """Documents written by bucket of their ids, each bucket a part."""
        folder = f"version={uuid.uuid4().hex}"
        dealt = documents.withColumn("bucket", bucket(F.col("id"), buckets))
        dealt.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        read = self.spark.read.schema(T.StructType([*tables.collection_schema(name), T.StructField("bucket", T.IntegerType())]))
        counts = read.parquet(f"{self.root}/{name}/{folder}").groupBy("bucket").count().collect()  # a number for each bucket
        return tuple(Part(f"{folder}/bucket={row.bucket}", f"{row.bucket}/{buckets}", row["count"]) for row in sorted(counts))

    def merge(self, updates: DataFrame, name: str) -> int:
        """Upsert fields by id, reading and rewriting the touched buckets only; returns how many these are."""
        parts = self.next.parts(name)
        buckets = max([1, *(int(p.batch.split("/")[1]) for p in parts)])
        given = updates.withColumn("_bucket", bucket(F.col("id"), buckets))
        touched = {row[0] for row in given.select("_bucket").distinct().collect()}  # at most one for each bucket
        if not touched:
            return 0
        old = tuple(p for p in parts if int(p.batch.split("/")[0]) in touched)
        documents = tables.collection_parts(self.spark, self.root, name, old)
        merged = normalise_events(upsert_by_id(documents, given.drop("_bucket")), tables.collection_schema(name))
        new = self.bucketed(merged, name, buckets)

        def step(m: Manifest) -> Manifest:
            if not set(old) <= set(m.parts(name)):
                raise Conflict(f"{name} was written meanwhile")
            return m.with_parts(name, (*(p for p in m.parts(name) if p not in old), *new))

        self.change(step)
        return len(touched)

    def compact(self, table: str, small: int) -> int:
        """Fold parts with fewer rows than `small` into one; returns how many."""
        chosen = tuple(p for p in self.next.parts(table) if p.rows < small)
        if len(chosen) < 2:
            return 0
        part, daily = self.written(tables.event_parts(self.spark, self.root, table, chosen), table, None)
        folders = {p.folder for p in chosen}

        def step(m: Manifest) -> Manifest:
            if not set(chosen) <= set(m.parts(table)):
                raise Conflict(f"{table} was written meanwhile")
            for name, new in ((table, part), (DAILY[table], daily)):
                m = m.with_parts(name, (*(p for p in m.parts(name) if p.folder not in folders), new))
            return m.with_folded(table, [p.batch for p in chosen if p.batch])

        self.change(step)
        return len(chosen)


class Conflict(RuntimeError):
    """Another writer replaced what this one had read; nothing was changed."""


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_event_tables(spark: SparkSession, root: str) -> list[str]:
    """Empty both event tables, whether they are there or not."""
    draft = Draft(spark, root)
    for table in EVENT_TABLES:
        draft.truncate(table)
    draft.commit()
    return list(EVENT_TABLES)


def truncate_table(spark: SparkSession, root: str, table: str) -> None:
    """Remove all rows of an event table."""
    draft = Draft(spark, root)
    draft.truncate(table)
    draft.commit()


def append_events(df: DataFrame, root: str, table: str, batch: str | None = None) -> int:
    """Append rows and return how many; columns not given become NULL.

    Appending the same rows under the same `batch` name again replaces them, and does nothing once the batch was
    folded, so a retry is safe; an append without a name gets one of its own.
    """
    draft = Draft(df.sparkSession, root)
    rows = draft.append(df, table, batch)
    draft.commit()
    return rows


def compact(spark: SparkSession, root: str, table: str, small: int = SMALL_PART) -> int:
    """Fold the small parts of an event table, its batches' names kept; returns how many there were.

    A part of `small` rows or more is never rewritten, so the folders of a table are bounded by its rows and by the
    batches since the last call.
    """
    draft = Draft(spark, root)
    folded = draft.compact(table, small)
    if folded:
        draft.commit()
    return folded


def clear_collection(spark: SparkSession, root: str, name: str) -> int:
    """Delete all documents and return how many there were."""
    draft = Draft(spark, root)
    tables.collection_schema(name)
    count = draft.base.rows(name)
    draft.change(lambda m: m.emptied(name))
    draft.commit()
    return count


def create_collections(spark: SparkSession, root: str) -> list[str]:
    draft = Draft(spark, root)
    for name in COLLECTIONS:
        draft.change(lambda m, name=name: m.emptied(name))
    draft.commit()
    return list(COLLECTIONS)


def replace_collection(df: DataFrame, root: str, name: str) -> int:
    """Put these documents in place of all and return how many; a missing id is generated.

    `df` may be derived from the collection: the old documents stay until the new ones are committed, and for readers
    that have begun.
    """
    draft = Draft(df.sparkSession, root)
    rows = draft.replace(df, name)
    draft.commit()
    return rows


def rewrite_collection(df: DataFrame, root: str, name: str) -> int:
    """Replace a collection by a frame derived from it."""
    return replace_collection(df, root, name)


def merge_collection(updates: DataFrame, root: str, name: str) -> int:
    """Merge the given fields into documents of the same id, insert the rest; returns the number of buckets rewritten."""
    draft = Draft(updates.sparkSession, root)
    touched = draft.merge(updates, name)
    if touched:
        draft.commit()
    return touched


def update_collection(updates: DataFrame, root: str, name: str, key: str) -> DataFrame:
    """Set the given fields on the first document of each key value; returns the updates that match nothing.

    The documents are found by two columns; only their buckets are rewritten.
    """
    draft = Draft(updates.sparkSession, root)
    first = first_of_key(draft.read(name), key)
    if draft.merge(first.join(updates, key).drop(key), name):
        draft.commit()
    return updates.join(first, key, "left_anti")


def replay_rejects(repairs: DataFrame, root: str, route: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, int]:
    """Take in rejected bodies once they are repaired; returns the rows that each table got.

    repairs: (body, repaired), one row for each rejected body it mends; a null `repaired` drops the body. `route` turns
    bodies into frames by table. The event tables, and the rejects without what was mended, change in one commit, so
    a body is taken in once or not at all; what `route` still rejects stays, in its repaired form.
    """
    spark = repairs.sparkSession
    draft = Draft(spark, root)
    parts = draft.next.parts(REJECTED)
    rejected = tables.rejected_parts(spark, root, parts)
    matched = repairs.groupBy("body").agg(F.max("repaired").alias("repaired"), F.lit(True).alias("mended"))
    joined = rejected.join(matched, "body", "left")
    frames = route(joined.where("mended AND repaired IS NOT NULL").select(F.col("repaired").alias("body")))
    added = {table: draft.append(frames[table], table) for table in EVENT_TABLES}
    left = joined.where("mended IS NULL").select("body", "error").unionByName(frames[REJECTED])
    name = f"replayed.{uuid.uuid4().hex}"
    added[REJECTED] = draft.append_plain(left, REJECTED, name)

    def step(m: Manifest) -> Manifest:
        if not set(parts) <= set(m.parts(REJECTED)):
            raise Conflict("the rejects were written meanwhile")
        kept = m.with_parts(REJECTED, tuple(p for p in m.parts(REJECTED) if p not in parts))
        return kept.with_folded(REJECTED, [p.batch for p in parts])

    draft.change(step)
    draft.commit()
    return added

