"""Keyed updates of document frames, as joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIT = "_hit"


def _merged(df: DataFrame, fields: list[str], skip: str) -> list[Column]:
    """Every column of `df` and every updated field; given values win, NULL included."""
    columns = []
    for name in [*df.columns, *[f for f in fields if f not in df.columns]]:
        if name == skip:
            continue
        old = F.col(f"d.{name}") if name in df.columns else F.lit(None)
        new = F.when(F.col(f"u.{_HIT}"), F.col(f"u.{name}")).otherwise(old) if name in fields else old
        columns.append(new.alias(name))
    return columns


def first_of_key(df: DataFrame, key: str) -> DataFrame:
    """(key, id): the document with the smallest id of each key value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"))


def update_by_field(df: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Set the given fields on the first document (smallest `id`) of each key value.

    `updates` has one row per key value. Returns the updated documents and the updates whose
    key matches nothing. The first document is found by a combined minimum and joined back
    on the unique `id`, so a key value shared by many documents never meets in one task.
    """
    fields = [c for c in updates.columns if c != key]
    first = first_of_key(df, key)
    changes = first.join(updates, key).select("id", *fields, F.lit(True).alias(_HIT))
    updated = (
        df.alias("d")
        .join(changes.alias("u"), F.col("d.id") == F.col("u.id"), "left")
        .select(F.col("d.id").alias("id"), *_merged(df, fields, skip="id"))
    )
    return updated, updates.join(first, key, "left_anti")


def upsert_by_id(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge the given fields into documents of the same `id`; insert the rest with only those."""
    fields = [c for c in updates.columns if c != "id"]
    given = updates.withColumn(_HIT, F.lit(True))
    return (
        df.alias("d")
        .join(given.alias("u"), F.col("d.id") == F.col("u.id"), "full_outer")
        .select(F.coalesce("d.id", "u.id").alias("id"), *_merged(df, fields, skip="id"))
    )
