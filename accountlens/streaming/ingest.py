"""Event ingestion: validation, routing and appending of JSON bodies, and running totals.

The same DataFrame functions serve batches and streams.
"""

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from accountlens.operators.updates import update_by_field
from accountlens.schemas import COMPANY_EVENT_TYPES, EVENT_TABLES, REJECTED
from accountlens.sources import versions
from accountlens.sources.store import Draft, compact
from accountlens.sources.versions import Manifest, Part

log = logging.getLogger(__name__)

# The messages a sender gets back.
NO_DATA = "No event data provided"
NO_TYPE = "Event type is required"
NO_COMPANY = "Company is required for company events"
NO_PURCHASED = "Purchased field is required for purchased events"
NO_PROVISIONED = "Provisioned field is required for provisioned events"
NOT_STORED = "Error adding event: "

_DECLARED = list(dict.fromkeys(name for schema in EVENT_TABLES.values() for name in schema.names))


def _field(name: str) -> Column:
    """The text of a top-level field; NULL if it is missing or null."""
    return F.col(f"_{name}")


def _has(name: str) -> Column:
    return F.array_contains("keys", name)


def _computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-element generator.

    Filters stay above a generator. Pushed below plain columns, each of their many
    references would be computed again.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def parse_bodies(df: DataFrame) -> DataFrame:
    """Add the declared fields of each body as text (`_<name>`) and all its top-level `keys`.

    `keys` is NULL if the body is not an object. Both are read once, whatever is filtered later.
    """
    fields = F.json_tuple("body", *_DECLARED).alias(*[f"_{name}" for name in _DECLARED])
    return _computed_once(df.select("*", fields), keys=F.json_object_keys("body"))


def _rule_error() -> Column:
    kind = _field("type")
    of_company = kind.isin(*COMPANY_EVENT_TYPES)
    # A non-empty array carries data but no type.
    no_object = F.when(F.json_array_length("body") > 0, NO_TYPE).otherwise(NO_DATA)
    return (
        F.when(F.col("keys").isNull(), no_object)
        .when(F.size("keys") == 0, NO_DATA)
        .when(~_has("type"), NO_TYPE)
        .when(of_company & ~_has("company"), NO_COMPANY)
        .when((kind == "purchased") & ~_has("purchased"), NO_PURCHASED)
        .when((kind == "provisioned") & ~_has("provisioned"), NO_PROVISIONED)
    )


def validate_events(df: DataFrame) -> DataFrame:
    """Add the parsed columns and `error`: the first rule a body breaks, or NULL.

    Rules ask for the presence of a key, not for a value.
    """
    return parse_bodies(df).withColumn("error", _rule_error())


def _typed(field: T.StructField) -> Column:
    return _field(field.name).try_cast(field.dataType)


def _storage_error(schema: T.StructType) -> Column:
    """What keeps a body out of its table: an undeclared key or a value of the wrong type."""
    undeclared = F.array_except("keys", F.array(*[F.lit(n) for n in schema.names]))
    message = F.concat(F.lit(NOT_STORED + "no such field: "), F.get(undeclared, F.lit(0)))
    error = F.when(F.size(undeclared) > 0, message)
    for field in schema:
        if not isinstance(field.dataType, T.StringType):
            wrong = _field(field.name).isNotNull() & _typed(field).isNull()
            error = error.when(wrong, F.lit(f"{NOT_STORED}invalid value for {field.name}"))
    return error


def route_events(df: DataFrame) -> DataFrame:
    """Add the parsed columns, `error`, and `target`: an event table (unknown types too) or `rejects`."""
    for_company = F.coalesce(_field("type").isin(*COMPANY_EVENT_TYPES), F.lit(False))
    storage_error = F.when(for_company, _storage_error(EVENT_TABLES["company_events"])).otherwise(
        _storage_error(EVENT_TABLES["user_events"])
    )
    table = F.when(for_company, "company_events").otherwise("user_events")
    checked = _computed_once(
        parse_bodies(df), error=F.coalesce(_rule_error(), storage_error), table=table
    )
    target = F.when(F.col("error").isNotNull(), REJECTED).otherwise(F.col("table"))
    return checked.withColumn("target", target).drop("table")


def typed_events(routed: DataFrame, table: str) -> DataFrame:
    """The rows routed to `table` in its schema; keys not given are NULL."""
    columns = [_typed(field).alias(field.name) for field in EVENT_TABLES[table]]
    return routed.where(F.col("target") == table).select(*columns)


def rejects(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("target") == REJECTED).select("body", "error")


def frames(bodies: DataFrame) -> dict[str, DataFrame]:
    """Bodies as rows by table, the rejects among them."""
    routed = route_events(bodies)
    return {table: typed_events(routed, table) for table in EVENT_TABLES} | {REJECTED: rejects(routed)}


def start_ingest(bodies: DataFrame, root: str, checkpoint: str, compact_every: int = 0, **trigger) -> StreamingQuery:
    """Append a stream of bodies to the two event tables and the rejects.

    A micro-batch's three tables change in one commit, under a name made of the stream's id, which its checkpoint
    keeps, and the batch number. A replayed batch so takes its own place instead of adding rows twice, and a stream
    with a new checkpoint never replaces an older one's. After every `compact_every` batches the small parts of the
    event tables are folded, so that their folders don't grow with the number of batches; replays of folded batches do
    nothing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routed = route_events(batch).persist()
        try:
            name = f"{_stream_id(batch)}-{batch_id}"
            draft = Draft(spark, root)
            for table in EVENT_TABLES:
                draft.append(typed_events(routed, table), table, name)
            draft.append_plain(rejects(routed), REJECTED, name)
            draft.commit()
        finally:
            routed.unpersist()
        if compact_every and batch_id % compact_every == compact_every - 1:
            for table in EVENT_TABLES:
                compact(spark, root, table)

    return (
        bodies.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _stream_id(batch: DataFrame) -> str:
    """The id of the stream a micro-batch belongs to; the same after a restart."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if stream is None:
        raise RuntimeError("the stream's id is not known, so its batches could not be told apart")
    return stream


def company_sums(bodies: DataFrame) -> DataFrame:
    """Boxes added per company by valid company events; a NULL amount adds nothing."""
    routed = route_events(bodies).where(F.col("target") == "company_events")
    amounts = [
        F.coalesce(
            F.sum(F.when(_field("type") == kind, _field(kind).try_cast("long"))), F.lit(0)
        ).alias(kind)
        for kind in COMPANY_EVENT_TYPES
    ]
    return routed.groupBy(_field("company").alias("company")).agg(*amounts)


def add_sums(companies: DataFrame, sums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals of the companies that have sums, and the sums of names `companies` does not have.

    A missing or NULL total counts as 0.
    """
    zero = F.lit(0)
    known = sums.withColumnRenamed("company", "name").join(companies, "name")
    totals = known.select(
        F.col("name").alias("company"),
        (F.coalesce("boxes_bought", zero) + F.col("purchased")).alias("boxes_bought"),
        (F.coalesce("boxes_prov", zero) + F.col("provisioned")).alias("boxes_prov"),
    )
    unknown = sums.join(companies.select(F.col("name").alias("company")), "company", "left_anti")
    return totals, unknown


_SUMS = "company string, purchased long, provisioned long"
SUMS = "sums"
#: Unknown names that one warning lists.
NAMED = 20


def start_company_totals(
    bodies: DataFrame, folder: str, companies: Callable[[], DataFrame] | None = None, **trigger
) -> StreamingQuery:
    """Keep the running sums of companies in `folder`, next to the checkpoint they belong to.

    A micro-batch adds its own sums to those of the batch before, writes them to a folder of its own, one row per
    company, and commits it. Readers follow the newest whole one and keep what they have begun to read; a replayed
    batch finds itself committed and adds nothing. With `companies`, which gives the documents (`name`) as they are at
    each batch, events of other names are logged and not kept, so what is kept is bounded by the documents.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"{_stream_id(batch)}-{batch_id}"
        newest = versions.current(spark, folder)
        if newest.holds(SUMS, name):
            return
        sums = company_sums(batch)
        if companies is not None:
            known = companies().select(F.col("name").alias("company")).where("company IS NOT NULL").distinct()
            sums = sums.persist()
            unknown = sums.join(known, "company", "left_anti").select("company")
            names = [row.company for row in unknown.limit(NAMED + 1).collect()]
            if names:
                more = " and others" if len(names) > NAMED else ""
                log.warning("batch %d has events of companies without a document: %s%s", batch_id, ", ".join(map(str, names[:NAMED])), more)
            sums = sums.join(known, "company", "left_semi")
        both = running_sums(spark, folder, newest).unionByName(sums)
        added = both.groupBy("company").agg(*[F.sum(kind).alias(kind) for kind in COMPANY_EVENT_TYPES])
        own = f"batch={batch_id}-{newest.version + 1}"
        added.write.mode("overwrite").parquet(f"{folder}/{SUMS}/{own}")

        def step(m: Manifest) -> Manifest:
            if m.version != newest.version:
                raise RuntimeError(f"another stream writes to {folder}")
            return m.with_parts(SUMS, (Part(own, None, 0),)).with_folded(SUMS, [name])

        versions.commit(spark, folder, step)
        versions.vacuum(spark, folder, keep=2)
        if companies is not None:
            sums.unpersist()

    return (
        bodies.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def running_sums(spark: SparkSession, folder: str, manifest: Manifest | None = None) -> DataFrame:
    """The sums after the latest micro-batch, or as of a manifest."""
    parts = (manifest or versions.current(spark, folder)).parts(SUMS)
    if not parts:
        return spark.createDataFrame([], _SUMS)
    return spark.read.schema(_SUMS).parquet(*[f"{folder}/{SUMS}/{part.folder}" for part in parts])


def current_totals(spark: SparkSession, folder: str, companies: DataFrame) -> DataFrame:
    """Totals of `companies` plus the running sums; names it does not have are skipped."""
    return add_sums(companies, running_sums(spark, folder))[0]


def companies_now(spark: SparkSession, folder: str, companies: DataFrame) -> DataFrame:
    """The company documents with their totals brought up to date."""
    totals = current_totals(spark, folder, companies).withColumnRenamed("company", "name")
    return update_by_field(companies, totals, "name")[0]
