"""Reading stored event tables, collections and SQL text."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlens.model import EventModel
from accountlens.schemas import COLLECTIONS, DAILY, DAILY_TABLES, EVENT_TABLES, IDENTITY, REJECTED, REJECTS, STORED
from accountlens.session import require_utc
from accountlens.sources.versions import Part, current


def _folders(spark: SparkSession, path: str, parts: tuple[Part, ...], layout: T.StructType, base: bool = False) -> DataFrame:
    """The rows of a table's live folders; of none, an empty frame."""
    if not parts:
        return spark.createDataFrame([], layout)
    reader = spark.read.schema(layout)
    return (reader.option("basePath", path) if base else reader).parquet(*[f"{path}/{part.folder}" for part in parts])


def event_parts(spark: SparkSession, root: str, table: str, parts: tuple[Part, ...], bounds: bool = False) -> DataFrame:
    """The declared columns and `event_date`; with `bounds`, those of the period as well, for readers of days."""
    schema = T.StructType([*EVENT_TABLES[table], STORED["event_date"]]) if table in EVENT_TABLES else DAILY_TABLES[table]
    layout = T.StructType([*schema, T.StructField("ingest_batch", T.StringType()), STORED["first_day"], STORED["last_day"]])
    rows = _folders(spark, f"{root}/{table}", parts, layout, base=True)
    return rows.select(*schema.names, *(["first_day", "last_day"] if bounds else []))


def collection_parts(spark: SparkSession, root: str, name: str, parts: tuple[Part, ...]) -> DataFrame:
    schema = collection_schema(name)
    frames = [_folders(spark, f"{root}/{name}", (part,), schema) for part in parts[:1]]
    if len(parts) > 1:
        layout = T.StructType([*schema, T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
        frames = [_folders(spark, f"{root}/{name}", parts, layout, base=True).select(*schema.names)]
    return frames[0] if frames else spark.createDataFrame([], schema)


def rejected_parts(spark: SparkSession, root: str, parts: tuple[Part, ...]) -> DataFrame:
    return _folders(spark, f"{root}/{REJECTED}", parts, T.StructType([*REJECTS, T.StructField("ingest_batch", T.StringType())]), base=True).drop("ingest_batch")


def _stored(spark: SparkSession, path: str, bounds: bool = False) -> DataFrame:
    root, _, table = path.rstrip("/").rpartition("/")
    return event_parts(spark, root, table, current(spark, root).parts(table), bounds)


def user_events(spark: SparkSession, path: str) -> DataFrame:
    """The 14 declared columns plus the day, `event_date`, as of now."""
    return _stored(spark, path)


def company_events(spark: SparkSession, path: str) -> DataFrame:
    """The 7 declared columns plus the day, `event_date`, as of now."""
    return _stored(spark, path)


def daily_events(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Sums per company, type and day of each batch, as of now; a day's are those of all its rows added up."""
    return _stored(spark, f"{root}/{DAILY[table]}", bounds=True)


def event_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON bodies, one per line of text files, as `body`."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def event_body_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of new files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.select(F.col("value").alias("body"))


def rejected_events(spark: SparkSession, path: str) -> DataFrame:
    """Bodies the ingest stream turned away, with the reason."""
    root = path.rstrip("/").rpartition("/")[0]
    return rejected_parts(spark, root, current(spark, root).parts(REJECTED))


def collection_schema(name: str) -> T.StructType:
    if name not in COLLECTIONS:
        raise ValueError(f"unknown collection {name!r}, expected one of {sorted(COLLECTIONS)}")
    return COLLECTIONS[name]


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The documents as of now."""
    return collection_parts(spark, root, name, current(spark, root).parts(name))


def company_names(spark: SparkSession, root: str) -> DataFrame:
    """The stored companies by name; those sharing a name are one."""
    names = collection(spark, root, "companies").select(F.col("name").alias("company"))
    return names.where(F.col("company").isNotNull()).distinct()


def event_model(spark: SparkSession, root: str) -> EventModel:
    """The stored tables as input of the cards."""
    require_utc(spark)
    return EventModel(
        lambda: _stored(spark, f"{root}/user_events", bounds=True),
        lambda: _stored(spark, f"{root}/company_events", bounds=True),
        lambda: company_names(spark, root),
        lambda: daily_events(spark, root, "user_events"),
        lambda: daily_events(spark, root, "company_events"),
    )


def first_users(directory: DataFrame, limit: int | None = None) -> DataFrame:
    """Users by e-mail; a falsy limit means all."""
    ordered = directory.orderBy("email", "company", "offset")
    return ordered.limit(int(limit)) if limit else ordered


def user_directory(directory: DataFrame, limit: int | None = None) -> DataFrame:
    """`email, company, offset` by e-mail; a falsy limit means all."""
    return first_users(directory.select("email", "company", "offset"), limit)


def run_query(spark: SparkSession, sql: str, args: dict[str, str] | None = None, **tables: DataFrame) -> DataFrame:
    """SQL text with named parameters (`:name`) over frames given as `{name}`."""
    return spark.sql(sql, args=args, **tables)


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: all documents, real ones (their identifying field is set), whether others exist.

    Each count reads one column.
    """

    def status(name: str, df: DataFrame) -> DataFrame:
        counts = df.agg(
            F.count("*").alias("total_documents"), F.count(IDENTITY[name]).alias("real_documents")
        )
        return counts.select(
            F.lit(name).alias("table_name"),
            "total_documents",
            "real_documents",
            (F.col("total_documents") > F.col("real_documents")).alias("has_placeholder"),
        )

    return reduce(DataFrame.unionByName, [status(name, df) for name, df in tables.items()])


def store_status(spark: SparkSession, root: str) -> DataFrame:
    """Status of every stored table."""
    stored = {name: collection(spark, root, name) for name in COLLECTIONS}
    stored["user_events"] = user_events(spark, f"{root}/user_events")
    stored["company_events"] = company_events(spark, f"{root}/company_events")
    return table_status(stored)
