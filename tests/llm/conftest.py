import duckdb
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ["key", "tag", "fp", "spans", "length", "ids", "piece", "score", "lang_pred", "component_id", "kept_id", "leak_id", "found_id", "TAG2", "word", "size", "part", "target", "phrase", "slice", "chunk"]

ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, None),
    (3, "   \t\n ", None, "a", 6),
    (4, "one", "en", "a", 3),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (6, LONG, "en", "b", len(LONG)),
    (None, LONG, "en", "b", None),
    (None, None, None, None, None),
    (7, "Ünïcödé     x́ \U0001f600 a\x1fb a\x0bb", "de", "c", 20),
    (8, "123 456 !!! ???", "xx", "c", 15),
    (9, "word0 tail0", "fr", "c", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD, COLUMNS)
    return rows.select("*", *[F.lit("clash").alias(name) for name in CLASHING])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def texts(sf_dir):
    """doc_id to text."""
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall())
