"""Token counts as delta-maintained rollups.

A batch is a set of signed rows: +1 inserts a document's count, -1 takes one back, and a revised count is the old
one taken back and the new one inserted. Only the sums of a batch by source, language and tokenizer version are
kept, one file set per batch, and totals are the sums over the batches. Sums are additive, so batches may be
committed in any order, and they combine before any shuffle, so a hot source costs no more than another.

A batch has a name. Committing writes the partition of that name anew and nothing else, so a repeated commit,
after a lost driver for instance, changes nothing. compacted() folds all batches into one, which keeps their names:
a repeated commit of a folded batch does nothing.

Defined cases: a null text has no tokens and is counted as a document; null source, language or tokenizer are
groups of their own; repeated rows count each; groups whose documents and tokens are all taken back disappear from
the totals; an empty batch is a committed batch; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountlens.llm.common import staged, table
from accountlens.session import new_shared_path

GROUP = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, holds string, batch string"

#: The tokenizer versions: what a token is. Version 1 takes runs of anything but blanks, version 2 cuts words,
#: digits and marks apart.
TOKENIZERS = {"blank-1": r"[^\x20\x09-\x0D]+", "class-2": r"[\p{L}\p{M}]+|[0-9]|[^\p{L}\p{M}0-9\x20\x09-\x0D]"}


def n_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of each row of docs."""
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens(F.col("text"), tokenizer).alias("tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select("*", F.lit(1).alias("sign"))


def deletes(counted: DataFrame) -> DataFrame:
    """Takes back what was inserted: the rows are the inserted ones."""
    return counted.select("*", F.lit(-1).alias("sign"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that give way to others, of another text or tokenizer version for instance."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals by source, language and tokenizer version in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, batch: str, signed: DataFrame) -> None:
        """Add the signed rows under the batch's name; a repeated commit of a name replaces the first, or does nothing if
        the first was folded."""
        if self.holds(batch):
            return
        sums = signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        # A batch without a row still leaves its partition: a marker that adds nothing.
        none, nothing = F.lit(None).cast("string"), F.lit(0).cast("long")
        marker = self.spark.range(1).select(*[none.alias(name) for name in GROUP], nothing.alias("documents"), nothing.alias("tokens"))
        self._write(sums.unionByName(marker).withColumns({"holds": none, "batch": F.lit(batch)}))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(DELTA).parquet(self.path)

    def holds(self, batch: str) -> bool:
        """Whether the batch was folded into another."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return False  # nothing was committed yet
        return bool(self.deltas().where(F.col("holds") == batch).take(1))

    def batches(self) -> DataFrame:
        """The names of all batches, the folded ones too."""
        return self.deltas().select(F.coalesce("holds", "batch").alias("batch")).distinct()

    def totals(self, without: Iterable[str] = ()) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens), but for the named batches."""
        rows = self.deltas().where(~F.col("batch").isin(list(without)))
        sums = rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compacted(self, path: str, batch: str = "compacted") -> Rollup:
        """A rollup in another folder with the same totals in one batch, which holds the names of all; readers and
        writers change over when it is complete."""
        other = Rollup(self.spark, path)
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
        names = self.batches().select(*[none.alias(name) for name in GROUP], zero.alias("documents"), zero.alias("tokens"), F.col("batch").alias("holds"))
        other._write(self.totals().withColumn("holds", none).unionByName(names).withColumn("batch", F.lit(batch)))
        return other


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents inserted under version 1, those labelled toxic deleted, and those
    labelled of low quality (and not toxic) revised to version 2. The last two batches are committed twice."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    sizes = docs.select("doc_id", "source", "lang", *[n_tokens(F.col("text"), name).alias(name) for name in TOKENIZERS])
    marked = staged(sizes.join(labels, "doc_id", "left"), "counts")

    def counted(rows: DataFrame, tokenizer: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("tokens"))

    first, second = TOKENIZERS
    toxic, low = marked.where("toxic = 1"), marked.where("quality = 0 and not toxic <=> 1")
    rollup = Rollup(spark, new_shared_path(spark, "rollup"))
    rollup.commit("1-insert", inserts(counted(marked, first)))
    for _ in range(2):
        rollup.commit("2-delete", deletes(counted(toxic, first)))
        rollup.commit("3-revise", revisions(counted(low, first), counted(low, second)))
    return rollup.totals()


OP9_SQL = r"""
WITH marks AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
     kept AS (
  SELECT d.source, d.lang, d.text, coalesce(m.quality, 1) = 0 AS revised
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
  WHERE coalesce(m.toxic, 0) <> 1),
     counted AS (
  SELECT source, lang, CASE WHEN revised THEN 'class-2' ELSE 'blank-1' END AS tokenizer,
         CASE WHEN revised THEN len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}]+|[0-9]|[^\p{L}\p{M}0-9\x20\x09-\x0D]'))
              ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END AS tokens
  FROM kept)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens
FROM counted GROUP BY source, lang, tokenizer
"""
