"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source is to have its weight's share of all words, but no more than `epochs` times its own. Sources above
that cap are clamped to it and the words they can't take go to the others by weight, again and again until none
is above its cap; such a round is one sum over the sources and hands the driver three numbers. A target is then
so many whole repetitions of a source and a rest. For the rest, the source's documents are put in a seeded order
(a digest of seed, id and text) and taken from the first on; the one at which the rest ends gives its first words
only, so that a source meets its target to the word.

No source's documents are ordered in one place: the digest's first 32 bits deal them to about as many bins as the
square root of their number, sums by source and bin (combined map-side) give each bin the words before it, and
only a bin's rows are put in order.

Defined cases: a null text has no words; a null source is a source of its own, the last one; a null doc_id is
mixed like any other; of rows equal in id, source and text any may come first, which changes no result row; a
source without words takes none; an empty table gives an empty result; other columns are ignored unless kept.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm.common import staged, table
from accountlens.operators.numbering import running_number

EPOCHS, SEED, CYCLE = 3, 11, 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the number of words, the place in the seeded order, and the columns to keep as one."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        *([F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []),
    )


def cycled(sources: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Adds `weight`: 1, 2, ... `cycle`, 1, ... by code point of the source, a null last."""
    ranked = running_number(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    return ranked.withColumn("weight", (F.col("_rank") - 1) % cycle + 1).drop("_null", "_rank")


def targets(sources: DataFrame, epochs: int = EPOCHS, total: int | None = None) -> DataFrame:
    """Adds `target` to (source, source_size, weight): of `total` words (default: all there are), by water-filling.

    Weights are whole numbers. Shares are compared as products of whole numbers, so the result is the same
    whatever the order of the sums; words times weights may have 38 digits.
    """
    wide = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast("decimal(19,0)")
    capped = sources.withColumn("_cap", F.col("source_size") * epochs)
    words, weight = capped.agg(F.sum("source_size"), F.sum("weight")).first()
    words, clamped = (total if total is not None else words) or 0, 0
    every, everything, weight = weight, words, weight or 0
    while True:
        above = F.lit(weight <= 0) | (wide("_cap") * wide(weight) <= wide("weight") * wide(words))
        row = capped.where(above).agg(F.count("*"), F.sum("_cap"), F.sum("weight")).first()
        if row[0] == clamped:
            break
        clamped, words, weight = row[0], everything - row[1], every - row[2]
    level: Column = (wide("weight") * wide(words)).cast("double") / F.lit(float(max(weight, 1)))
    return capped.withColumn("target", F.when(above, F.col("_cap").cast("double")).otherwise(level)).drop("_cap")


def mix(documents: DataFrame, weighted: DataFrame, epochs: int = EPOCHS, total: int | None = None) -> DataFrame:
    """documents as `sized` gives them; weighted: (source, source_size, weight). documents is read twice: stage it.

    Adds source_size, target, copies (whole repetitions), part (words of one more, from its first) and taken.
    """
    quota = F.round("target").cast("long")
    plan = targets(weighted, epochs, total).select(
        F.struct("source").alias("_group"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV source_size")).otherwise(0).alias("copies"),
        F.when(F.col("source_size") > 0, quota % F.col("source_size")).otherwise(0).alias("_rest"),
    )
    bins = 16 + isqrt(documents.count())
    front = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = documents.withColumns({"_group": F.struct("source"), "_bin": F.shiftright(front * bins, 32)})
    sums = dealt.groupBy("_group", "_bin").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words").join(plan, "_group")
    inside = Window.partitionBy("_group", "_bin").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = dealt.join(offsets, ["_group", "_bin"]).withColumn("_at", F.col("_before") + own)
    part = F.greatest(F.lit(0), F.least("size", F.col("_rest") - F.col("_at")))
    mixed = placed.withColumn("part", part).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    return mixed.select(*documents.columns, "source_size", "target", "copies", "part", "taken")


def repetitions(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row (doc_id, source, repetition, text) for each repetition; `text` was kept by `sized`."""
    each = mixed.withColumn("repetition", F.explode(F.expr("sequence(1, CAST(copies + least(part, 1) AS INT))")))
    each = each.where("copies + part > 0 AND repetition > 0")
    words = F.regexp_extract_all("kept.text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    first = F.array_join(F.slice(words, 1, F.col("part").cast("int")), "")
    text = F.when(F.col("repetition") <= F.col("copies"), F.col("kept.text")).otherwise(first)
    return each.select("doc_id", "source", "repetition", text.alias("text"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = staged(sized(table(spark, sf_dir, "documents")), "sizes")
    sources = staged(cycled(documents.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    return mix(documents, sources).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "part")


OP11_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT 0 AS round, CAST(-1 AS HUGEINT) AS clamped_before, CAST(0 AS HUGEINT) AS clamped,
         CAST((SELECT sum(source_size) FROM sources) AS HUGEINT) AS words, CAST((SELECT sum(weight) FROM sources) AS HUGEINT) AS weight
  UNION ALL
  SELECT f.round + 1, f.clamped, r.clamped, r.words, r.weight
  FROM filling f, LATERAL (
    SELECT count(*) FILTER (above) AS clamped, sum(source_size) - coalesce(sum(3 * source_size) FILTER (above), 0) AS words,
           coalesce(sum(weight) FILTER (NOT above), 0) AS weight
    FROM (SELECT *, f.weight = 0 OR 3 * source_size * f.weight <= weight * f.words AS above FROM sources)
  ) r
  WHERE f.clamped <> f.clamped_before
), level AS (
  SELECT words, weight FROM filling ORDER BY round DESC LIMIT 1
), planned AS (
  SELECT s.source, s.source_size,
         CASE WHEN l.weight = 0 OR 3 * s.source_size * l.weight <= s.weight * l.words THEN CAST(3 * s.source_size AS DOUBLE)
              ELSE CAST(s.weight * l.words AS DOUBLE) / CAST(l.weight AS DOUBLE) END AS target
  FROM sources s, level l
), parted AS (
  SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN CAST(round(p.target) AS BIGINT) // p.source_size ELSE 0 END AS copies,
         CASE WHEN p.source_size > 0 THEN CAST(round(p.target) AS BIGINT) % p.source_size ELSE 0 END AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, source, copies,
       CAST(greatest(0, least(size, rest - earlier)) AS BIGINT) AS part,
       CAST(copies * size + greatest(0, least(size, rest - earlier)) AS BIGINT) AS taken
FROM parted
"""
