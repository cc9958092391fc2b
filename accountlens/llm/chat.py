"""Preference formatting: a chosen and a rejected conversation as one prompt and two masked completions.

The longest common prefix of the two conversations' turns is rendered once, as the prompt; what is left of each is
its completion, with the spans of its assistant turns, on which alone a model is to be trained. Turns stay rows,
in one partitioning by pair, until the pair is put together; a pair is one training example and one row.

A turn is rendered as <|role|>, a line break, its text, <|end|> and a line break; a "<|" in a text becomes "< |",
so that no text can pose as a marker.

Defined cases: a null role is "unknown" and a null text is empty; turns are ordered by turn, role and text, so
repeated rows are repeated turns; a null pair_id takes no part; a pair without one of its sides is left out; equal
conversations have empty completions; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm.common import table

END = "<|end|>\n"
TRAINED = "assistant"


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of turns (pair_id, turn, role, text).

    A mask is the trained spans of the completion as start:end in code points, end exclusive, comma-joined.
    """
    sides = [df.select("pair_id", F.lit(side).alias("side"), "turn", "role", "text") for side, df in (("chosen", chosen), ("rejected", rejected))]
    header = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"))
    shown = F.concat("header", F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END))
    turns = sides[0].union(sides[1]).where("pair_id is not null").repartition("pair_id").withColumn("header", header).withColumn("shown", shown)
    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")))
    here = Window.partitionBy("pair_id", "place")
    same = (F.count("*").over(here) == 2) & (F.min("shown").over(here) == F.max("shown").over(here))
    split = placed.withColumn("same", same).withColumn("first", F.min(F.when(~F.col("same"), F.col("place"))).over(Window.partitionBy("pair_id")))
    common = F.col("first").isNull() | (F.col("place") < F.col("first"))
    parted = split.withColumn("part", F.when(common, "prompt").otherwise(F.col("side")))
    begin = F.sum(F.length("shown")).over(Window.partitionBy("pair_id", "side", "part").orderBy("place")) - F.length("shown")
    spans = F.concat_ws(":", begin + F.length("header"), begin + F.length("shown"))
    rows = parted.withColumn("span", F.when((F.col("part") != "prompt") & (F.col("role") == TRAINED), spans))

    def joined(side: str, part: str, what: str, by: str) -> Column:
        own = F.collect_list(F.when((F.col("side") == side) & (F.col("part") == part) & F.col(what).isNotNull(), F.struct("place", what)))
        return F.array_join(F.transform(F.array_sort(own), lambda x: x[what]), by)

    return (
        rows.groupBy("pair_id")
        .agg(
            F.count_if((F.col("side") == "chosen") & (F.col("part") == "prompt")).alias("n_prompt_turns"),
            joined("chosen", "prompt", "shown", "").alias("prompt"),
            joined("chosen", "chosen", "shown", "").alias("chosen"),
            joined("rejected", "rejected", "shown", "").alias("rejected"),
            joined("chosen", "chosen", "span", ",").alias("chosen_mask"),
            joined("rejected", "rejected", "span", ",").alias("rejected_mask"),
            F.count_distinct("side").alias("sides"),
        )
        .where("sides = 2")
        .drop("sides")
    )


def op10_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation up to its last assistant turn is chosen; rejected is the same with that turn's text taken
    from the partner conversation (2n and 2n + 1 are partners). Without such turns in both there is no pair."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where(F.col("role") == TRAINED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    swapped = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("other"))
    ends = last.join(swapped, "pair_id").select("pair_id", F.col("last.turn").alias("end"), "other")
    chosen = turns.join(ends, "pair_id").where((F.col("turn") < F.col("end")) | ((F.col("turn") == F.col("end")) & (F.col("role") == TRAINED)))
    kept = chosen.where(F.col("turn") < F.col("end")).select("pair_id", "turn", "role", "text")
    return preferences(chosen, kept.union(ends.select("pair_id", "end", F.lit(TRAINED), "other")))


OP10_SQL = r"""
WITH lasts AS (
  SELECT conv_id AS pair_id, turn AS fin, text AS own FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS r
    FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL) WHERE r = 1),
     ends AS (
  SELECT a.pair_id, a.fin, b.own AS other FROM lasts a JOIN lasts b
    ON b.pair_id = CASE WHEN a.pair_id % 2 = 0 THEN a.pair_id + 1 ELSE a.pair_id - 1 END),
     sides AS (
  SELECT 'chosen' AS side, e.pair_id, c.turn, c.role, c.text FROM ends e JOIN conversations c ON c.conv_id = e.pair_id
   WHERE c.turn < e.fin OR (c.turn = e.fin AND c.role = 'assistant')
  UNION ALL
  SELECT 'rejected', e.pair_id, c.turn, c.role, c.text FROM ends e JOIN conversations c ON c.conv_id = e.pair_id WHERE c.turn < e.fin
  UNION ALL
  SELECT 'rejected', pair_id, fin, 'assistant', other FROM ends),
     shown AS (
  SELECT *, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS header,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS shown,
         row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, role, text) AS place
  FROM sides),
     firsts AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id,
         min(coalesce(c.place, r.place)) FILTER (WHERE c.shown IS NULL OR r.shown IS NULL OR c.shown <> r.shown) AS first_place
  FROM (SELECT * FROM shown WHERE side = 'chosen') c
  FULL JOIN (SELECT * FROM shown WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.place = r.place GROUP BY 1),
     parts AS (
  SELECT s.*, f.first_place IS NULL OR s.place < f.first_place AS common FROM shown s JOIN firsts f ON f.pair_id = s.pair_id),
     offsets AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, common ORDER BY place) AS finish FROM parts)
SELECT pair_id,
       count(*) FILTER (WHERE side = 'chosen' AND common) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'chosen' AND common), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'chosen' AND NOT common), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'rejected' AND NOT common), '') AS rejected,
       coalesce(string_agg(CAST(finish - length(shown) + length(header) AS BIGINT) || ':' || CAST(finish AS BIGINT), ',' ORDER BY place)
         FILTER (WHERE side = 'chosen' AND NOT common AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(finish - length(shown) + length(header) AS BIGINT) || ':' || CAST(finish AS BIGINT), ',' ORDER BY place)
         FILTER (WHERE side = 'rejected' AND NOT common AND role = 'assistant'), '') AS rejected_mask
FROM offsets GROUP BY pair_id HAVING count(DISTINCT side) = 2
"""
