"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, and each segment has a table of the codes by the segment's value. Round s looks up, for
each query that is not finished, all values at s flipped bits from its segments' values. After round s every code within
SEGMENTS * (s + 1) - 1 bits is found, so a query is finished once its k-th verified distance is not above that.

Equal codes are one entry with their k + 1 smallest ids (one may be the query itself), and equal queries are searched
once, so a vector that a third of all rows share is one table entry and one query. Of what a query has found, only its
best k + 1 entries are kept from round to round, and a task gives a query's best k + 1 that are no farther than the k-th
so far. Lookups are made in the tasks: a query is sent once to each group of codes in which values may lie, so neither
lookups nor codes that were found and are too far are shuffled.

Defined cases: null vectors are neither queries nor found, a null id neither; other than 64 numbers a vector has its
first 64 taken, missing ones and nulls count as not positive; repeated rows of an id are one; ties go to the smaller
id; fewer than k other ids give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm.common import staged, table
from accountlens.session import checkpointed

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: First bits of a segment's value by which codes and queries meet in a group; the others are looked up in its task.
FRONT = 4
#: Codes of a group; more are dealt to several, and a query goes to each.
GROUP_CODES = 500_000
#: Lookups, and codes verified, at a time.
STEP = 1 << 18


def sign_code(vector: Column) -> Column:
    """A bit for each of the first 64 numbers: whether it is positive."""

    def bit(i: Column) -> Column:
        return F.when(F.coalesce(F.get(vector, i) > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda sum_, i: sum_.bitwiseOR(bit(i)))


def segment(code: Column, number: int) -> Column:
    return F.shiftrightunsigned(code, number * WIDTH).bitwiseAND((1 << WIDTH) - 1)


def fronts(codes: DataFrame, name: str, flips: list[int]) -> DataFrame:
    """A row of codes for each segment and flip of its front, with both numbers."""
    values = F.array(*[F.struct(F.lit(i).alias("segment"), F.shiftright(segment(F.col(name), i), WIDTH - FRONT).cast("int").alias("own")) for i in range(SEGMENTS)])
    rows = codes.select("*", F.explode(values).alias("s"))
    flip = F.explode(F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>"))
    return rows.select("*", flip.alias("flip")).select(*codes.columns, "s.segment", F.col("s.own").bitwiseXOR(F.col("flip")).alias("front"))


def best_of(who: np.ndarray, apart: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k first entries of each query, and their places from 0."""
    order = np.lexsort((least, apart, who))
    new = np.ones(len(order), bool)
    new[1:] = who[order[1:]] != who[order[:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[place < k], place[place < k]


def _lookups(radius: int, k: int):
    """Looks up the values at `radius` flipped bits in a group of codes with one front; gives a query's k best."""
    back = WIDTH - FRONT
    weights = np.bitwise_count(np.arange(1 << back))

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        code, least, n = (entries[c].to_numpy() for c in ("code", "least", "n"))
        query, limit = asked["query"].to_numpy(), asked["bound"].to_numpy().copy()
        code, query = code.view(np.uint64), query.view(np.uint64)  # of signed numbers numpy counts the bits of the amount
        found = [(np.zeros(0, np.int64),) * 3]
        if len(code) and len(query):
            number, front = asked["segment"][0].as_py(), asked["front"][0].as_py()
            own, value = ((x >> np.uint64(number * WIDTH)).astype(np.int64) & ((1 << WIDTH) - 1) for x in (code, query))
            low = own & ((1 << back) - 1)
            order = np.argsort(low)
            code, least, n = code[order], least[order], n[order]
            first = np.searchsorted(low[order], np.arange((1 << back) + 1))
            away = np.bitwise_count((value >> back) ^ front)
            for there in range(max(0, radius - back), min(radius, FRONT) + 1):
                masks = np.flatnonzero(weights == radius - there)
                rows, step = np.flatnonzero(away == there), max(1, STEP // len(masks))
                for own_rows in (rows[i : i + step] for i in range(0, len(rows), step)):
                    found.append(_verified(own_rows, (value[own_rows, None] & ((1 << back) - 1)) ^ masks, first, query, code, least, limit, k))
        who, at, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": query[who].view(np.int64), "code": code[at].view(np.int64), "n": n[at], "least": least[at], "apart": apart.astype(np.int32)})

    return run


def _verified(rows, values, first, query, code, least, limit, k: int):
    """(row of the query, place of the code, distance): the k best found at a query's values, none above its limit."""
    starts = first[values].ravel()
    counts = first[values + 1].ravel() - starts
    who, ends = np.repeat(rows, values.shape[1]), np.cumsum(counts)
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(STEP, ends[-1], STEP)), len(ends)])
    kept = (np.zeros(0, np.int64),) * 3
    for a, b in zip(cuts, cuts[1:], strict=False):
        many = counts[a:b]
        at = np.arange(many.sum()) + np.repeat(starts[a:b] - ends[a:b] + many + (ends[a - 1] if a else 0), many)
        asking = np.repeat(who[a:b], many)
        apart = np.bitwise_count(query[asking] ^ code[at]).astype(np.int64) if len(at) else at
        near = apart <= limit[asking]
        kept = tuple(np.concatenate([x, y[near]]) for x, y in zip(kept, (asking, at, apart), strict=True))
        chosen, place = best_of(kept[0], kept[2], least[kept[1]], k)
        kept = tuple(x[chosen] for x in kept)
        last = place == k - 1
        limit[kept[0][last]] = kept[2][last]  # k entries are no farther, so what is farther is not needed
    return kept


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, code, apart, least): for each query code at least the entries that hold its k nearest ids.

    codes: (code, ids, least), ids the k smallest of the code, least the smallest; queries: (query).
    """
    best = Window.partitionBy("query").orderBy("apart", "least")
    up_to = best.rowsBetween(Window.unboundedPreceding, 0)
    entries = codes.count()
    slots = fronts(codes.select("code", F.size("ids").alias("n"), "least"), "code", [0])
    # One row for each segment and front, 64 at most.
    shares = F.broadcast(checkpointed(slots.groupBy("segment", "front").agg((F.floor(F.count("*") / GROUP_CODES) + 1).cast("int").alias("shares"))))
    key = ["segment", "front", "share"]
    grouped = slots.join(shares, key[:2]).withColumn("share", F.pmod(F.xxhash64("code"), "shares").cast("int")).drop("shares").groupBy(*key)
    active, found, finished = queries.withColumn("bound", F.lit(BITS)), None, None
    for radius in range(WIDTH + 1):
        flips = [x for x in range(1 << FRONT) if 0 <= radius - x.bit_count() <= WIDTH - FRONT]
        asked = fronts(active, "query", flips).join(shares, key[:2])
        asked = asked.select("query", "bound", *key[:2], F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        hits = grouped.cogroup(asked.groupBy(*key)).applyInArrow(_lookups(radius, k), "query long, code long, n int, least long, apart int")
        if found is not None:
            hits = hits.union(found.join(active, "query", "left_semi").select(hits.columns))
        merged = hits.groupBy("query", "code").agg(F.min("n").alias("n"), F.min("least").alias("least"), F.min("apart").alias("apart"))
        kept = merged.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        found = checkpointed(kept.withColumn("sum", F.sum("n").over(up_to)).select("query", "code", "n", "least", "apart", "sum"))
        covered = SEGMENTS * (radius + 1) - 1
        kth = found.groupBy("query").agg(F.min(F.when(F.col("sum") >= k, F.col("apart"))).alias("kth"), F.count("*").alias("had"))
        done = kth.where((F.col("kth") <= covered) | (F.lit(covered) >= BITS) | (F.col("had") >= entries)).select("query")
        found = found.select("query", "code", "n", "least", "apart")
        part = found.join(done, "query", "left_semi")
        finished = part if finished is None else finished.union(part)
        left = active.select("query").join(done, "query", "left_anti").join(kth, "query", "left")
        active = checkpointed(left.select("query", F.coalesce("kth", F.lit(BITS)).cast("int").alias("bound")))
        if active.isEmpty():
            break
    return finished.select("query", "code", "apart", "least")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, place, vec_id, distance): the k nearest other ids of each query by Hamming distance, exactly.

    vectors and queries: (vec_id, code); a query that is a vector itself doesn't find its own id.
    """
    known = vectors.where("vec_id is not null and code is not null").distinct()
    least = Window.partitionBy("code").orderBy("vec_id")
    few = known.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    codes = checkpointed(few.groupBy("code").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("least", F.col("ids")[0]))
    asked = queries.where("vec_id is not null and code is not null").select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).distinct()
    near = nearest_codes(codes, checkpointed(asked.select("query").distinct()), k + 1)
    ids = near.join(codes.select("code", "ids"), "code").select("query", "apart", F.explode("ids").alias("vec_id"))
    first = ids.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("apart", "vec_id"))).where(F.col("place") <= k + 1)
    lists = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("apart").alias("distance"), "vec_id"))).alias("found"))
    others = asked.join(lists, "query").withColumn("found", F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k))
    return others.select("query_id", F.posexplode("found").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.vec_id", "x.distance")


def op4_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each vector whose id is divisible by 20, among all others, by the signs of the numbers."""
    coded = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("embedding").isNotNull(), sign_code(F.col("embedding"))).alias("code"))
    coded = staged(coded, "codes")
    return top_k(coded, coded.where("vec_id % 20 = 0"), 10)


OP4_SQL = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, e.vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(coalesce(q.embedding[i] > 0, FALSE) <> coalesce(e.embedding[i] > 0, FALSE) AS INTEGER))) AS INTEGER) AS distance
  FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM pairs)
WHERE place <= 10
"""
