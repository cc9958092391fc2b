"""Packing documents into sequences: linear grouping of the large pieces, best fit of the small ones.

Spark cuts documents into pieces and counts the pieces of each length; that histogram, of at most `capacity`
numbers however many documents there are, is all that the planner sees. The planner ranks large pieces by
length, cuts the ranking into groups of equal cardinality and rounds lengths up to the longest of the group.
For the few sizes left it chooses configurations, each the fullest around the largest size not yet packed, and
uses each as often as the sizes last. Then actual lengths replace the rounded ones, and small pieces go, the
longest first, where they fit best. Everything is kept as runs: so many pieces of one length, from such a
number on, go to so many consecutive sequences. Spark numbers the pieces of each length, and a piece finds its
run by length and number.

Defined cases: a null or empty text is the closing id alone; a null doc_id is packed like any other; repeated
rows are packed each; ties are broken by hash, id and piece, and any outcome of a tie is a valid packing; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm.common import parts, staged, table, utf8
from accountlens.llm.tokens import word_tokenizer

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
CLOSING = (0).to_bytes(4, "little")
#: Bytes of text tokenized together.
SLICE = 4 << 20
#: Pieces of more than capacity / LARGE tokens are grouped, in so many groups.
LARGE, GROUPS = 6, 128


def _cutter(name: str, capacity: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(name)
        for batch in batches:
            for part in parts(batch, 1, SLICE):
                row, piece, length, ids = [], [], [], []
                for i, found in enumerate(tokenizer.ids_of(utf8(part.column(1)))):
                    whole = memoryview(found + CLOSING)
                    for number, first in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[first : first + 4 * capacity]
                        row.append(i)
                        piece.append(number)
                        length.append(len(own) // 4)
                        ids.append(zlib.crc32(own) if digest else bytes(own))
                number = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(number),
                        pa.array(number.astype(np.int64) * capacity),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.int64() if digest else pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids) of docs (doc_id, text); ids: little-endian unsigned 32-bit numbers.

    With `digest` only their checksum, ids_crc32, leaves the workers.
    """
    out = f"doc_id long, piece int, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}"
    return docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, capacity, digest), out)


class Plan:
    """Runs (length, first, count, sequence, offset): pieces first, first + 1, ... of a length go to sequence,
    sequence + 1, ... at an offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # by free tokens, runs (first sequence, count)
        self.sizes: list[int] = []  # the keys of room, sorted
        lengths = sorted(counts, reverse=True)
        self.large([(x, counts[x]) for x in lengths if x * LARGE > capacity])
        for x in lengths:
            if x * LARGE <= capacity:
                self.small(x, counts[x])

    def free(self, size: int, first: int, count: int) -> None:
        if size and count:
            if size not in self.room:
                bisect.insort(self.sizes, size)
            self.room.setdefault(size, []).append((first, count))

    def configurations(self, sizes: list[int], demand: list[int]) -> Iterator[tuple[dict[int, int], int]]:
        """Groups with the pieces of each in a sequence, and how many sequences are filled so."""
        left = list(demand)
        for largest in range(len(sizes)):
            while left[largest]:
                space = self.capacity - sizes[largest]
                by: list[tuple[int, int] | None] = [None] * (space + 1)  # what last reached a fill
                reached = np.zeros(space + 1, bool)
                reached[0] = True
                for g in range(largest, len(sizes)):
                    most = min(left[g] - (g == largest), space // sizes[g])
                    before = reached.copy()
                    for copies in range(1, most + 1):
                        moved = np.zeros_like(reached)
                        moved[copies * sizes[g] :] = before[: space + 1 - copies * sizes[g]]
                        for fill in np.flatnonzero(moved & ~reached).tolist():
                            by[fill] = (g, copies)
                        reached |= moved
                    if reached[space]:
                        break
                fill = int(np.flatnonzero(reached)[-1])
                chosen = {largest: 1}
                while fill:
                    g, copies = by[fill]
                    chosen[g] = chosen.get(g, 0) + copies
                    fill -= copies * sizes[g]
                times = min(left[g] // n for g, n in chosen.items())
                for g, n in chosen.items():
                    left[g] -= n * times
                yield chosen, times

    def large(self, counts: list[tuple[int, int]]) -> None:
        """counts: (length, pieces), falling."""
        total = sum(n for _, n in counts)
        if not total:
            return
        ends = np.cumsum([n for _, n in counts])
        of = lambda rank: int(np.searchsorted(ends, rank, side="right"))  # noqa: E731  where a rank's length is
        cuts = sorted({total * g // GROUPS for g in range(GROUPS + 1)})
        sizes = [counts[of(cut)][0] for cut in cuts[:-1]]
        taken = cuts[:-1]
        for chosen, times in self.configurations(sizes, [b - a for a, b in zip(cuts, cuts[1:], strict=False)]):
            slots = []
            for g, n in chosen.items():
                slots += [taken[g] + times * i for i in range(n)]
                taken[g] += n * times
            done = 0
            while done < times:  # as far as no slot's length changes
                at = [of(slot + done) for slot in slots]
                step = min([times - done, *(int(ends[k]) - slot - done for k, slot in zip(at, slots, strict=True))])
                offset = 0
                for k, slot in zip(at, slots, strict=True):
                    length, n = counts[k]
                    self.runs.append((length, slot + done - int(ends[k]) + n, step, self.sequences, offset))
                    offset += length
                self.free(self.capacity - offset, self.sequences, step)
                self.sequences += step
                done += step

    def small(self, length: int, count: int) -> None:
        number = 0
        while number < count:
            at = bisect.bisect_left(self.sizes, length)
            if at == len(self.sizes):
                per = self.capacity // length
                opened = max(1, (count - number) // per)
                self.free(self.capacity, self.sequences, opened)
                self.sequences += opened
                continue
            size = self.sizes[at]
            first, n = self.room[size].pop()
            if not self.room[size]:
                del self.room[size], self.sizes[at]
            used = min(n, count - number)
            self.runs.append((length, number, used, first, self.capacity - size))
            self.free(size, first + used, n - used)
            self.free(size - length, first, used)
            number += used


def _finder(runs: np.ndarray):
    """Adds sequence_id and offset; the last two columns are a piece's length and its number among that length's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of_length = np.searchsorted(runs[:, 0], np.arange(runs[-1, 0] + 2)) if len(runs) else np.zeros(1, np.int64)
        for batch in batches:
            length, number = (batch.column(batch.num_columns - i).to_numpy(zero_copy_only=False) for i in (2, 1))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own, (a, b) = length == x, first_of_length[x : x + 2]
                at[own] = a - 1 + np.searchsorted(runs[a:b, 1], number[own], side="right")
            found = [pa.array(runs[at, 3] + number - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + found, names=batch.schema.names[:-2] + ["sequence_id", "offset"])

    return run


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut, which has doc_id, piece and length, with sequence_id and offset. It is read twice: stage what is dear."""
    counts = {row.length: row["count"] for row in cut.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(counts.values())
    plan = Plan(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    salt: Column = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(16 + isqrt(total)))
    salted = cut.withColumn("_salt", salt)
    per_salt = salted.groupBy("length", "_salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_salt.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.join(offsets, ["length", "_salt"]).withColumn("_number", F.col("_before") + own)
    rows = numbered.select(*cut.columns, F.col("length").alias("_length"), F.col("_number").cast("long"))
    schema = rows.select(*cut.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return rows.mapInArrow(_finder(runs), schema)


def op3_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(staged(pieces(table(spark, sf_dir, "documents"), digest=True), "pieces"))
