"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. Of two fingerprints within the allowed distance, at least one segment
is so close that a small Hamming ball around it holds the other's segment (the pigeonhole principle), so
every fingerprint looks up the balls of its segments in tables keyed by segment and checks whole
distances. Equal fingerprints are one entry. A table slot with many entries is cut into a grid of cells of
bounded size, and a cell hands on a spanning forest of its links, not the links themselves, so a group of
n near copies makes about n rows.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than
a shingle are one shingle; a null doc_id is fingerprinted and links others, but is nobody's component_id
(null if no other id is reachable); repeated rows each get their row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from accountlens.llm.common import staged, table, utf8, words_of
from accountlens.llm.components import components

BITS = 64
#: Entries of a table slot, or lookups in it, that meet in one cell.
CELL = 1024
#: Pairs compared and shingles counted in one step of a task.
STEP = 1 << 20


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """Bit by bit the majority of the shingles' XXH64 values, as an unsigned number."""
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    slices = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    values = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in slices], "<u8")
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(values), STEP // BITS):
        part = values[first : first + STEP // BITS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(values)).tolist())


def _fingerprinter(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(words_of(text and text.lower()), shingle, seed) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprinter(shingle, seed), "doc_id long, fp long")


def segments(distance: int, pieces: int) -> list[tuple[int, int, list[int]]]:
    """(shift, mask, ball): where each segment lies, and the bits to flip in it for its lookups.

    With distance = pieces * a + b, some of the first b + 1 segments differs by at most a bits, or one of the
    others by at most a - 1. Of two entries that differ by a flip, the one with the flip's lowest bit set looks
    up the other.
    """
    a, b = divmod(distance, pieces)
    cuts = [BITS * i // pieces for i in range(pieces + 1)]
    out = []
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        radius = a if i <= b else a - 1
        if radius >= 0:
            ball = [sum(1 << bit for bit in bits) for r in range(radius + 1) for bits in combinations(range(low, high), r)]
            out.append((low, (1 << high) - (1 << low), ball))
    return out


def _lookups(layout: list[tuple[int, int, list[int]]]):
    """A row for each entry of a segment's table (entry true) and for each lookup in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, (low, mask, ball) in enumerate(layout):
                own = (fps & np.uint64(mask)) >> np.uint64(low)
                for kind in ["entry", *ball]:
                    flip = 0 if kind == "entry" else kind
                    asks = fps if not flip else fps[(fps & np.uint64(flip & -flip)) != 0]
                    slot = own if not flip else ((asks ^ np.uint64(flip)) & np.uint64(mask)) >> np.uint64(low)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(asks), number, np.int8)), pa.array(slot.view(np.int64)), pa.array(asks.view(np.int64)), pa.array(np.full(len(asks), kind == "entry"))],
                        names=["segment", "slot", "fp", "entry"],
                    )

    return run


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node reachable) that connect what the links (u, v) connect."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = where[: len(u)], where[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        if (label[a] == label[b]).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]


def near_pairs(run: np.ndarray, fps: np.ndarray, entry: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different fingerprints within the distance, an entry and a lookup of the same run, step by step."""
    sizes = np.bincount(run[entry], minlength=run.max() + 1 if len(run) else 0)
    table_fps = fps[entry]  # in the order of the runs
    first = np.concatenate([[0], np.cumsum(sizes)])
    asks, ask_run = fps[~entry], run[~entry]
    used = sizes[ask_run] > 0
    asks, ask_run = asks[used], ask_run[used]
    done = np.cumsum(sizes[ask_run])
    at = 0
    while at < len(asks):
        until = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP, side="right")))
        n = sizes[ask_run[at:until]]
        left = np.repeat(asks[at:until], n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        right = table_fps[np.repeat(first[ask_run[at:until]], n) + within]
        differ = np.bitwise_count(left ^ right)
        near = (differ > 0) & (differ <= distance)
        if near.any():
            yield left[near], right[near]
        at = until


def _linker(distance: int):
    """Rows sorted by segment, slot and cell; a run of equal ones is compared when it is complete."""

    def compared(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        segment, slot, cell, fps, entry = columns
        new = (segment[1:] != segment[:-1]) | (slot[1:] != slot[:-1]) | (cell[1:] != cell[:-1])
        run = np.concatenate([[0], np.cumsum(new)])
        for left, right in near_pairs(run, fps.view(np.uint64), entry.astype(bool), distance):
            u, v = forest(left.view(np.int64), right.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
            last = np.ones(len(columns[0]), bool)
            for key in columns[:3]:
                last &= key == key[-1]
            cut = int(len(last) - last.sum())
            if cut:
                yield from compared([column[:cut] for column in columns])
            rest = [column[cut:] for column in columns]
        if rest is not None:
            yield from compared(rest)

    return run


def links(distinct: DataFrame, distance: int, pieces: int = 3) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints (column fp, no repeats) that chains of near ones connect."""
    rows = distinct.select("fp").mapInArrow(_lookups(segments(distance, pieces)), "segment byte, slot long, fp long, entry boolean")
    full = rows.where("entry").groupBy("segment", "slot").count().where(F.col("count") > CELL)
    side = full.select("segment", "slot", F.ceil(F.col("count") / CELL).cast("int").alias("side"))
    cut = rows.join(side, ["segment", "slot"], "left").withColumn("side", F.coalesce("side", F.lit(1)))
    own, other = F.pmod(F.xxhash64("fp"), F.col("side")), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    cells = cut.select("*", other.alias("other")).select(
        "segment", "slot", F.when(F.col("entry"), own * F.col("side") + F.col("other")).otherwise(F.col("other") * F.col("side") + own).alias("cell"), "fp", "entry"
    )
    keys = ["segment", "slot", "cell"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linker(distance), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int, distance: int, pieces: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text); chains of links form a component.

    pieces: segments of a fingerprint. Three suit up to some hundred million distinct fingerprints; with more,
    two make longer keys and larger balls.
    """
    marked = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, distance, pieces))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    chained = grouped.join(least, "root").select("fp", F.col("component_id").alias("chained"))
    known = distinct.join(chained, "fp", "left").select("fp", F.coalesce("chained", "least").alias("component_id"))
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
