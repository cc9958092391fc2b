"""Language-model scoring by a weighted backoff automaton.

States are words, arcs all bigrams, with discounted probabilities mixed with the word's own; where a state has no arc for
the next word, its failure arc, weighted with the mass left over, leads to the empty state, which has an arc for every
word (the base probability, with room for unknown ones). The probabilities of a state's successors sum to one. A text is
read once from left to right: the state is carried along, arc and failure weights add up, and the end token closes it. A
text starts in the end token's state.

Texts are read once, and kept in slices: rows of some megabytes of text, each with its distinct words and its tokens as
numbers of these. A slice asks for what its distinct bigrams count in all, and then its distinct words; what it knows of
them itself is part of the question. Questions are dealt to buckets by hash, summed there and answered in their order. A
key is asked for once by a slice, however often the slice has it, so no bigram or word makes a hot bucket, and nothing but
single counts comes to the driver. The number of a state's arcs is summed with the words: one of the slices that teach a
bigram is told that it is the first, and adds it to its state.

Words are known by 64-bit hashes of their lower-cased bytes, bigrams by a mix of two of these.

Defined cases: a null text is empty, an empty text is one end token; a null doc_id is not held out; repeated rows are
scored, and teach, each; with nothing to learn from every token has the probability of an unknown one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from accountlens.llm.common import BASE, MIX, parts, staged, table, utf8, words_of

#: What is taken off an arc's count.
DISCOUNT = 0.75
#: Bytes of text in a slice; buckets at least, and questions in a bucket in the mean.
SLICE, BUCKETS, BUCKET = 8 << 20, 1024, 2_000_000
END = b""
SLICES = "docs array<long>, teaches binary, scored binary, sizes binary, words binary, tokens binary, taught long, arcs long"
ASKED = "bucket int, slice long, n int, keys binary, values array<binary>"
ANSWERED = "bucket int, slice long, n int, firsts long, sums array<binary>, first binary"
COUNTED = "slice long, words binary, counts binary, own_arcs binary"
READ = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.array([xxh64_intdigest(word) for word in words], np.uint64)


def tokens(text: bytes | None) -> list[bytes]:
    return words_of(text and text.lower()) + [END]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte: first the lowest bytes of all, and no bytes above those of the largest."""
    size = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()
    return bytes([size]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return keys[:1].tobytes() + pack(np.diff(keys))


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    steps = unpack(data[8:], n - 1).view(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), steps]), dtype=np.uint64)


def schema_names(schema: str) -> list[str]:
    return [field.split(" ")[0] for field in schema.split(", ")]


class Slice:
    """The texts of a slice: numbers of their tokens in the slice's words, and the slice's distinct bigrams."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.words = np.frombuffer(row["words"], np.uint64)
        self.teaches, self.scored, self.sizes = (unpack(row[name], len(self.docs)) for name in ("teaches", "scored", "sizes"))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.following = unpack(row["tokens"], int(self.sizes.sum()))
        states = np.empty_like(self.following)
        states[1:] = self.following[:-1]
        states[self.starts] = 0  # the end token's number
        arcs, self.arc = np.unique(states * len(self.words) + self.following, return_inverse=True)
        self.state, self.next = arcs // len(self.words), arcs % len(self.words)
        self.taught = np.repeat(self.teaches, self.sizes)

    def arc_keys(self) -> np.ndarray:
        key = self.words[self.state] * np.uint64(BASE) + self.words[self.next]
        key ^= key >> np.uint64(32)
        key *= np.uint64(MIX)
        return key ^ (key >> np.uint64(29))

    def arc_counts(self) -> np.ndarray:
        return np.bincount(self.arc, self.taught, len(self.state)).astype(np.int64)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.following, self.taught, len(self.words)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts (doc_id, text, teaches, scored)."""
    for whole in batches:
        for batch in parts(whole, 1, SLICE):
            numbers: dict[bytes, int] = {END: 0}
            sizes, found = [], []
            for text in utf8(batch.column(1)):
                own = tokens(text)
                sizes.append(len(own))
                found += [numbers.setdefault(word, len(numbers)) for word in own]
            teaches, scored = (batch.column(i).cast(pa.uint8()).to_numpy(zero_copy_only=False) for i in (2, 3))
            row = {
                "docs": batch.column(0).to_pylist(), "teaches": pack(teaches), "scored": pack(scored), "sizes": pack(np.array(sizes, np.int64)),
                "words": word_hashes(numbers).tobytes(), "tokens": pack(np.array(found, np.int64)), "taught": int(np.dot(teaches.astype(np.int64), sizes)),
            }
            row["arcs"] = len(Slice(row).state)
            yield pa.RecordBatch.from_arrays([pa.array([row[name]], kind) for name, kind in zip(schema_names(SLICES), [pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.int64()], strict=True)], names=schema_names(SLICES))


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' buckets, which are ranges, and their order."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32), np.argsort(keys, kind="stable")


def _asked(question: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]], buckets: int):
    """A row for each slice and bucket: the keys that the slice asks for, and the numbers it adds to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, values = question(row)
                bucket, order = dealt(keys, buckets)
                own, first = np.unique(bucket[order], return_index=True)
                places = [order[a:b] for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
                columns = [
                    pa.array(own), pa.array(np.full(len(own), row["slice"], np.int64)), pa.array([len(at) for at in places], pa.int32()),
                    pa.array([pack_keys(keys[at]) for at in places], pa.binary()), pa.array([[pack(value[at]) for value in values] for at in places], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema_names(ASKED))

    return run


def _summed(asked: pa.Table) -> pa.Table:
    """Answers to the questions of one bucket: the sums for each key, and whether the slice is the first that adds to it."""
    asked = asked.sort_by("slice")
    sizes = asked["n"].to_pylist()
    keys = [unpack_keys(x, n) for x, n in zip(asked["keys"].to_pylist(), sizes, strict=True)]
    values = [np.concatenate([unpack(x, n) for x, n in zip(column, sizes, strict=True)]) for column in zip(*asked["values"].to_pylist(), strict=True)]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(where, value, len(distinct)).astype(np.int64)[where] for value in values]
    adds = np.flatnonzero(values[0])
    first = np.zeros(len(where), np.int64)
    first[adds[np.unique(where[adds], return_index=True)[1]]] = 1
    cuts = np.cumsum(sizes)[:-1]
    firsts = np.split(first, cuts)
    columns = [
        asked["bucket"], asked["slice"], pa.array(sizes, pa.int32()), pa.array([int(x.sum()) for x in firsts], pa.int64()),
        pa.array([[pack(x) for x in row] for row in zip(*[np.split(x, cuts) for x in sums], strict=True)], pa.list_(pa.binary())), pa.array([pack(x) for x in firsts], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, names=schema_names(ANSWERED))


def answers(slices: DataFrame, question: Callable, buckets: int, purpose: str) -> DataFrame:
    asked = slices.mapInArrow(_asked(question, buckets), ASKED)
    return staged(asked.groupBy("bucket").applyInArrow(_summed, ANSWERED), purpose)


def in_order(answer: pa.Table, keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The sums and the firsts of a slice's answers, in the order of its keys."""
    rows = answer.sort_by("bucket").to_pylist()
    _, order = dealt(keys, buckets)
    columns = zip(*[[unpack(x, row["n"]) for x in (*row["sums"], row["first"])] for row in rows], strict=True)
    out = []
    for column in columns:
        values = np.empty(len(keys), np.int64)
        values[order] = np.concatenate(column)
        out.append(values)
    return out


def _ask_arcs(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    own = Slice(row)
    return own.arc_keys(), [own.arc_counts()]


def _ask_words(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    words = np.frombuffer(row["words"], np.uint64)
    return words, [unpack(row[name], len(words)) for name in ("counts", "own_arcs")]


def _counted(buckets: int):
    """The words of a slice with their counts in it, and how many arcs of each state it is the first to teach."""

    def run(slices: pa.Table, answer: pa.Table) -> pa.Table:
        row = slices.to_pylist()[0]
        own = Slice(row)
        _, first = in_order(answer, own.arc_keys(), buckets)
        own_arcs = np.bincount(own.state, first, len(own.words)).astype(np.int64)
        columns = [row["words"], pack(own.word_counts()), pack(own_arcs)]
        return pa.Table.from_arrays([pa.array([row["slice"]], pa.int64()), *[pa.array([x], pa.binary()) for x in columns]], names=schema_names(COUNTED))

    return run


class Automaton:
    """States are words and the empty state. A state's arcs lead to the next word's state, its failure arc to the empty
    state, which has an arc for every word. All weights are log10 probabilities.

    arcs: by number, NaN for a bigram that was never seen, which is no arc; fails: by state; empty: by word.
    """

    def __init__(self, arcs: np.ndarray, fails: np.ndarray, empty: np.ndarray):
        self.arcs = [None if weight != weight else weight for weight in arcs.tolist()]
        self.fails, self.empty = fails.tolist(), empty.tolist()

    def read(self, state: int, following: list[int], numbers: list[int]) -> float:
        """One traversal from left to right; numbers: of the arc from each state by each token, if there is one."""
        total = 0.0
        for token, number in zip(following, numbers, strict=True):
            weight = self.arcs[number]
            if weight is None:
                total += self.fails[state]
                weight = self.empty[token]
            total += weight
            state = token
        return total


def _read(buckets: int, total: int, distinct: int):
    """The texts of a slice, read by the automaton."""

    def run(slices: pa.Table, answer: pa.Table) -> pa.Table:
        row = slices.to_pylist()[0]
        own = Slice(row)
        of_arcs = pc.field("of_arcs")
        seen, _ = in_order(answer.filter(of_arcs), own.arc_keys(), buckets)
        counts, arcs, _ = in_order(answer.filter(~of_arcs), own.words, buckets)
        base = (counts + 0.5) / (total + 0.5 * (distinct + 1))
        # What the arcs of a state leave is DISCOUNT of each; a state that was never seen leaves all.
        left = np.where(counts > 0, DISCOUNT * arcs / np.maximum(counts, 1), 1.0)
        mixed = (seen - DISCOUNT) / np.maximum(counts[own.state], 1) + left[own.state] * base[own.next]
        weights = np.full(len(seen), np.nan)
        weights[seen > 0] = np.log10(mixed[seen > 0])
        # A state whose failure arc can't be reached, as it has no arc, is one that was never seen.
        fails = np.log10(np.where(left > 0, left, 1.0))
        automaton = Automaton(weights, fails, np.log10(base))
        scores = []
        for first, size in zip(own.starts.tolist(), own.sizes.tolist(), strict=True):
            scores.append(automaton.read(0, own.following[first : first + size].tolist(), own.arc[first : first + size].tolist()))
        sums = lambda x: np.add.reduceat(x, own.starts)  # noqa: E731  every text has a token
        columns = [own.sizes, sums((counts > 0).astype(np.int64)[own.following]), sums(np.log10(base)[own.following]), np.array(scores)]
        rows = pa.Table.from_arrays([pa.array(own.docs, pa.int64()), *map(pa.array, columns)], names=schema_names(READ))
        return rows.filter(pa.array(own.scored.astype(bool)))

    return run


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of the rows of docs (doc_id, text, teaches, scored) that
    are to be scored, by a model of those that teach. Scores are log10 probabilities: base_score that of the words alone,
    score the automaton's."""
    sliced = docs.select("doc_id", "text", "teaches", "scored").mapInArrow(_slices, SLICES)
    slices = staged(sliced.withColumn("slice", F.monotonically_increasing_id()), "slices")
    size = slices.agg(F.coalesce(F.sum("taught"), F.lit(0)).alias("taught"), F.coalesce(F.sum("arcs"), F.lit(0)).alias("arcs")).first()
    buckets = max(BUCKETS, -(-size.arcs // BUCKET))
    arcs = answers(slices, _ask_arcs, buckets, "arcs")
    counted = slices.groupBy("slice").cogroup(arcs.groupBy("slice")).applyInArrow(_counted(buckets), COUNTED)
    words = answers(counted, _ask_words, buckets, "words")
    distinct = words.agg(F.coalesce(F.sum("firsts"), F.lit(0)).alias("n")).first().n
    both = arcs.withColumn("of_arcs", F.lit(True)).union(words.withColumn("of_arcs", F.lit(False)))
    read = slices.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(_read(buckets, size.taught, distinct), READ)
    return read.select("doc_id", "n_tokens", "n_known", F.lit(size.taught).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """The same for each row of docs (doc_id, text), by a model of training (text)."""
    teaching = training.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("teaches"), F.lit(False).alias("scored"))
    return scored(docs.select("doc_id", "text", F.lit(False).alias("teaches"), F.lit(True).alias("scored")).union(teaching))


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    found = scored(docs.select("doc_id", "text", (~held_out).alias("teaches"), F.lit(True).alias("scored")))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
