"""Substring dedup: words covered by a window of 50 words that also starts in a document with a smaller doc_id go.

The de Bruijn graph of the corpus is held in sampled form. Each window has an anchor, its k-mer of least hash (the
leftmost of equals), and consecutive windows with one anchor form an edge: a token string that its hash names. Equal
windows have equal anchors, so only edges whose anchor occurs in two documents matter; a join finds them. Edges that
always follow one another (the occurrences of the second are exactly those of the first, moved on) are compacted to
one path. The path's least document is its source.

Windows of edges whose anchor no other edge has are settled by the path. The others, at branches, are hashed one by one
at the source coordinates and grouped with those of the other edges of their anchor. Occurrences of a path's first edge,
joined with the path, give the spans to remove, and a span goes only if its words have the digest of the words at the
path's source coordinates.

Texts are shuffled twice, and only those that hold a source or lose words: a bitmap of fixed size, made of the keys of
these documents, goes with the scan, and what it lets through wrongly meets no partner in the join.

Defined cases: a null text has no words, an empty one neither, and their kept text is empty; a null doc_id is neither
smaller nor larger than another, so such a row stays whole and removes nothing; rows that repeat a doc_id never remove
words of one another; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from accountlens.llm.common import Windows, WordCache, parts, staged, table, utf8, words_of

#: Words of a window, and of its anchor.
SPAN, ANCHOR = 50, 12
#: Bits of the bitmap of document keys.
BITMAP_BITS = 22


class Words:
    """The words of some texts as codes, one text after the other."""

    def __init__(self, texts: list[bytes | None], codes: WordCache):
        split = [words_of(text) for text in texts]
        self.sizes = np.array([len(words) for words in split], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.text = np.repeat(np.arange(len(split)), self.sizes)
        self.codes = np.fromiter((codes[word] for words in split for word in words), np.uint64, int(self.sizes.sum()))
        self.windows = Windows(self.codes)


def runs(words: Words, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of windows with one anchor begin, how many windows they have, and their anchor's hash."""
    n, wide = len(words.codes), span - anchor + 1
    if n < span:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64)
    hashes = words.windows.hashes(np.arange(n - anchor + 1), anchor)
    # The upper half of a hash decides, then the place: the least is the same for equal windows wherever they are.
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[wide - width : wide - width + n - span + 1])
    starts = np.flatnonzero(words.text[: n - span + 1] == words.text[span - 1 :])
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), hashes[place[first]]


def _edges(span: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCache(xxh64_intdigest)
        for whole in batches:
            for batch in parts(whole, 2):
                words = Words(utf8(batch.column(2)), codes)
                first, count, anchors = runs(words, span, anchor)
                text = words.text[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text)),
                        batch.column(1).take(pa.array(text)),
                        pa.array((first - words.begin[text]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(anchors.view(np.int64)),
                        pa.array(words.windows.hashes(first, count + span - 1).view(np.int64)),
                    ],
                    names=["doc_id", "tag", "at", "n", "anchor", "edge"],
                )

    return run


def bitmap(keys: DataFrame) -> np.ndarray:
    """2**BITMAP_BITS bits as bytes: those of the column key are set. At most 2**(BITMAP_BITS - 6) rows are collected."""
    bit = F.col("key").bitwiseAND((1 << BITMAP_BITS) - 1)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = keys.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in words:
        out[row.word] = row.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _hits(batch: pa.RecordBatch, packed: bytes) -> np.ndarray:
    """Whether the bit of each row's key, the last column, is set."""
    known = np.frombuffer(packed, np.uint8)
    bit = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & ((1 << BITMAP_BITS) - 1)
    return ((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _hit(bits: np.ndarray):
    packed = np.packbits(bits, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_hits(batch, packed)))

    return run


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one behind the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _sources(span: int, step: int = 1 << 16):
    """From texts and their sources: a digest for each path, and hashes of the windows at branches."""
    names = ["path", "at", "anchor", "window", "proof", "doc_id"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def rows(columns: list) -> pa.RecordBatch:
        size = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCache(xxh64_intdigest)
        for whole in batches:
            for batch in parts(whole, 1, 1 << 20):
                texts = utf8(batch.column(1))
                split = Words(texts, codes)
                doc_id = batch.column(0).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
                sources = batch.column(2).flatten()
                path, at, n = (pc.struct_field(sources, x).to_numpy(zero_copy_only=False) for x in ("path", "at", "n"))
                proof, known, words = [], -1, []
                for i, first, count in zip(row.tolist(), at.tolist(), n.tolist(), strict=True):
                    if i != known:
                        known, words = i, words_of(texts[i])
                    proof.append(digest(words[first : first + count + span - 1]))
                yield rows([path, None, None, None, proof, doc_id[row]])
                held = pc.struct_field(sources, "branches")
                source = np.repeat(np.arange(len(sources)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
                branches = held.flatten()
                off, count, anchor = (pc.struct_field(branches, x).to_numpy(zero_copy_only=False) for x in ("off", "n", "anchor"))
                begin = split.begin[row[source]] + at[source] if len(source) else source
                # So many windows at a time, cut at branches.
                group = np.cumsum(count) // step
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(count)] if len(count) else []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own = np.repeat(np.arange(a, b), count[a:b])
                    place = off[own] + _within(count[a:b].astype(np.int64))
                    hashes = split.windows.hashes(begin[own] + place, span).view(np.int64)
                    yield rows([path[source[own]], place.astype(np.int32), anchor[own], hashes, None, doc_id[row[source[own]]]])

    return run


def _kept(span: int, hashed: bool, bits: np.ndarray | None = None):
    """Removes the spans of each text. With `bits`, only texts whose key has no bit there are read, and kept whole."""
    packed = None if bits is None else np.packbits(bits, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rest = whole if packed is None else whole.filter(pa.array(~_hits(whole, packed)))
            for batch in parts(rest, 1, 1 << 20):
                total, removed, kept = [], [], []
                every = [None] * batch.num_rows if packed else batch.column(2).to_pylist()
                for text, spans in zip(utf8(batch.column(1)), every, strict=True):
                    words = words_of(text)
                    left = words if not spans else _without(words, spans, span)
                    total.append(len(words))
                    removed.append(len(words) - len(left))
                    joined = b" ".join(left)
                    kept.append(hashlib.sha256(joined).hexdigest() if hashed else joined.decode(errors="replace"))
                columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256" if hashed else "kept"])

    return run


def _without(words: list[bytes], spans: list[dict], span: int) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int64)
    for one in spans:
        if digest(words[one["at"] : one["at"] + one["n"] + span - 1]) == one["proof"]:
            for piece in one["pieces"]:
                gone[one["at"] + piece["off"]] += 1
                gone[one["at"] + piece["off"] + piece["n"] + span - 1] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def paths(repeated: DataFrame) -> DataFrame:
    """(path, edge, off, n, anchor, branch, doc_id, tag, at) for each edge of the repeated occurrences.

    path: the first edge of the compacted path; off: windows of the path before the edge; doc_id, tag, at: its source;
    branch: whether other edges have its anchor.
    """
    here, after = F.xxhash64("doc_id", "tag", "at"), F.xxhash64("doc_id", "tag", (F.col("at") + F.col("n")))
    edges = repeated.groupBy("edge").agg(
        F.min(F.struct("doc_id", "tag", "at", "n", "anchor")).alias("source"),
        F.count("*").alias("count"),
        F.bit_xor(here).alias("here"),
        F.bit_xor(after).alias("after"),
        # Bit-wise sums forget what occurs twice; plain sums of other hashes don't.
        F.sum(F.hash("doc_id", "tag", "at").cast("long")).alias("here_2"),
        F.sum(F.hash("doc_id", "tag", F.col("at") + F.col("n")).cast("long")).alias("after_2"),
    ).select("edge", "source.*", "count", "here", "after", "here_2", "after_2")
    shared = edges.groupBy("anchor").agg((F.count("*") > 1).alias("branch"))
    known = edges.join(shared, "anchor")
    line = Window.partitionBy("doc_id", "tag").orderBy("at")
    follows = (
        (F.lag("after").over(line) == F.col("here")) & (F.lag("after_2").over(line) == F.col("here_2"))
        & (F.lag("count").over(line) == F.col("count")) & (F.lag(F.col("at") + F.col("n")).over(line) == F.col("at"))
    )
    begun = known.withColumn("head", ~F.coalesce(follows, F.lit(False)))
    up_to = line.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("head"), F.struct("at", "edge"))).over(up_to)
    return begun.withColumn("first", last).select("edge", F.col("first.edge").alias("path"), (F.col("at") - F.col("first.at")).alias("off"), "n", "anchor", "branch", "doc_id", "tag", "at")


def removals(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, tag, spans) for the rows of docs (doc_id, tag, text) that lose words; spans: at, n, proof, pieces."""
    known = docs.where("doc_id is not null and text is not null")
    edges = staged(known.select("doc_id", "tag", "text").mapInArrow(_edges(span, anchor), "doc_id long, tag int, at int, n int, anchor long, edge long"), "edges")
    twice = edges.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    repeated = staged(edges.join(twice, "anchor"), "repeated")
    found = staged(paths(repeated), "paths")

    branches = F.array_compact(F.collect_list(F.when(F.col("branch"), F.struct("off", "n", "anchor"))))
    whole = found.groupBy("path").agg(F.min(F.struct("off", "doc_id", "tag", "at")).alias("source"), F.sum("n").alias("n"), branches.alias("branches"))
    sources = whole.select("path", "source.doc_id", "source.tag", "source.at", "n", "branches")
    per_doc = sources.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("path", "at", "n", "branches")).alias("sources"))
    key = F.xxhash64("doc_id", "tag")
    keyed = known.select("doc_id", "tag", "text", key.alias("key"))
    texts = keyed.mapInArrow(_hit(bitmap(sources.select(key.alias("key")))), keyed.schema)
    # A repeated row is one source: its windows would count twice, and make its paths longer than their text.
    seen = texts.join(per_doc, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("doc_id", "text", "sources")
    seen = staged(seen.mapInArrow(_sources(span), "path long, at int, anchor long, window long, proof binary, doc_id long"), "sources")

    windows = seen.where("window is not null").select("path", "at", "anchor", "window", "doc_id")
    least = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"))
    settled = windows.join(least, ["anchor", "window"]).select("path", F.col("at").alias("off"), F.lit(1).alias("n"), "least")
    plain = found.where(~F.col("branch")).select("path", "off", "n", F.col("doc_id").alias("least"))
    line = Window.partitionBy("path").orderBy("off")
    marked = settled.union(plain).withColumn("new", F.coalesce((F.lag("least").over(line) != F.col("least")).cast("int"), F.lit(0)))
    island = marked.withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = island.groupBy("path", "island").agg(F.min("off").alias("off"), F.sum("n").cast("int").alias("n"), F.min("least").alias("least"))
    pieces = pieces.groupBy("path").agg(F.collect_list(F.struct("off", "n", "least")).alias("pieces"), F.sum("n").cast("int").alias("total"))
    proven = pieces.join(seen.where("proof is not null").select("path", "proof").distinct(), "path")

    heads = repeated.select("doc_id", "tag", "at", F.col("edge").alias("path"))
    met = heads.join(proven, "path").select("doc_id", "tag", "at", "total", "proof", F.filter("pieces", lambda x: x.least < F.col("doc_id")).alias("pieces"))
    lost = met.where(F.size("pieces") > 0).withColumn("pieces", F.transform("pieces", lambda x: F.struct(x.off.alias("off"), x.n.alias("n"))))
    one = F.struct("at", F.col("total").alias("n"), "proof", "pieces")
    return lost.groupBy("doc_id", "tag").agg(F.collect_list(one).alias("spans"))


def dedup(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, hashed: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs (doc_id, text); kept: the words left, joined by a blank.

    With `hashed` their SHA-256, kept_sha256, leaves the workers instead.
    """
    tagged = docs.select("doc_id", "text", F.hash("text").alias("tag"))
    lost = staged(removals(tagged, span, anchor), "removals")
    key = F.xxhash64("doc_id", "tag")
    keyed = tagged.select("doc_id", "tag", "text", key.alias("key"))
    bits = bitmap(lost.select(key.alias("key")))
    cut = keyed.mapInArrow(_hit(bits), keyed.schema).join(lost, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    out = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if hashed else 'kept'} string"
    rest = keyed.select("doc_id", "text", "key").mapInArrow(_kept(span, hashed, bits), out)
    return cut.mapInArrow(_kept(span, hashed), out).union(rest)


def op2_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), hashed=True)
