"""Aligning the tokens of two tokenizers, by windows between white-space anchors.

Both tokenizers encode whole texts, with a space in front. Their tokens' bytes are checked against the text, so
every token has a place. Where a token of either tokenizer that begins with a space starts at one and the same
byte, the tokens before end together: an anchor. Anchors cut a text into windows, short runs of ids on either
side that repeat all over a corpus, so the groups of a window (the cuts at bytes where tokens of both end) are
worked out once for each pair of id tuples and kept.

For the counts over the corpus, texts are dealt to slices of some 8 MB. A slice keeps its links as numbers of its
distinct id pairs and asks for each pair once: pairs are summed up over slices (map-side first), joined back to
the slices that asked, and each slice adds up its own documents. So neither a frequent pair nor the table of
pairs meets in one task or is broadcast.

Defined cases: a text that is null or empty, or whose tokens of either tokenizer don't spell it (a tokenizer that
writes spaces as U+2581 can't tell them from the real one), has no tokens; special tokens' strings are plain
text; a null doc_id is aligned like any other; repeated rows are aligned and counted each; an empty table gives
an empty result; other columns are ignored. A document's links are one value.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accountlens.llm.common import BASE, Windows, parts, staged, table
from accountlens.llm.tokens import path

#: The first is byte_bpe_50k.json's vocabulary as ranks: the same ids, found four times as fast.
A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text tokenized at once, and of a slice; windows that a worker keeps.
STEP, SLICE, KEPT = 1 << 18, 3 << 20, 100_000


class Side:
    """One tokenizer: ids of texts, and by id the token's bytes, their number, and whether they begin with a space.

    cuts: its tokens are cut from the text's own bytes, so they spell it if they are as long.
    """

    def __init__(self, name: str):
        self.cuts = name.endswith(".tiktoken")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name.endswith(".model"):
            model = sentencepiece.SentencePieceProcessor(model_file=path(name))
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            self.bytes = [_piece(model, i) for i in range(model.get_piece_size())]
        elif name.endswith(".tiktoken"):
            with open(path(name), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [model.encode_to_numpy(f" {t}", disallowed_special=()) for t in texts]
            known = {rank: token for token, rank in ranks.items()}
            self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        else:
            model = Tokenizer.from_file(path(name))
            model.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
            byte = _byte_level()
            known = {i: bytes(byte.get(c, 63) for c in token) for token, i in model.get_vocab().items()}
            self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.marked = np.array([b.startswith(b" ") for b in self.bytes])

    def spells(self, ids, spelt: bytes) -> bool:
        if self.cuts:
            return int(self.lengths[ids].sum()) == len(spelt)
        return b"".join(map(self.bytes.__getitem__, ids)) == spelt


def _piece(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def _byte_level() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of several runs, one run behind the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Aligned:
    """Some texts' tokens: flat ids and each text's number of them; group by group how many ids it has on either side,
    and each text's number of groups."""

    def __init__(self, ids, counts, sizes, groups, linked):
        self.ids, self.counts, self.sizes, self.groups = ids, counts, sizes, groups
        self.ends = [np.cumsum(x) for x in sizes]
        #: The distinct pairs of ids that end together, and which of them each group has.
        self.pairs, self.links = linked

    def texts(self, pieces: list[str], offsets: tuple[int, int]) -> Iterator[str]:
        """The groups of each text; pieces: an id with what follows it, by side and whether it ends its group."""
        (a, b), (a_ends, b_ends) = self.ids, self.ends
        codes = np.empty(len(a) + len(b), np.int64)
        for side, (ids, ends, sizes) in enumerate(zip(self.ids, self.ends, self.sizes, strict=True)):
            own = ids.astype(np.int64) + offsets[side]
            own[ends - 1] += offsets[1] // 2 if side == 0 else (len(pieces) - offsets[1]) // 2
            # Before an id stand those of the other side in earlier groups, and for b of its own group as well.
            before = b_ends - self.sizes[1] if side == 0 else a_ends
            codes[np.arange(len(ids)) + np.repeat(before, sizes)] = own
        ends = np.cumsum(self.counts[0] + self.counts[1]).tolist()
        for first, end in zip([0, *ends], ends, strict=False):
            yield "".join(map(pieces.__getitem__, codes[first:end].tolist()))[:-1]


class Aligner:
    def __init__(self, a: str, b: str):
        self.sides = Side(a), Side(b)
        self.known: dict[tuple[bytes, bytes], bytes] = {}
        self.pieces = [f"{i}{mark}" for side, marks in zip(self.sides, (",|", ",;"), strict=True) for mark in marks for i in range(len(side.bytes))]
        self.offsets = 0, 2 * len(self.sides[0].bytes)

    def texts(self, aligned: Aligned) -> Iterator[str]:
        return aligned.texts(self.pieces, self.offsets)

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids on either side; none for texts that one side doesn't spell."""
        nothing = np.zeros(0, np.int32)
        usable = [i for i, text in enumerate(texts) if text]
        out = [nothing] * len(texts), [nothing] * len(texts)
        whole = [texts[i] for i in usable]
        both = [side.encode(whole) if whole else [] for side in self.sides]
        for i, text, *ids in zip(usable, whole, *both, strict=True):
            spelt = f" {text}".encode()
            if all(side.spells(own, spelt) for side, own in zip(self.sides, ids, strict=True)):
                out[0][i], out[1][i] = (np.asarray(own, np.int32) for own in ids)
        return out

    def shared(self, ids: list[np.ndarray], only_marked: bool) -> list[np.ndarray]:
        """On either side the tokens that start where one of the other side does; with only_marked, both with a space."""
        starts = [np.cumsum(n := side.lengths[own]) - n for side, own in zip(self.sides, ids, strict=True)]
        chosen = [np.flatnonzero(side.marked[own]) if only_marked else np.arange(len(own)) for side, own in zip(self.sides, ids, strict=True)]
        size = max([0, *(int(x[-1]) + 1 for x in starts if len(x))])
        cuts = []
        for this, that in ((0, 1), (1, 0)):
            there = np.zeros(size, bool)
            there[starts[that][chosen[that]]] = True
            cuts.append(chosen[this][there[starts[this][chosen[this]]]])
        return cuts

    def sizes(self, ids: list[np.ndarray], starts: list[np.ndarray], counts: list[np.ndarray], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window (its first id and their number on either side) how many groups it has, and all groups' sizes.

        Windows that occur often are looked up by the tuples of their ids, and kept. The others are laid end to end, which
        leaves the places of their tokens relative to one another as they are, and cut together.
        """
        flat = [x.tobytes() for x in ids]
        first, end = ([(4 * x[often]).tolist() for x in y] for y in (starts, [s + n for s, n in zip(starts, counts, strict=True)]))
        keys = list(zip(
            [flat[0][i:j] for i, j in zip(first[0], end[0], strict=True)],
            [flat[1][i:j] for i, j in zip(first[1], end[1], strict=True)],
            strict=True,
        ))
        found = list(map(self.known.get, keys))
        missed = np.array([x is None for x in found], bool)
        fresh = np.ones(len(starts[0]), bool)
        fresh[often[~missed]] = False
        new, old = np.flatnonzero(fresh), often[~missed]
        held = [x for x in found if x is not None]
        own = [x[_spans(s[new], n[new])] for x, s, n in zip(ids, starts, counts, strict=True)]
        cuts = self.shared(own, only_marked=False)
        cut = np.stack([np.diff(c, append=len(x)) for c, x in zip(cuts, own, strict=True)], axis=1)
        ends = np.searchsorted(cuts[0], np.cumsum(counts[0][new]))
        groups = np.empty(len(fresh), np.int64)
        groups[new] = np.diff(ends, prepend=0)
        groups[old] = [len(x) // 8 for x in held]
        offsets = np.cumsum(groups) - groups
        pairs = np.empty((int(groups.sum()), 2), np.int64)
        pairs[_spans(offsets[new], groups[new])] = cut
        pairs[_spans(offsets[old], groups[old])] = np.frombuffer(b"".join(held), "<u4").reshape(-1, 2)
        if len(self.known) + int(missed.sum()) > KEPT:
            self.known.clear()
        room, told = KEPT - len(self.known), pairs.astype("<u4").tobytes()
        for i in np.flatnonzero(missed)[:room].tolist():
            window = often[i]
            self.known[keys[i]] = told[8 * offsets[window] : 8 * (offsets[window] + groups[window])]
        return groups, pairs

    def align(self, texts: list[str | None]) -> Aligned:
        """All texts at once; each begins with a space on either side, so their ends are anchors as well."""
        tokens: tuple[list, list] = [], []
        for first, end in _steps(texts):
            for side, own in zip(tokens, self.tokens(texts[first:end]), strict=True):
                side += own
        ids = [np.concatenate([np.zeros(0, np.int32), *x]) for x in tokens]
        per_text = [np.array([len(y) for y in x], np.int64) for x in tokens]
        starts = self.shared(ids, only_marked=True)
        counts = [np.diff(s, append=len(x)) for s, x in zip(starts, ids, strict=True)]
        # Windows with equal ids, by a hash of them that is then checked.
        hashes = [Windows(x.astype(np.int64)).hashes(s, n) for x, s, n in zip(ids, starts, counts, strict=True)]
        _, one, number = np.unique(hashes[0] * np.uint64(BASE) ^ hashes[1], return_index=True, return_inverse=True)
        good = np.logical_and.reduce([n == n[one][number] for n in counts])
        for x, s, n in zip(ids, starts, counts, strict=True):
            window, at = np.repeat(np.arange(len(s)), n), _spans(s, n)
            there = np.minimum(s[one][number][window] + at - s[window], len(x) - 1)
            good[window[x[at] != x[there]]] = False
        wrong = np.flatnonzero(~good)
        number[wrong] = len(one) + np.arange(len(wrong))
        one = np.concatenate([one, wrong])
        often = np.flatnonzero(np.bincount(number, minlength=len(one)) > 1)
        groups, pairs = self.sizes(ids, [s[one] for s in starts], [n[one] for n in counts], often)
        each = groups[number]
        every = pairs[_spans((np.cumsum(groups) - groups)[number], each)]
        until = np.concatenate([[0], np.cumsum(each)])
        ends = until[np.searchsorted(starts[0], np.cumsum(per_text[0]))]
        return Aligned(ids, per_text, [every[:, 0], every[:, 1]], np.diff(ends, prepend=0), self.linked(ids, [s[one] for s in starts], pairs, groups, number))

    def linked(self, ids: list[np.ndarray], starts: list[np.ndarray], pairs: np.ndarray, groups: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of ids that end together, as a << 32 | b, and of each group in order which it has.

        Only the groups of distinct windows are looked at.
        """
        first = np.repeat(np.cumsum(groups) - groups, groups)
        ends = [np.cumsum(pairs[:, side]) for side in (0, 1)]
        before = [np.concatenate([[0], e])[first] for e in ends]
        a, b = (x[np.repeat(s, groups) + e - z - 1].astype(np.int64) for x, s, e, z in zip(ids, starts, ends, before, strict=True))
        links, which = np.unique(a << 32 | b, return_inverse=True)
        each = groups[number]
        return links, which[_spans((np.cumsum(groups) - groups)[number], each)]


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= STEP or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


@cache
def aligner(a: str, b: str) -> Aligner:
    """One per worker, so that tasks share what is kept."""
    return Aligner(a, b)


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def alignments(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """doc_id, a_ids, b_ids, and for each group how many ids of either side it has (a_sizes, b_sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1, SLICE):
                got = aligner(a, b).align(part.column(1).to_pylist())
                columns = [part.column(0), *[_lists(x, n, pa.int32()) for x, n in zip(got.ids, got.counts, strict=True)]]
                columns += [_lists(x, got.groups, pa.int32()) for x in got.sizes]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    out = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, out)


MEASURED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_SLICED = "slice long, links binary, pairs array<long>, times array<long>"


def measured(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """A row for each document (MEASURED, slice, links) and one for each slice (slice, pairs, times).

    pairs: the slice's distinct linked ids as a << 32 | b; times: how often each; links: a document's links as
    numbers of these, little-endian unsigned 32-bit. Every group has one link: the ids at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in parts(batch, 1, STEP):
                ids.append(part.column(0))
                texts += part.column(1).to_pylist()
                size += part.column(1).nbytes
                if size >= SLICE:
                    yield _sliced(number, ids, aligner(a, b), texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _sliced(number, ids, aligner(a, b), texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"{MEASURED}, {_SLICED}")


def _sliced(number: int, ids: list[pa.Array], by: Aligner, texts: list[str | None]) -> pa.RecordBatch:
    got = by.align(texts)
    pairs, times = got.pairs, np.bincount(got.links, minlength=len(got.pairs))
    places, rows = got.links.astype("<u4").tobytes(), len(got.groups)
    ends = (4 * np.cumsum(got.groups)).tolist()
    own = [places[first:end] for first, end in zip([0, *ends], ends, strict=False)]
    columns = [
        pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)]),
        *[pa.array([*n.tolist(), None], pa.int64()) for n in (*got.counts, got.groups, got.groups)],
        pa.array([*(hashlib.sha256(t.encode()).hexdigest() if t else "" for t in by.texts(got)), None]),
        pa.array(np.full(rows + 1, number)),
        pa.array([*own, None], pa.binary()),
        *[pa.array([*[None] * rows, x], pa.list_(pa.int64())) for x in (pairs, times)],
    ]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slice", "links", "pairs", "times"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def pair_counts(sliced: DataFrame) -> DataFrame:
    """(asker, at, pair, times) of each slice with `count` over the corpus and `best`: no id on the A side has more for
    the id on the B side."""
    each = sliced.where("pairs IS NOT NULL").select(F.col("slice").alias("asker"), F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "one"))
    asked = each.select("asker", "at", F.col("one.pairs").alias("pair"), F.col("one.times").alias("times"))
    counts = asked.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.expr("pair & 4294967295L"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    rated = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    return asked.join(rated, "pair")


def _added(docs: pa.Table, replies: pa.Table) -> pa.Table:
    at = replies.column("at").to_numpy()
    count, best = np.zeros((2, len(at)), np.int64)
    count[at], best[at] = replies.column("count").to_numpy(), replies.column("best").to_numpy(zero_copy_only=False)
    links = docs.column("links").to_pylist()
    ends = np.cumsum([len(x) // 4 for x in links])
    places = np.frombuffer(b"".join(links), "<u4")
    for name, values in (("n_best", best), ("count_sum", count)):
        sums = np.concatenate([[0], np.cumsum(values[places])])
        docs = docs.append_column(name, pa.array(np.diff(sums[ends], prepend=0)))
    return docs.drop_columns(["slice", "links"])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = staged(measured(table(spark, sf_dir, "documents")), "aligned")
    docs = sliced.where("links IS NOT NULL").drop("pairs", "times")
    replies = pair_counts(sliced).select("asker", "at", "count", "best")
    out = f"{MEASURED}, n_best long, count_sum long"
    return docs.groupBy("slice").cogroup(replies.groupBy("asker")).applyInArrow(_added, out)
