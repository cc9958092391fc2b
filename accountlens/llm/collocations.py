"""Phrase collocations over a prefix-free parse of the corpus.

A text is a sequence of words, cut into pieces at punctuation. Where the hash of the last longest - 1 words is
divisible by `every`, a chunk ends and the next begins with these same words, so equal passages give equal chunks
wherever they are and neighbours overlap by that many words. The distinct chunks of each language, with how often
the parse has them, are the dictionary (combined map-side, then by key). From here on only the dictionary is read:
an n-gram of a distinct chunk counts as often as the chunk, and one that lies in the overlap counts for the chunk
before alone, as a later chunk only counts n-grams that end behind its first longest - 1 words.

Most n-grams are rare, so frequent ones are found before any becomes a string. The dictionary is dealt to slices.
A slice counts its n-grams exactly, by numbers of its own words, and asks the buckets of their hashes; a bucket
adds up what the slices asked, each count up to the threshold, and answers with a bit each. Equal hashes can only
let an n-gram through. Those let through become strings, whose counts Spark adds up and holds against the
threshold, so counts are exact. Slices and buckets are of bounded size; their messages shrink as both grow in
number, down to one for each distinct n-gram of a slice.

Defined cases: a null text is empty; a null language is `und`; a null doc_id makes no difference; repeated rows
count each; a text without words, and an empty table, give nothing; ties of a rank are ordered by phrase; a run
without any cut is cut after so many words, which changes no count; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from accountlens.llm.common import BASE, INVERSE, MIX, parts, staged, table, utf8

LONGEST, LEAST, TOP, SHARE = 3, 10, 2000, 50
#: Words from cut to cut on average, and bytes of chunks that a task gathers before it hands them on.
EVERY, GATHERED = 16, 16 << 20
#: Bytes of the dictionary's words, four each, for each bucket of hashes; 2**TOGETHER slices are told together.
BUCKET, TOGETHER = 4 << 20, 2

#: What ends a piece; and how a chunk in a slice begins, at the start of a text or behind a cut.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
FIRST, LATER = b"\x0b", b"\x0d"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(ENDS))
_APART = np.zeros(256, bool)
_APART[list(b" \n" + FIRST + LATER)] = True


@cache
def _powers(size: int) -> np.ndarray:
    factors = np.full((2, size + 1), 1, np.uint64)
    factors[0, 1:], factors[1, 1:] = BASE, INVERSE
    return np.cumprod(factors, axis=1, dtype=np.uint64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where words start and end."""
    codes = np.frombuffer(data, np.uint8)
    apart = np.concatenate([[True], _APART[codes], [True]])
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    return codes, edges[::2], edges[1::2]


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(32))) * np.uint64(MIX)
    return value ^ (value >> np.uint64(29))


def bits(longest: int) -> int:
    """Of a word's number in a slice; an n-gram's numbers are one 64-bit key."""
    return 63 // longest


def chunks(texts: list[bytes], longest: int, every: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes of all texts, and for each chunk where it starts and ends there, whether it is a text's first,
    and the text's number."""
    nothing, overlap = np.zeros(0, np.int64), longest - 1
    data = LATER.join([text.translate(_PLAIN) for text in texts])
    codes, starts, ends = _words(data)
    if not len(starts):
        return data, nothing, nothing, nothing, nothing
    up, down = _powers(1 << max(20, len(codes).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], dtype=np.uint64)])
    word = _mixed((sums[ends] - sums[starts]) * up[starts])
    text_of = np.searchsorted(np.flatnonzero(codes == LATER[0]), starts)
    n = len(starts)
    last = np.concatenate([text_of[1:] != text_of[:-1], [True]])
    first_word = np.maximum.accumulate(np.where(np.concatenate([[True], last[:-1]]), np.arange(n), 0))
    window = np.zeros(n, np.uint64)
    for back in range(overlap - 1, -1, -1):
        moved = word if not back else np.concatenate([word[:back][::-1], word[:-back]])
        window = _mixed(window * np.uint64(BASE) + moved)
    cut = (np.arange(n) - first_word >= overlap - 1) & ((window >> np.uint64(20)) % np.uint64(every) == 0) | last
    until = np.flatnonzero(cut)
    most = 1 << (min(bits(longest), 14) - 2)
    gaps = np.diff(until, prepend=-1)
    if gaps.max() > most:
        more = [np.arange(end - gap + most, end, most) for end, gap in zip(until[gaps > most].tolist(), gaps[gaps > most].tolist(), strict=True)]
        until = np.unique(np.concatenate([until, *more]))
        until = until[(until - first_word[until] >= overlap - 1) | last[until]]
    before = np.concatenate([[-1], until[:-1]])
    fresh = np.concatenate([[True], last[until[:-1]]])
    begin = np.where(fresh, before + 1, before + 1 - overlap)
    return data, starts[begin], ends[until], fresh, text_of[until]


def parse(docs: DataFrame, longest: int = LONGEST, every: int = EVERY) -> DataFrame:
    """(lang, chunk, times): the dictionary of each language with parse frequencies; a chunk's first byte says whether
    it begins a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = Counter(), 0
        for batch in batches:
            for part in parts(batch, 1):
                langs, texts = part.column(0).to_pylist(), [text or b"" for text in utf8(part.column(1))]
                data, starts, ends, fresh, own = chunks(texts, longest, every)
                found.update([
                    (langs[i], (FIRST if new else LATER) + data[a:b])
                    for a, b, new, i in zip(starts.tolist(), ends.tolist(), fresh.tolist(), own.tolist(), strict=True)
                ])
                size += part.column(1).nbytes
                if size > GATHERED:
                    yield from _counted(found)
                    found, size = Counter(), 0
        yield from _counted(found)

    each = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "lang string, chunk binary, times long")
    return each.groupBy("lang", "chunk").agg(F.sum("times").alias("times"))


def _counted(found: Counter, step: int = 20_000) -> Iterator[pa.RecordBatch]:
    keys, times = list(found), list(found.values())
    for first in range(0, len(keys), step):
        own = keys[first : first + step]
        columns = [pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.binary()), pa.array(times[first : first + step], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "times"])


SLICE = "slice long, lang string, vocabulary binary, words binary, flags binary, sizes binary, times binary"
#: Flags of a word: it is in the piece of the word before; an n-gram that ends with it counts here.
SAME, COUNTED = 1, 2


def dealt(dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """SLICE: the dictionary in slices of one language, with words as numbers of the slice's own vocabulary.

    words: 32-bit numbers from 1, all chunks one behind the other; flags: a byte each; sizes, times: of each chunk
    its words and parse frequency. A slice has fewer words than a key has room for.
    """
    limit = min(4 << 20, 3 << (bits(longest) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId() << 32, 0
        gathered: dict[str, tuple[list[bytes], list[int], list[int]]] = {}
        for batch in batches:
            for lang, chunk, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own, counts, size = gathered.setdefault(lang, ([], [], [0]))
                own.append(chunk)
                counts.append(times)
                size[0] += len(chunk)
                total += len(chunk)
                if size[0] >= limit or total >= 4 * limit:
                    full = [lang] if size[0] >= limit else list(gathered)
                    for name in full:
                        total -= gathered[name][2][0]
                        yield _slice(number, name, *gathered.pop(name)[:2], longest)
                        number += 1
        for lang, (own, counts, _) in gathered.items():
            yield _slice(number, lang, own, counts, longest)
            number += 1

    return dictionary.select("lang", "chunk", "times").mapInArrow(run, SLICE)


def _slice(number: int, lang: str, own: list[bytes], times: list[int], longest: int) -> pa.RecordBatch:
    data = b"".join(own)
    codes, starts, _ = _words(data)
    spelt = data.split()
    known = {word: i for i, word in enumerate(dict.fromkeys(spelt), 1)}
    words = np.fromiter(map(known.__getitem__, spelt), "<u4", len(spelt))
    leads = np.flatnonzero((codes == FIRST[0]) | (codes == LATER[0]))
    begin = np.searchsorted(starts, leads)
    sizes = np.diff(begin, append=len(starts))
    piece = np.searchsorted(np.flatnonzero((codes == 10) | (codes == FIRST[0]) | (codes == LATER[0])), starts)
    flags = np.zeros(len(starts), np.uint8)
    flags[1:][piece[1:] == piece[:-1]] = SAME
    ahead = np.arange(len(starts)) - np.repeat(begin, sizes)
    flags[(ahead >= longest - 1) | np.repeat(codes[leads] == FIRST[0], sizes)] |= COUNTED
    blobs = [b" ".join(known), words.tobytes(), flags.tobytes(), sizes.astype("<u4").tobytes(), np.array(times, "<i8").tobytes()]
    columns = [pa.array([number]), pa.array([lang]), *[pa.array([blob], pa.binary()) for blob in blobs]]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "lang", "vocabulary", "words", "flags", "sizes", "times"])


class Grams:
    """The distinct n-grams of a slice: keys of word numbers, exact counts and hashes; the number of words."""

    def __init__(self, row: dict, longest: int):
        self.shift = bits(longest)
        self.words = [b"", *row["vocabulary"].split(b" ")]
        number = np.frombuffer(row["words"], "<u4").astype(np.int64)
        flags = np.frombuffer(row["flags"], np.uint8)
        weight = np.repeat(np.frombuffer(row["times"], "<i8"), np.frombuffer(row["sizes"], "<u4"))
        counted, same = (flags & COUNTED) > 0, (flags & SAME) > 0
        self.total = int(weight[counted].sum())
        keys, weights, good = [], [], counted
        for n in range(1, longest + 1):
            if n > 1:
                # The last n words are in one piece if the n - 1 before are and the last follows in it.
                good = good.copy()
                good[: n - 1] = False
                good[n - 2 + 1 :] &= same[1 : len(same) - (n - 2)] if n > 2 else same[1:]
            ends = np.flatnonzero(good)
            key = np.zeros(len(ends), np.int64)
            for i in range(longest):
                key = key << self.shift | (number[ends - n + 1 + i] if i < n else 0)
            keys.append(key)
            weights.append(weight[ends])
        keys, weights = np.concatenate(keys), np.concatenate(weights)
        order = np.argsort(keys)
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys = keys[heads]
        self.counts = np.add.reduceat(weights[order], heads) if len(heads) else weights
        digests = np.array([0, *map(xxh64_intdigest, self.words[1:])], np.uint64)
        self.hashes = np.full(len(self.keys), xxh64_intdigest(row["lang"].encode()), np.uint64)
        for i in range(longest):
            self.hashes = _mixed((self.hashes ^ digests[self.ids(self.keys, longest - 1 - i)]) * np.uint64(BASE))

    def ids(self, keys: np.ndarray, place: int) -> np.ndarray:
        """Word numbers, from the last place (0) on."""
        return keys >> (self.shift * place) & ((1 << self.shift) - 1)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams in the order of their buckets, and where each bucket's end."""
        bucket = ((self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _asked(buckets: int, longest: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, longest)
                order, ends = grams.by_bucket(buckets)
                # A bucket's n-grams are few against 2**32, however large the corpus.
                hashes = (grams.hashes[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
                counts = np.minimum(grams.counts[order], min(least, 255)).astype(np.uint8)
                bounds = [0, *ends.tolist()]
                own = [(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in own], pa.int32()), pa.array([row["slice"]] * len(own), pa.int64()),
                        pa.array([hashes[a:b].tobytes() for _, a, b in own], pa.binary()),
                        pa.array([counts[a:b].tobytes() for _, a, b in own], pa.binary()),
                    ],
                    names=["bucket", "slice", "hashes", "counts"],
                )

    return run


def _answered(least: int):
    def run(asked: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(asked.column("hashes").to_pylist()), "<u4")
        counts = np.frombuffer(b"".join(asked.column("counts").to_pylist()), np.uint8)
        order = np.argsort(hashes)
        ranked = hashes[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        enough = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(head)) >= min(least, 255)
        frequent = np.empty(len(hashes), bool)
        frequent[order] = enough[np.cumsum(head) - 1]
        ends = np.cumsum([len(x) for x in asked.column("counts").to_pylist()]).tolist()
        masks = [np.packbits(frequent[a:b]).tobytes() for a, b in zip([0, *ends], ends, strict=False)]
        return pa.table({"slice": asked.column("slice"), "bucket": asked.column("bucket"), "mask": pa.array(masks, pa.binary())})

    return run


def _told(buckets: int, longest: int):
    """From some slices and what they were answered: their frequent phrases with counts, added up over these slices."""

    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        masks = dict(zip(zip(answers.column("slice").to_pylist(), answers.column("bucket").to_pylist(), strict=True), answers.column("mask").to_pylist(), strict=True))
        counts: dict[str, dict[bytes, int]] = {}
        totals: dict[str, int] = {}
        for at in range(slices.num_rows):
            row = slices.slice(at, 1).to_pylist()[0]
            grams = Grams(row, longest)
            order, ends = grams.by_bucket(buckets)
            frequent = np.zeros(len(order), bool)
            for i, (a, b) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
                if b > a:
                    frequent[a:b] = np.unpackbits(np.frombuffer(masks[row["slice"], i], np.uint8), count=b - a)
            chosen = order[frequent]
            own, spelt = counts.setdefault(row["lang"], {}), [[grams.words[i] for i in grams.ids(grams.keys[chosen], place).tolist()] for place in range(longest - 1, -1, -1)]
            # A place without a word is empty and leaves a blank at the end.
            for phrase, n in zip(map(b" ".join, zip(*spelt, strict=True)), grams.counts[chosen].tolist(), strict=True):
                own[phrase] = own.get(phrase, 0) + n
            totals[row["lang"]] = totals.get(row["lang"], 0) + grams.total
        out = []
        for lang, own in counts.items():
            phrases = [phrase.rstrip(b" ") for phrase in own]
            out.append(pa.table({
                "lang": pa.array([lang] * (len(own) + 1)),
                "phrase": pa.array([*phrases, None], pa.binary()).cast(pa.string()),
                "words": pa.array([*(phrase.count(b" ") + 1 for phrase in phrases), 0], pa.int32()),
                "n": pa.array([*own.values(), totals[lang]], pa.int64()),
            }))
        return pa.concat_tables(out)

    return run


def frequencies(slices: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of up to `longest` words with n >= least, and for each language a null
    phrase whose n counts all its words. slices is read three times: stage it."""
    size = slices.agg(F.sum(F.length("words"))).first()[0] or 0
    buckets = 1 + size // BUCKET
    asked = slices.mapInArrow(_asked(buckets, longest, least), "bucket int, slice long, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered(least), "slice long, bucket int, mask binary")
    # Neighbouring slices together, so that a phrase is sent once for all of them.
    several = lambda rows: rows.withColumn("several", F.shiftright("slice", TOGETHER)).groupBy("several")
    each = several(slices).cogroup(several(answers)).applyInArrow(_told(buckets, longest), "lang string, phrase string, words int, n long")
    return each.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least))


def collocations(counted: DataFrame, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Each language's best phrases of `counted`, as `frequencies` gives it; it is read several times: stage it.

    Scores are whole numbers from exact decimals: counts may have 15 digits.
    """
    phrases = counted.where("phrase IS NOT NULL")
    several = phrases.where("words > 1").withColumnRenamed("n", "a")
    cuts = several.select("lang", "phrase", "a", F.expr("explode(sequence(1, words - 1))").alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = "CAST({} AS DECIMAL(15, 0))".format
    score = f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) DIV ({wide('l')} * {wide('r')})"
    cut = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", F.expr(score))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"))
    inner = """explode(flatten(transform(sequence(2, words - 1), m ->
        transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))"""
    longer = several.where("words > 2").select("lang", F.expr(inner).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    order = [F.desc("least.score"), F.desc("a"), F.asc("phrase")]
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    totals = counted.where("phrase IS NULL").select("lang", "n")
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "least.l", "least.r", "n", F.col("least.score").alias("score")
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = staged(dealt(parse(table(spark, sf_dir, "documents"))), "chunks")
    return collocations(staged(frequencies(slices), "phrases"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) AS lengths(m) WHERE len(w) >= m
), counts AS (
  SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY lang, m, phrase
), totals AS (
  SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang
), cuts AS (
  SELECT lang, m, phrase, c AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest
  FROM counts, (VALUES (1), (2)) AS places(k) WHERE m > k AND c >= 10
), scored AS (
  SELECT t.lang, t.m, t.phrase, t.a, t.k, h.c AS l, r.c AS r,
         CAST((CAST(1000000 AS HUGEINT) * t.a * t.a) // (CAST(h.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM cuts t JOIN counts h ON h.lang = t.lang AND h.phrase = t.head JOIN counts r ON r.lang = t.lang AND r.phrase = t.rest
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, t.k) = 1
), kept AS (
  SELECT * FROM scored s WHERE m = 3 OR NOT EXISTS (
    SELECT 1 FROM cuts t WHERE t.m = 3 AND t.lang = s.lang AND 100 * t.a >= 50 * s.a
      AND ((t.k = 1 AND t.rest = s.phrase) OR (t.k = 2 AND t.head = s.phrase)))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
