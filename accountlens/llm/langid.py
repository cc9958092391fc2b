"""Language identification by rank-order profiles (Cavnar and Trenkle's out-of-place distance).

A language's profile is the ranking of the most frequent character n-grams of its training texts,
counted by Spark over all of them. A document is ranked the same way, and the language whose profile
has the n-grams in the most similar places wins.

Defined cases: a text that is null or has no letter is `und` with score 0, and so is every text if
nothing could be learned; a null language teaches nothing; an empty table gives an empty result; a
repeated row is predicted like its twin; ties go to the language that sorts first; letters are what str.isalpha
says, so number signs are none; columns other than
the three named are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accountlens.llm.common import parts, staged, table

UNDETERMINED = "und"
#: N-grams of up to so many characters, and how many of them a profile ranks.
LONGEST, PROFILE = 3, 400
#: Languages whose profiles are sent to the executors together (at most this times PROFILE short rows); more
#: languages are compared in further passes over the rows, so no number of languages is too large.
LANGUAGES_AT_ONCE = 500

#: Characters of a text whose n-grams are sorted at once.
STEP = 1 << 20
#: Bits of a character in an n-gram's code: its characters' code points one after the other.
CHARACTER = 21
BLANK = ord(" ")


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _distinct(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes in ascending order, each once, and how often they occur."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    totals = np.diff(heads, append=len(codes)) if counts is None else np.add.reduceat(counts, heads) if len(heads) else counts
    return codes[heads], totals


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the n-grams of a text's words, each word between two blanks and the lone blank left out, with counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[points]
    # A blank ends each word, and one begins the first.
    kept = np.flatnonzero(letter | np.concatenate([[False], letter[:-1]])[: len(letter)])
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.concatenate([[BLANK], np.where(letter[kept], points[kept], BLANK), [] if not letter[-1] else [BLANK]]).astype(np.int64)
    found = []
    for first in range(0, len(line), STEP):
        own, parts = line[first : first + STEP + LONGEST - 1], []
        for n in range(1, LONGEST + 1):
            code, inside = np.zeros(max(0, len(own) - n + 1), np.int64), np.ones(max(0, len(own) - n + 1), bool)
            for i in range(n):
                at = own[i : i + len(code)]
                code = code << CHARACTER | at
                if 0 < i < n - 1 or n == 1:
                    inside &= at != BLANK
            parts.append(code[inside][: np.count_nonzero(inside[:STEP])])
        found.append(_distinct(np.concatenate(parts)))
    if len(found) == 1:
        return found[0]
    return _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))


def gram_text(code: int) -> str:
    points = [code >> CHARACTER * i & ((1 << CHARACTER) - 1) for i in range(LONGEST - 1, -1, -1)]
    return "".join(chr(point) for point in points if point)


def gram_code(gram: str) -> int:
    code = 0
    for character in gram:
        code = code << CHARACTER | ord(character)
    return code


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list] = defaultdict(list)
        for part in parts(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by_lang[lang].append(grams(text))
            for lang, found in by_lang.items():
                by_lang[lang] = [_distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        for lang, ((codes, counts),) in by_lang.items():
            spelt = pa.array([gram_text(code) for code in codes.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), spelt, pa.array(counts)], names=["lang", "gram", "n"])


def profiles(training: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the n-grams of each language by falling count, from 0; training has lang and text."""
    known = training.select("lang", "text").where("lang is not null and text is not null")
    counts = known.mapInArrow(_counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("place", place).where(F.col("place") < size).select("lang", "gram", "place")


class Ranker:
    """Places of n-grams in the profiles of some languages, and the distance of a text to each of them."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int):
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        self.codes = np.array(sorted({gram_code(gram) for _, gram, _ in rows}), np.int64)
        # A column more, for n-grams that no profile has.
        self.places = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for lang, gram, place in rows:
            self.places[number[lang], np.searchsorted(self.codes, gram_code(gram))] = place

    def distances(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each language, the mean out-of-place distance as a share of the largest possible.

        N-grams of one count are ranked by their codes.
        """
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.codes, top)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != top] = len(self.codes)
        places = self.places[:, at]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(top))))
        return apart.mean(axis=1) / self.size


def _scorer(rows: list[tuple[str, str, int]], size: int, text_at: int):
    """Adds the nearest language and its distance, or keeps those of an earlier pass if they are nearer."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(rows, size)
        for whole in batches:
            for batch in parts(whole, text_at):
                langs, apart = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for i, text in enumerate(batch.column(text_at).to_pylist()):
                    codes, counts = grams(text)
                    if len(codes) and ranker.langs:
                        distances = ranker.distances(codes, counts)
                        best = int(distances.argmin())
                        if (distances[best], ranker.langs[best]) < (apart[i], langs[i]):
                            langs[i], apart[i] = ranker.langs[best], float(distances[best])
                columns = batch.columns[:-2] + [pa.array(langs, pa.string()), pa.array(apart, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return score


def classify(df: DataFrame, learned: DataFrame, text: str, pred: str, score: str, size: int = PROFILE) -> DataFrame:
    """df with two more columns: the language, and 0 to 1 (1: every n-gram in its place); df must not have them.

    learned: the result of profiles(). The rows stay where they are: nothing is shuffled.
    """
    learned = staged(learned, "profiles")
    out = df.select("*", F.lit(UNDETERMINED).alias(pred), F.lit(2.0).alias(score))
    langs = sorted(row.lang for row in learned.select("lang").distinct().toLocalIterator())
    for first in range(0, len(langs), LANGUAGES_AT_ONCE):
        block = learned.where(F.col("lang").isin(langs[first : first + LANGUAGES_AT_ONCE]))
        rows = [(row.lang, row.gram, row.place) for row in block.collect()]
        out = out.mapInArrow(_scorer(rows, size, df.columns.index(text)), out.schema)
    return out.select(*df.columns, pred, F.when(F.col(score) > 1, 0.0).otherwise(1 - F.col(score)).alias(score))


def remainder(doc_id: str, of: int):
    return F.crc32(F.col(doc_id).cast("string")) % of


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of docs (doc_id, text, lang), learned from the rows whose crc32(doc_id) mod 3 is not 1.

    A null doc_id has no remainder; such a row is not held out and teaches.
    """
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    learned = profiles(docs.where(~held_out).select("lang", "text"))
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return classify(marked, learned, "text", "lang_pred", "score").drop("text")


def op6_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
