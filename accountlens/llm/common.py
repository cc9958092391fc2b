"""What several operators share: reading, staging, words and tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from accountlens.session import new_shared_path

#: Entries that a worker's word cache may hold before it starts anew.
CACHE_ENTRIES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, written once to the shared folder, so that later passes and lost executors reread them."""
    path = new_shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but space and the control characters 9 to 13; a null text has none."""
    return text.split() if text else []


class WordCache(dict):
    """A value for each word, made on demand; it is emptied when full, so that memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = self.make(word)
        return value


def parts(batch: pa.RecordBatch, text_at: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text, so that what is made of a slice stays small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows]
    for first, until in zip(cuts, cuts[1:], strict=False):
        if until > first:
            yield batch.slice(first, until - first)


#: An odd number and its inverse modulo 2**64, for window hashes; and a mixer's factor.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93


class Windows:
    """Hashes of stretches of a sequence of 64-bit codes, each in constant time."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        factors = np.full((2, n + 1), 1, np.uint64)
        factors[0, 1:], factors[1, 1:] = BASE, INVERSE
        self.up, down = np.cumprod(factors, axis=1, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.view(np.uint64) * down[:n], dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """A mixed hash of the codes from each start on; equal stretches have equal hashes wherever they are."""
        value = (self.sums[starts + lengths] - self.sums[starts]) * self.up[starts]
        value ^= value >> np.uint64(32)
        value *= np.uint64(MIX)
        return value ^ (value >> np.uint64(29))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
