"""Helpers that the text operators share: Arrow passes over whole texts, hashed words, tables made by Spark from SQL values."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one Arrow batch of results stands for; longer texts are a batch of their own.
BATCH_BYTES = 4 << 20
#: Words whose hash a Python worker remembers.
KEPT_WORDS = 300_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows written as Parquet to a (new) folder of the shared checkpoint folder and read again, without their lineage."""
    spark = df.sparkSession
    path = path or f"{spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lowered_ascii(text):
    """The column with A-Z in lower case and everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no piece holds much more than ``most`` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch[column].cast(pa.binary())).fill_null(0)).astype(np.int64)
        group = np.cumsum(sizes) // most
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(begin), int(end - begin))


class Remembered(dict):
    """A dictionary that makes missing values with ``make`` and remembers a bounded number of them."""

    def __init__(self, make: Callable, most: int = KEPT_WORDS):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


WORD_HASHES = Remembered(xxhash.xxh3_64_intdigest)

MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive words (of their hashes), in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width * int(MIX) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(width):
        out ^= hashes[k:n + k]
        out *= MIX
        out ^= out >> np.uint64(29)
    return out
