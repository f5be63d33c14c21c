"""What the operators of this subpackage share: scratch space, input clean-up and word splitting.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``; ``bytes.split()`` splits on exactly those.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch: documents can be long, so that the session's limit of rows alone would not bound it.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a new temporary one on a single machine."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of keys (one or two longs) that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """A table of keys, counted, as a side of a join: broadcast up to BROADCAST_ROWS, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def packed(df: DataFrame, *without: str):
    """The columns of ``df`` as one struct ``row``, so that no name of theirs meets a name of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without)).alias("row")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def by_batch(df: DataFrame, schema: str | StructType, body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow under a small batch size."""
    small_batches(df.sparkSession)
    return df.mapInArrow(body, schema)


def texts(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Word (bytes) -> row of ``lo`` and ``hi``, two independent 64-bit halves of the word's XXH3-128 hash.

    Bounded: beyond ``most`` distinct words the table starts anew, so memory does not grow with the vocabulary.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most
        self._lo, self._hi = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self._lo):
            self._lo, self._hi = np.resize(self._lo, 2 * k), np.resize(self._hi, 2 * k)
        h = xxhash.xxh3_128_intdigest(word)
        self._lo[k], self._hi[k] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        self[word] = k
        return k

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self._lo[rows], self._hi[rows]
