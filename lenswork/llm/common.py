"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators between words (space, tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs in one process (tests) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lenswork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written, its shuffle files go as soon as they have been read, and Arrow batches stay small.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """While something is collected, Arrow batches stay as small as while a table is written."""
    return settings(spark, {k: v for k, v in WHILE_WRITING.items() if "arrow" in k})


def keep_batches_small(spark: SparkSession) -> None:
    """For results that the caller writes: from now on Arrow batches of the session stay small, unless it has set their size itself."""
    for k, v in WHILE_WRITING.items():
        if "arrow" in k and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with settings(spark, WHILE_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What an operator keeps between tasks of one Python worker; that of other operators is let go."""
    if name not in _caches:
        _caches.clear()
        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
            trim(0)
    return _caches.setdefault(name, {})


def in_slices(batches, most_bytes: int = 8 << 20):
    """Arrow batches in slices of about so many bytes (or one row), as Python objects take several times the room."""
    for b in batches:
        rows = max(1, b.num_rows * most_bytes // max(1, b.get_total_buffer_size()))
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once all that is read from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def filesystem(uri: str):
    """pyarrow file system and path in it, for files that tasks write in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def words(text, pattern: str = SPACES):
    """Words of a text column, in order; null or blank gives an empty array."""
    return F.coalesce(F.array_remove(F.split(text, pattern), ""), F.array().cast("array<string>"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Words(NamedTuple):
    """The words of some texts: the words, the row and the number of the piece of each, and its first and last byte in data."""

    words: pyarrow.LargeStringArray
    row: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: bytes


def split_words(texts: pyarrow.Array, table: bytes) -> Words:
    """All words of an Arrow column of texts; the table maps what is between words to a space, what ends a piece to a line feed."""
    texts = texts.fill_null("")
    kind = np.int64 if pyarrow.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = bytes(memoryview(texts.buffers()[2])[at[0] : at[-1]]) if texts.buffers()[2] else b""
    raw = np.frombuffer(data.translate(table), np.uint8)
    starts = at[:-1] - at[0]
    new = np.zeros(len(raw) + 1, bool)
    new[starts] = True
    new[-1] = True
    gap = (raw == 32) | (raw == 10)
    first = np.flatnonzero(~gap & (new[:-1] | np.append(True, gap[:-1])[: len(gap)]))
    last = np.flatnonzero(~gap & (new[1:] | np.append(gap[1:], True)[: len(gap)]))
    breaks = np.cumsum((raw == 10) | new[:-1])
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first + 1, out=offsets[1:])
    made = pyarrow.LargeStringArray.from_buffers(len(first), pyarrow.py_buffer(offsets), pyarrow.py_buffer(raw[~gap].tobytes()))
    return Words(made, np.searchsorted(starts, first, "right") - 1, breaks[first] if len(first) else first, first, last, data)
