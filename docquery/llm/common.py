"""Helpers the training-data operators share: the shared folder, tables and hashing of text batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.session import shared_root

#: Rows of an Arrow batch handled at once, so that a task's memory follows this and not the batch size.
SLICE_ROWS = 512

MASK = (1 << 64) - 1
#: Bases of two unrelated hashes of byte spans; where 64 bits may not do, both are used.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_root(spark)}/docquery/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Executions begun inside drop their shuffle files as they end; else those stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, so that later steps start from files."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def slices(batches, rows: int = SLICE_ROWS):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its worker lives on, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and where each row begins (one more than rows). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in any of the inclusive spans."""
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every maximal run of non-separators; words never cross rows. Third: words before each row, one more than rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): neighbouring inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) for base in BASES]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(family: int, inverse: bool, n: int) -> np.ndarray:
    have = _powers.get((family, inverse))
    if have is None or len(have) < n:
        base = BASES[family]
        factor = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
        factor[0] = 1
        have = _powers[family, inverse] = np.cumprod(factor, dtype=np.uint64)
    return have[:n]


def powers(family: int, n: int) -> np.ndarray:
    """The family's base to the powers 0 to n - 1, modulo 2^64."""
    return _power(family, False, n)


def prefix_hash(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Sums of byte value times base^position modulo 2^64, before each byte and at the end."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[family][data] * _power(family, False, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair, whatever the place; the prefix must be of the same family."""
    raw = (prefix[ends] - prefix[starts]) * _power(family, True, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def file_at(uri: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, content: bytes) -> None:
    system, path = file_at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(content)


def read_file(uri: str) -> bytes:
    system, path = file_at(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()
