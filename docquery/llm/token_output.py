"""Token ids as binary files of patched frame-of-reference blocks.

A file holds whole documents: a header, the documents' ids (and whether each has one) and token counts, for each block
of 128 ids its minimum, width, number of exceptions and start, and then the blocks. A block is its ids less the minimum, packed at the width
that the 90th percentile needs; ids too large for it stand in the block's exception list (positions, then values).
Block starts make a range of ids readable without the blocks before it.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import common, tokens

MAGIC = b"PFR2"
BLOCK = 128
PERCENTILE = 90
#: Ids after which a task closes its file and begins another (about 2 bytes each), and blocks that are packed at once.
FILE_IDS = 8_000_000
CHUNK_BLOCKS = 4096
#: Rows whose texts share the encoder's dictionary of words.
ROWS = 1024

_HEADER = struct.Struct("<4sIQ")


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values under 2^width as (n, 16 * width) bytes."""
    columns = np.ascontiguousarray(rows.T.astype(np.uint64))
    words = np.zeros((2 * width, len(rows)), np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 64)
        words[at] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(rows), 16 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(len(packed), 2 * width).T)
    out, mask = np.empty((BLOCK, len(packed)), np.uint32), np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 64)
        x = words[at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[at + 1] << np.uint64(64 - shift)
        out[j] = x & mask
    return out.T


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _blocks(full: np.ndarray) -> tuple[np.ndarray, ...]:
    """Minimum, width, number of exceptions, size and bytes of each row of (n, BLOCK) ids; the bytes are laid end to end."""
    least = full.min(axis=1)
    values = full - least[:, None]
    rank = BLOCK * PERCENTILE // 100 - 1
    width = _bits(np.partition(values, rank, axis=1)[:, rank])
    odd = values > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    n_odd = odd.sum(axis=1)
    size = 16 * width + 5 * n_odd
    starts = np.cumsum(size) - size
    blocks = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            blocks[starts[rows][:, None] + np.arange(16 * w)] = _pack(values[rows] & np.uint32((1 << int(w)) - 1), int(w))
    which, where = np.nonzero(odd)
    if len(which):
        nth = np.arange(len(which)) - (np.cumsum(n_odd) - n_odd)[which]
        lists = starts[which] + 16 * width[which]
        blocks[lists + nth] = where
        blocks[(lists + n_odd[which] + 4 * nth)[:, None] + np.arange(4)] = values[which, where].astype("<u4").view(np.uint8).reshape(-1, 4)
    return least, width, n_odd, size, blocks


def encode_ids(ids: np.ndarray) -> bytes:
    """Block table and blocks of a uint32 array."""
    n_blocks = -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.repeat(ids[-1:], n_blocks * BLOCK - len(ids))]).reshape(n_blocks, BLOCK)
    none = [(np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint8))]
    parts = [_blocks(full[low : low + CHUNK_BLOCKS]) for low in range(0, n_blocks, CHUNK_BLOCKS)] or none
    least, width, n_odd, size = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:4])
    starts = np.concatenate([[0], np.cumsum(size)])
    return b"".join([least.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), n_odd.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(), *(x[4].tobytes() for x in parts)])


def _table(content: bytes, n_ids: int, at: int) -> tuple:
    n = -(-n_ids // BLOCK)
    least = np.frombuffer(content, "<u4", n, at)
    width = np.frombuffer(content, np.uint8, n, at + 4 * n).astype(np.int64)
    n_odd = np.frombuffer(content, np.uint8, n, at + 5 * n).astype(np.int64)
    starts = np.frombuffer(content, "<u8", n + 1, at + 6 * n).astype(np.int64)
    return least, width, n_odd, starts, at + 6 * n + 8 * (n + 1)


def decode_ids(content: bytes, n_ids: int, at: int = 0, first: int = 0, count: int | None = None) -> np.ndarray:
    """ids[first : first + count] of the blocks whose table begins at byte `at`; only the blocks that hold them are unpacked."""
    count = n_ids - first if count is None else count
    least, width, n_odd, starts, base = _table(content, n_ids, at)
    if count <= 0:
        return np.zeros(0, np.uint32)
    low, high = first // BLOCK, -(-(first + count) // BLOCK)
    least, width, n_odd, starts = least[low:high], width[low:high], n_odd[low:high], starts[low : high + 1]
    data = np.frombuffer(content, np.uint8)
    out = np.zeros((high - low, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(data[base + starts[rows][:, None] + np.arange(16 * w)], int(w))
    which = np.repeat(np.arange(high - low), n_odd)
    if len(which):
        nth = np.arange(len(which)) - np.concatenate([[0], np.cumsum(n_odd)])[which]
        lists = base + starts[which] + 16 * width[which]
        out[which, data[lists + nth]] = np.ascontiguousarray(data[(lists + n_odd[which] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return (out + least[:, None]).reshape(-1)[first - low * BLOCK :][:count]


def encode_file(doc_ids: list[int | None] | pa.Array, counts: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    doc_ids = pa.array(doc_ids, pa.int64()) if isinstance(doc_ids, list) else doc_ids
    known = pc.is_valid(doc_ids).to_numpy(zero_copy_only=False).astype(np.uint8)
    numbers = pc.fill_null(doc_ids, 0).to_numpy()
    return _HEADER.pack(MAGIC, len(doc_ids), len(ids)) + known.tobytes() + numbers.astype("<i8").tobytes() + np.array(counts, "<u8").tobytes() + encode_ids(ids)


def decode_file(content: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all ids of a file."""
    magic, n_docs, n_ids = _HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = _HEADER.size
    known, docs = np.frombuffer(content, np.uint8, n_docs, at), np.frombuffer(content, "<i8", n_docs, at + n_docs)
    counts = np.frombuffer(content, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    return pa.array(docs, mask=known == 0), counts, decode_ids(content, n_ids, at + 17 * n_docs)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the ids of every text, each document closed by end_id, in ascending doc_id order (repeated ids: by text).

    Null and empty texts are their end id alone; a null doc_id sorts first and comes back null; very long texts are
    encoded in parts with the same ids; other columns are ignored; an empty table gives no files. Returns the manifest: one row for each file, with its order, and the number of ids before it. A task
    that runs again writes files of new names, and only those of the attempt that Spark commits are in the manifest.
    """
    spark = docs.sparkSession
    folder = folder or common.fresh_dir(spark, "token-files")

    def write(batches):
        encoder, part, n_file = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        shape = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def close():
            nonlocal held, size, n_file
            path = f"{folder}/{part:06d}-{n_file:05d}-{uuid.uuid4().hex}.pfr"
            docs, counts, ids = pa.concat_arrays([x[0] for x in held]), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
            common.write_file(path, encode_file(docs, counts, ids))
            row = pa.RecordBatch.from_pydict({"part": [part], "nth": [n_file], "path": [path], "n_docs": [len(docs)], "n_ids": [len(ids)]}, schema=shape)
            held, size, n_file = [], 0, n_file + 1
            return row

        for batch in common.slices(batches, ROWS):
            ids, counts = encoder.encode_closed(batch.column(1), end_id)
            held.append((batch.column(0), counts, ids))
            size += len(ids)
            if size >= FILE_IDS:
                yield close()
        if held:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange(common.task_count(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return common.stored(ordered.mapInArrow(write, "part int, nth int, path string, n_docs long, n_ids long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files in order: doc_id, start (ids before it), n_tokens and the ids' bytes, little-endian."""
    spark = manifest.sparkSession
    # totals of a task's files first: the only window over all rows sees one row for each task that wrote
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lead"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("own", own).join(parts, "part").select("path", (F.col("lead") + F.col("own")).alias("base"))
    files = files.repartition(common.task_count(spark), "path")

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, counts, ids = decode_file(common.read_file(path))
                edges = np.concatenate([[0], np.cumsum(counts)])
                raw = pa.py_buffer(ids.astype("<u4", copy=False).tobytes())
                for low in range(0, len(docs), ROWS):
                    high = min(low + ROWS, len(docs))
                    spans = pa.py_buffer((edges[low : high + 1] * 4).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([
                        docs.slice(low, high - low), pa.array(base + edges[low:high]), pa.array(counts[low:high]),
                        pa.Array.from_buffers(pa.large_binary(), high - low, [None, spans, raw]).cast(pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of whole documents, read back. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as write_tokens states."""
    files = write_tokens(common.table(spark, sf_dir, "documents"), tokens.default_path())
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["decode_file", "decode_ids", "encode_file", "encode_ids", "op4_token_output", "read_tokens", "write_tokens"]
