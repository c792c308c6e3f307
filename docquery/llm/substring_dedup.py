"""Repeated byte strings across documents, by distributed prefix doubling over a synchronising set of positions.

Sorting all positions at every doubling would move many times the corpus, so positions are thinned first: among the
grams of GRAM bytes inside a window of LENGTH bytes, the one with the smallest hash stands for the window. The choice
depends on the window's bytes alone, so equal windows have equal grams at equal offsets, and all windows belong to
some gram's run of consecutive windows. Then, at growing lengths, Spark sorts ranks and what is unique is dropped:

1. whole texts: all but the first of equal texts are repeats, and only the first goes on;
2. grams: those that stand at one place only are dropped;
3. whole runs: all but the first of equal runs are repeats, and only the first goes on;
4. rounds of doubling around each gram: a position's rank after a round is the pair of its rank before and the rank of
   the bytes at the next offset, to the right and to the left. Unique ranks leave the rounds, and how far a position
   came bounds its windows that can be repeated;
5. those windows, at the full length: all but the first of equal ones are repeats.

A rank is the name of its class, a 64-bit hash, so no numbering of all classes is needed; in rounds a false match only
leaves more windows for step 5, and steps 1, 3 and 5 tell strings apart by 128 bits. Each text file ("bucket", one for
each task that wrote one) sends a class once, however often it holds it, so that a class has no more rows in a sort
than there are files. The files stay in the shared folder with what each step found in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from docquery.llm import common

LENGTH = 100
GRAM = 32
#: Rounds of doubling on each side of a gram, before windows are compared at the full length.
ROUNDS = 4
#: Rows of a batch in the text files, and bytes that are hashed at once: the arrays stay in the processor's cache.
FILE_ROWS = 64
PIECE = 1 << 18
#: Rows of the result sets that a task yields at once.
OUT_ROWS = 1 << 16

_TO_BUCKETS = "bucket long, kind int, x long"
MARK, LIVE, COPY, CLASS, WINDOW, RANK = range(6)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i that has so many."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows that one gram stands for: row, first window, number of windows, gram hash, gram's place, hash prefix.

    Windows are whole inside their row; places count from the start of data.
    """
    none = np.zeros(0, np.int64)
    prefix = common.prefix_hash(data)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none, prefix
    at = np.arange(len(data) - gram + 1)
    hashed = common.span_hash(prefix, at, at + gram)
    key = (hashed & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    chosen = (_sliding_least(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    whole = np.arange(len(chosen)) + length <= offsets[1:][row]
    change = np.ones(len(chosen), bool)
    change[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    n = np.diff(np.append(first, len(chosen)))
    keep = whole[first]
    first, n = first[keep], n[keep]
    return row[first], first, n, hashed[chosen[first]], chosen[first], prefix


def pieces(offsets: np.ndarray, length: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of about `most` bytes as first row, last row + 1, start and stop; a longer row is cut into parts of which each window of `length` bytes is in one."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        start, stop = int(offsets[low]), int(offsets[high])
        if stop - start <= most + length:
            yield low, high, start, stop
        else:
            for a in range(start, stop - length + 1, most):
                yield low, high, a, min(stop, a + most + length - 1)
        low = high


def _path(folder: str, name: str, bucket: int) -> str:
    return f"{folder}/{name}/{bucket}"


def _put(folder: str, name: str, bucket: int, columns: dict[str, np.ndarray]) -> None:
    """Keep what a task found in a bucket. A task that runs again finds the same and replaces it whole."""
    system, path = common.file_at(_path(folder, name, bucket))
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(own, compression=None) as out:
        pq.write_table(pa.table(columns), out, compression="zstd", compression_level=1, use_dictionary=False, row_group_size=1 << 20)
    system.move(own, path)


def _get(folder: str, name: str, bucket: int) -> dict[str, np.ndarray] | None:
    system, path = common.file_at(_path(folder, name, bucket))
    if system.get_file_info(path).type == pa.fs.FileType.NotFound:
        return None
    with system.open_input_file(path) as source:
        table = pq.read_table(source)
    return {c: table[c].to_numpy() for c in table.column_names}


def _batches(folder: str, bucket: int, columns: list[str] | None = None, rows: int = FILE_ROWS, name: str = "texts"):
    """First row and rows of the batches of a bucket's file."""
    system, path = common.file_at(_path(folder, name, bucket))
    with system.open_input_file(path) as source:
        first = 0
        for batch in pq.ParquetFile(source).iter_batches(batch_size=rows, columns=columns):
            yield first, batch
            first += batch.num_rows


def _live(folder: str, bucket: int, rows: np.ndarray):
    """Of each batch with some of the rows (ascending): their numbers, order keys of their doc_ids, bytes and offsets."""
    for first, batch in _batches(folder, bucket, ["doc_id", "text"]):
        low, high = np.searchsorted(rows, [first, first + batch.num_rows])
        if low < high:
            batch = batch.take(pa.array(rows[low:high] - first))
            yield (rows[low:high], *_order_of(batch.column(0)), *common.text_buffer(batch.column(1)))


def _order_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_id, and what is added to a start so that (first, second + start) orders places with a null doc_id before all others."""
    least = np.int64(-(1 << 63))
    return pc.fill_null(ids, int(least)).to_numpy(), np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), np.int64(-(1 << 62)), np.int64(0))


def _rows(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[low : low + OUT_ROWS]) for c in columns], names=names)


def _held(batches, *kinds: int) -> list[np.ndarray]:
    """The messages of one bucket by kind, ascending; their number is bounded by the bucket's size."""
    kind, x = [], []
    for batch in batches:
        kind.append(batch.column("kind").to_numpy())
        x.append(batch.column("x").to_numpy())
    kind, x = np.concatenate(kind), np.concatenate(x)
    return [np.sort(x[kind == k]) for k in kinds]


def _among(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of x are in the ascending array."""
    if not len(wanted):
        return np.zeros(len(x), bool)
    return wanted[np.minimum(np.searchsorted(wanted, x), len(wanted) - 1)] == x


def _each_bucket(messages: DataFrame, run, schema: str | StructType) -> DataFrame:
    """run(bucket, its messages) for each bucket. The number of tasks is not left to their small size: the files behind them are not small."""
    spread = messages.repartition(common.task_count(messages.sparkSession), "bucket")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from run(first.column("bucket")[0].as_py(), _chain(first, batches))
        common.give_back()

    return spread.groupBy("bucket").applyInArrow(one, schema)


def _chain(first, rest):
    yield first
    yield from rest


_CLASSES = "k long, bucket long, twice boolean"


def _class_rows(bucket: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, n = np.unique(keys, return_counts=True)
    yield from _rows(["k", "bucket", "twice"], [k, np.full(len(k), bucket), n > 1])


def _repeated(found: DataFrame, kind: int) -> DataFrame:
    """Messages with the classes that stand at two places at least, to each bucket that holds them.

    found has a row for each class of a bucket; twice: it stands twice in that one. Spark sorts, and rows stream.
    """

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def out(k, bucket, twice):
            if not len(k):
                return
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(edge, len(k)))
            keep = np.repeat((size > 1) | np.logical_or.reduceat(twice, edge), size)
            yield from _rows(["bucket", "kind", "x"], [bucket[keep], np.full(int(keep.sum()), kind, np.int32), k[keep]])

        for batch in batches:
            held = [np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False)]) for i, a in enumerate(held)]
            if batch.num_rows:  # the last class may go on: at most a row for each bucket waits
                edge = int(np.searchsorted(held[0], held[0][-1]))
                yield from out(*(a[:edge] for a in held))
                held = [a[edge:] for a in held]
        yield from out(*held)

    return found.repartition(common.task_count(found.sparkSession), "k").sortWithinPartitions("k").mapInArrow(run, _TO_BUCKETS)


_PLACES = "k1 long, k2 long, doc long, at long, bucket long, slot long"


def _later(found: DataFrame, kind: int) -> DataFrame:
    """Messages with the slots of the rows that are not at the first place (doc, at) of their class (k1, k2); equal places are all first."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, doc, at, bucket, slot = (c.to_numpy() for c in batch.columns)
            head = np.ones(len(k1), bool)
            head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            head[0] = last is None or (k1[0], k2[0]) != last[:2]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(k1)), -1))
            first_doc, first_at = np.where(lead < 0, last[2] if last else 0, doc[lead]), np.where(lead < 0, last[3] if last else 0, at[lead])
            keep = (doc != first_doc) | (at != first_at)
            yield from _rows(["bucket", "kind", "x"], [bucket[keep], np.full(int(keep.sum()), kind, np.int32), slot[keep]])
            last = (k1[-1], k2[-1], first_doc[-1], first_at[-1])

    return found.repartition(common.task_count(found.sparkSession), "k1", "k2").sortWithinPartitions("k1", "k2", "doc", "at").mapInArrow(run, _TO_BUCKETS)


def _local_classes(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each row, the row at each class's first place, and whether a row is at another place than that."""
    order = np.lexsort((at, doc, k2, k1))
    head = np.ones(len(order), bool)
    head[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    number = np.cumsum(head) - 1
    lead = order[head]
    own = np.empty(len(order), np.int64)
    own[order] = number
    return own, lead, (doc != doc[lead][own]) | (at != at[lead][own])


def _store_texts(docs: DataFrame, folder: str) -> DataFrame:
    """Write the rows of each task into a file of its own; for each row: bucket, idx in the file, doc, known (0: no doc_id), size and digest of the text."""

    def run(batches):
        bucket, done = TaskContext.get().taskAttemptId(), 0
        system, path = common.file_at(_path(folder, "texts", bucket))
        system.create_dir(path.rpartition("/")[0], recursive=True)
        writer, out = None, system.open_output_stream(path, compression=None)
        for batch in common.slices(batches, FILE_ROWS):
            if writer is None:
                writer = pq.ParquetWriter(out, batch.schema, compression="zstd", compression_level=1, use_dictionary=False)
            writer.write_batch(batch, row_group_size=FILE_ROWS * 16)
            data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
            view = memoryview(data)
            digest = np.array([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], "V16").view("<i8").reshape(-1, 2)
            doc, shift = _order_of(batch.column(batch.schema.get_field_index("doc_id")))
            n = batch.num_rows
            columns = [np.full(n, bucket), np.arange(done, done + n), doc, (shift == 0).astype(np.int32), np.diff(offsets), digest[:, 0], digest[:, 1]]
            yield from _rows(["bucket", "idx", "doc", "known", "size", "d1", "d2"], columns)
            done += n
        if writer is not None:
            writer.close()
        out.close()

    return docs.mapInArrow(run, "bucket long, idx long, doc long, known int, size long, d1 long, d2 long")


def _first_texts(texts: DataFrame, length: int) -> DataFrame:
    """Messages with the rows of at least length bytes: COPY where an earlier document has the text, LIVE else."""
    long_ = texts.filter(F.col("size") >= length)
    first = long_.groupBy("d1", "d2").agg(F.min(F.struct("doc", "known")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # stored, so that the join alone shuffles both sides and a text with very many copies can be split
    joined = long_.join(common.stored(first, "first-texts").hint("merge"), ["d1", "d2"], "left")
    copy = F.coalesce(F.struct("doc", "known") != F.col("first"), F.lit(False))
    return joined.select("bucket", F.when(copy, COPY).otherwise(LIVE).alias("kind"), F.col("idx").alias("x"))


def _grams(live: DataFrame, folder: str, length: int, gram: int, piece: int) -> DataFrame:
    """The distinct grams of each bucket's first texts."""

    def run(bucket, batches):
        (rows,) = _held(batches, LIVE)
        found = [np.zeros(0, np.int64)]
        for _, _, _, data, offsets in _live(folder, bucket, rows):
            for low, high, start, stop in pieces(offsets, length, piece):
                h = runs(data[start:stop], np.clip(offsets[low : high + 1] - start, 0, stop - start), length, gram)[3]
                found.append(common.signed(h))
        yield from _class_rows(bucket, np.concatenate(found))

    return _each_bucket(live, run, _CLASSES)


def _run_classes(messages: DataFrame, folder: str, length: int, gram: int, piece: int) -> DataFrame:
    """The distinct runs of repeated grams in each bucket, by their bytes; all runs are kept with the bucket."""

    def run(bucket, batches):
        rows, wanted = _held(batches, LIVE, RANK)
        if not len(wanted):
            return
        out = []
        for numbers, doc, shift, data, offsets in _live(folder, bucket, rows):
            for low, high, start, stop in pieces(offsets, length, piece):
                part = data[start:stop]
                row, first, n, h, m, prefix = runs(part, np.clip(offsets[low : high + 1] - start, 0, stop - start), length, gram)
                keep = np.flatnonzero(_among(common.signed(h), wanted))
                if len(keep):
                    row, first, n, h, m = row[keep] + low, first[keep], n[keep], h[keep], m[keep]
                    end = first + n - 1 + length
                    v = (common.signed(common.span_hash(p, first, end, f)) for f, p in enumerate((prefix, common.prefix_hash(part, 1))))
                    begin = first + start - offsets[row]
                    out.append((numbers[row], begin, n, m - first, common.signed(h), *v, doc[row], shift[row] + begin))
        if not out:
            return
        idx, begin, n, off, h, v1, v2, doc, at = (np.concatenate(x) for x in zip(*out, strict=True))
        own, lead, again = _local_classes(v1, v2, doc, at)
        _put(folder, "runs", bucket, {"idx": idx, "start": begin, "stop": begin + n - 1 + length, "class": own, "again": again})
        _put(folder, "classes", bucket, {"h": h[lead], "idx": idx[lead], "start": begin[lead], "n": n[lead], "off": off[lead], "doc": doc[lead], "at": at[lead]})
        yield from _rows(["k1", "k2", "doc", "at", "bucket", "slot"], [v1[lead], v2[lead], doc[lead], at[lead], np.full(len(lead), bucket), np.arange(len(lead))])

    return _each_bucket(messages, run, _PLACES)


def _lead_grams(messages: DataFrame, folder: str) -> DataFrame:
    """The grams of the runs that are first of their class, kept with the bucket."""

    def run(bucket, batches):
        (later,) = _held(batches, CLASS)
        known = _get(folder, "classes", bucket)
        if known is not None:
            keep = np.ones(len(known["h"]), bool)
            keep[later] = False
            leads = {c: x[keep] for c, x in known.items()}
            _put(folder, "leads", bucket, leads)
            yield from _class_rows(bucket, leads["h"])

    return _each_bucket(messages, run, _CLASSES)


def _lengths(length: int, gram: int) -> list[int]:
    """Bytes beyond the gram that a rank covers after each round."""
    return [(length - gram) * (i + 1) // ROUNDS for i in range(ROUNDS)]


def _ranks(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray, gram_at: np.ndarray, reach: int, gram: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each position whose run holds so many bytes beyond the gram (side 0: after it, 1: before it), and which these are."""
    low, high = (gram_at, gram_at + gram + reach) if side == 0 else (gram_at - reach, gram_at + gram)
    there = np.flatnonzero((low >= begin) & (high <= end))
    named = common.span_hash(prefix, low[there], high[there]) ^ np.uint64((2 * reach + side + 1) * 0x9E3779B97F4A7C15 & common.MASK)
    return common.signed(common.mix(named)), there


def _open_runs(folder: str, bucket: int):
    """Batches of a bucket's open runs as one buffer: hash prefix, begin, end and gram's place of each there, and its columns."""
    for _, batch in _batches(folder, bucket, rows=4096, name="open"):
        data, offsets = common.text_buffer(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
        yield data, offsets[:-1], offsets[1:], offsets[:-1] + batch.column("off").to_numpy(), batch


def _round(messages: DataFrame, folder: str, k: int, length: int, gram: int) -> DataFrame:
    """Ranks after round k of the positions whose rank before is in the messages; before the first round that is their gram."""
    reach = _lengths(length, gram)

    def keep_open(bucket, wanted):
        leads = _get(folder, "leads", bucket)
        which = np.flatnonzero(_among(leads["h"], wanted))
        which = which[np.lexsort((leads["start"][which], leads["idx"][which]))]
        leads = {c: x[which] for c, x in leads.items()}
        stop = leads["start"] + leads["n"] - 1 + length
        content: list[bytes] = []
        for first, batch in _batches(folder, bucket, ["text"]):
            low, high = np.searchsorted(leads["idx"], [first, first + batch.num_rows])
            for i in range(low, high):
                content.append(batch.column(0)[int(leads["idx"][i]) - first].as_buffer()[int(leads["start"][i]) : int(stop[i])].to_pybytes())
        _put(folder, "open", bucket, {**{c: leads[c] for c in ("idx", "start", "n", "off", "doc", "at")}, "bytes": pa.array(content, pa.binary())})

    def run(bucket, batches):
        (wanted,) = _held(batches, RANK)
        if not len(wanted):
            return
        if k == 0:
            keep_open(bucket, wanted)
        found = [np.zeros(0, np.int64)]
        for data, begin, end, at, _ in _open_runs(folder, bucket):
            prefix = common.prefix_hash(data)
            for side in (0, 1):
                alive = np.ones(len(at), bool)
                if k:
                    rank, there = _ranks(prefix, begin, end, at, reach[k - 1], gram, side)
                    alive[:] = False
                    alive[there[_among(rank, wanted)]] = True
                rank, there = _ranks(prefix, begin, end, at, reach[k], gram, side)
                found.append(rank[alive[there]])
        yield from _class_rows(bucket, np.concatenate(found))

    return _each_bucket(messages, run, _CLASSES)


def _window_classes(messages: DataFrame, folder: str, length: int, gram: int) -> DataFrame:
    """The distinct windows of each bucket's open runs that the shared ranks leave; their places are kept with the bucket."""
    reach = _lengths(length, gram)

    def run(bucket, batches):
        (shared,) = _held(batches, RANK)
        out = []
        for data, begin, end, at, batch in _open_runs(folder, bucket) if len(shared) else ():
            prefix = common.prefix_hash(data)
            far = []
            for side in (0, 1):
                most = np.full(len(at), reach[0] - 1)  # a window with more bytes on this side than that would share the next rank
                for k in range(ROUNDS):
                    rank, there = _ranks(prefix, begin, end, at, reach[k], gram, side)
                    most[there[_among(rank, shared)]] = reach[k + 1] - 1 if k + 1 < ROUNDS else length - gram
                far.append(most)
            low = np.maximum(begin, at - far[1])
            high = np.minimum(end - length, at + gram + far[0] - length)
            n = np.maximum(0, high - low + 1)
            of = np.repeat(np.arange(len(n)), n)
            w = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            if len(w):
                keys = (common.signed(common.span_hash(p, w, w + length, f)) for f, p in enumerate((prefix, common.prefix_hash(data, 1))))
                idx, start, doc, place = (batch.column(c).to_numpy()[of] for c in ("idx", "start", "doc", "at"))
                ahead = w - begin[of]
                out.append((*keys, doc, place + ahead, idx, start + ahead))
        if not out:
            return
        k1, k2, doc, at, idx, start = (np.concatenate(x) for x in zip(*out, strict=True))
        own, lead, again = _local_classes(k1, k2, doc, at)
        _put(folder, "windows", bucket, {"idx": idx, "start": start, "stop": start + length, "class": own, "again": again})
        yield from _rows(["k1", "k2", "doc", "at", "bucket", "slot"], [k1[lead], k2[lead], doc[lead], at[lead], np.full(len(lead), bucket), np.arange(len(lead))])

    return _each_bucket(messages, run, _PLACES)


def _merged(idx: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch, joined, in order of row and start."""
    if not len(idx):
        return idx, start, stop
    order = np.lexsort((start, idx))
    idx, start, stop = idx[order], start[order], stop[order]
    base = idx - idx[0] << 36
    so_far = np.maximum.accumulate(base + stop)
    head = np.ones(len(idx), bool)
    head[1:] = (idx[1:] != idx[:-1]) | (base[1:] + start[1:] > so_far[:-1])
    edge = np.flatnonzero(head)
    return idx[edge], start[edge], (so_far - base)[np.append(edge[1:], len(idx)) - 1]


def _spans(folder: str, bucket: int, messages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of what is removed from a bucket's texts, in order; a copy's span ends at -1."""
    copies, classes, windows = _held(messages, COPY, CLASS, WINDOW)
    parts = []
    for name, later in (("runs", classes), ("windows", windows)):
        if (known := _get(folder, name, bucket)) is not None:
            gone = known["again"] | _among(known["class"], later)
            parts.append([known[c][gone] for c in ("idx", "start", "stop")])
    idx, start, stop = _merged(*(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 3
    idx, start, stop = (np.concatenate(x) for x in ((idx, copies), (start, np.zeros_like(copies)), (stop, np.full_like(copies, -1))))
    order = np.argsort(idx, kind="stable")  # copies have no other spans: they are not among the first texts
    return idx[order], start[order], stop[order]


def _cut(folder: str, bucket: int, messages, columns: list[str] | None):
    """Batches of a bucket's file, and for each row its bytes and the spans that go."""
    idx, start, stop = _spans(folder, bucket, messages)
    for first, batch in _batches(folder, bucket, columns):
        edges = np.searchsorted(idx, np.arange(first, first + batch.num_rows + 1)).tolist()
        texts = batch.column(batch.schema.get_field_index("text"))
        rows = []
        for k in range(batch.num_rows):
            text = texts[k].as_buffer() if texts[k].is_valid else pa.py_buffer(b"")
            a, b = edges[k], edges[k + 1]
            rows.append((memoryview(text), [(x, len(text) if y < 0 else y) for x, y in zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True)]))
        yield batch, rows


def _whole_characters(text: bytes, spans: list[list[int]]) -> str:
    """The text without the characters that lie wholly inside a span."""
    out, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode()


def _found(docs: DataFrame, folder: str, length: int, gram: int, piece: int) -> DataFrame:
    """All steps on documents: what is removed, as messages to the buckets in the folder (COPY, CLASS, WINDOW, and a MARK for each bucket)."""
    texts = common.stored(_store_texts(docs, folder), "texts")
    mark = texts.groupBy("bucket").agg(F.lit(MARK).alias("kind"), F.count("*").alias("x"))
    firsts = common.stored(_first_texts(texts, length), "first-texts")
    live = firsts.filter(F.col("kind") == LIVE)
    grams = _repeated(_grams(live, folder, length, gram, piece), RANK)
    later_runs = common.stored(_later(_run_classes(grams.union(live), folder, length, gram, piece), CLASS), "later-runs")
    shared = common.stored(_repeated(_lead_grams(later_runs.union(mark), folder), RANK), "ranks")
    every = None
    for k in range(ROUNDS):
        shared = common.stored(_repeated(_round(shared, folder, k, length, gram), RANK), "ranks")
        every = shared if every is None else every.union(shared)
    later_windows = _later(_window_classes(every, folder, length, gram), WINDOW)
    return firsts.filter(F.col("kind") == COPY).union(later_runs).union(later_windows).union(mark)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, piece: int = PIECE) -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts earlier (smaller doc_id, or same and earlier).

    Result, one row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, spans
    (starts and stops of the removed runs), kept (the remaining bytes, which may cut a character) and text (a
    character cut by a run's edge stays whole). Null and empty texts have no bytes; very long ones are hashed in
    parts. Rows that repeat a doc_id are one place: neither is earlier than the other. A null doc_id comes before all
    others. Other columns are ignored; an empty table gives no rows.
    """
    folder = common.fresh_dir(docs.sparkSession, "texts")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.string()]

    def run(bucket, messages):
        for batch, rows in _cut(folder, bucket, messages, ["doc_id", "text"]):
            out = []
            for text, spans in rows:
                bounds = [0, *(x for span in spans for x in span), len(text)]
                kept = [text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
                digest = hashlib.sha256()
                for part in kept:
                    digest.update(part)
                shown = (b"".join(kept), _whole_characters(text.tobytes(), spans)) if with_text else (None, None)
                out.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), bounds[1:-1], *shown))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds[1:], strict=True))], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary, text string"
    return _each_bucket(_found(docs.select("doc_id", "text"), folder, length, gram, piece), run, schema)


def cut_repeats(docs: DataFrame, changed: str, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """The rows of docs, all columns kept, with the repeats that remove_repeats finds cut out of text; the column `changed` tells which were.

    A character cut by a run's edge stays whole. Rows are told apart by their place in the files, whatever their ids.
    """
    folder = common.fresh_dir(docs.sparkSession, "texts")

    def run(bucket, messages):
        for batch, rows in _cut(folder, bucket, messages, None):
            place = batch.schema.get_field_index("text")
            own = batch.column(place)
            texts = [_whole_characters(text.tobytes(), spans) if spans else own[k] for k, (text, spans) in enumerate(rows)]
            texts = pa.array([t if isinstance(t, str) else t.as_py() for t in texts], own.type)
            yield batch.set_column(place, "text", texts).append_column(changed, pa.array([bool(spans) for _, spans in rows]))

    schema = StructType([*docs.schema.fields, StructField(changed, BooleanType())])
    return _each_bucket(_found(docs, folder, length, gram, piece), run, schema)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 100 bytes in whole documents. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as remove_repeats states."""
    found = remove_repeats(common.table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
