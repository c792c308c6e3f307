"""Scores and phrases of a document in the task that has its postings, for whole batches of queries.

Postings of the queries' terms are dealt by document, once, and not multiplied by the queries before they move: tasks
read the queries' clauses from the shared folder and return what is asked for, a few rows of each query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.session import shared_root

#: Cells (documents by queries) that are scored at once.
CELLS = 2_000_000
#: Rows that a task deals to parts at once, and tokens of an index for which there is one part (some tens of bytes each at most).
DEALT_ROWS, PART_TOKENS = 1_000_000, 4_000_000


def stored(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder."""
    path = f"{shared_root(rows.sparkSession)}/docquery-queries/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read(paths: list[str], names: list[str]) -> pa.Table:
    """Columns of a stored table, in a task."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    tables = []
    for uri in paths:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            tables.append(pq.ParquetFile(source).read(columns=names).select(names))
    return pa.concat_tables(tables) if tables else pa.table({n: pa.array([], pa.string() if n in ("field", "term") else pa.int64()) for n in names})


def _columns(paths: list[str], names: list[str]) -> list[np.ndarray]:
    return [c.to_numpy() for c in read(paths, names).columns]


def _packed(rows: pa.Table) -> bytes:
    """Rows (doc_id first) in compressed columns; ids as steps, whose halves are small."""
    steps = np.diff(rows.column(0).to_numpy(), prepend=0)
    halves = [pa.array((steps >> 32).astype(np.int32)), pa.array((steps & 0xFFFFFFFF).astype(np.uint32))]
    batch = pa.Table.from_arrays([*halves, *rows.columns[1:]], names=["high", "low", *rows.column_names[1:]]).combine_chunks().to_batches()[0]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(pack: pa.Scalar) -> pa.Table:
    rows = pa.ipc.open_stream(pack.as_buffer()).read_all()
    high, low = (rows.column(c).to_numpy().astype(np.int64) for c in ("high", "low"))
    return pa.table({"doc_id": np.cumsum((high << 32) + low)} | {c: rows.column(c) for c in rows.column_names[2:]})


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """rows with a doc_id (first) as packs (part, rows), all of a document in one part and all of a part in one task, in order."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packs() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).filter(pc.field("doc_id").is_valid())
            doc = table.column(0).to_numpy()
            part = ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
            table, part = table.take(pa.array(order)), part[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(part, prepend=-1) != 0)
            ends = np.r_[cuts[1:], len(part)]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array([_packed(table.slice(a, b - a)) for a, b in zip(cuts, ends, strict=True)] if len(part) else [], pa.binary())], names=["part", "rows"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= DEALT_ROWS:
                yield packs()
                held, n = [], 0
        if n:
            yield packs()

    # by a hash of its own: an exchange that a join below made in its place might be split or read in another order at run time
    return rows.mapInArrow(deal, "part int, rows binary").repartition(F.xxhash64("part")).sortWithinPartitions("part")


def _whole(batches: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[pa.Table]:
    """Tables of about so many rows that part no document (the first column), in order of documents within each part."""

    def cut(packs: list[pa.Scalar]) -> Iterator[pa.Table]:
        table = pa.concat_tables([_unpacked(p) for p in packs])
        doc = table.column(0).to_numpy()
        order = np.argsort(doc, kind="stable")
        table, doc = table.take(pa.array(order)), doc[order]
        start = 0
        while start < len(doc):
            stop = int(np.searchsorted(doc, doc[min(start + rows, len(doc)) - 1], "right"))
            yield table.slice(start, stop - start)
            start = stop

    part, held = None, []
    for batch in batches:
        for number, pack in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and number != part:
                yield from cut(held)
                held = []
            part = number
            held.append(pack)
    if held:
        yield from cut(held)


def _pairs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For spans (first, count): the span of each member, and the member."""
    span = np.repeat(np.arange(len(count)), count)
    return span, np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count) + first[span]


def _first(keys: list[np.ndarray], n: int) -> np.ndarray:
    """Of rows in order, which are among the first n of those that share the keys."""
    new = np.any([np.r_[True, k[1:] != k[:-1]] for k in keys], axis=0) if len(keys[0]) else np.zeros(0, bool)
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) < n


def best(hits: DataFrame, clauses: DataFrame, limit: int, gain: Callable, factor: Callable, owner: Callable | None = None, per_owner: int | None = None, digits: int = 6, parts: int = 64) -> DataFrame:
    """query_id, doc_id and score of each query's candidates for its `limit` best documents: of every task its own.

    hits: doc_id, id, tf, dl, n_chars. clauses: query_id, id, weight, average. A hit adds weight times gain(tf, dl, average) to
    the queries of its id, and factor(n_chars) multiplies the sum. Ties go to the smaller doc_id. Of one owner(doc_id)
    at most per_owner are kept: what a task leaves out, by cap or limit, has enough that is better in that task alone.
    """
    clauses = stored(clauses.select(F.col("query_id").cast("long").alias("query_id"), "id", "weight", "average"))
    paths = clauses.inputFiles()

    def search(batches):
        query, of, weight, average = _columns(paths, ["query_id", "id", "weight", "average"])
        order = np.argsort(of, kind="stable")
        of, weight, average = of[order], weight[order], average[order]
        names, query = np.unique(query[order], return_inverse=True)
        wide = max(1, len(names))
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, owner, document, score
        least = np.full(wide, -np.inf)
        for table in _whole(batches):
            doc, id_, tf, dl, chars = (c.to_numpy() for c in table.columns)
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            first = np.searchsorted(of, id_, "left")
            count = np.searchsorted(of, id_, "right") - first
            ends, pairs = np.r_[at[1:], len(doc)], np.cumsum(count)
            done = 0
            while done < len(at):
                most = (pairs[at[done] - 1] if at[done] else 0) + CELLS
                stop = min(max(done + 1, int(np.searchsorted(pairs[ends - 1], most, "right"))), done + max(1, CELLS // wide))
                low, high = at[done], ends[stop - 1]
                hit, clause = _pairs(first[low:high], count[low:high])
                hit += low
                cell = (np.searchsorted(at, hit, "right") - 1 - done) * wide + query[clause]
                size = (stop - done) * wide
                score = np.bincount(cell, weight[clause] * gain(tf[hit], dl[hit], average[clause]), size).reshape(-1, wide)
                seen = np.zeros(size, bool)
                seen[cell] = True
                here = at[done:stop]
                score = np.round(score * factor(chars[here])[:, None], digits)
                d, q = np.nonzero(seen.reshape(-1, wide) & (score >= least))
                done = stop
                if not len(d):
                    continue
                found = doc[here[d]]
                new = [q, found if owner is None else owner(found), found, score[d, q]]
                kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
                if per_owner:
                    kept = [x[np.lexsort((kept[2], -kept[3], kept[1], kept[0]))] for x in kept]
                    kept = [x[_first(kept[:2], per_owner)] for x in kept]
                kept = [x[np.lexsort((kept[2], -kept[3], kept[0]))] for x in kept]
                kept = [x[_first(kept[:1], limit)] for x in kept]
                held = np.bincount(kept[0], minlength=wide)
                full = np.flatnonzero(held >= limit)
                least[full] = kept[3][np.cumsum(held)[full] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), pa.array(kept[2]), pa.array(kept[3])], names=["query_id", "doc_id", "score"])

    rows = _dealt(hits.select("doc_id", "id", F.col("tf").cast("int").alias("tf"), "dl", "n_chars"), parts)
    return rows.mapInArrow(search, "query_id long, doc_id long, score double")


def places(postings: DataFrame, entries: DataFrame, parts: int = 64) -> DataFrame:
    """pid, doc_id, field, tf, dl and n_chars: how often each phrase's terms stand at their places in a field of a document.

    postings: doc_id, field, id (of the term), positions, dl, n_chars. entries: pid, nth, id, offset and lead, which marks
    the one term of each phrase whose positions are looked at first; those that stay are sought in the next term's.
    """
    entries = stored(entries.select("pid", "nth", "id", F.col("offset").cast("long").alias("offset"), "lead"))
    paths = entries.inputFiles()

    def search(batches):
        pid, nth, of, offset, lead = _columns(paths, ["pid", "nth", "id", "offset", "lead"])
        order = np.lexsort((nth, ~lead.astype(bool), pid))
        pid, of, offset = pid[order], of[order], offset[order]
        terms, of = np.unique(of, return_inverse=True)
        first = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]]) if len(pid) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(pid)])
        by = np.argsort(of[first], kind="stable")  # phrases by their leading term
        led = of[first][by]
        for table in _whole(batches):
            table = table.combine_chunks()
            doc, id_, dl, chars = (table.column(c).to_numpy() for c in ("doc_id", "id", "dl", "n_chars"))
            field = table.column("field").combine_chunks().dictionary_encode()
            kind = field.indices.to_numpy().astype(np.int64)
            here = np.searchsorted(doc, doc, "left").astype(np.int64) * (1 + kind.max()) + kind  # the document's field
            lists = table.column("positions").combine_chunks()
            held = lists.value_lengths().to_numpy()
            position = lists.flatten().to_numpy().astype(np.int64)
            term = np.searchsorted(terms, id_)
            span = int(position.max() + offset.max() + 2) if len(position) and len(offset) else 1
            base = here * len(terms) + term
            keys = np.sort(np.repeat(base, held) * span + position)
            # starts of every phrase that a row's term leads, some rows at a time
            low = np.searchsorted(led, term, "left")
            count = (np.searchsorted(led, term, "right") - low) * held
            total, ends = np.cumsum(count), np.cumsum(held)
            done = 0
            while done < len(term):
                stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CELLS, "right")))
                rows = np.arange(done, stop)
                done = stop
                row, nth_start = _pairs(np.zeros(len(rows), np.int64), count[rows])
                row = rows[row]
                which = by[low[row] + nth_start // np.maximum(held[row], 1)]
                start = position[ends[row] - held[row] + nth_start % np.maximum(held[row], 1)] - offset[first[which]]
                alive = start >= 0
                for k in range(1, int(size.max()) if len(size) else 1):
                    row, which, start = row[alive], which[alive], start[alive]
                    entry = np.minimum(first[which] + k, len(of) - 1)
                    want = (here[row] * len(terms) + of[entry]) * span + start + offset[entry]
                    found = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want if len(keys) else np.zeros(len(want), bool)
                    alive = (size[which] <= k) | found
                row, which, start = row[alive], which[alive], start[alive]
                if not len(row):
                    continue
                order = np.lexsort((start, which, row))
                row, which = row[order], which[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (which[1:] != which[:-1])])
                n, row, which = np.diff(np.r_[new, len(row)]), row[new], which[new]
                yield pa.RecordBatch.from_arrays([pa.array(pid[first[which]]), pa.array(doc[row]), field.dictionary.take(pa.array(kind[row])), pa.array(n), pa.array(dl[row]), pa.array(chars[row])], names=["pid", "doc_id", "field", "tf", "dl", "n_chars"])

    rows = _dealt(postings.select("doc_id", "id", "field", "positions", "dl", "n_chars"), parts)
    return rows.mapInArrow(search, "pid long, doc_id long, field string, tf long, dl int, n_chars int")
