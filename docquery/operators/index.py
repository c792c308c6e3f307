"""A stored inverted index in segments: immutable postings with positions, a table of deleted documents, and merging by size.

A document is live in the newest segment that has it, unless it was deleted later. An update writes one segment with
its documents and one list of their ids, which ends their rows in all older segments; nothing else is written. Statistics
count live documents only. Segments of like size are merged, which drops the rows that no search sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions import analyzer
from docquery.functions.text import simple_tokens
from docquery.operators import scan
from docquery.sources import store
from docquery.sources.store import Conflict, Part, Snapshot

#: Folders that postings are dealt to by a hash of their term; a search for few terms reads few of them.
BUCKETS = 32
#: The folder of the rows that stand for whole documents.
LENGTHS = -1
#: Rows (deleted ids, terms) up to which a table is broadcast (some tens of bytes each).
BROADCAST_ROWS = 200_000
#: Segments of one size class that are merged, and how many times larger the next class is.
MERGED = 4
TIER = 4
#: Tokens or words that are grouped at once (one row's may be more).
SLICE_TOKENS = 1_000_000
#: Terms of packs that a task counts at once.
COUNTED_ROWS = 4_000_000

#: A pack: the blocks of one folder that a task made of a slice, in compressed columns. A block is the postings of one term and
#: field, in order of rows. doc_id is that of the slice's first row.
PACK = "bucket int, doc_id long, pack binary"
#: Stands for a document without an id in a pack.
NO_ID = -(2**63)


def bucket(term: Column | str) -> Column:
    return F.pmod(F.crc32(F.col(term) if isinstance(term, str) else term), F.lit(BUCKETS)).cast("int")


def _folders(terms: pa.Array) -> np.ndarray:
    """bucket() of each term."""
    return np.fromiter((crc32(t.encode()) % BUCKETS for t in terms.to_pylist()), np.int64, len(terms))


def _placed(tokens: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, term and position of every token: tokens are terms in order, or (gap, term) as the analyzer gives them."""
    held = pc.fill_null(tokens.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, first, flat = np.repeat(np.arange(len(held)), held), np.cumsum(held) - held, tokens.flatten()
    if not pa.types.is_struct(flat.type):
        return row, flat, np.arange(len(row)) - first[row]
    gap, term = flat.flatten()
    steps = np.r_[0, np.cumsum(gap.to_numpy(zero_copy_only=False).astype(np.int64))]
    positions = steps[1:] - steps[first[row]] - 1
    known = term.is_valid()
    there = known.to_numpy(zero_copy_only=False)
    return row[there], term.filter(known), positions[there]


def _fewest(values: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in as few bytes as hold them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _written(columns: dict, compression: str | None = None) -> bytes:
    """Columns, of any lengths, as bytes."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()]
    batch, out = pa.RecordBatch.from_arrays(lists, names=[str(c) for c in columns]), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _read(written: bytes | pa.Buffer) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(written).read_next_batch()
    return {name: column[0].values for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _pack(fields: pa.Array, kind: np.ndarray, term: pa.Array, n: np.ndarray, row: np.ndarray, tf: np.ndarray, place: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """Blocks (kind: number of the field, term, n postings), postings (row, tf) and positions in order. rows: doc_id, dl and n_chars of all rows, of which those of the postings are kept."""
    there = np.zeros(len(rows[0]), bool)
    there[row] = True
    doc, dl, chars = (x[there] for x in rows)
    row = (np.cumsum(there) - 1)[row]
    # rows of a block and positions of a posting rise: steps are small
    steps, moves = np.diff(row, prepend=0), np.diff(place, prepend=0)
    firsts, starts = np.cumsum(n) - n, (np.cumsum(tf) - tf)[tf > 0]
    steps[firsts], moves[starts] = row[firsts], place[starts]
    names = np.diff(doc, prepend=0).view(np.uint8).reshape(-1, 8).T.ravel()  # high and low bytes apart
    held = {"field": fields, "kind": _fewest(kind), "term": term, "n": _fewest(n), "row": _fewest(steps), "tf": _fewest(tf), "place": _fewest(moves), "doc": names, "dl": _fewest(dl), "chars": _fewest(chars)}
    return _written(held, "zstd")


class Blocks:
    """A pack's blocks, of which postings are given as columns."""

    def __init__(self, pack: bytes | pa.Buffer):
        held = _read(pack)
        number = lambda name: held[name].to_numpy().astype(np.int64)
        self.fields, self.term = held["field"], held["term"]
        self.kind, self.n, self.tf = number("kind"), number("n"), number("tf")
        self.first = np.cumsum(self.n) - self.n
        self.row = self._risen(number("row"), self.first, self.n)
        self.doc = np.cumsum(np.ascontiguousarray(held["doc"].to_numpy().reshape(8, -1).T).view(np.int64).ravel())
        self.dl, self.chars = (held[c].to_numpy().astype(np.int32) for c in ("dl", "chars"))
        self._moves = held["place"]

    @staticmethod
    def _risen(steps: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        total = np.cumsum(steps)
        return total - np.repeat(total[first] - steps[first], n)

    def rows(self, chosen: np.ndarray | None = None, places: bool = True) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Postings of the chosen blocks, or of all: the block of each, and their columns."""
        chosen = np.arange(len(self.n)) if chosen is None else chosen
        n = self.n[chosen]
        block = np.repeat(chosen, n)
        at = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n) + self.first[block]
        row, tf = self.row[at], self.tf[at]
        doc = self.doc[row]
        out = {"doc_id": pa.array(doc, mask=doc == NO_ID), "field": self.fields.take(pa.array(self.kind[block])), "term": self.term.take(pa.array(block)), "tf": pa.array(tf)}
        if places:
            moves, held = self._moves.to_numpy().astype(np.int64), self.tf > 0
            begins = np.cumsum(self.tf) - self.tf
            place = self._risen(moves, begins[held], self.tf[held]) if len(moves) else moves
            ends = np.r_[0, np.cumsum(tf)]
            of = np.repeat(begins[at] - ends[:-1], tf) + np.arange(ends[-1])
            out["positions"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[of].astype(np.int32)))
        return block, out | {"dl": pa.array(self.dl[row]), "n_chars": pa.array(self.chars[row])}


def _packs(rows: tuple[np.ndarray, np.ndarray, np.ndarray], kind: np.ndarray, fields: pa.Array, row: np.ndarray, code: np.ndarray, terms: pa.Array, place: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    """Tokens (row, code of the term, position) in order of their rows (doc_id, dl, n_chars; kind: number of the field) as packs, and one pack without terms for the rows that stand for documents (whole)."""
    wide, deep = max(1, len(terms)), max(1, len(fields))
    # by folder, field and term, and in the order of rows: a block's postings lie together, and each posting's positions stay in order
    key = (_folders(terms)[code] * deep + kind[row]) * wide + code
    order = np.argsort(key, kind="stable")
    key, at, place = key[order], row[order], place[order]
    new = np.diff(key, prepend=-1) != 0
    block, posting = np.flatnonzero(new), np.flatnonzero(new | (np.diff(at, prepend=-1) != 0))
    first, tf = np.searchsorted(posting, block), np.diff(np.r_[posting, len(key)])
    folder, of = key[block] // (deep * wide), key[block] // wide % deep
    named, n, at = terms.take(pa.array(key[block] % wide)), np.diff(np.r_[first, len(posting)]), at[posting]
    cuts = np.r_[np.flatnonzero(np.diff(folder, prepend=-1) != 0), len(block)]
    places, first = np.r_[posting, len(key)], np.r_[first, len(posting)]
    packs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = first[a], first[b]
        packs.append((folder[a], _pack(fields, of[a:b], named.slice(a, b - a), n[a:b], at[low:high], tf[low:high], place[places[low] : places[high]], rows)))
    if len(whole):
        whole = whole[np.argsort(kind[whole], kind="stable")]
        held = np.bincount(kind[whole], minlength=deep)
        there = np.flatnonzero(held)
        packs.append((LENGTHS, _pack(fields, there, pa.nulls(len(there), pa.string()), held[there], whole, np.zeros(len(whole), np.int64), np.zeros(0, np.int64), rows)))
    doc = pa.array([None if not len(rows[0]) or rows[0][0] == NO_ID else int(rows[0][0])] * len(packs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([f for f, _ in packs], pa.int32()), doc, pa.array([x for _, x in packs], pa.binary())], names=["bucket", "doc_id", "pack"])


def _ids(doc: pa.Array) -> np.ndarray:
    return pc.fill_null(doc, NO_ID).to_numpy()


def _grouped(doc: pa.Array, chars: pa.Array, kind: np.ndarray, fields: pa.Array, row: np.ndarray, code: np.ndarray, terms: pa.Array, positions: np.ndarray) -> pa.RecordBatch:
    return _packs((_ids(doc), np.bincount(row, minlength=len(doc)), chars.to_numpy()), kind, fields, row, code, terms.cast(pa.string()), positions, np.arange(len(doc)))


def _slices(batches: Iterator[pa.RecordBatch], split: Callable[[pa.Array], pa.ListArray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, n_chars, field, tokens or, to be split, a text) with about SLICE_TOKENS tokens together: batches are put together or parted."""
    parts: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if split is not None:
            batch = pa.RecordBatch.from_arrays([*batch.columns[:3], split(batch.column(3))], names=["doc_id", "n_chars", "field", "tokens"])
        held = np.cumsum(pc.fill_null(batch.column(3).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = held[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(held, before + SLICE_TOKENS - n, "right"))), batch.num_rows)
            parts.append(batch.slice(start, stop - start))
            n += held[stop - 1] - before
            start = stop
            if n >= SLICE_TOKENS or start < batch.num_rows:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, n = [], 0
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, n_chars, field, tokens): blocks of postings by term, and blocks without a term for the rows themselves."""
    for part in _slices(batches):
        doc, chars, field, tokens = part.columns
        row, terms, positions = _placed(tokens)
        coded, kinds = terms.dictionary_encode(), field.dictionary_encode()
        code, kind = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (coded, kinds))
        yield _grouped(doc, chars, kind, kinds.dictionary, row, code, coded.dictionary, positions)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, n_chars, field, text): slices with their words by number, those of analyzer.plain first, and each of the others once."""
    for part in _slices(batches, pc.ascii_split_whitespace):
        doc, chars, field, words = part.columns
        held = pc.fill_null(words.value_lengths(), 0)
        coded, kinds = words.flatten().dictionary_encode(), field.dictionary_encode()
        plain = analyzer.plain(coded.dictionary)
        order = np.argsort(~plain, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order))
        ordered, n = coded.dictionary.take(pa.array(order)), int(plain.sum())
        columns = [doc, chars, kinds.indices, kinds.dictionary, held, pa.array(number[coded.indices.to_numpy()]), ordered.slice(0, n)]
        others = pa.ListArray.from_arrays(pa.array([0, len(plain) - n], pa.int32()), ordered.slice(n))
        yield pa.RecordBatch.from_arrays([pa.array([_written(dict(enumerate(columns)))], pa.binary()), others], names=["rest", "others"])


def _entries_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_entries of slices whose words are numbered, with the (gap, term) of each of the others."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc, chars, kinds, fields, held, words, plain = _read(batch.column("rest")[i].as_buffer()).values()
            others = batch.column("others")[i].values
            sizes, gaps, terms = (pa.concat_arrays(x) for x in zip(analyzer.plain_tokens(plain), (pc.fill_null(others.value_lengths(), 0), *others.flatten().flatten()), strict=True))
            coded = terms.dictionary_encode()
            code, gap = pc.fill_null(coded.indices, -1).to_numpy(), gaps.to_numpy().astype(np.int64)
            size = sizes.to_numpy().astype(np.int64)
            held, words = held.to_numpy().astype(np.int64), words.to_numpy()
            each = size[words]
            first = np.r_[0, np.cumsum(each)]
            token = np.arange(first[-1]) + np.repeat((np.cumsum(size) - size)[words] - first[:-1], each)
            of = np.repeat(np.arange(len(held)), held)
            row, steps = np.repeat(of, each), np.r_[0, np.cumsum(gap[token])]
            begins = first[np.cumsum(held) - held]  # each row's first token
            positions = steps[1:] - steps[begins[row]] - 1
            code = code[token].astype(np.int64)
            there = code >= 0
            yield _grouped(doc, chars, kinds.to_numpy().astype(np.int64), fields, row[there], code[there], coded.dictionary, positions[there])


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of postings (doc_id, n_chars, field, positions, dl, term), and of rows that stand for documents, which have no term."""
    for part in _slices(batches):
        doc, chars, field, positions, dl, term = part.columns
        fields, terms = field.dictionary_encode(), term.dictionary_encode()
        kind, code = fields.indices.to_numpy().astype(np.int64), pc.fill_null(terms.indices, -1).to_numpy().astype(np.int64)
        doc, dl, chars = _ids(doc), dl.to_numpy(), chars.to_numpy()
        # a document that comes twice has its postings twice, which are of different rows
        order = np.lexsort((code, chars, dl, kind, doc))
        same = lambda *keys: np.any([np.diff(k[order], prepend=k[order][:1] - 1) != 0 for k in keys], axis=0)
        at = np.arange(len(order))
        time = np.empty(len(order), np.int64)
        time[order] = at - np.maximum.accumulate(np.where(same(doc, kind, dl, chars, code), at, 0))
        order = np.lexsort((time, chars, dl, kind, doc))
        new = same(doc, kind, dl, chars, time)
        row, here = np.empty(len(order), np.int64), order[new]
        row[order] = np.cumsum(new) - 1
        posting = np.repeat(np.arange(len(row)), positions.value_lengths().to_numpy())
        place, by = positions.flatten().to_numpy(), np.argsort(row[posting], kind="stable")
        posting = posting[by]
        yield _packs((doc[here], dl[here], chars[here]), kind[here], fields.dictionary, row[posting], code[posting], terms.dictionary, place[by].astype(np.int64), np.sort(row[code < 0]))


def opened(packs: DataFrame, wanted: DataFrame | None = None, places: bool = True) -> DataFrame:
    """The postings of packs as rows, with the packs' other columns; positions only if places are asked for.

    wanted names terms (term), or terms of fields (field, term, id): blocks of others are left closed, and postings have the id.
    """
    others = [c for c in packs.columns if c not in ("doc_id", "pack")]
    marked = wanted is not None and "id" in wanted.columns
    names = ["field", "term", "id"] if marked else ["term"]
    paths = None if wanted is None else scan.stored(wanted.select(*names)).inputFiles()
    types = {f.name: f.dataType.simpleString() for f in packs.schema.fields}
    kept = {"doc_id": "long", "field": "string", "term": "string", "tf": "long", **({"positions": "array<int>"} if places else {}), "dl": "int", "n_chars": "int", **({"id": "long"} if marked else {})}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if paths is None else scan.read(paths, names)
        by_field = {}
        if marked:
            of, named, ids = (known.column(c).combine_chunks() for c in names)
            by_field = {f.as_py(): (named.filter(here), ids.filter(here).to_numpy()) for f in of.unique() for here in [pc.equal(of, f)]}
        for batch in batches:
            for i in range(batch.num_rows):
                held = Blocks(batch.column("pack")[i].as_buffer())
                chosen, ids = None, np.zeros(len(held.n), np.int64)
                if marked:
                    met = np.zeros(len(held.n), bool)
                    for k, f in enumerate(held.fields.to_pylist()):
                        if f in by_field:
                            at = np.flatnonzero(held.kind == k)
                            found = pc.fill_null(pc.index_in(held.term.take(pa.array(at)), value_set=by_field[f][0]), -1).to_numpy()
                            at, found = at[found >= 0], found[found >= 0]
                            met[at], ids[at] = True, by_field[f][1][found]
                    chosen = np.flatnonzero(met)
                elif known is not None:
                    chosen = np.flatnonzero(pc.is_in(held.term, value_set=known.column("term").combine_chunks()).to_numpy(zero_copy_only=False))
                if chosen is not None and not len(chosen):
                    continue
                block, columns = held.rows(chosen, places)
                if marked:
                    columns["id"] = pa.array(ids[block])
                columns |= {c: pa.repeat(batch.column(c)[i], len(block)) for c in others}
                yield pa.RecordBatch.from_pydict(columns)

    return packs.mapInArrow(search, ", ".join(f"{c} {t}" for c, t in (kept | {c: types[c] for c in others}).items()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """field, term and df of a task's packs."""
    counts: list[pa.Table] = []
    rows = 0

    def summed() -> pa.Table:
        out = pa.concat_tables(counts).group_by(["field", "term"]).aggregate([("df", "sum")])
        return out.select(["field", "term", "df_sum"]).rename_columns(["field", "term", "df"])

    for batch in batches:
        for pack in batch.column("pack"):
            held = Blocks(pack.as_buffer())
            counts.append(pa.table({"field": held.fields.take(pa.array(held.kind)), "term": held.term, "df": held.n}))
            rows += len(held.n)
            if rows > COUNTED_ROWS:
                yield from summed().to_batches()
                counts, rows = [], 0
    if counts:
        yield from summed().to_batches()


def blocks(rows: DataFrame, fields: dict[str, Column] | None = None, analyzed: bool = False) -> DataFrame:
    """Packs of postings of an index over rows (doc_id, text, ...), texts being tokenized once.

    fields names the token arrays that are indexed (simple tokens of text if none are given): terms in order or, for all
    fields alike, the (gap, term) of the analyzer, of which several may stand at one position. A posting is a term of a field of a
    document: tf, positions (from 0), dl (tokens of the field) and n_chars (of the text). A row without a term, in the
    folder LENGTHS, stands for each document and field. Null token arrays are empty.

    If analyzed, fields names texts, of which the analyzer's tokens are indexed: those of a word are found once in a slice.
    """
    fields = {"text": simple_tokens("text")} if fields is None else fields
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens.alias("tokens")) for f, tokens in fields.items()])
    tokens = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.inline(each))
    if analyzed:
        words = tokens.mapInArrow(_worded, "rest binary, others array<string>")
        return words.withColumn("others", F.transform("others", lambda w: analyzer.lattice(w))).mapInArrow(_entries_of_words, PACK)
    return tokens.mapInArrow(_entries, PACK)


def build(rows: DataFrame, fields: dict[str, Column] | None = None) -> DataFrame:
    """The postings of blocks(), one in a row."""
    return opened(blocks(rows, fields))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _put_entries(spark: SparkSession, root: str, entries: DataFrame) -> list[Part]:
    # the hash of a term deals the packs, so that those of one term lie in one folder, which is some files
    dealt = entries.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8))).sortWithinPartitions("bucket", "doc_id")
    (part,) = store.put(spark, root, {"segment": dealt}, {"segment": ["bucket"]})
    df = store.written(spark, part).filter(F.col("bucket") != LENGTHS).select("pack").mapInArrow(_counted, "field string, term string, df long").groupBy("field", "term").agg(F.sum("df").alias("df"))
    (terms,) = store.put(spark, root, {"df": df})
    rows = opened(store.written(spark, part).filter(F.col("bucket") == LENGTHS), places=False).select("doc_id").distinct().count()
    return [replace(part, facts={"rows": rows}), replace(terms, facts={"segment": part.path})]


def _put_ids(spark: SparkSession, root: str, ids: DataFrame) -> Part:
    (part,) = store.put(spark, root, {"gone": ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()})
    return replace(part, facts={"rows": store.written(spark, part).count()})


def _with_stats(spark: SparkSession, root: str, parts: list[Part], now: Snapshot) -> list[Part]:
    """The parts with a part `stats` that states, for each field, how many live documents they have and of how many tokens.

    Only rows that stand for documents are read, and none but those of new segments where no document ends.
    """
    parts = [p for p in parts if p.name != "stats"]
    view = Index(spark, root, Snapshot(now.generation + 1, tuple(replace(p, seq=now.generation + 1) if p.seq is None else p for p in parts)), stats=False)
    rows = view.lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()  # a row for each field
    return [*parts, Part("stats", "", "", None, {r.field: [r.n, r.total] for r in rows})]


def write(spark: SparkSession, root: str, documents: DataFrame, fields: dict[str, Column] | None = None, analyzed: bool = False) -> int:
    """Write an index of the documents and publish it as the root's next generation, in place of all segments."""
    parts = _put_entries(spark, root, blocks(documents, fields, analyzed))
    kept = lambda now: [p for p in now.parts if p.name not in ("segment", "df", "gone", "stats")]
    return store.publish(spark, root, lambda now: _with_stats(spark, root, [*kept(now), *parts], now))


def update_parts(spark: SparkSession, root: str, documents: DataFrame | None, ended: DataFrame | None, fields: dict[str, Column] | None = None) -> list[Part]:
    """Written but unpublished: a segment of the documents, and the ids of theirs and of those that end."""
    ids = [d.select(F.col("doc_id").cast("long").alias("doc_id")) for d in (documents, ended) if d is not None]
    entries = [] if documents is None else _put_entries(spark, root, blocks(documents, fields))
    return [*entries, _put_ids(spark, root, reduce(DataFrame.unionByName, ids))]


def with_parts(spark: SparkSession, root: str, now: Snapshot, parts: list[Part]) -> list[Part]:
    """The snapshot's parts with these and the statistics of what is live then; for a change that store.publish makes."""
    return _with_stats(spark, root, [*now.parts, *parts], now)


def upsert(spark: SparkSession, root: str, documents: DataFrame, fields: dict[str, Column] | None = None) -> int:
    """Put the documents in place of those with the same doc_id: one segment and one list of ids are written.

    Of two writers that bring the same document, the one that is published later wins.
    """
    parts = [*_put_entries(spark, root, blocks(documents, fields)), _put_ids(spark, root, documents)]
    return store.publish(spark, root, lambda now: _with_stats(spark, root, [*now.parts, *parts], now))


def delete(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """End the documents with these ids (doc_id): one list of ids is written. Unknown ids change nothing that a search sees."""
    part = _put_ids(spark, root, ids)
    return store.publish(spark, root, lambda now: _with_stats(spark, root, [*now.parts, part], now) if now.of("segment") else now.parts)


def due(segments: list[Part]) -> list[Part]:
    """The segments of the smallest size class that has MERGED of them, or none. A class holds up to TIER times the documents of the one below."""
    classes: dict[int, list[Part]] = {}
    for p in segments:
        size, tier = max(1, p.facts["rows"]), 0
        while size >= TIER:
            size, tier = size // TIER, tier + 1
        classes.setdefault(tier, []).append(p)
    return next((classes[t] for t in sorted(classes) if len(classes[t]) >= MERGED), [])


def merge(spark: SparkSession, root: str, everything: bool = False) -> int:
    """Merge the segments that are due (or all) into one that has their live rows, and drop the lists of ids that end no row any more.

    A merge that another writer has overtaken by merging the same segments starts anew.
    """
    while True:
        now = store.snapshot(spark, root)
        old = now.of("segment") if everything else due(now.of("segment"))
        if len(old) < 2 and not (everything and now.of("gone")):
            return now.generation
        seq = max(p.seq for p in old)
        live = Index(spark, root, now).entries(old).select("doc_id", "n_chars", "field", "positions", "dl", "term")
        merged = _put_entries(spark, root, live.mapInArrow(_repacked, PACK))
        merged = [replace(p, seq=seq) for p in merged]
        paths = {p.path for p in old}

        def change(newest: Snapshot, paths=paths, merged=merged) -> list[Part]:
            if not paths <= {p.path for p in newest.parts}:
                raise Conflict
            parts = [p for p in newest.parts if p.path not in paths and p.facts.get("segment") not in paths] + merged
            oldest = min(p.seq for p in parts if p.name == "segment")
            return _with_stats(spark, root, [p for p in parts if p.name != "gone" or p.seq > oldest], newest)

        try:
            return store.publish(spark, root, change)
        except Conflict:
            continue


class Index:
    """One generation of a stored index: searches see its segments and deletions, whatever is published meanwhile."""

    def __init__(self, spark: SparkSession, root: str, at: int | Snapshot | None = None, stats: bool = True):
        self.spark, self.root = spark, root
        self.snapshot = at if isinstance(at, Snapshot) else store.snapshot(spark, root, at)
        self.generation = self.snapshot.generation
        self.segments, self.gone = self.snapshot.of("segment"), self.snapshot.of("gone")
        if not self.segments:
            raise KeyError("segment")
        if stats:
            (facts,) = [p.facts for p in self.snapshot.of("stats")]
            self.stats = spark.createDataFrame([(f, n, total) for f, (n, total) in sorted(facts.items())], "field string, n long, total long")
            self._fields = sorted(facts)
            # documents are dealt to so many parts, each of which a task holds
            self.parts = max(64, sum(total or 0 for _, total in facts.values()) // scan.PART_TOKENS)

    def fields(self) -> list[str]:
        return self._fields

    def _ended(self) -> tuple[DataFrame, int]:
        """doc_id and ended: rows of older segments than that are dead; and how many ids there are at most."""
        lists = [store.written(self.spark, p).withColumn("ended", F.lit(p.seq).cast("long")) for p in self.gone]
        return reduce(DataFrame.unionByName, lists).groupBy(F.col("doc_id").alias("__doc")).agg(F.max("ended").alias("ended")), sum(p.facts["rows"] for p in self.gone)

    def _split(self, rows: DataFrame, live: bool) -> DataFrame:
        ended, n = self._ended()
        return rows.join(_small(ended, n), (F.col("doc_id") == F.col("__doc")) & (F.col("seq") < F.col("ended")), "left_anti" if live else "left_semi")

    def _all(self, segments: list[Part]) -> DataFrame:
        return reduce(DataFrame.unionByName, (store.written(self.spark, p).withColumn("seq", F.lit(p.seq).cast("long")) for p in segments))

    def entries(self, segments: list[Part] | None = None) -> DataFrame:
        """Live rows of the segments with their seq."""
        return self._live(opened(self._all(self.segments if segments is None else segments)))

    def _live(self, rows: DataFrame) -> DataFrame:
        return self._split(rows, True) if self.gone else rows

    @property
    def postings(self) -> DataFrame:
        return self._live(opened(self._all(self.segments).filter(F.col("bucket") != LENGTHS)))

    @property
    def lengths(self) -> DataFrame:
        return self._live(opened(self._all(self.segments).filter(F.col("bucket") == LENGTHS), places=False)).select("doc_id", "field", "dl", "n_chars")

    def _of_terms(self, terms: DataFrame, places: bool) -> DataFrame:
        """Postings of the terms alone, dead ones too: only the folders that they are dealt to are read."""
        wanted = scan.stored(terms.select("term").distinct())
        buckets = [r.b for r in wanted.select(bucket("term").alias("b")).distinct().filter("b IS NOT NULL").collect()]  # BUCKETS rows at most
        packs = self._all(self.segments).filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        if wanted.count() > BROADCAST_ROWS:
            return opened(packs, places=places).join(wanted, "term", "left_semi")
        return opened(packs, wanted, places)

    def within(self, terms: DataFrame, places: bool = True) -> DataFrame:
        """Postings of the terms (a table with a column term) alone; positions only if places are asked for."""
        return self._live(self._of_terms(terms, places))

    def marked(self, marks: DataFrame, places: bool = True) -> DataFrame:
        """Postings of the fields and terms of a table (field, term, id: one row of each), with its id; positions only if places are asked for."""
        packs = self._all(self.segments).filter(F.col("bucket") != LENGTHS)
        rows = opened(packs, places=places).join(marks, ["field", "term"]) if marks.count() > BROADCAST_ROWS else opened(packs, marks, places)
        return self._live(rows)

    def of(self, terms: list[str] | None) -> DataFrame:
        """Postings of the named terms, or of all."""
        return self.postings if terms is None else self.within(self.spark.createDataFrame([(t,) for t in terms], "term string"))

    @property
    def df(self) -> DataFrame:
        return self.df_of()

    def df_of(self, terms: DataFrame | None = None) -> DataFrame:
        """field, term and df (live documents) of the terms, or of all: what the segments counted less what has ended."""
        parts = [store.written(self.spark, p) for p in self.snapshot.of("df")]
        counted = reduce(DataFrame.unionByName, parts)
        if terms is not None:
            wanted = terms.select("term").distinct()
            counted = counted.join(_small(wanted, wanted.count()), "term", "left_semi").select("field", "term", "df")
        if len(parts) == 1 and not self.gone:
            return counted
        if self.gone:
            rows = self._of_terms(terms, False) if terms is not None else opened(self._all(self.segments).filter(F.col("bucket") != LENGTHS), places=False)
            dead = self._split(rows, False).groupBy("field", "term").agg((-F.count("*")).alias("df"))
            counted = counted.unionByName(dead)
        return counted.groupBy("field", "term").agg(F.sum("df").alias("df")).filter("df > 0")
