"""Prefix trie of conversations, with a count-min sketch that keeps unshared prefixes out of the exact grouping.

A prefix is named by its number of turns and two 64-bit sums over hashes of its turns. The sketch counts all prefixes of
all conversations; an estimate of one proves that no other conversation has the prefix, so the rest of the conversation
is emitted where it is. Only prefixes that may be shared are shuffled, grouped exactly and linked to their parents.

A node belongs to the smallest conversation through it, so each conversation owns one chain of nodes, which hangs on a
chain of a smaller conversation. Sums over subtrees are sums along a chain and of the chains below, whose totals are found by
doubling pointers from chain to chain. Nothing here gathers a conversation, a node's members or its children in one place.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import common, ranks
from docquery.llm.merkle import CRC32

#: Cells of each of the sketch's rows: about four for each prefix, up to this many (a byte each). Beyond, fewer prefixes are proven unshared.
MOST_CELLS = 1 << 25
CELL_BLOCK = 1 << 14
SKETCH_ROWS = 2
#: Turns that a conversation may take from another's beginning.
HEAD = 8
#: Depths that one task sums at once along a chain.
CHAIN_BLOCK = 1024
#: Ids that are joined to one row before a node's members are hashed.
ENDS = 512
NOBODY = hashlib.sha256(b"").hexdigest()

SUMS = ["o1", "o2", "p1", "p2"]
SCANNED = "task int, conv_id long, at long, o1 long, o2 long, p1 long, p2 long, size long, last boolean"
PLACED = "conv_id long, at long, o1 long, o2 long, p1 long, p2 long, size long"
PREFIXES = "conv_id long, depth long, o1 long, o2 long, p1 long, p2 long, size long, n long"
SCREENED = PREFIXES + ", alone boolean, tail boolean"
KEY = ["depth", "p1", "p2"]


def turn_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of role and text, and the text's bytes; null roles and texts are empty, turns without conv_id are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("size")
    )


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _wide(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _ints(batch, name).view(np.uint64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted turns: the place in the part of the conversation that this task has, and the sums before and after the turn; last: the task's last row."""
    task = TaskContext.get().partitionId()
    conv, at, sums, waiting = None, 0, [0, 0], None

    def out(cols: list, last: bool) -> pa.RecordBatch:
        flags = np.zeros(len(cols[0]), bool)
        flags[-1] = last
        return pa.RecordBatch.from_arrays([pa.array(c) for c in [np.full(len(flags), task, np.int32), *cols, flags]], names=["task", "conv_id", "at", *SUMS, "size", "last"])

    for batch in common.slices(batches, 1 << 15):
        convs = _ints(batch, "conv_id")
        new = np.r_[conv is None or convs[0] != conv, convs[1:] != convs[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(convs)), -1))
        places = np.arange(len(convs)) - begin + np.where(begin < 0, at - 1, 0)
        done = []
        for family, name in enumerate("ab"):
            terms = _wide(batch, name) * common.powers(family, int(places.max()) + 1)[places]
            total = np.cumsum(terms, dtype=np.uint64)
            before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], np.uint64(0)) - np.where(begin < 0, np.uint64(sums[family]), np.uint64(0))
            done.append((total - before - terms, total - before))
        if waiting:
            yield out(waiting, False)
        waiting = [convs, places, *[common.signed(x) for x in (done[0][0], done[1][0], done[0][1], done[1][1])], _ints(batch, "size")]
        conv, at, sums = convs[-1], int(places[-1]) + 1, [int(done[0][1][-1]), int(done[1][1][-1])]
    if waiting:
        yield out(waiting, True)


def _carries(edges: list) -> dict[int, tuple[int, int, int, int]]:
    """For each task, from the tasks' last rows: the conversation that the tasks before it have begun, with its turns and sums so far."""
    found, held = {}, None
    for e in sorted(edges, key=lambda r: r.task):
        if held:
            found[e.task] = held
        base = held[1:] if held and held[0] == e.conv_id else (0, 0, 0)
        sums = [(b + pow(common.BASES[f], base[0], 1 << 64) * p) & common.MASK for f, (b, p) in enumerate(zip(base[1:], (e.p1, e.p2), strict=True))]
        held = (e.conv_id, base[0] + e.at + 1, *sums)
    return found


def _place(carries: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and sums from the conversation's beginning: what the tasks before had of it is added."""
    for batch in batches:
        task, conv, at = _ints(batch, "task"), _ints(batch, "conv_id"), _ints(batch, "at")
        sums = {c: _wide(batch, c).copy() for c in SUMS}
        for t in np.unique(task):
            if t in carries:
                begun, turns, *carried = carries[t]
                rows = (task == t) & (conv == begun)
                at = at + np.where(rows, turns, 0)
                for c in SUMS:
                    f = int(c[1]) - 1
                    sums[c][rows] = np.uint64(carried[f]) + np.uint64(pow(common.BASES[f], turns, 1 << 64)) * sums[c][rows]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in [conv, at, *[common.signed(sums[c]) for c in SUMS], _ints(batch, "size")]], names=["conv_id", "at", *SUMS, "size"])


def placed(conversations: DataFrame) -> DataFrame:
    """Each turn with its place (from 0) in its conversation and the sums that name the prefixes before and after it.

    Turns are sorted by number (null first), equal ones by their hashes, over all tasks; a long conversation may lie in many.
    """
    turns = ranks.salted(turn_hashes(conversations), "turn-hashes")
    by = ["conv_id", "turn", "a", "b", "__salt"]
    dealt = turns.repartitionByRange(ranks.tasks_for(turns.count()), *by).sortWithinPartitions(*by)
    scanned = common.stored(dealt.select("conv_id", "a", "b", "size").mapInArrow(_scan, SCANNED), "scanned-turns")
    # one row for each task
    carries = _carries(scanned.filter("last").select("task", "conv_id", "at", "p1", "p2").collect())
    return common.stored(scanned.mapInArrow(partial(_place, carries), PLACED), "placed-turns")


def _rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of own turns, after others (nb turns with the sums hb) stand in place of the first h ones (with the sums q)."""
    for batch in batches:
        h, nb = _ints(batch, "h"), _ints(batch, "nb")
        sums = []
        for c in SUMS:
            f = c[1]
            shifts = np.array([pow(common.BASES[int(f) - 1], k - HEAD, 1 << 64) for k in range(HEAD + 1)], np.uint64)
            sums.append(common.signed(_wide(batch, f"hb{f}") + shifts[nb - h + HEAD] * (_wide(batch, c) - _wide(batch, f"q{f}"))))
        depth = _ints(batch, "at") - h + nb + 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in [_ints(batch, "conv_id"), depth, *sums, _ints(batch, "size"), _ints(batch, "n")]], names=["conv_id", "depth", *SUMS, "size", "n"])


def rebuilt(turns: DataFrame, base: Column | None = None, h: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Prefixes of all conversations, and the conversations (conv_id, n turns), after the first h turns were replaced.

    In their place stand the first h turns of the conversation `base` (all, if it has fewer; none, if it is absent); h is at
    most HEAD. Without base and h, conversations stay as they are.
    """
    first = F.array_sort(F.collect_list(F.when(F.col("at") < HEAD, F.struct("at", *SUMS, "size"))))
    info = common.stored(turns.groupBy("conv_id").agg((F.max("at") + 1).alias("own"), first.alias("first")), "beginnings")
    info = info.withColumn("base", F.lit(None).cast("long") if base is None else base).withColumn("h", (F.lit(0) if h is None else h).cast("long"))
    bases = info.select(F.col("conv_id").alias("base"), F.col("first").alias("taken"))
    plan = info.join(bases, "base", "left").withColumn("taken", F.coalesce(F.slice("taken", 1, F.col("h").cast("int")), F.array().cast(bases.schema["taken"].dataType)))
    plan = plan.withColumn("nb", F.size("taken").cast("long"))
    kept = F.when((F.col("h") > 0) & (F.col("own") >= F.col("h")), F.try_element_at("first", F.col("h").cast("int")))
    end = F.when(F.col("nb") > 0, F.try_element_at("taken", F.lit(-1)))
    of = lambda x, c: F.coalesce(x[c], F.lit(0))
    n = F.col("nb") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    plan = plan.select("conv_id", "h", "nb", "taken", n.alias("n"), of(end, "p1").alias("hb1"), of(end, "p2").alias("hb2"), of(kept, "p1").alias("q1"), of(kept, "p2").alias("q2"))
    plan = common.stored(plan, "rebuilt-conversations")
    own = turns.join(plan.drop("taken"), "conv_id").filter("at >= h").mapInArrow(_rebase, PREFIXES)
    borrowed = plan.select("conv_id", "n", F.inline("taken")).select("conv_id", (F.col("at") + 1).alias("depth"), *SUMS, "size", "n")
    return common.stored(own.unionByName(borrowed), "prefixes"), plan.select("conv_id", "n")


def cells(width: int, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The cell of each prefix in each row of the sketch."""
    out, x = [], common.mix(a + depth.astype(np.uint64) * np.uint64(common.BASES[0]))
    for _ in range(SKETCH_ROWS):
        x = common.mix(x ^ (b + np.uint64(common.BASES[1])))
        out.append((x & np.uint64(width - 1)).astype(np.int64))
    return out


def _block_rows(blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for number, counts in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _count(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's own sketch, as blocks of cells that are not all zero. Counts stop at two: only none, one and more are told apart."""
    sketch = np.zeros((SKETCH_ROWS, width), np.uint8)
    for batch in batches:
        for row, at in zip(sketch, cells(width, _ints(batch, "depth"), _wide(batch, "p1"), _wide(batch, "p2")), strict=True):
            at, times = np.unique(at, return_counts=True)
            row[at] = np.minimum(2, row[at] + np.minimum(2, times).astype(np.uint8))
    blocks = sketch.reshape(-1, CELL_BLOCK)
    yield from _block_rows((int(i), blocks[i]) for i in np.flatnonzero(blocks.any(axis=1)))
    common.give_back()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            counts = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
            total[number] = np.minimum(2, total[number] + counts) if number in total else counts
    yield from _block_rows(iter(total.items()))


def _screen(width: int, path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """alone: the sketch proves that no other conversation has the prefix; tail: nor the prefix before it."""
    blocks = np.zeros((SKETCH_ROWS * width // CELL_BLOCK, CELL_BLOCK), np.uint8)
    system, folder = common.file_at(path)
    for part in pq.ParquetDataset(folder, filesystem=system).fragments:
        for batch in part.to_batches():
            for number, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                blocks[number] = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8)
    sketch = blocks.reshape(SKETCH_ROWS, width)
    single = lambda depth, a, b: reduce(np.logical_or, [row[at] == 1 for row, at in zip(sketch, cells(width, depth, a, b), strict=True)])
    for batch in batches:
        depth = _ints(batch, "depth")
        alone = single(depth, _wide(batch, "p1"), _wide(batch, "p2"))
        tail = alone & (depth > 1) & single(depth - 1, _wide(batch, "o1"), _wide(batch, "o2"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(tail)], names=[*batch.schema.names, "alone", "tail"])
    common.give_back()


def screened(prefixes: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """prefixes with alone and tail, from a count-min sketch of all of them that the tasks fill and merge block by block."""
    rows = prefixes.count()
    width = max(CELL_BLOCK, min(most_cells, 1 << (4 * rows).bit_length()))
    counted = prefixes.select("depth", "p1", "p2").coalesce(max(1, min(256, ranks.tasks_for(rows)))).mapInArrow(partial(_count, width), "block long, counts binary")
    path = common.fresh_dir(prefixes.sparkSession, "prefix-sketch")
    counted.repartition(ranks.LEAST_TASKS, "block").mapInArrow(_merge, "block long, counts binary").write.parquet(path)
    return common.stored(prefixes.mapInArrow(partial(_screen, width, path), SCREENED), "screened-prefixes")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted members, rows of at most ENDS ids of one node, joined by commas."""
    for batch in common.slices(batches, ENDS):
        key = [_ints(batch, c) for c in KEY]
        ids = _ints(batch, "conv_id")
        cuts = np.flatnonzero(np.r_[True, reduce(np.logical_or, [k[1:] != k[:-1] for k in key])])
        text = [",".join(map(str, part)) for part in np.split(ids, cuts[1:])]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[cuts]) for k in key], pa.array(ids[cuts]), pa.array(text)], names=[*KEY, "first", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, of its sorted rows one after the other."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([state.hexdigest()])], names=[*KEY, "ends"])
    for batch in common.slices(batches):
        for *k, ids in zip(*[batch.column(c).to_pylist() for c in [*KEY, "ids"]], strict=True):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    yield row()
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
    if key is not None:
        yield row()


def ends_of(members: DataFrame) -> DataFrame:
    """For each node (depth, p1, p2) the hash of the ids of the conversations that end there, ascending, joined by commas."""
    members = common.stored(members, "ends")
    tasks = ranks.tasks_for(members.count())
    joined = members.repartitionByRange(tasks, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_join_ids, "depth long, p1 long, p2 long, first long, ids string")
    return joined.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hash_ids, "depth long, p1 long, p2 long, ends string")


def subtree_totals(chains: DataFrame) -> DataFrame:
    """conv_id, saved and leaves of each chain and all chains below, from chains (conv_id, up, saved, leaves), up being the chain that it hangs on.

    A round adds to each chain the sums of those that point to it and lets every pointer skip as far again, so a
    path of d chains takes about log d rounds.
    """
    state = common.stored(chains.select("conv_id", "up", "saved", "leaves"), "chains")
    while state.filter("up IS NOT NULL").limit(1).count():
        below = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        skip = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = state.join(below, "conv_id", "left").join(skip, "up", "left")
        moved = moved.select("conv_id", F.col("next").alias("up"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"))
        state = common.stored(moved, "chains")
    return state.select("conv_id", "saved", "leaves")


def _down_chain(rows: DataFrame) -> DataFrame:
    """conv_id and depth with the sums of saved and leaves from that depth down the chain; blocks of depths are summed first."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / CHAIN_BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(after), F.lit(0)).alias("l"))
    summed = rows.select("conv_id", "block", "depth", F.sum("saved").over(within).alias("saved"), F.sum("leaves").over(within).alias("leaves"))
    return summed.join(blocks, ["conv_id", "block"]).groupBy("conv_id", "depth").agg(F.max(F.col("saved") + F.col("s")).alias("saved_tokens"), F.max(F.col("leaves") + F.col("l")).alias("n_leaves"))


def trie(prefixes: DataFrame, conversations: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The nodes of the trie of all prefixes of conversations (conv_id, n): one row each, the root (depth 0) among them.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. A tail, which no other conversation shares, is emitted from its own rows.
    """
    seen = screened(prefixes, most_cells)
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "n_convs", "conv_id", F.struct(zero.alias("o1"), zero.alias("o2")).alias("parent"), zero.alias("size"))
    groups = seen.filter("NOT alone").groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.struct("o1", "o2")).alias("parent"), F.max("size").alias("size"))
    groups = common.stored(groups.unionByName(root), "shared-prefixes")

    child = groups.filter("depth > 0").select(*KEY, "conv_id", "parent.*").unionByName(seen.filter("alone AND NOT tail").select(*KEY, "conv_id", "o1", "o2"))
    parent = groups.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("o1"), F.col("p2").alias("o2"), F.col("conv_id").alias("up"))
    # a parent that is in no group is a prefix that the sketch proved unshared: the same conversation's
    child = common.stored(child.join(parent, ["depth", "o1", "o2"], "left").withColumn("up", F.coalesce("up", "conv_id")), "children")
    counts = child.groupBy((F.col("depth") - 1).alias("depth"), F.col("o1").alias("p1"), F.col("o2").alias("p2")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("size")
    nodes = groups.join(counts, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saved", saved).withColumn("leaves", (F.col("n_children") == 0).cast("long"))
    nodes = common.stored(nodes.drop("parent", "size"), "shared-nodes")

    ended = seen.filter("alone AND depth = n").select("conv_id", "depth", zero.alias("saved"), F.lit(1).cast("long").alias("leaves"))
    own = nodes.select("conv_id", "depth", "saved", "leaves").unionByName(ended)
    tops = child.filter("up != conv_id").select("conv_id", "up", (F.col("depth") - 1).alias("depth"))
    chains = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).join(tops, "conv_id", "left")
    hung = tops.join(subtree_totals(chains), "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    sums = _down_chain(own.unionByName(hung).groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))

    members = seen.filter("NOT alone AND depth = n").select(*KEY, "conv_id").unionByName(conversations.filter("n = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id"))
    shared = nodes.join(ends_of(members), KEY, "left").join(child.select(*KEY, "up"), KEY, "left").join(sums, ["conv_id", "depth"])
    shared = shared.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    ends = F.when(F.col("depth") == F.col("n"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOBODY))
    single = [one.alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256")]
    tails = seen.filter("tail").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *single)
    heads = seen.filter("alone AND NOT tail").join(child.select(*KEY, "up"), KEY).select("conv_id", "depth", F.col("up").alias("parent_conv_id"), *single)
    return shared.unionByName(tails).unionByName(heads)


def conversation_trie(conversations: DataFrame, base: Column | None = None, h: Column | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """trie of a table (conv_id, turn, role, text), with the first h turns taken from the conversation `base` where these are given.

    Null roles and texts are empty; a null turn comes first; rows with the same turn are all kept, in the order of two
    hashes of role and text, equal ones too; rows without a conv_id are no conversation's. Texts are hashed whole. An
    empty table gives no node, not even a root. Extra columns are ignored.
    """
    return trie(*rebuilt(placed(conversations), base, h), most_cells)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt as the contract says. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as conversation_trie states."""
    base = F.col("conv_id") - F.col("conv_id") % 5
    return conversation_trie(common.table(spark, sf_dir, "conversations"), base, common.crc_of_id("conv_id") % (HEAD + 1))


ORACLE = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id AS c, {CRC32.format(x="conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)
), r AS (
  SELECT c, pos, role, text FROM c JOIN o ON o.conv_id = c - c % 5 AND pos < h
  UNION ALL
  SELECT c, pos, role, text FROM c JOIN o ON o.conv_id = c AND pos >= h
), k AS (
  SELECT c, row_number() OVER w AS d, strlen(text) AS size, sha256(string_agg(sha256(sha256(role) || text), '') OVER w) AS key FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL
  SELECT c, 0, 0, '' FROM c
), n AS (SELECT c, max(d) AS last FROM k GROUP BY c
), v AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, max(size) AS size,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM k JOIN n USING (c) GROUP BY d, key
), e AS (
  SELECT v.*, p.key AS up, u.conv_id AS parent_conv_id
  FROM v LEFT JOIN k p ON p.c = v.conv_id AND p.d = v.d - 1 LEFT JOIN v u ON u.d = p.d AND u.key = p.key
), b AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM e WHERE d > 0 GROUP BY ALL
), s AS (
  SELECT k.d, k.key, sum((n_convs - 1) * v.size) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
  FROM v LEFT JOIN b ON b.d = v.d AND b.key = v.key JOIN k ON k.c = v.conv_id AND k.d <= v.d GROUP BY k.d, k.key
)
SELECT conv_id, e.d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM e LEFT JOIN b ON b.d = e.d AND b.key = e.key JOIN s ON s.d = e.d AND s.key = e.key
"""
