"""Best-fit packing of token pieces into sequences, planned on the histogram of piece lengths.

The plan is a configuration linear program: a configuration is a set of lengths that fits one sequence, and the
program covers every length's count with as few as possible. Multiplicative weights hold a price for each length,
falling with its coverage; a knapsack by dynamic programming finds the best-priced configurations. The solution is
rounded and solved again for the rest, until few pieces are left, which go to the fullest sequence that has room (best fit, longest first). All of it sees at
most `capacity` lengths, so the driver's work and the plan's size do not grow with the documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm import common, tokens

CAPACITY = 1024
ROUNDS = 200
#: Rows whose texts share the encoder's dictionary of words.
ROWS = 1024
#: Configurations taken at one set of prices: the least covered lengths, each with its best-priced company.
SEEDS = 32
#: Shares of the program's solution that rounding tries.
SHARES = (1.0, 0.7)
#: Pieces that are not solved for any more, but placed best fit.
LAST = 256

Config = tuple[tuple[int, int], ...]


def _price_table(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every space that lengths fill without a gap, the index of the one that the best-priced filling takes next; and the largest such space up to each."""
    best, pick = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for space in range(1, capacity + 1):
        if k := fits[space]:
            value = best[space - lengths[:k]] + price[:k]
            j = int(value.argmax())
            if value[j] > -np.inf:
                pick[space], best[space] = j, value[j]
    filled = np.where((pick >= 0) | (np.arange(capacity + 1) == 0), np.arange(capacity + 1), 0)
    return pick, np.maximum.accumulate(filled)


def cover(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = 4.0) -> dict[Config, float]:
    """A fractional solution for counts[length] pieces by configurations ((length, copies), ...), by multiplicative weights; it covers nearly all, and rounding leaves the rest to the next solution."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return {}
    need = counts[lengths].astype(float)
    covered = np.zeros(len(lengths))
    least = float((lengths * need).sum()) / capacity
    out: dict[Config, float] = {}
    used = 0.0
    for _ in range(rounds):
        if used >= 0.99 * least:
            break
        ratio = covered / need
        pick, filled = _price_table(lengths, lengths / capacity * np.exp(np.clip(-eta * (ratio - used / least), -8, 4)), capacity)
        for seed in np.argsort(ratio, kind="stable")[:SEEDS]:
            config, space = {int(seed): 1}, int(filled[capacity - lengths[seed]])
            while space > 0:
                j = int(pick[space])
                config[j] = config.get(j, 0) + 1
                space -= lengths[j]
            index = np.fromiter(config, int)
            copies = np.fromiter(config.values(), float)
            most = float((need[index] / copies).min())
            step = min(most, max(0.1 * most, 0.5 * least / (rounds * SEEDS)))
            covered[index] += copies * step
            used += step
            key = tuple(sorted(((int(lengths[j]), n) for j, n in config.items()), reverse=True))
            out[key] = out.get(key, 0.0) + step
    return out


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """Best fit, longest first, of all pieces of a length at a time: (configuration, how many sequences)."""
    open_: dict[int, list[tuple[Config, int]]] = {capacity: []}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for space in sorted(s for s in open_ if s >= length):
            while left and open_[space]:
                config, n = open_[space].pop()
                per = min(space // length, -(-left // n))
                if per * n > left and n > 1 and (rest := n - left // per):
                    open_[space].append((config, rest))
                    n -= rest
                if per * n > left:
                    per = left // n
                left -= per * n
                open_.setdefault(space - per * length, []).append(((*config, (length, per)), n))
        if left:
            per = min(capacity // length, left)
            full, extra = divmod(left, per)
            open_.setdefault(capacity - per * length, []).append((((length, per),), full))
            if extra:
                open_.setdefault(capacity - extra * length, []).append((((length, extra),), 1))
    return [x for groups in open_.values() for x in groups]


def _rounded(fractional: dict[Config, float], counts: np.ndarray, share: float) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """Whole numbers nearest to a share of each configuration, as far as there are pieces, and the pieces that are left."""
    rest, chosen = counts.copy(), []
    for config, x in sorted(fractional.items(), key=lambda x: (-x[1], x[0])):
        n = min([int(share * x + 0.5), *(int(rest[length]) // copies for length, copies in config)])
        if n > 0:
            chosen.append((config, n))
            for length, copies in config:
                rest[length] -= n * copies
    return chosen, rest


def program(counts: np.ndarray, capacity: int = CAPACITY, share: float = 1.0) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """Sequences from the program: solved and rounded, then again for what is left, until LAST pieces are or rounding takes none."""
    chosen, rest = [], counts
    while rest.sum() > LAST:
        more, left = _rounded(cover(rest, capacity), rest, share)
        if not more:
            break
        chosen, rest = chosen + more, left
    return chosen, rest


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """How many sequences hold which lengths; every counted piece has a place exactly once.

    The program's sequences at some shares of its solution, each with its last pieces placed best fit, are compared, and the
    fewest are taken (ties: the larger share). Where best fit of all pieces needs still fewer, as it may where many short
    pieces fill every gap, that is taken: the plan never has more sequences than best fit.
    """
    plans = []
    for share in SHARES:
        chosen, rest = program(counts, capacity, share)
        plans.append(chosen + best_fit(rest, capacity))
    plans.append(best_fit(counts, capacity))
    return min(plans, key=lambda p: sum(n for _, n in p))


def slots(chosen: list[tuple[Config, int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, in order of rank, where its pieces go; sorted by key = length and first rank."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for config, n in chosen:
        offset = 0
        for length, copies in config:
            rows.append((length, rank[length], copies, base, offset))
            rank[length] += copies * n
            offset += length * copies
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "copies": table[:, 2], "base": table[:, 3], "offset": table[:, 4]}


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and its end, cut only where longer than capacity (the first piece takes what is over).

    Null and empty texts are their end id alone. `part` and `local` number the pieces of one length within a task.
    """

    def cut(batches):
        encoder, part, seen = tokens.encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in common.slices(batches, ROWS):
            ids, counts = encoder.encode_closed(batch.column(1), end_id)
            raw, base = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
            per, starts, lengths, crc = [], [], [], []
            for n in counts.tolist():
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                per.append(len(edges) - 1)
                starts += edges[:-1]
                lengths += [b - a for a, b in zip(edges, edges[1:], strict=False)]
                crc += [zlib.crc32(raw[4 * (base + a) : 4 * (base + b)]) for a, b in zip(edges, edges[1:], strict=False)]
                base += n
            row, length = np.repeat(np.arange(batch.num_rows), per), np.array(lengths, np.int64)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            local = np.empty(len(length), np.int64)
            local[order] = seen[length[order]] + np.arange(len(length)) - first
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column(0).take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(starts, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each stored piece its sequence_id and offset. No two pieces share a place; sequences have no gaps."""
    sizes = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # a row for each task and length, never one for each piece
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(sizes.withColumn("before", before).drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))

    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    where = slots(plan(counts, capacity), capacity)

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(where["key"], (length << 44) + rank, side="right") - 1
            nth = rank - where["first"][at]
            copies = where["copies"][at]
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(where["base"][at] + nth // copies), pa.array(where["offset"][at] + nth % copies * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places.

    Null and empty texts are their end id alone; a null doc_id stays null; very long texts are encoded in parts with
    the same ids. Rows that repeat a doc_id are packed each; which of equally long pieces takes which place is any.
    Other columns are ignored; an empty table gives no rows.
    """
    return place(common.stored(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens for whole documents. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as pack states."""
    return pack(common.table(spark, sf_dir, "documents"), tokens.default_path())
