"""Near-duplicate documents: fast similarity sketching, banding, exact verification and components.

A sketch has SLOTS bins. In round i of the first SLOTS rounds every shingle falls into one hashed bin with a hashed
value; in round SLOTS + j all shingles fall into bin j. A bin keeps its smallest value of the first round that
reaches it, so each bin is full and two sketches agree in a bin with probability equal to the sets' similarity.
Rows of bins make bands; documents that share a band are candidates, and only links confirmed on full sets count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import common
from docquery.llm.components import components

#: 32 bands of 4 bins: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32, 5e-8.
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Rounds of hubs before the pairs left between components of a bucket are compared one by one.
HUB_ROUNDS = 2
#: Buckets with more members than this are not paired row by row: their members are compared block by block.
SMALL_BUCKET = 64
BLOCK = 256

SEPARATORS = common.byte_class([(0x20, 0x20), (0x09, 0x0D)])
_SEEDS = common.mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64))
_DIGESTS = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_BIN_SHIFT = np.uint64(64 - 7)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    data, offsets = common.text_buffer(texts)
    data = common.LOWER[data]
    starts, ends, before = common.word_bounds(data, offsets, SEPARATORS)
    hashed = common.span_hash(common.prefix_hash(data), starts, ends)
    weight = [np.uint64(pow(0x9FB21C651E98DF25, j + 1, 1 << 64)) for j in range(size)]
    joint = sum((hashed[j : len(hashed) - size + 1 + j] * weight[j] for j in range(size)), np.zeros(max(0, len(hashed) - size + 1), np.uint64)) if len(hashed) >= size else np.zeros(0, np.uint64)
    joint = common.mix(joint + np.uint64(size))
    out = []
    for low, high in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        n = high - low
        if n >= size:
            out.append(np.unique(joint[low : high - size + 1]))
        elif n:
            with np.errstate(over="ignore"):
                short = sum((hashed[low + j] * weight[j] for j in range(n)), np.uint64(n))
            out.append(common.mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SLOTS values of a non-empty set of distinct hashes."""
    out, empty = np.zeros(SLOTS, np.uint64), np.ones(SLOTS, bool)
    edges = np.arange(SLOTS, dtype=np.uint64) << _BIN_SHIFT
    for i in range(SLOTS):
        values = np.sort(common.mix(shingles ^ _SEEDS[i]))
        at = np.searchsorted(values, edges)
        there = at < len(values)
        there[there] = values[at[there]] >> _BIN_SHIFT == np.flatnonzero(there).astype(np.uint64)
        new = there & empty
        out[new] = values[at[new]]
        empty &= ~there
        if not empty.any():
            return out
    for j in np.flatnonzero(empty):
        out[j] = common.mix(shingles ^ _SEEDS[SLOTS + j]).min()
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _DIGESTS[1]
    for r in range(ROWS):
        out = common.mix(out ^ rows[:, r])
    return out


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and its band hashes; no bands for an empty set."""

    def run(batches):
        for batch in common.slices(batches, 128):
            sets = shingle_sets(batch.column(1), size)
            digest = [(int(common.signed(common.mix(s ^ _DIGESTS[0])).sum()), int(common.signed(common.mix(s ^ _DIGESTS[1])).sum())) for s in sets]
            bands = [common.signed(band_hashes(sketch(s))) if len(s) else np.zeros(0, np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, bands)]).astype(np.int32), np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64()), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node and shingles of the documents named in nodes."""

    def run(batches):
        for batch in common.slices(batches, 128):
            sets = [common.signed(s) for s in shingle_sets(batch.column(1), size)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "shingles"])

    # a shuffle at every size: whether the nodes could be broadcast depends on the corpus
    named = nodes.select(F.col("node").alias("doc_id")).hint("merge")
    return docs.select("doc_id", "text").join(named, "doc_id", "left_semi").mapInArrow(run, "node long, shingles array<long>")


def _could(percent: int):
    return F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("us"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("vs"))
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("us", "vs")))
    return both.filter(f"100 * common >= {percent} * (size(us) + size(vs) - common)").select("u", "v")


def common_sizes(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of a bounded list of sets, as products of 0/1 matrices of some shingles at a time."""
    lengths = [len(x) for x in sets]
    row = np.repeat(np.arange(len(sets)), lengths)
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1
    keep = seen[column] > 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        a, b = np.searchsorted(column, [low, low + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _block_links(placed: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of large buckets. Members that such buckets connect are cut into blocks, and each pair of blocks is a task of bounded size that returns links only."""
    inside = placed.join(large.select("bucket"), "bucket")
    hubs = inside.groupBy("bucket").agg(F.min("node").alias("hub"))
    clusters = common.stored(components(inside.join(hubs, "bucket").select(F.col("node").alias("u"), F.col("hub").alias("v"))), "clusters")
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = inside.select("node", F.col("component").alias("own")).distinct().join(clusters, "node").join(sizes, "component")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "own")

    def verify(table: pa.Table) -> pa.Table:
        node, own, block = (table[c].to_numpy() for c in ("node", "own", "block"))
        lists = table["shingles"].combine_chunks()
        sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
        n = np.array([len(x) for x in sets])
        both = common_sizes(sets)
        linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        linked &= (own[:, None] != own[None, :]) & (node[:, None] > node[None, :])
        if table["i"][0].as_py() != table["j"][0].as_py():
            linked &= block[:, None] != block[None, :]
        u, v = np.nonzero(linked)
        return pa.table([pa.array(node[u]), pa.array(node[v])], names=["u", "v"])

    return keyed.join(sets, "node").groupBy("component", "i", "j").applyInArrow(verify, "u long, v long")


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable through links) of every row.

    Documents with equal sets are one node, named by their smallest doc_id. Each bucket's members are first compared
    with its hub, the member whose buckets are largest; members still in other components are compared with the hubs
    of those, and after HUB_ROUNDS rounds all pairs between components of a bucket are (in blocks, where it is large),
    so no candidate is left out and a group that a hub connects is never paired within itself.
    Null and empty texts have an empty set and are linked with nothing. Rows with the same doc_id are one node. A
    null doc_id is a node of its own that takes no part and keeps a null component. Very long texts are one set as any
    other; of equal sets the smallest doc_id names the node, and equally weighted hubs the smaller one. Other columns
    are ignored; an empty table gives no rows.
    """
    signs = common.stored(signatures(docs, size), "signatures")
    nodes = signs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.stored(nodes.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # stored, so that both sides of the join are shuffled by it alone and a large bucket can be split
    shared = common.stored(rows.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "shared-buckets")
    members = rows.join(shared, "bucket").distinct()
    weight = members.groupBy("node").agg(F.sum("m").alias("weight"))
    members = common.stored(members.join(weight, "node").select("bucket", "node", "n", "weight"), "members")
    sets = common.stored(full_sets(docs, members.select("node").distinct(), size), "sets")

    done = links = labels = None
    for k in range(HUB_ROUNDS + 1):
        placed = members.withColumn("component", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if k == 0:
            hubs = placed.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"), "n", "component")).alias("h"))
        else:
            by_component = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.max(F.struct("weight", (-F.col("node")).alias("node"), "n", "component")).alias("h"))
            largest = by_component.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("m").alias("size"), F.max(F.struct("m", F.col("component").alias("c"))).alias("top")).filter("k > 1")
            others = by_component.join(largest, "bucket").filter("component != top.c")
            if k < HUB_ROUNDS:  # the hub of the largest component that is not the bucket's first
                hubs = others.groupBy("bucket").agg(F.max(F.struct("m", "h")).alias("x")).select("bucket", F.col("x.h").alias("h"))
            else:
                largest = common.stored(largest, "open-buckets")
                large = largest.filter(F.col("size") > SMALL_BUCKET)
                outside = placed.join(largest.filter(F.col("size") <= SMALL_BUCKET), "bucket").filter("component != top.c")
                hubs = outside.select("bucket", F.struct("weight", (-F.col("node")).alias("node"), "n", "component").alias("h"))
        pairs = (
            placed.join(hubs, "bucket")
            .filter("component != h.component")
            .select("node", F.col("n").alias("a_n"), (-F.col("h.node")).alias("hub"), F.col("h.n").alias("b_n"))
            .filter(_could(percent))
            .select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v"))
            .distinct()
        )
        pairs = common.stored(pairs if done is None else pairs.join(done, ["u", "v"], "left_anti"), "pairs")
        new = _verified(pairs, sets, percent)
        if k == HUB_ROUNDS and not large.isEmpty():
            new = new.union(_block_links(placed, large, sets, percent))
        new = common.stored(new, "links")
        done = pairs if done is None else done.union(pairs)
        links = new if links is None else links.union(new)
        labels = common.stored(components(links), "labels")

    named = classes.select("d1", "d2", "node")
    named = named.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = signs.join(named.select("d1", "d2", "component"), ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as link states."""
    found = link(common.table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM common JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * c >= 80 * (nu.n + nv.n - c)
), e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, e.v FROM reach JOIN e ON reach.r = e.u
), comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON comp.d = doc_id
"""
