"""Merkle manifest of a table as a persistent tree: a changed leaf is a version that copies its ancestors and shares all else.

Leaves are numbered within their group, and aligned blocks of them are one task's work: a block's tree depends on no other
block. The blocks' roots are the nodes of the next tier, dealt to blocks again, up to one root for each group and then one
for all. On the way down each block learns the siblings above it; a version copies the path from its leaf to the block's
root, and goes on along those siblings, so that the versions of one block never meet those of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import common, ranks

#: Levels of a block; it has 2^LEVELS leaves.
LEVELS = 8
#: A version where this divides the checksum of the document's id.
TAMPERED = 7

NODES = "g long, place long, of long, digest string"
HEADS = "g long, place long, subroot string, path array<string>"
VERSIONS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, copied array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(**columns: Column) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns.values()]), 256)


def block_levels(leaves: list[str], of: int, most: int = LEVELS) -> list[list[str]]:
    """The nodes of a block, level by level: as many levels as its group (of nodes) still has, at most so many."""
    out = [leaves]
    for _ in range(min(most, max(0, of - 1).bit_length())):
        below = out[-1]
        out.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """For each level below the top, L or R (the side) and the digest of the sibling of leaf `at`'s ancestor, or `-` where there is none."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return out


def copied_path(leaf: str, path: list[str]) -> list[str]:
    """The nodes that a version with this leaf copies, from the leaf to the root; all others are shared."""
    out = [leaf]
    for s in path:
        out.append(digest(s[1:], out[-1]) if s[0] == "L" else digest(out[-1], s[1:] if s[0] == "R" else ""))
    return out


def proof(path: list[str]) -> str:
    return digest(*[s[1:] for s in path])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list]]:
    """Each block's group, number and rows, of batches sorted by group, block and place."""
    rows = chain.from_iterable(zip(*[c.to_pylist() for c in part.columns], strict=True) for part in common.slices(batches))
    for (g, block), block_rows in groupby(rows, key=lambda r: r[:2]):
        yield g, block, list(block_rows)


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, 1024)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def _dealt(nodes: DataFrame, tasks: int, levels: int) -> DataFrame:
    """Whole blocks to tasks, in order: g, block, place first."""
    block = F.shiftright("place", levels)
    if "head" in nodes.columns:
        block = F.coalesce("head", block)
    rest = [c for c in nodes.columns if c not in ("g", "head", "place", "of")]
    return nodes.select("g", block.alias("block"), "place", "of", *rest).repartition(tasks, "g", "block").sortWithinPartitions("g", "block", "place")


def _roots(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for g, block, members in _groups(batches):
            of = members[0][3]
            yield g, block, -(-of // (1 << most)), block_levels([m[4] for m in members], of, most)[-1][0]

    return _emit(rows(), pa.schema([("g", pa.int64()), ("place", pa.int64()), ("of", pa.int64()), ("digest", pa.string())]))


def _heads(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for g, _, (head, *members) in _groups(batches):
            levels = block_levels([m[4] for m in members], members[0][3], most)
            for i, m in enumerate(members):
                yield g, m[2], head[5], [*siblings(levels, i), *head[6]]

    return _emit(rows(), pa.schema([("g", pa.int64()), ("place", pa.int64()), ("subroot", pa.string()), ("path", pa.list_(pa.string()))]))


def _versions(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for _, _, (head, *members) in _groups(batches):
            levels = block_levels([m[4] for m in members], members[0][3], most)
            for i, m in enumerate(members):
                path = [*siblings(levels, i), *head[6]]
                nodes = copied_path(m[8] or m[4], path)
                yield m[7], m[4], head[5], proof(path), nodes[-1], nodes if m[8] else None

    text = pa.string()
    return _emit(rows(), pa.schema([("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("proof_sha256", text), ("folded_root", text), ("copied", pa.list_(text))]))


def _tiers(nodes: DataFrame, tasks: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of blocks of these, up to one root for each group."""
    out, most = [nodes], nodes.agg(F.coalesce(F.max("of"), F.lit(0))).first()[0]
    while len(out) == 1 or most > 1:
        out.append(common.stored(_dealt(out[-1], tasks, levels).mapInArrow(partial(_roots, levels), NODES), f"tier-{len(out)}"))
        most, tasks = -(-most >> levels), max(ranks.LEAST_TASKS, tasks >> levels)
    return out


def _under(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """nodes with a row before each block that holds what is above it."""
    first = heads.select("g", F.col("place").alias("head"), F.lit(-1).cast("long").alias("place"), "subroot", "path")
    return nodes.unionByName(first, allowMissingColumns=True).select("g", "head", "place", "of", "digest", "subroot", "path", *[c for c in nodes.columns if c in ("doc_id", "changed")])


def _down(tiers: list[DataFrame], heads: DataFrame, lowest: int, tasks: int, levels: int) -> DataFrame:
    """The siblings above every node of the lowest tier named, heads being those above the roots."""
    for k in range(len(tiers) - 2, lowest - 1, -1):
        heads = common.stored(_dealt(_under(tiers[k], heads), tasks, levels).mapInArrow(partial(_heads, levels), HEADS), f"above-{k}")
    return heads


@dataclass
class Manifest:
    """leaves (g, place, of, digest, doc_id, changed), the siblings above each block of them, and the root (null without leaves)."""

    leaves: DataFrame
    heads: DataFrame
    root: str | None
    tasks: int
    levels: int


def build(rows: DataFrame, group: str, order: str, levels: int = LEVELS) -> Manifest:
    """The tree over rows (group, order, digest, changed): leaves of a group ascend by order (null first), then by digest."""
    rows = ranks.salted(rows, "leaves")
    tasks = ranks.tasks_for(rows.count())
    groups = ranks.numbered(ranks.salted(rows.select(group).distinct(), "groups"), [], [group], "ordered-groups").select(F.col(group).alias("__group"), F.col("place").alias("g"), F.col("of").alias("groups"))
    groups = common.stored(groups, "groups-of-leaves")
    placed = ranks.joined(ranks.numbered(rows, [group], [order, "digest"], "ordered-leaves"), groups, {group: "__group"})
    leaves = common.stored(placed.select("g", "place", "of", "digest", F.col(order).alias("doc_id"), "changed"), "numbered-leaves")
    tiers = _tiers(leaves.select("g", "place", "of", "digest"), tasks, levels)
    subroots = tiers[-1].select("g", F.col("digest").alias("subroot"))
    over = groups.join(subroots, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("place"), F.col("groups").alias("of"), F.col("subroot").alias("digest"))
    over = _tiers(common.stored(over, "subroots"), ranks.LEAST_TASKS, levels)
    top = over[-1].first()
    none = over[-1].select("g", "place", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<string>").alias("path"))
    heads = _down(over, none, 0, ranks.LEAST_TASKS, levels).select(F.col("place").alias("g"), F.lit(0).cast("long").alias("place"), "path")
    heads = _down(tiers, heads.join(subroots, "g").select("g", "place", "subroot", "path"), 1, tasks, levels)
    return Manifest(leaves, heads, top.digest if top else None, tasks, levels)


def versions(tree: Manifest) -> DataFrame:
    """Each leaf with its group's root, the hash of its proof and the root folded from it (its changed digest, if it has one).

    copied has the nodes of the version that a changed leaf makes, from the leaf to the root; null for other leaves.
    """
    return _dealt(_under(tree.leaves, tree.heads), tree.tasks, tree.levels).mapInArrow(partial(_versions, tree.levels), VERSIONS)


def document_leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, digest and changed (the digest with n_chars one larger where the document is tampered with and has n_chars)."""
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = columns | {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    hit = (F.pmod(common.crc_of_id(), F.lit(TAMPERED)) == 0) & F.col("n_chars").isNotNull()
    return docs.select("lang", "doc_id", leaf_of(**columns).alias("digest"), F.when(hit, leaf_of(**more)).alias("changed"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """versions of the documents' tree by lang, with root and verified (the folded root is the root).

    Nulls in any column are encoded as `-`; null langs are a group of their own, the first; a null doc_id comes first in
    its group and is never tampered with; rows with the same doc_id ascend by leaf, equal rows are leaves of their own.
    Texts are hashed whole, empty ones too. An empty table has no root and gives no rows. Extra columns take no part.
    """
    tree = build(document_leaves(docs), "lang", "doc_id", levels)
    root = F.lit(tree.root).cast("string")
    return versions(tree).select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), "copied")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents and its tampered versions. Nulls, long texts, ties, repeated rows, empty tables and extra columns: as manifest states."""
    return manifest(common.table(spark, sf_dir, "documents")).drop("copied")


#: The checksum of the decimal text of {x}, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))))"""

_ENCODED = "coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
_LEAF = " || ".join(_ENCODED.format(x=x) for x in ("doc_id", "source", "lang", "{n}", "text"))

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM (
    SELECT row_number() OVER () AS k, doc_id, lang, sha256({_LEAF.format(n="n_chars")}) AS leaf,
           CASE WHEN {CRC32.format(x="doc_id")} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_LEAF.format(n="(n_chars + 1)")}) END AS changed
    FROM documents)
), t AS (
  SELECT lang, 0 AS lv, list(leaf ORDER BY r) AS n FROM d GROUP BY lang
  UNION ALL
  SELECT lang, lv + 1, [sha256(n[2 * i - 1] || coalesce(n[2 * i], '')) for i in range(1, (len(n) + 1) // 2 + 1)] FROM t WHERE len(n) > 1
), s AS (
  SELECT lang, lv AS height, n[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS sr FROM t WHERE len(n) = 1
), u AS (
  SELECT 0 AS lv, list(subroot ORDER BY sr) AS n FROM s
  UNION ALL
  SELECT lv + 1, [sha256(n[2 * i - 1] || coalesce(n[2 * i], '')) for i in range(1, (len(n) + 1) // 2 + 1)] FROM u WHERE len(n) > 1
), p AS (
  SELECT k, lv, (r >> lv) % 2 AS odd, n[xor(r >> lv, 1) + 1] AS sib FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang WHERE len(n) > 1
  UNION ALL
  SELECT k, height + lv, (sr >> lv) % 2, n[xor(sr >> lv, 1) + 1] FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang, u WHERE len(n) > 1
), q AS (
  SELECT k, sha256(coalesce(string_agg(sib, '' ORDER BY lv), '')) AS proof_sha256 FROM d LEFT JOIN p USING (k) GROUP BY k
), f AS (
  SELECT k, 0 AS lv, coalesce(changed, leaf) AS h FROM d
  UNION ALL
  SELECT f.k, f.lv + 1, sha256(CASE WHEN odd = 1 THEN sib || h ELSE h || coalesce(sib, '') END) FROM f JOIN p ON f.k = p.k AND f.lv = p.lv
), g AS (SELECT k, arg_max(h, lv) AS folded_root FROM f GROUP BY k
), top AS (SELECT n[1] AS root FROM u WHERE len(n) = 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang JOIN q USING (k) JOIN g USING (k), top
"""
