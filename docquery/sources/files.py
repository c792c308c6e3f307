"""Markdown files of a directory tree as documents."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.functions.text import line_count

# Directories that are never indexed, and the default size limit in bytes.
IGNORED_DIRS = ["node_modules", "target", "vendor", "dist", "build", ".git"]
MAX_FILE_SIZE = 1_048_576
#: Names of ignore files, which every folder may have; rules of a later name are stronger.
IGNORE_FILES = [".gitignore", ".docqueryignore"]


def pruned(rel_path: Column) -> Column:
    """True where a component is an ignored directory or begins with a dot."""
    parts = F.split(rel_path, "/")
    return F.exists(parts, lambda p: p.isin(IGNORED_DIRS) | p.startswith("."))


def _pattern(glob: str, exact: bool = False) -> str:
    """A regular expression for one ignore pattern on paths below its folder; one that leads out of the folder is an error.

    exact: for the matched file or folder itself (which ends with a slash), not for what lies below it.
    """
    if ".." in glob.replace("\\", "/").split("/"):
        raise ValueError(f"an ignore pattern leaves the root: {glob}")
    body = glob.strip("/")
    marks = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.+", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def part(x: str) -> str:
        if x.startswith("[") and len(x) > 2:
            return "[" + re.sub(r"([\[\\&])", r"\\\1", x[1:-1].replace("!", "^", 1) if x[1] == "!" else x[1:-1]) + "]"
        return marks.get(x, re.escape(x[1:] if x.startswith("\\") and len(x) > 1 else x))

    text = "".join(map(part, re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[!?[^\]/]+\]|\\.|[^*?/\[\\]+|/|\[|\\", body)))
    start = "^" if "/" in glob.rstrip("/") else "(?:^|/)"
    if exact:
        return start + text + ("/$" if glob.endswith("/") else "/?$")
    return start + text + ("/" if glob.endswith("/") else "(?:/|$)")


def rules(lines: list[str], inner: bool = False) -> list[tuple[str, bool]]:
    """Each pattern of an ignore file, in order, as a regular expression and whether it leaves out (or takes back, `!`). Of an inner folder, patterns with `..` match nothing."""
    out = []
    for line in (x.strip() for x in lines):
        glob = line.removeprefix("!")
        if line and not line.startswith("#") and not (inner and ".." in glob.split("/")):
            out.append((_pattern(glob, exact=True), not line.startswith("!")))
    return out


def ignored(rel_path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns leave a path out: `*` and `?` inside a name, `**` across names, a leading or inner slash for the root, a final one for folders, `!` to take back; the last that matches decides."""
    out = F.lit(False)
    for p in (x.strip() for x in patterns):
        if p and not p.startswith("#"):
            out = F.when(rel_path.rlike(_pattern(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def _read(spark: SparkSession, path: str) -> list[str] | None:
    """Lines of a small file; none where there is no such file, and an error where it is larger than a file may be."""
    # Spark's readers pass over names that begin with a dot, so the file comes through the file system that they use
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path) or not system.getFileStatus(path).isFile():
        return None
    if system.getFileStatus(path).getLen() > MAX_FILE_SIZE:
        raise ValueError(f"{path.getName()} is too large")
    stream = system.open(path)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def ignore_file(spark: SparkSession, root: str, name: str = ".gitignore") -> list[str]:
    """Patterns of the root's ignore file; none where there is no such file, and an error where it is larger than a file may be."""
    return _read(spark, f"{root.rstrip('/')}/{name}") or []


def exclude_file(spark: SparkSession, root: str) -> list[str]:
    """Patterns of version control's own exclude file: of the root's folder or, in a linked worktree, of the common folder that it names."""
    root = root.rstrip("/")
    link = _read(spark, f"{root}/.git")  # a file in a linked worktree
    if link is None:
        return _read(spark, f"{root}/.git/info/exclude") or []
    named = next((x.removeprefix("gitdir:").strip() for x in link if x.startswith("gitdir:")), None)
    if not named:
        return []
    below = lambda base, path: path if path.startswith("/") else f"{base}/{path}"
    own = below(root, named)
    common = _read(spark, f"{own}/commondir")
    return _read(spark, f"{below(own, common[0].strip()) if common else own}/info/exclude") or []


def _uri(path: str) -> str:
    return re.sub("^file:/+", "file:///", path)


def _ignore_files(base: str):
    """For batches of folders below base: their ignore files as folder, rank (place of the name in IGNORE_FILES), depth and rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(_uri(base))
        schema = pa.schema([("folder", pa.string()), ("rank", pa.int32()), ("depth", pa.int32()), ("rules", pa.list_(pa.struct([("regex", pa.string()), ("out", pa.bool_())])))])
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info([f"{path.rstrip('/')}/{folder}/{name}" for name in IGNORE_FILES])
                for rank, info in enumerate(found):
                    if info.type != fs.FileType.File:
                        continue
                    if info.size > MAX_FILE_SIZE:
                        raise ValueError(f"{folder}/{info.base_name} is too large")
                    with system.open_input_stream(info.path) as stream:
                        lines = stream.read().decode("utf-8", "replace").splitlines()
                    rows.append({"folder": folder, "rank": rank, "depth": folder.count("/") + 1, "rules": [{"regex": r, "out": o} for r, o in rules(lines, inner=True)]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _unlinked(base: str):
    """Of batches of paths below a local folder, those that no symbolic link leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = os.path.realpath(re.sub("^file:/+", "/", base))
        for batch in batches:
            real = [os.path.realpath(f"{root}/{p}") == os.path.normpath(f"{root}/{p}") for p in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(real, pa.bool_()))

    return run


def _left_out(spark: SparkSession, root: str, base: str, paths: DataFrame, patterns: list[str]) -> DataFrame:
    """rel_path of the paths that ignore rules leave out.

    A path is out if it, or a folder above it, is; what lies in such a folder is not taken back. Of all rules that match one
    the strongest decides: the given patterns, then IGNORE_FILES from the last name to the first, in each the deepest
    folder's, in a file the last, and weakest version control's exclude file.
    """
    parts = F.split("rel_path", "/")
    n = F.size(parts)
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    nodes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(upto(i), F.when(i < n, "/").otherwise("")))
    placed = paths.select("rel_path", F.explode(nodes).alias("node"))
    every = placed.select("node").distinct()
    # the rules of the root meet all paths, so they are part of the expression; those of other folders are joined by folder
    at_root = [(len(IGNORE_FILES), patterns), *[(rank, ignore_file(spark, root, name)) for rank, name in enumerate(IGNORE_FILES)], (-1, exclude_file(spark, root))]
    best = [F.col("inner")]
    for rank, lines in at_root:
        out = F.lit(None).cast("boolean")
        for regex, leaves_out in rules(lines):
            out = F.when(F.col("node").rlike(regex), F.lit(leaves_out)).otherwise(out)
        best.append(F.when(out.isNotNull(), F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("depth"), out.alias("out"))))
    steps = F.split(F.rtrim(F.col("node"), F.lit("/")), "/")
    above = F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    pairs = every.select("node", F.explode(above).alias("folder"))
    held = pairs.select("folder").distinct().mapInArrow(_ignore_files(base), "folder string, rank int, depth int, rules array<struct<regex:string,out:boolean>>").filter(F.size("rules") > 0)
    matched = F.filter("rules", lambda r: F.regexp_like(F.expr("substring(node, length(folder) + 2)"), r["regex"]))
    inner = pairs.join(held, "folder").withColumn("met", F.try_element_at(matched, F.lit(-1))).filter("met IS NOT NULL")
    inner = inner.groupBy("node").agg(F.max(F.struct("rank", "depth", F.col("met.out").alias("out"))).alias("inner"))
    gone = every.join(inner, "node", "left").filter(F.greatest(*best)["out"]).select("node")
    return placed.join(gone, "node", "left_semi").select("rel_path").distinct()


def inside(root: str, rel_path: str) -> str:
    """The path of a document below the root; one that is empty, absolute, leaves the root or is no Markdown file is an error."""
    parts = rel_path.replace("\\", "/").split("/")
    if not rel_path or rel_path.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or not rel_path.lower().endswith(".md"):
        raise ValueError(f"not a document of this root: {rel_path!r}")
    return f"{root.rstrip('/')}/{'/'.join(p for p in parts if p not in ('', '.'))}"


def scan(spark: SparkSession, root: str, max_file_size: int = MAX_FILE_SIZE, patterns: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """rel_path, size, mtime, text and warning of every Markdown file below root (or in it alone) that is not pruned or ignored.

    Files over the limit or not in UTF-8 have a null text and a warning, and do not stop the scan. Paths use '/'.
    patterns: ignore patterns besides those of the ignore files of the root and all folders. Files that a symbolic link
    leads to are no files of the root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[mM][dD]").load(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"
    rel = F.translate(F.expr(f"substring(path, {len(base) + 1})"), "\\", "/")
    named = files.withColumn("rel_path", rel).filter(~pruned(F.col("rel_path")))
    paths = named.select("rel_path")  # the files themselves are not read for this
    if base.startswith("file:"):
        paths = paths.mapInArrow(_unlinked(base), "rel_path string")
    kept = paths.join(_left_out(spark, root, base, paths, patterns or []), "rel_path", "left_anti")
    large = F.col("length") > max_file_size
    text = F.when(~large, F.try_validate_utf8(F.col("content").cast("string")))
    warning = F.when(large, "too large").when(text.isNull(), "not UTF-8")
    read = named.select("rel_path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), text.alias("text"), warning.alias("warning"))
    return read.join(kept, "rel_path", "left_semi")


def one_document(docs: DataFrame, rel_path: str) -> DataFrame:
    """Path, content, size in bytes and lines of one document of a scan."""
    inside("", rel_path)
    return docs.filter(F.col("rel_path") == rel_path).select("rel_path", F.col("text").alias("content"), F.octet_length("text").alias("size"), line_count(F.col("text")).alias("lines"))


def beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (doc_id, title, text), queries (query_id, text) and judgements (query_id, doc_id, grade) of a BEIR directory."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels")
    return (
        corpus.withColumnRenamed("_id", "doc_id"),
        queries.withColumnRenamed("_id", "query_id"),
        qrels.filter("score > 0").select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"), F.lit(2).alias("grade")),
    )
