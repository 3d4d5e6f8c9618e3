"""Merkle manifest of a dataset: a tree of arity 3 over each source's rows, and one over the sources.

A leaf is the sha256 of a row's fields; leaves of a source ascend by doc_id, and every 3 consecutive
nodes become the sha256 of their digests (hex text, concatenated) until one is left. Subtrees of
``BUCKET`` = 3**LEVELS consecutive leaves are whole below their root, so leaves are dealt to tasks by
(source, place // BUCKET); in each task DuckDB runs the level queries, an ordered string_agg and a
sha256, over Arrow tables of some whole buckets. The buckets' roots are the leaves of the next round,
which is the same job on a 729th of the rows, until each source has one node; the sources' nodes are
one more tree. Proofs come down the same way: Spark joins the path above a bucket to the bucket, and
DuckDB appends the levels within, folds and hashes. A path is a list with one text a level, the
siblings to the left and to the right with a comma between.

Places come from a range partitioning by (source, doc_id): rows are numbered within each partition,
and each partition's first place is a running sum over partitions. Only digests are shuffled, never
texts, and no task holds more than a partition or ``BLOCK`` rows, however large a source is.

Defined results: a null doc_id stands first in its source and is not tampered with; rows of equal
doc_id stand in order of their leaves, and repeated rows are leaves of their own; null sources are one
source, before all others; null and empty fields differ ("-" and "0:"); texts are hashed whole. A
source of one row has its leaf as root, and one source alone gives its root as the dataset's. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage_table

ARITY, LEVELS = 3, 6
BUCKET = ARITY**LEVELS
#: Rows that DuckDB takes at a time: whole buckets, about so many rows.
BLOCK = 20_000
#: Runs of a source within a partition, and paths above buckets, up to which they are broadcast.
MAX_RUNS, MAX_PATHS = 200_000, 20_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "tree string, pos long, h string, n long"
_PATHS = "tree string, pos long, path array<string>"
_PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


class Tree(NamedTuple):
    """Nodes (tree, pos, h, n: nodes of the tree) of each round, and (tree, h) of the roots."""

    rounds: list[DataFrame]
    roots: DataFrame


def field(value: Column) -> Column:
    """`-` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source; sorts as the contract orders sources), h, told (the leaf as tampered with), row."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    told = F.when(tampered, leaf_hash(F.replace("text", F.lit("\n"), F.lit(""))))
    own = docs.select(*FIELDS)
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_hash(F.col("text")).alias("h"), told.alias("told"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (tree, ...) with pos, their place in their tree by ``order`` (which leaves no ties), and n, the tree's size."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = stage_table(ordered.withColumns({"pid": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ordered")
    runs = ordered.groupBy("tree", "pid").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("pid")) - F.col("rows")
    runs = stage_table(runs.select("tree", "pid", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")), "runs")
    return ordered.join(maybe_broadcast(runs, MAX_RUNS), ["tree", "pid"]).withColumn("pos", F.col("at") + F.col("shift")).drop("pid", "at", "shift", *[c for c in ("row",) if c in order])


def _level_queries() -> str:
    """l0 .. lK: the nodes of each level of the buckets in ``nodes``."""
    made = [f"l0 AS (SELECT tree, bucket, pos % {BUCKET} AS i, h, levels FROM nodes)"]
    for k in range(LEVELS):
        up = f"CASE WHEN levels > {k} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END"
        made.append(f"l{k + 1} AS MATERIALIZED (SELECT tree, bucket, i // {ARITY} AS i, {up} AS h, levels FROM l{k} GROUP BY tree, bucket, i // {ARITY}, levels)")
    return ",\n".join(made)


_UP = f"""WITH {_level_queries()}
SELECT l.tree, l.bucket AS pos, l.h, (n.n + {BUCKET - 1}) // {BUCKET} AS n
FROM l{LEVELS} l JOIN nodes n ON l.tree = n.tree AND l.bucket = n.bucket AND n.pos % {BUCKET} = 0"""


def _path_queries() -> str:
    """paths: every node's siblings, level by level, then those above its bucket."""
    runs = [f"r{k} AS (SELECT tree, bucket, i // {ARITY} AS run, string_agg(h, '' ORDER BY i) AS s FROM l{k} WHERE levels > {k} GROUP BY tree, bucket, i // {ARITY})" for k in range(LEVELS)]
    at = lambda k: f"(n.pos % {BUCKET} // {ARITY**k} % {ARITY})"
    step = lambda k: f"CASE WHEN n.levels > {k} THEN concat(r{k}.s[1 : 64 * {at(k)}], ',', r{k}.s[64 * {at(k)} + 65 :]) END"
    joins = "\n".join(f"LEFT JOIN r{k} ON n.tree = r{k}.tree AND n.bucket = r{k}.bucket AND n.pos % {BUCKET} // {ARITY ** (k + 1)} = r{k}.run" for k in range(LEVELS))
    inner = f"list_filter([{', '.join(step(k) for k in range(LEVELS))}], lambda x: x IS NOT NULL)"
    above = f"above AS (SELECT tree, bucket, path, subroot FROM nodes WHERE pos % {BUCKET} = 0)"
    return ",\n".join([*runs, above, f"paths AS (SELECT n.* EXCLUDE (path, subroot), a.subroot, list_concat({inner}, a.path) AS path FROM nodes n JOIN above a ON n.tree = a.tree AND n.bucket = a.bucket\n{joins})"])


_DOWN = f"WITH {_level_queries()},\n{_path_queries()}\nSELECT tree, pos, path FROM paths"
_PROVE = f"""WITH {_level_queries()},\n{_path_queries()}
SELECT doc_id, h AS leaf, subroot, sha256(replace(array_to_string(path, ''), ',', '')) AS proof_sha256,
       list_reduce(path, lambda node, x: sha256(concat(split_part(x, ',', 1), node, split_part(x, ',', 2))), coalesce(told, h)) AS folded_root
FROM paths"""


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``BLOCK`` rows that end where a bucket ends; batches are in order of (tree, bucket)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            last, end = table.slice(size - 1).select(["tree", "bucket"]).to_pylist()[0], size
            while end and table["bucket"][end - 1].as_py() == last["bucket"] and table["tree"][end - 1].as_py() == last["tree"]:
                end -= 1
            if end:
                yield table.slice(0, end)
            held, size = table.slice(end).to_batches(), size - end
    if size:
        yield pa.Table.from_batches(held)


def _level_job(nodes: DataFrame, query: str, schema: str) -> DataFrame:
    """``query`` over all buckets of ``nodes`` (tree, bucket, pos, ...), each whole in one task."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
            for table in _whole_buckets(batches):
                con.register("nodes", table)
                yield from con.sql(query).to_arrow_table().cast(wanted).to_batches()
                con.unregister("nodes")

    dealt = nodes.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "pos")
    return dealt.mapInArrow(run, schema)


def _bucketed(nodes: DataFrame) -> DataFrame:
    """With bucket, and levels: how many levels the bucket has below its root."""
    levels = sum((F.col("n") > ARITY**k).cast("int") for k in range(LEVELS))
    return nodes.withColumns({"bucket": F.floor(F.col("pos") / F.lit(BUCKET)), "levels": levels})


def grow(nodes: DataFrame) -> Tree:
    """All rounds of bucket roots above ``nodes`` (tree, pos, h, n), a stage table."""
    rounds, top = [nodes], nodes
    while True:
        top = stage_table(_level_job(_bucketed(top).select("tree", "bucket", "pos", "h", "n", "levels"), _UP, _NODES), "roots")
        if top.where("n > 1").isEmpty():
            return Tree(rounds, top.select("tree", "h"))
        rounds.append(top)


def _with_paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes by bucket; the first of each bucket carries what stands above it (tree, bucket, path, subroot)."""
    joined = _bucketed(nodes).join(maybe_broadcast(above, MAX_PATHS), ["tree", "bucket"])
    first = F.col("pos") % BUCKET == 0
    return joined.withColumns({c: F.when(first, F.col(c)) for c in ("path", "subroot")})


def paths_down(tree: Tree, above: DataFrame) -> DataFrame:
    """(tree, bucket, path, subroot) above each bucket of the first round, from (tree, path, subroot) above each tree."""
    subroots = above.select("tree", "subroot")
    above = above.select("tree", F.lit(0).cast("long").alias("bucket"), "path", "subroot")
    for nodes in tree.rounds[:0:-1]:
        made = _level_job(_with_paths(nodes.select("tree", "pos", "h", "n"), above), _DOWN, _PATHS)
        above = stage_table(made.withColumnRenamed("pos", "bucket").join(maybe_broadcast(subroots, MAX_RUNS), "tree"), "paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``."""
    found = stage_table(leaves(docs), "leaves")
    rows = stage_table(placed(found, "doc_id", "h", "row"), "placed")
    forest = grow(rows.select("tree", "pos", "h", "n"))
    sources = forest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "h")
    sources = stage_table(placed(sources, "source"), "sources")
    crown = grow(sources.select("tree", "pos", "h", "n"))
    top = crown.roots.head()  # one row, none where there are no documents
    root = F.lit(top["h"] if top else None).cast("string")

    nothing = F.array().cast("array<string>")
    over = paths_down(crown, crown.roots.select("tree", nothing.alias("path"), F.lit("").alias("subroot")))
    paths = _level_job(_with_paths(sources.select("tree", "pos", "h", "n"), over), _DOWN, _PATHS)
    own = sources.select("pos", F.col("source").alias("of"), F.col("h").alias("subroot"))
    above = stage_table(paths.select("pos", "path").join(own, "pos").select(F.col("of").alias("tree"), "path", "subroot"), "paths")
    proofs = _level_job(_with_paths(rows, paths_down(forest, above)), _PROVE, _PROOFS)
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
