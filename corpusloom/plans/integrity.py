"""Queries p2_... and p3_...: orphan references and hierarchies over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import hierarchy as H
from corpusloom.operators import references as R
from corpusloom.plans.links import RESOLVE_SQL
from corpusloom.runtime import table

REFERENCE_TABLES = ("collections", "files", "file_deletions", "chunks", "chunk_vectors", "links", "ref_results")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphans among the targets of links and ref_results, with the first reason that holds: level 0 of the cascade over these edges."""
    targets, _, _ = R.target_orphans({n: table(spark, folder, n) for n in REFERENCE_TABLES})
    return targets.where("reason is not null").select("ref_table", "ref_id", "reason").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans per table, month, edge and reason."""
    return R.orphan_report(R.orphan_cascade({n: table(spark, folder, n) for n in REFERENCE_TABLES}))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return H.chunk_edges(table(spark, folder, "chunks")).unionByName(H.folder_edges(table(spark, folder, "folders")))


def _split_key(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("node_table", F.substring_index(column, ":", 1)).withColumn("node_key", F.expr(f"substring({column}, length(node_table) + 2)"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and folders that are their own ancestor."""
    return _split_key(H.cycle_nodes(_edges(spark, folder)), "node").select("node_table", "node_key")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk and folder with parent, root, depth, tour interval, number of descendants and path."""
    chunks, folders = table(spark, folder, "chunks"), table(spark, folder, "folders")
    nodes = chunks.where("id is not null").select(F.concat(F.lit("chunks:"), F.col("id").cast("string")).alias("node")).unionByName(folders.where("path is not null").select(F.concat(F.lit("folders:"), "path").alias("node")))
    return _split_key(H.hierarchy(nodes, _edges(spark, folder)), "node").select("node_table", "node_key", "parent", "root", "depth", "entry", "exit", "n_descendants", "path", "in_cycle", "n_parents", "further_tops")


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy}
FOUND_SQL = f"""
WITH RECURSIVE c AS (SELECT DISTINCT id, parent_chunk_id AS p FROM chunks WHERE id IS NOT NULL),
d AS (SELECT collection_id, path, {RESOLVE_SQL("path")} AS spot, unnest(children) AS entry FROM folders),
f AS (SELECT collection_id, path, {RESOLVE_SQL("(CASE WHEN contains(replace(entry, chr(92), '/'), '/') THEN entry ELSE spot || '/' || entry END)")} AS target FROM d WHERE entry <> ''),
e AS (SELECT 'chunks' AS t, p::VARCHAR AS a, id::VARCHAR AS b FROM c WHERE p IN (SELECT id FROM c)
 UNION SELECT 'folders', f.path, g.path FROM f JOIN folders g ON g.collection_id = f.collection_id AND {RESOLVE_SQL("g.path")} = f.target),
r AS (SELECT t, a, b FROM e UNION SELECT r.t, r.a, e.b FROM r JOIN e ON e.t = r.t AND e.a = r.b)
SELECT DISTINCT t AS node_table, a AS node_key FROM r WHERE a = b
"""
SQL = {"p3_found": FOUND_SQL}
