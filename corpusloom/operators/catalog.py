"""The index as tables: collections, membership, roll-ups, snapshot maintenance, metrics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import cut


def membership(files: DataFrame, collections: DataFrame) -> DataFrame:
    """(path, collection_id, is_primary): the collections whose root lies above a path; the deepest root is primary.

    A path's ancestors are compared by equality with the roots, so this is an ordinary join.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = files.select("path").where("path is not null").distinct().withColumn("root", F.explode(folders))
    roots = collections.select(F.col("id").alias("collection_id"), F.col("path").alias("root"), "name")
    order = Window.partitionBy("path").orderBy(F.desc(F.length("root")), "name", "collection_id")
    return up.join(roots, "root").withColumn("is_primary", F.row_number().over(order) == 1).select("path", "collection_id", "is_primary")


def section_rollup(chunks: DataFrame) -> DataFrame:
    """Sections of files: characters, first line and order, heading, parent section and number of different subsections.

    Parts of a section ('id::2') count as one. Heading and parent are the first that are given, in chunk order.
    """
    c = chunks.where("id is not null and file_id is not null").withColumn("section", F.substring_index(F.coalesce("section_id", F.lit("")), "::", 1))
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.struct("chunk_order", "id")))
    named = F.coalesce("heading", F.lit("")) != ""
    own = c.groupBy("file_id", "section").agg(F.sum("char_count").alias("char_count"), F.min("start_line").alias("start_line"), F.min("chunk_order").alias("first_order"), F.coalesce(first(F.col("heading"), named), F.lit("")).alias("heading"), F.count("*").alias("n_chunks"))
    up = c.select("id", F.col("file_id").alias("p_file"), F.col("section").alias("p_section"))
    links = c.where("parent_chunk_id is not null").select("file_id", "section", "chunk_order", "id", "parent_chunk_id").join(up.withColumnRenamed("id", "parent_chunk_id"), "parent_chunk_id").where("not (file_id = p_file and section = p_section)")
    parents = links.groupBy("file_id", "section").agg(F.min_by("p_section", F.struct("chunk_order", "id")).alias("parent_section"))
    kids = links.groupBy(F.col("p_file").alias("file_id"), F.col("p_section").alias("section")).agg(F.count_distinct("file_id", "section").alias("n_subsections"))
    return own.join(parents, ["file_id", "section"], "left").join(kids, ["file_id", "section"], "left").withColumns({"parent_section": F.coalesce("parent_section", F.lit("")), "n_subsections": F.coalesce("n_subsections", F.lit(0))})


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two snapshots (path, file_hash, mtime): new, deleted, changed, touched or unchanged.

    A file is read again only if its mtime moved, so equal mtimes mean unchanged; with a new mtime an equal hash means touched.
    """
    o, n = old.select("path", F.col("file_hash").alias("h0"), F.col("mtime").alias("m0"), F.lit(True).alias("in_old")), new.select("path", F.col("file_hash").alias("h1"), F.col("mtime").alias("m1"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "deleted").when(F.col("m0").eqNullSafe(F.col("m1")), "unchanged").when(F.col("h0").eqNullSafe(F.col("h1")), "touched").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def freshness(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, decision) of two sets of signatures (id, content, head, tail, words): new, deleted, noop, regenerate, update_mechanical."""
    o, n = (d.select("id", F.struct("content", "head", "tail", "words").alias(k)) for d, k in ((old, "o"), (new, "n")))
    w0, w1 = F.col("o.words"), F.col("n.words")
    drift = F.when(F.greatest(w0, w1) == 0, w0 != w1).otherwise(F.abs(w0 - w1) / F.greatest(w0, w1) >= 0.10)
    decision = (
        F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("o.content") == F.col("n.content"), "noop")
        .when((F.col("o.head") != F.col("n.head")) | (F.col("o.tail") != F.col("n.tail")) | drift, "regenerate").otherwise("update_mechanical")
    )
    return o.join(n, "id", "full_outer").select("id", decision.alias("decision"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of `changes` in place of those with the same keys."""
    return base.join(changes.select(keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def cascade_delete(t: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """files, chunks, chunk_vectors and links without the given files (id) and what hangs on them."""
    gone = files.select("id").distinct()
    out = {"files": t["files"].join(gone, "id", "left_anti")}
    dead = t["chunks"].join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select(F.col("id").alias("chunk_id")).distinct()
    out["chunks"] = t["chunks"].join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_anti")
    out["chunk_vectors"] = t["chunk_vectors"].join(dead, "chunk_id", "left_anti")
    out["links"] = t["links"].join(gone.withColumnRenamed("id", "source_file_id"), "source_file_id", "left_anti")
    return out


def latency_metrics(rows: DataFrame, group: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per group: n, mean, linear percentiles (p50, p95) and the nearest values below them (low50, low95). Null values are left out.

    Equal values are counted first and dealt over tasks by range, so no task sees a whole group: the counts of the ranges before it tell
    the rank a value begins at.
    """
    v = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = cut(v.repartitionByRange(*group, "v").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "part").agg(F.sum("c").alias("n"))
    ahead = sizes.select(*group, "part", (F.sum("n").over(Window.partitionBy(*group).orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.sum("c").over(Window.partitionBy(*group, "part").orderBy("v"))
    placed = ranged.withColumn("upto", inside).join(ahead, [*group, "part"]).select(*group, "v", (F.col("ahead") + F.col("upto") - F.col("c")).alias("first"), (F.col("ahead") + F.col("upto") - 1).alias("last"))
    totals = ranged.groupBy(*group).agg(F.sum("c").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"))
    out = placed.join(totals, group)
    at = {p: (F.col("n") - 1) * p for p in points}
    value_at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))
    low, high = {p: value_at(F.floor(at[p])) for p in points}, {p: value_at(F.ceil(at[p])) for p in points}
    name = {p: f"{round(p * 100)}" for p in points}
    linear = [F.round(low[p] + (high[p] - low[p]) * F.max(at[p] - F.floor(at[p])), 6).alias(f"p{name[p]}") for p in points]
    return out.groupBy(*group, "n", "mean").agg(*linear, *[low[p].alias(f"low{name[p]}") for p in points])


def extension_counts(paths: DataFrame) -> DataFrame:
    """Files per lower-case extension; names without one are left out."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return paths.select("path").distinct().select(ext.alias("ext")).where("ext <> ''").groupBy("ext").agg(F.count("*").alias("n"))


def week_of(epoch: Column) -> Column:
    """Monday of the week of a time in seconds, as yyyy-MM-dd."""
    return F.date_format(F.date_trunc("week", F.timestamp_seconds(epoch)), "yyyy-MM-dd")


def churn(decisions: DataFrame, by: str) -> DataFrame:
    """Per group the share of changed entries, and whether 20 % or more of them changed."""
    moved = F.col("decision").isin("new", "deleted", "regenerate").cast("double")
    return decisions.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(moved), 6).alias("churn"), (F.avg(moved) >= 0.2).alias("is_stale"))


def renamed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_path, file_hash): new paths whose content a deleted path had; of several deleted ones the first by name.

    Old paths are reduced to one per hash before the join, so a hash that a third of the files share stays one row. Null hashes match nothing.
    """
    gone = old.join(new.select("path").distinct(), "path", "left_anti").where("file_hash is not null").groupBy("file_hash").agg(F.min("path").alias("old_path"))
    fresh = new.join(old.select("path").distinct(), "path", "left_anti").select("path", "file_hash").distinct()
    return fresh.join(gone, "file_hash").select("path", "old_path", "file_hash")


def without_collection(members: DataFrame, collections: DataFrame, removed: int) -> DataFrame:
    """(path, primary_id, is_orphan) for paths of a removed collection: who is primary now; orphans have no collection left.

    `members` are (path, collection_id, is_primary). The primary stays unless it is the removed one; then the deepest root takes over.
    """
    hit = members.where(F.col("collection_id") == removed).select("path").distinct()
    roots = collections.select(F.col("id").alias("collection_id"), F.length("path").alias("depth"), "name")
    rest = members.where(F.col("collection_id") != removed).join(hit, "path", "left_semi").join(roots, "collection_id")
    best = rest.groupBy("path").agg(F.min_by("collection_id", F.struct((~F.col("is_primary")).alias("a"), (-F.col("depth")).alias("b"), "name", "collection_id")).alias("primary_id"))
    return hit.join(best, "path", "left").select("path", "primary_id", F.col("primary_id").isNull().alias("is_orphan"))
