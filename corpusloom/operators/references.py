"""References to records that do not exist: direct orphans and what inherits from them.

Every reference of the index is an edge of a foreign-key graph: file to collection, deletion to path and collection, chunk to file and parent
chunk, vector to chunk, link to source file and section, check result to source file, and the targets of links and results. Level 0
holds the rows whose own reference fails. The cascade then runs to a fixpoint by semi-joins: rows that refer to an orphan are
orphans themselves. The only recursive edge, chunk to parent chunk, is followed by doubling, so a chain of depth d takes log2(d) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import resolve, slug
from corpusloom.runtime import cut


def file_states(files: DataFrame, deletions: DataFrame) -> DataFrame:
    """Per path: when it was first and last indexed, and whether its latest deletion is later than that."""
    seen = files.groupBy(resolve(F.col("path")).alias("path")).agg(F.min("last_indexed").alias("first_indexed"), F.max("last_indexed").alias("last_indexed"))
    gone = deletions.groupBy(resolve(F.col("path")).alias("path")).agg(F.max("deleted_at").alias("deleted_at"))
    return seen.where("path is not null").join(gone, "path", "left").withColumn("is_deleted", F.coalesce(F.col("deleted_at") > F.col("last_indexed"), F.lit(False)))


def file_ids(files: DataFrame) -> DataFrame:
    """One row per file id: its path and collection as of its latest indexing pass."""
    latest = F.max_by(F.struct("path", "collection_id"), F.struct("last_indexed", "path")).alias("f")
    return files.where("id is not null").groupBy("id").agg(latest).select(F.col("id").alias("file_id"), resolve(F.col("f.path")).alias("path"), "f.collection_id")


def target_references(links: DataFrame, refs: DataFrame, ids: DataFrame, collections: DataFrame) -> DataFrame:
    """links and ref_results as (ref_table, ref_id, path, section, at); rows without a target are left out.

    The root for a relative target is the collection of the referring file; a ref_result whose source is
    not an indexed file takes the longest collection root above its source path.
    """
    roots = collections.select(F.col("id").alias("collection_id"), F.col("path").alias("root"))
    a = links.select(F.lit("links").alias("ref_table"), F.col("id").alias("ref_id"), F.col("source_file_id").alias("file_id"), "target_path", "target_section", F.col("indexed_at").alias("at")).distinct()
    a = a.join(ids.select("file_id", "collection_id"), "file_id", "left").join(roots, "collection_id", "left").drop("file_id", "collection_id")
    by_path = ids.groupBy("path").agg(F.max("collection_id").alias("collection_id"))
    b = refs.select(F.lit("ref_results").alias("ref_table"), F.col("id").alias("ref_id"), resolve(F.col("source_path")).alias("path"), "target_path", "target_section", F.col("checked_at").alias("at")).distinct()
    b = b.join(by_path, "path", "left").join(roots, "collection_id", "left")
    # a source that is not indexed: its ancestor folders are matched with the collection roots
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    strays = b.where("root is null and path is not null").select("path").distinct().withColumn("folder", F.explode(folders))
    strays = strays.join(roots.select(F.col("root").alias("folder")), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("above"))
    b = b.join(strays, "path", "left").withColumn("root", F.coalesce("root", "above")).drop("path", "collection_id", "above")
    absolute = F.translate("target_path", "\\", "/").startswith("/")
    out = a.unionByName(b).where("target_path is not null and target_path <> ''")
    out = out.withColumn("path", resolve(F.when(absolute, F.col("target_path")).otherwise(F.concat(F.coalesce("root", F.lit("?")), F.lit("/"), F.col("target_path")))))
    section = F.when(F.col("target_section") != "", slug(F.col("target_section")))
    return out.select("ref_table", "ref_id", "path", section.alias("section"), "at")


def judge_targets(refs: DataFrame, states: DataFrame, ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first reason that holds for each target: missing, deleted, section, late; null when it resolves.

    Targets are joined once per distinct (path, section), so a popular target is one row in both joins.
    """
    sections = chunks.select("file_id", F.col("section_id").alias("section")).where("section is not null").distinct().join(ids.select("file_id", "path"), "file_id").select("path", "section").distinct().withColumn("has_section", F.lit(True))
    wanted = refs.select("path", "section").distinct()
    judged = wanted.join(states.withColumn("indexed", F.lit(True)), "path", "left").join(sections, ["path", "section"], "left")
    judged = judged.select(
        F.col("path").alias("t_path"),
        F.col("section").alias("t_section"),
        F.when(F.col("indexed").isNull(), "missing").when(F.col("is_deleted"), "deleted").when(F.col("section").isNotNull() & F.col("has_section").isNull(), "section").alias("reason"),
        "first_indexed",
    )
    out = refs.join(judged, (F.col("path") == F.col("t_path")) & F.col("section").eqNullSafe(F.col("t_section")), "left")
    return out.withColumn("reason", F.coalesce("reason", F.when(F.col("first_indexed") > F.col("at"), "late"))).drop("t_path", "t_section", "first_indexed")


def cascade_chunks(parents: DataFrame, orphans: DataFrame) -> DataFrame:
    """Levels of the orphans (chunk_id, level) and of all chunks below them: (chunk_id, level), the least where there are several.

    parents: (chunk_id, parent_id), any number of parents a chunk. Round k joins pointers of length 2^k with what is reached so far; chunks
    reached are settled and their pointers leave. A round that reaches no new chunk proves that none is further away, cycles included.
    """
    reached = cut(orphans.groupBy("chunk_id").agg(F.min("level").alias("level")))
    unsettled = lambda df: df.join(reached.select("chunk_id"), "chunk_id", "left_anti")
    jump, step = cut(unsettled(parents.select("chunk_id", "parent_id").distinct())), 1
    while True:
        found = cut(jump.join(reached.select(F.col("chunk_id").alias("parent_id"), "level"), "parent_id").groupBy("chunk_id").agg((F.min("level") + step).alias("level")))
        if found.isEmpty():
            return reached
        reached = cut(reached.unionByName(found))
        # what was settled in this round still carries the pointers of those below it
        jump = cut(unsettled(jump).join(jump.select(F.col("chunk_id").alias("parent_id"), F.col("parent_id").alias("above")), "parent_id").select("chunk_id", F.col("above").alias("parent_id")).distinct())
        step *= 2


COLUMNS = ["ref_table", "ref_id", "edge", "kind", "reason", "level", "at"]


def _rows(df: DataFrame, table: str, key: str, edge: str, kind: str = "direct") -> DataFrame:
    """Report rows of (key, at) with reason for direct orphans and level for inherited ones."""
    reason = F.col("reason") if kind == "direct" else F.lit(None).cast("string")
    level = F.lit(0) if kind == "direct" else F.col("level").cast("int")
    return df.select(F.lit(table).alias("ref_table"), F.col(key).cast("string").alias("ref_id"), F.lit(edge).alias("edge"), F.lit(kind).alias("kind"), reason.alias("reason"), level.alias("level"), "at")


def target_orphans(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(judged targets, file states, file ids): level 0 of the cascade over the edge 'target', reason null where a target resolves."""
    states, ids = file_states(t["files"], t["file_deletions"]), file_ids(t["files"])
    return judge_targets(target_references(t["links"], t["ref_results"], ids, t["collections"]), states, ids, t["chunks"]), states, ids


def orphan_cascade(t: dict[str, DataFrame]) -> DataFrame:
    """All orphans: (ref_table, ref_id, edge, kind, reason, level, at).

    t: collections, files, file_deletions, chunks, chunk_vectors, links, ref_results. kind is 'direct' when the
    row's own reference over this edge fails, 'inherited' when the row referred to is an orphan; level
    counts the steps to the nearest direct orphan. A row can appear under several edges, once each. ref_id is the id as text, of a deletion
    its path. Null keys are no reference. Exact duplicate rows count once. Empty tables give no rows.
    """
    targets, states, ids = target_orphans(t)
    targets = cut(targets)
    homes = t["collections"].select(F.col("id").alias("collection_id"), F.lit(True).alias("home")).distinct()
    astray = ids.where("collection_id is not null").join(homes, "collection_id", "left_anti").select("file_id", "path", F.lit("missing").alias("reason"))
    known = cut(ids.join(states.select("path", "is_deleted", F.col("last_indexed").alias("at")), "path", "left").join(astray.select("file_id", F.lit(True).alias("astray")), "file_id", "left").select("file_id", "path", "at", F.when(F.col("is_deleted"), "deleted").alias("state"), F.coalesce("astray", F.lit(False)).alias("astray"), F.lit(True).alias("there")))
    gone = F.when(F.col("there").isNull(), "missing").otherwise(F.col("state"))
    out = _rows(known.where("astray").withColumn("reason", F.lit("missing")), "files", "file_id", "collection")

    deletions = t["file_deletions"].select("collection_id", "path", resolve(F.col("path")).alias("resolved"), F.col("deleted_at").alias("at")).distinct()
    never = deletions.where("path is not null").join(states.select(F.col("path").alias("resolved")), "resolved", "left_anti").withColumn("reason", F.lit("missing"))
    homeless = deletions.where("collection_id is not null").join(homes, "collection_id", "left_anti").withColumn("reason", F.lit("missing"))
    out = out.unionByName(_rows(never, "file_deletions", "path", "path")).unionByName(_rows(homeless, "file_deletions", "path", "collection"))

    chunks = t["chunks"].select(F.col("id").alias("chunk_id"), "file_id", F.col("section_id").alias("section"), F.col("parent_chunk_id").alias("parent_id"), F.col("created_at").alias("at")).distinct()
    filed = chunks.where("file_id is not null").join(known.drop("at", "path"), "file_id", "left").withColumn("reason", gone)
    present = chunks.select(F.col("chunk_id").alias("parent_id")).distinct()
    linked = chunks.where("parent_id is not null").select("chunk_id", "parent_id", "at")
    dangling = linked.join(present, "parent_id", "left_anti").withColumn("reason", F.lit("missing"))
    by_file, dangling = cut(filed.where("reason is not null or astray").select("chunk_id", "reason", "at")), cut(dangling)
    seeds = by_file.select("chunk_id", F.when(F.col("reason").isNotNull(), 0).otherwise(1).alias("level")).unionByName(dangling.select("chunk_id", F.lit(0).alias("level")))
    levels = cascade_chunks(linked.join(present, "parent_id", "left_semi"), seeds)
    times = chunks.groupBy("chunk_id").agg(F.min("at").alias("at"))
    below = linked.select("chunk_id", "parent_id").distinct().join(levels.select(F.col("chunk_id").alias("parent_id"), "level"), "parent_id").groupBy("chunk_id").agg((F.min("level") + 1).alias("level")).join(times, "chunk_id")
    out = out.unionByName(_rows(by_file.where("reason is not null").distinct(), "chunks", "chunk_id", "file")).unionByName(_rows(by_file.where("reason is null").withColumn("level", F.lit(1)).distinct(), "chunks", "chunk_id", "file", "inherited"))
    out = out.unionByName(_rows(dangling.select("chunk_id", "reason", "at").distinct(), "chunks", "chunk_id", "parent")).unionByName(_rows(below, "chunks", "chunk_id", "parent", "inherited"))

    vectors = t["chunk_vectors"].select("chunk_id").where("chunk_id is not null").distinct()
    lost = vectors.join(present.select(F.col("parent_id").alias("chunk_id")), "chunk_id", "left_anti").withColumn("reason", F.lit("missing")).withColumn("at", F.lit(None).cast("long"))
    heirs = vectors.join(levels, "chunk_id").join(times, "chunk_id").withColumn("level", F.col("level") + 1)
    out = out.unionByName(_rows(lost, "chunk_vectors", "chunk_id", "chunk")).unionByName(_rows(heirs, "chunk_vectors", "chunk_id", "chunk", "inherited"))

    # sections that stand in orphaned chunks only, per file: what links come from or point to
    held = chunks.where("section is not null and file_id is not null").select("chunk_id", "file_id", "section").distinct().join(levels, "chunk_id", "left").groupBy("file_id", "section").agg(F.count_if(F.col("level").isNull()).alias("alive"), F.min("level").alias("level"))
    fallen = cut(held.where("alive = 0").join(ids.select("file_id", "path"), "file_id", "left").select("file_id", "path", "section", "level"))
    links = t["links"].select(F.col("id").alias("ref_id"), F.col("source_file_id").alias("file_id"), F.col("source_section_id").alias("section"), F.col("indexed_at").alias("at")).where("file_id is not null").distinct()
    source = cut(links.join(known.drop("at", "path"), "file_id", "left").withColumn("reason", gone))
    out = out.unionByName(_rows(source.where("reason is not null"), "links", "ref_id", "source")).unionByName(_rows(source.where("reason is null and astray").withColumn("level", F.lit(1)), "links", "ref_id", "source", "inherited"))
    out = out.unionByName(_rows(links.join(fallen.select("file_id", "section", (F.col("level") + 1).alias("level")), ["file_id", "section"]), "links", "ref_id", "source_section", "inherited"))

    results = t["ref_results"].select(F.col("id").alias("ref_id"), resolve(F.col("source_path")).alias("path"), F.col("checked_at").alias("at")).where("path is not null").distinct()
    sources = results.join(states.select("path", F.when(F.col("is_deleted"), "deleted").alias("state"), F.lit(True).alias("there")), "path", "left").withColumn("reason", gone)
    out = out.unionByName(_rows(sources.where("reason is not null"), "ref_results", "ref_id", "source"))

    resolved = targets.where("reason is null and section is not null").join(fallen.groupBy("path", "section").agg(F.min("level").alias("level"), F.count("*").alias("fallen")), ["path", "section"])
    every = held.join(ids.select("file_id", "path"), "file_id").groupBy("path", "section").agg(F.count_if(F.col("alive") > 0).alias("standing"))
    heirs = resolved.join(every.where("standing = 0"), ["path", "section"]).withColumn("level", F.col("level") + 1)
    for name in ("links", "ref_results"):
        own = F.col("ref_table") == name
        out = out.unionByName(_rows(targets.where(own & F.col("reason").isNotNull()), name, "ref_id", "target")).unionByName(_rows(heirs.where(own), name, "ref_id", "target", "inherited"))
    return out.select(COLUMNS)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of reference, edge, kind and reason. Rows without a time fall under 'undated'."""
    month = F.coalesce(F.date_format(F.timestamp_seconds("at"), "yyyy-MM"), F.lit("undated"))
    return orphans.groupBy("ref_table", month.alias("period"), "edge", "kind", F.coalesce("reason", F.lit("inherited")).alias("reason")).agg(F.count("*").alias("n_rows"), F.max("level").alias("deepest"))
