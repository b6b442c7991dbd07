"""Incremental indexing as one job: diff a scan against the catalog, take out what went, read again only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import content_hash
from corpusloom.operators.outline import section_chunks
from corpusloom.runtime import cut, let_workers_import


def refresh(scanned: DataFrame, files: DataFrame, chunks: DataFrame, max_chars: int = 2000, overlap: int = 5) -> dict[str, DataFrame]:
    """'changes' (path, change), 'files' and 'chunks' after a refresh.

    scanned: (path, mtime, text), one row per path; files: (id, path, file_hash, mtime); chunks: (id, file_id, chunk_order, section_id, heading,
    level, start_line, end_line, content). Only files whose mtime moved are hashed; with an equal hash they are 'touched' and keep their
    chunks under the new mtime. New and changed files are cut into sections; deleted ones go with their chunks. Ids of files come from the path
    and those of chunks from path and order, so a repeated run gives the same rows. Repeated rows count once; a null path is left out, a null text has no chunk.
    """
    let_workers_import(scanned.sparkSession)
    s = scanned.where("path is not null").dropDuplicates(["path"]).select("path", F.col("mtime").alias("m1"), F.lit(True).alias("there"))
    f = files.where("path is not null").dropDuplicates(["path"]).select("path", "id", F.col("file_hash").alias("h0"), F.col("mtime").alias("m0"), F.lit(True).alias("known"))
    both = s.join(f, "path", "full_outer")
    still = F.col("there") & F.col("known") & F.col("m0").eqNullSafe(F.col("m1"))
    # paths and times are compared first; only texts of files whose time moved, or that are new, are read on, as hashes
    moved = both.where(F.col("there") & ~F.coalesce(still, F.lit(False))).select("path")
    hashes = scanned.join(moved, "path", "left_semi").select("path", content_hash(F.col("text")).alias("h1")).dropDuplicates(["path"])
    hashed = both.join(hashes, "path", "left")
    change = F.when(F.col("known").isNull(), "new").when(F.col("there").isNull(), "deleted").when(still, "unchanged").when(F.col("h0").eqNullSafe(F.col("h1")), "touched").otherwise("changed")
    state = cut(hashed.select("path", F.coalesce("id", F.xxhash64("path")).alias("id"), change.alias("change"), F.when(still, F.col("h0")).otherwise(F.col("h1")).alias("file_hash"), F.coalesce("m1", "m0").alias("mtime")))
    live = state.where("change <> 'deleted'").select("id", "path", "file_hash", "mtime")
    kept = chunks.dropDuplicates(["id"]).join(state.where("change in ('unchanged', 'touched')").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    columns = ["id", "file_id", "chunk_order", "section_id", "heading", "level", "start_line", "end_line", "content"]
    todo = scanned.select("path", "text").join(state.where("change in ('new', 'changed')").select("path", "id"), "path").select("id", "text")
    todo = todo.dropDuplicates(["id"])
    made = section_chunks(todo, max_chars, overlap).withColumnRenamed("id", "file_id").withColumn("id", F.xxhash64("file_id", "chunk_order"))
    return {"changes": state.select("path", "change"), "files": live, "chunks": kept.select(columns).unionByName(made.select(columns))}


def read_sections(docs: DataFrame, spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, name, start_line, end_line, text): of (id, text) the section that each (id, name) asks for.

    A name is a heading in any case, its slug, or its slug without a leading number ('3. Foo' is also 'foo'); the first section that fits counts.
    spans are (id, start_line, end_line, heading, section_id). A name that fits nothing gives no row.
    """
    plain = F.regexp_replace("section_id", "^[0-9]+-", "")
    names = spans.select("id", "start_line", "end_line", F.explode(F.array_distinct(F.array(F.lower(F.trim("heading")), "section_id", plain))).alias("key")).where("key <> ''")
    hit = wanted.distinct().withColumn("key", F.lower(F.trim("name"))).join(names, ["id", "key"]).groupBy("id", "name").agg(F.min(F.struct("start_line", "end_line")).alias("s"))
    text = F.array_join(F.slice(F.split("text", "\n"), F.col("s.start_line"), F.col("s.end_line") - F.col("s.start_line") + 1), "\n")
    return hit.join(docs.select("id", "text"), "id").select("id", "name", "s.start_line", "s.end_line", text.alias("text"))


def compare_runs(results: DataFrame, variants: list[str]) -> DataFrame:
    """(case_id, one column per variant, best): reciprocal rank of each case under each variant; a miss is 0, of equal ones the first named is best."""
    wide = results.groupBy("case_id").pivot("variant", variants).agg(F.max(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0))).na.fill(0.0, variants)
    best = F.array_max(F.array(*[F.struct(F.col(v).alias("v"), F.lit(-k).alias("k")) for k, v in enumerate(variants)]))["k"]
    return wide.withColumn("best", F.element_at(F.array(*[F.lit(v) for v in variants]), 1 - best))


def authority_batches(files: DataFrame, size: int) -> DataFrame:
    """files (folder, path, authority) with batch and place: each folder's files from the most telling to the least, `size` to a batch.

    Ties go by path. The order is kept by blocks: a folder's files are ranked within ranges of authority, whose counts are summed up before.
    """
    # a folder that holds a third of all files is ranked in buckets, so that no task sorts it alone
    bucket = F.floor(F.col("authority") * 4)
    f = files.withColumn("bucket", F.coalesce(bucket, F.lit(-(10**9))))
    counts = f.groupBy("folder", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("folder").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("folder", "bucket", "before")
    inner = F.row_number().over(Window.partitionBy("folder", "bucket").orderBy(F.desc_nulls_last("authority"), "path"))
    ranked = f.withColumn("place", inner).join(before, ["folder", "bucket"]).withColumn("place", F.col("place") + F.col("before"))
    return ranked.select(*files.columns, F.floor((F.col("place") - 1) / size).cast("int").alias("batch"), F.col("place").cast("int").alias("place"))
