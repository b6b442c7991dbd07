"""Files as last indexed, and links with their targets read as the index reads paths: what all link queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import resolve, slug
from corpusloom.runtime import table


def latest_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file id: its latest indexing pass."""
    f = table(spark, folder, "files")
    best = F.max_by(F.struct("path", "collection_id", "mtime", "last_indexed", "size_bytes", "chunk_count", "title"), F.struct("last_indexed", F.coalesce("mtime", F.lit(0)))).alias("f")
    return f.groupBy("id").agg(best).select(F.col("id").alias("file_id"), "f.*")


def resolved_links(spark: SparkSession, folder: str) -> DataFrame:
    """(id, link_type, source_path, source_section, target, section) of links with a target from files that are indexed.

    A target that is not absolute starts at the root of the referring file's collection; sections are slugs, '' where none is named.
    """
    links = table(spark, folder, "links").select("id", "link_type", F.col("source_file_id").alias("file_id"), F.coalesce("source_section_id", F.lit("")).alias("source_section"), "target_path", "target_section").where("target_path <> ''").distinct()
    roots = table(spark, folder, "collections").select(F.col("id").alias("collection_id"), F.col("path").alias("root"))
    rows = links.join(latest_files(spark, folder).select("file_id", F.col("path").alias("source_path"), "collection_id"), "file_id").join(roots, "collection_id", "left")
    absolute = F.translate("target_path", "\\", "/").startswith("/")
    target = resolve(F.when(absolute, F.col("target_path")).otherwise(F.concat(F.coalesce("root", F.lit("?")), F.lit("/"), F.col("target_path"))))
    return rows.select("id", "link_type", "source_path", "source_section", target.alias("target"), F.coalesce(slug(F.col("target_section")), F.lit("")).alias("section"))


SLUG_SQL = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-')"
RESOLVE_SQL = lambda x: f"('/' || array_to_string(list_reduce(list_transform(list_filter(string_split(replace({x}, chr(92), '/'), '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s]), lambda acc, s: CASE WHEN s[1] = '..' THEN list_slice(acc, 1, len(acc) - 1) ELSE list_concat(acc, s) END, []::VARCHAR[]), '/'))"
FILES_SQL = "files_l AS (SELECT id AS file_id, arg_max(struct_pack(p := path, m := mtime, c := collection_id), (last_indexed, coalesce(mtime, 0))) AS f FROM files GROUP BY id)"
# needs files_l
LINKS_SQL = f"""lk AS (SELECT l.id, link_type, f.p AS source_path, coalesce(source_section_id, '') AS source_section, coalesce({SLUG_SQL("target_section")}, '') AS section,
  CASE WHEN left(replace(target_path, chr(92), '/'), 1) = '/' THEN {RESOLVE_SQL("target_path")} ELSE {RESOLVE_SQL("(coalesce(c.path, '?') || '/' || target_path)")} END AS target
  FROM (SELECT DISTINCT id, link_type, source_file_id, source_section_id, target_path, target_section FROM links WHERE target_path <> '') l JOIN files_l ON file_id = source_file_id LEFT JOIN collections c ON c.id = f.c)"""
