"""Keeping the index up to date, finding files that references name, and small reports on documents and folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.paths import extension, parent_of
from corpusloom.operators import documents as D
from corpusloom.plans.corpus import _HEADS, _docs
from corpusloom.plans.links import FILES_SQL, RESOLVE_SQL, latest_files
from corpusloom.plans.search import _TOKENS, TERMS
from corpusloom.runtime import shared_folder, table
from corpusloom.sources import index


def maintained_index(spark: SparkSession, folder: str) -> DataFrame:
    """Term figures of an index built from the older chunks, after the newer ones were upserted and those of deleted files taken out in one batch."""
    chunks = table(spark, folder, "chunks").select("id", "file_id", "created_at", F.col("content").alias("text"))
    middle = chunks.agg(F.avg("created_at")).first()[0] or 0
    seen = table(spark, folder, "files").groupBy("path").agg(F.max("last_indexed").alias("seen"))
    gone = table(spark, folder, "file_deletions").groupBy("path").agg(F.max("deleted_at").alias("gone")).join(seen, "path").where("gone > seen").select("path")
    dead = latest_files(spark, folder).join(gone, "path", "left_semi").select("file_id")
    place = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    newer = F.coalesce(F.col("created_at") > middle, F.lit(False))
    index.build(chunks.where(~newer).select("id", "text"), place)
    deleted = chunks.join(dead, "file_id", "left_semi").select("id").distinct()
    index.apply(spark, place, chunks.where(newer).join(dead, "file_id", "left_anti").select("id", "text"), deleted)
    return index.rows(spark, place).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


INDEX_SQL = f"""
WITH {FILES_SQL}, seen AS (SELECT path, max(last_indexed) AS s FROM files GROUP BY path), gone AS (SELECT path FROM file_deletions JOIN seen USING (path) GROUP BY path HAVING max(deleted_at) > any_value(s)),
dead AS (SELECT file_id FROM files_l WHERE f.p IN (SELECT path FROM gone)),
toks AS (SELECT id, unnest({_TOKENS}) AS term FROM (SELECT DISTINCT id, file_id, content AS text FROM chunks) WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM dead))
SELECT term, count(DISTINCT id) AS df, count(*)::BIGINT AS cf FROM toks GROUP BY term
"""


def located_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Where the targets of document links in check results exist: beside the referring file, or below the first collection that has them."""
    refs = table(spark, folder, "ref_results").where("kind = 'doc_link' and target_path <> '' and source_path is not null").select("id", "source_path", F.translate("target_path", "\\", "/").alias("path"))
    roots = table(spark, folder, "collections").select(F.col("path").alias("root"))
    return D.located(refs, roots, table(spark, folder, "files").select("path"))


LOCATED_SQL = f"""
WITH r AS (SELECT DISTINCT id, source_path, replace(target_path, chr(92), '/') AS path FROM ref_results WHERE kind = 'doc_link' AND target_path <> '' AND source_path IS NOT NULL),
c AS (SELECT *, {RESOLVE_SQL("(CASE WHEN path LIKE '/%' THEN path ELSE regexp_replace(source_path, '/[^/]*$', '') || '/' || path END)")} AS spot, '' AS place FROM r
 UNION ALL SELECT r.id, source_path, r.path, {RESOLVE_SQL("(k.path || '/' || r.path)")}, k.path FROM r, collections k WHERE r.path NOT LIKE '/%'),
b AS (SELECT id, source_path, path, arg_min(spot, place) AS resolved FROM c WHERE spot IN (SELECT path FROM files) GROUP BY id, source_path, path)
SELECT r.*, resolved FROM r LEFT JOIN b USING (id, source_path, path)
"""


def text_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document cut at a sentence and as a window around the first term that is searched for."""
    d = _docs(spark, folder).where("text is not null")
    return d.select("id", T.truncate_at_sentence(F.col("text"), 200).alias("summary"), T.highlight_preview(F.col("text"), TERMS, 160).alias("window"))


_HEAD = "substr(text, 1, 200)"
CUTS_SQL = f"""
WITH d AS (SELECT doc_id AS id, text, regexp_extract({_HEAD}, '^((?s:.*)[.!?])(\\s|$)', 1) AS whole, list_min(list_filter([{", ".join(f"instr(lower(text), '{t}')" for t in TERMS)}], lambda p: p > 0)) AS p FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, greatest(coalesce(p, 1) - 40, 1) AS b FROM d)
SELECT id, CASE WHEN length(text) <= 200 THEN text WHEN whole <> '' THEN whole ELSE CASE WHEN regexp_matches({_HEAD}, '\\s') THEN rtrim(regexp_replace({_HEAD}, '\\s\\S*\\z', ''), ' ') ELSE substr(text, 1, 199) END || '…' END AS summary,
 CASE WHEN b > 1 THEN '...' ELSE '' END || substr(text, b, 160) || CASE WHEN b + 159 < length(text) THEN '...' ELSE '' END AS window FROM w
"""

# fixed values: files and bytes of a folder from which it is worked on in parts, and beyond which it is not worked on at all
PARTITION_FROM, CEILING = (20, 200 * 1024), (25, 250 * 1024)


def folder_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Files and bytes of every folder, how many are of a textual kind, and whether it has to be worked on in parts or is too large."""
    f = latest_files(spark, folder).where("path is not null").select(parent_of(F.col("path")).alias("folder"), F.coalesce("size_bytes", F.lit(0)).alias("size"), T.kind_of(extension(F.col("path"))).alias("kind"))
    loads = f.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.count_if(F.col("kind").isin("markdown", "text")).alias("n_text"))
    over = lambda limit: (F.col("n_files") > limit[0]) | (F.col("n_bytes") > limit[1])
    return loads.withColumns({"needs_parts": over(PARTITION_FROM), "too_large": over(CEILING)})


LOADS_SQL = f"""
WITH f AS (SELECT id, arg_max(struct_pack(p := path, s := size_bytes), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id),
g AS (SELECT regexp_replace(x.p, '/[^/]*$', '') AS folder, count(*) AS n_files, sum(coalesce(x.s, 0))::BIGINT AS n_bytes, count(*) FILTER (lower(regexp_extract(x.p, '(\\.[^./]*)$', 1)) IN ('.md', '.mdx', '.markdown', '.qmd', '.txt', '.log')) AS n_text FROM f WHERE x.p IS NOT NULL GROUP BY 1)
SELECT *, n_files > {PARTITION_FROM[0]} OR n_bytes > {PARTITION_FROM[1]} AS needs_parts, n_files > {CEILING[0]} OR n_bytes > {CEILING[1]} AS too_large FROM g
"""


def section_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document the first three headings that differ from its title, as one line, and the first six as a list."""
    heads = D.headings(_docs(spark, folder)).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "heading"))), lambda h: h["heading"]).alias("heads"))
    titles = _docs(spark, folder).where("text is not null").select("id", D.title(F.col("text")).alias("title"))
    other = F.filter("heads", lambda h: (h != "") & (F.lower(h) != F.lower("title")))
    return heads.join(titles, "id").select("id", F.array_join(F.slice(other, 1, 3), ", ").alias("topics"), F.slice(other, 1, 6).alias("topic_list"))


TOPICS_SQL = f"""
WITH {_HEADS}, t AS (SELECT doc_id AS id, coalesce(nullif(regexp_replace(trim(regexp_extract(coalesce(nullif(regexp_extract(text, '^-{{3,}}[ \\t]*\\n((?s:.*?))\\n-{{3,}}[ \\t]*(?:\\n|$)', 1), ''), ''), '(?m)^(?:title|name):[ \\t]*(.*)$', 1), ' '), '^["'']|["'']$', '', 'g'), ''), trim(regexp_extract(text, '(?m)^##?[ \\t]+(.*)$', 1), ' '), '') AS title FROM documents WHERE text IS NOT NULL),
o AS (SELECT h.id, list(heading ORDER BY line_no) FILTER (heading <> '' AND lower(heading) <> lower(title)) AS hs FROM h JOIN t USING (id) GROUP BY h.id)
SELECT id, array_to_string(list_slice(coalesce(hs, []), 1, 3), ', ') AS topics, list_slice(coalesce(hs, []), 1, 6) AS topic_list FROM o
"""


def use_when_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each folder names at least one occasion, how many differ, and whether its children are listed without repeats."""
    f = table(spark, folder, "folders").select("collection_id", "path", "use_when", "children").distinct()
    cues = F.filter(F.transform(F.coalesce("use_when", F.array()), lambda x: F.btrim(x)), lambda x: x != "")
    once = F.coalesce(F.array_sort("children") == F.array_sort(F.array_distinct("children")), F.lit(True))
    return f.select("collection_id", "path", (F.size(cues) > 0).alias("is_valid"), F.size(F.array_distinct(cues)).alias("n_cues"), once.alias("children_once"))


CUES_SQL = """
WITH f AS (SELECT DISTINCT collection_id, path, list_filter(list_transform(coalesce(use_when, []), lambda x: trim(x, ' ')), lambda x: x <> '') AS c, children FROM folders)
SELECT collection_id, path, len(c) > 0 AS is_valid, len(list_distinct(c))::INTEGER AS n_cues, coalesce(len(children) = len(list_distinct(children)) + CASE WHEN len(list_filter(children, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END, true) AS children_once FROM f
"""

QUERIES = {"maintained_index": maintained_index, "located_refs": located_refs, "text_cuts": text_cuts, "folder_loads": folder_loads, "section_topics": section_topics, "use_when_checks": use_when_checks}
SQL = {"maintained_index": INDEX_SQL, "located_refs": LOCATED_SQL, "text_cuts": CUTS_SQL, "folder_loads": LOADS_SQL, "section_topics": TOPICS_SQL, "use_when_checks": CUES_SQL}
