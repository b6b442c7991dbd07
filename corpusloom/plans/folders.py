"""Queries over folder rows and the files below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import parent_of
from corpusloom.operators import catalog as C
from corpusloom.operators import folders as O
from corpusloom.plans.corpus import _RESOLVE_LIST
from corpusloom.plans.search import distinct_chunks, latest_files
from corpusloom.runtime import table


def folder_defects(spark: SparkSession, folder: str) -> DataFrame:
    return O.defects(table(spark, folder, "folders"))


DEFECT_SQL = f"""
WITH r AS (SELECT DISTINCT * FROM folders),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r h WHERE h.ignored AND h.collection_id = r.collection_id AND (h.path = r.path OR starts_with(r.path, h.path || '/')))),
e AS (SELECT collection_id, path, unnest(children) AS entry FROM f),
l AS (SELECT collection_id, path, substr({_RESOLVE_LIST("CASE WHEN contains(entry, '/') THEN entry ELSE path || '/' || entry END")}, 2) AS child, count(*) AS times FROM e WHERE entry IS NOT NULL GROUP BY ALL),
x AS (SELECT collection_id, path, 'missing_index' AS kind, '' AS detail FROM f WHERE NOT coalesce(has_index, false) AND file_count > 0
 UNION ALL SELECT collection_id, path, 'parse_error', parse_error FROM f WHERE parse_error IS NOT NULL
 UNION ALL SELECT collection_id, path, 'missing_purpose', '' FROM f WHERE coalesce(has_index, false) AND parse_error IS NULL AND trim(coalesce(purpose, ''), ' ') = ''
 UNION ALL SELECT collection_id, path, 'wrong_depth', depth::VARCHAR FROM f WHERE len(string_split(path, '/')) <> depth
 UNION ALL SELECT collection_id, path, 'orphaned', child FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.collection_id = l.collection_id AND r.path = child)
 UNION ALL SELECT collection_id, path, 'repeated', child FROM l WHERE times > 1
 UNION ALL SELECT c.collection_id, p.path, 'unlisted', c.path FROM (SELECT DISTINCT collection_id, path FROM f) c JOIN (SELECT DISTINCT collection_id, path FROM f WHERE children IS NOT NULL) p ON p.collection_id = c.collection_id AND contains(c.path, '/') AND p.path = regexp_replace(c.path, '/[^/]*$', '')
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.collection_id = c.collection_id AND l.path = p.path AND l.child = c.path))
SELECT * FROM x
"""


def defect_counts(spark: SparkSession, folder: str) -> DataFrame:
    return folder_defects(spark, folder).groupBy("collection_id", "kind").agg(F.count("*").alias("n"))


COUNT_SQL = DEFECT_SQL.replace("SELECT * FROM x\n", "SELECT collection_id, kind, count(*) AS n FROM x GROUP BY ALL\n")


def collection_digests(spark: SparkSession, folder: str) -> DataFrame:
    return O.digests(table(spark, folder, "folders"))


DIGEST_SQL = """
WITH s AS (SELECT DISTINCT collection_id, path, trim(regexp_extract(replace(trim(purpose, ' '), chr(10), ' '), '^([^.!?]*[.!?]?)', 1), ' ') AS s FROM folders),
b AS (SELECT *, coalesce(sum(strlen(s) + 1) OVER (PARTITION BY collection_id ORDER BY path, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS before FROM s WHERE s <> ''),
t AS (SELECT collection_id, string_agg(s, ' ' ORDER BY path, s) AS t FROM b WHERE before < 500 GROUP BY collection_id)
SELECT collection_id, CASE WHEN length(t) > 500 THEN trim(substr(t, 1, 500), ' ') || '...' ELSE t END AS digest FROM t
"""


def folder_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return O.markdown(table(spark, folder, "folders"))


_LIST = lambda c: f"list_sort(list_distinct(list_filter({c}, lambda x: x IS NOT NULL AND trim(x, ' ') <> '')))"
_BULLETS = lambda name, c: f"CASE WHEN len({_LIST(c)}) > 0 THEN '{name}:' || chr(10) || array_to_string(list_transform({_LIST(c)}, lambda x: '- ' || x), chr(10)) END"
MARKDOWN_SQL = f"""
SELECT collection_id, path, concat_ws(chr(10) || chr(10), repeat('#', least(len(string_split(path, '/')), 6)) || ' ' || path, nullif(trim(purpose, ' '), ''), coalesce(file_count, 0) || ' files, ' || coalesce(word_count, 0) || ' words', {_BULLETS("Use when", "use_when")}, {_BULLETS("Folders", "children")}) AS block FROM (SELECT DISTINCT * FROM folders)
"""


def ungrounded_purposes(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the purpose of a folder that neither the files right below it nor its path mention."""
    roots = table(spark, folder, "collections").select(F.col("id").alias("collection_id"), F.col("path").alias("root"))
    purposes = table(spark, folder, "folders").join(roots, "collection_id").select(F.concat("root", F.lit("/"), "path").alias("folder"), "purpose")
    files = latest_files(spark, folder).select("file_id", "path", parent_of(F.col("path")).alias("folder"), F.coalesce("title", F.lit("")).alias("title"))
    bodies = distinct_chunks(spark, folder).select("file_id", F.col("content").alias("text")).join(files.select("file_id", "folder"), "file_id").select("folder", "text")
    return O.ungrounded(purposes, bodies.unionByName(files.select("folder", F.concat_ws(" ", "path", "title").alias("text"))))


_EDGE = r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$"
_COMMON = ", ".join(f"'{w}'" for w in O.COMMON_WORDS)
GROUND_SQL = f"""
WITH p AS (SELECT c.path || '/' || f.path AS folder, max(purpose) AS purpose FROM folders f JOIN collections c ON c.id = f.collection_id WHERE purpose IS NOT NULL GROUP BY ALL),
w AS (SELECT folder, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT folder, list_filter(regexp_split_to_array(purpose, '\\s+'), lambda x: x <> '') AS ws FROM p)),
s AS (SELECT folder, k = 1 OR coalesce(regexp_matches(ws[k - 1], '[.!?]$'), false) AS begins, regexp_matches(regexp_replace(w, '{_EDGE}', '', 'g'), '[-/—–]') AS joined, unnest(regexp_split_to_array(regexp_replace(w, '{_EDGE}', '', 'g'), '[-/—–]')) AS part FROM w),
t AS (SELECT folder, begins, joined, regexp_replace(regexp_replace(part, '(?i)(''s|’s)$', ''), '{_EDGE}', '', 'g') AS t FROM s),
n AS (SELECT DISTINCT folder, lower(t) AS word FROM t WHERE ((NOT begins AND regexp_matches(t, '^[A-Z]') AND regexp_matches(t, '[A-Z][a-zA-Z0-9]+') AND t NOT IN ({_COMMON})) OR regexp_matches(t, '[0-9]')) AND NOT (joined AND regexp_matches(t, '^[0-9]+$'))),
i AS (SELECT id, arg_max(struct_pack(path, title), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id),
d AS (SELECT regexp_replace(x.path, '/[^/]*$', '') AS folder, lower(content) AS text FROM (SELECT DISTINCT id, file_id, content FROM chunks) c JOIN i ON i.id = c.file_id UNION ALL SELECT regexp_replace(x.path, '/[^/]*$', ''), lower(x.path || ' ' || coalesce(x.title, '')) FROM i)
SELECT folder, word FROM n WHERE NOT contains(lower(folder), word) AND NOT EXISTS (SELECT 1 FROM d WHERE d.folder = n.folder AND contains(d.text, word))
"""


def ungrounded_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Names in the heading of a chunk that its content does not mention."""
    c = distinct_chunks(spark, folder).select(F.col("id").cast("string").alias("folder"), "heading", "content")
    return O.ungrounded(c.select("folder", F.col("heading").alias("purpose")), c.select("folder", F.col("content").alias("text"))).select(F.col("folder").cast("long").alias("id"), "word")


HEADING_SQL = f"""
WITH p AS (SELECT DISTINCT id, heading, lower(content) AS text FROM chunks WHERE heading IS NOT NULL), w AS (SELECT id, text, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT id, text, list_filter(regexp_split_to_array(heading, '\\s+'), lambda x: x <> '') AS ws FROM p)),
s AS (SELECT id, text, k = 1 OR coalesce(regexp_matches(ws[k - 1], '[.!?]$'), false) AS begins, regexp_matches(regexp_replace(w, '{_EDGE}', '', 'g'), '[-/—–]') AS joined, unnest(regexp_split_to_array(regexp_replace(w, '{_EDGE}', '', 'g'), '[-/—–]')) AS part FROM w),
t AS (SELECT id, text, begins, joined, regexp_replace(regexp_replace(part, '(?i)(''s|’s)$', ''), '{_EDGE}', '', 'g') AS t FROM s)
SELECT DISTINCT id, lower(t) AS word FROM t WHERE ((NOT begins AND regexp_matches(t, '^[A-Z]') AND regexp_matches(t, '[A-Z][a-zA-Z0-9]+') AND t NOT IN ({_COMMON})) OR regexp_matches(t, '[0-9]')) AND NOT (joined AND regexp_matches(t, '^[0-9]+$')) AND NOT contains(id::VARCHAR, lower(t)) AND NOT coalesce(contains(text, lower(t)), false)
"""


def renamed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Deleted files of which later files of another path have the content."""
    f = table(spark, folder, "files").where("path is not null").select("path", "file_hash", "last_indexed")
    gone = table(spark, folder, "file_deletions").groupBy("path").agg(F.max("deleted_at").alias("deleted_at"))
    last = f.groupBy("path").agg(F.max_by("file_hash", F.struct("last_indexed", F.coalesce("file_hash", F.lit("")))).alias("file_hash"), F.max("last_indexed").alias("seen"))
    state = last.join(gone, "path", "left")
    dead = F.coalesce(F.col("deleted_at") > F.col("seen"), F.lit(False))
    # every path that lives is compared with those that were deleted for good
    return C.renamed(state.where(dead), state.where(~dead))


RENAME_SQL = """
WITH f AS (SELECT path, arg_max(struct_pack(h := file_hash), (last_indexed, coalesce(file_hash, ''))).h AS file_hash, max(last_indexed) AS seen FROM files WHERE path IS NOT NULL GROUP BY path),
s AS (SELECT f.*, coalesce((SELECT max(deleted_at) FROM file_deletions d WHERE d.path = f.path) > seen, false) AS dead FROM f)
SELECT a.path, min(b.path) AS old_path, a.file_hash FROM s a JOIN s b ON NOT a.dead AND b.dead AND a.file_hash = b.file_hash GROUP BY a.path, a.file_hash
"""


def collection_removed(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the files of collection 1 when it is removed."""
    collections = table(spark, folder, "collections")
    return C.without_collection(C.membership(table(spark, folder, "files"), collections), collections, 1)


REMOVED_SQL = """
WITH m AS (SELECT DISTINCT f.path, c.id, length(c.path) AS depth, name FROM files f JOIN collections c ON starts_with(f.path, c.path || '/')), h AS (SELECT DISTINCT path FROM m WHERE id = 1)
SELECT h.path, arg_min(m.id, (-depth, name, m.id)) AS primary_id, count(m.id) = 0 AS is_orphan FROM h LEFT JOIN m ON m.path = h.path AND m.id <> 1 GROUP BY h.path
"""

QUERIES = {
    "folder_defects": folder_defects, "defect_counts": defect_counts, "collection_digests": collection_digests, "folder_markdown": folder_markdown, "ungrounded_purposes": ungrounded_purposes, "ungrounded_headings": ungrounded_headings,
    "renamed_files": renamed_files, "collection_removed": collection_removed,
}
SQL = {
    "folder_defects": DEFECT_SQL, "defect_counts": COUNT_SQL, "collection_digests": DIGEST_SQL, "folder_markdown": MARKDOWN_SQL, "ungrounded_purposes": GROUND_SQL, "ungrounded_headings": HEADING_SQL, "renamed_files": RENAME_SQL, "collection_removed": REMOVED_SQL,
}
