"""Queries that take documents apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.paths import basename, extension, parent_of, slug
from corpusloom.operators import documents as D
from corpusloom.plans.links import FILES_SQL, LINKS_SQL as RESOLVED_SQL, RESOLVE_SQL, SLUG_SQL, resolved_links
from corpusloom.runtime import spread, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "path", "text"), "id")


def doc_headings(spark: SparkSession, folder: str) -> DataFrame:
    return D.headings(_docs(spark, folder))


_LINES = "l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), li AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM l)"
_SLUG = SLUG_SQL
_HEADS = f"{_LINES}, h AS (SELECT id, line_no, n, len(regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})[ \\t]+(.+)$', 2), ' ') AS heading FROM li WHERE regexp_matches(line, '^(#{{1,6}})[ \\t]+(.+)$'))"
HEADINGS_SQL = f"WITH {_HEADS} SELECT id, line_no::INTEGER AS line_no, level::INTEGER AS level, heading, {_SLUG('heading')} AS section_id FROM h"


def section_spans(spark: SparkSession, folder: str) -> DataFrame:
    return D.sections(_docs(spark, folder))


SPANS_SQL = f"WITH {_HEADS} SELECT a.id, a.line_no::INTEGER AS start_line, coalesce(min(b.line_no) - 1, any_value(a.n))::INTEGER AS end_line, a.level::INTEGER AS level, any_value(a.heading) AS heading, {_SLUG('any_value(a.heading)')} AS section_id FROM h a LEFT JOIN h b ON a.id = b.id AND b.line_no > a.line_no AND b.level <= a.level GROUP BY a.id, a.line_no, a.level"


def chunk_in_section(spark: SparkSession, folder: str) -> DataFrame:
    """Row chunks mapped to the deepest section that holds their middle line."""
    docs = _docs(spark, folder)
    chunks = D.row_chunks(docs).select("id", "chunk_order", F.floor((F.col("start_line") + F.col("end_line")) / 2).alias("middle"))
    spans = D.sections(docs).groupBy("id").agg(F.collect_list(F.struct("level", "start_line", "end_line", "section_id")).alias("spans"))
    inside = F.array_max(F.filter("spans", lambda s: (s["start_line"] <= F.col("middle")) & (F.col("middle") <= s["end_line"])))
    return chunks.join(spans, "id", "left").select("id", "chunk_order", "middle", F.coalesce(inside["section_id"], F.lit("")).alias("section_id"))


def row_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return D.row_chunks(_docs(spark, folder)).select("id", "chunk_order", "start_line", "end_line", "char_count", F.md5("content").alias("digest"))


_ROWS = """
l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), li AS (SELECT id, unnest(ls) AS s, generate_subscripts(ls, 1) AS n FROM l),
r AS (SELECT id, s, n, row_number() OVER (PARTITION BY id ORDER BY n) AS k, count(*) OVER (PARTITION BY id) AS total FROM li WHERE trim(s, ' ') <> ''),
g AS (SELECT id, (k - 1) // 25 AS g, min(k) AS a, max(k) AS b, sum(octet_length(encode(s)) + 1) - 1 AS size, any_value(total) AS total FROM r GROUP BY id, (k - 1) // 25),
m AS (SELECT *, max(g) OVER (PARTITION BY id) AS last_g, lead(size) OVER w AS next_size, lag(size) OVER w AS prev_size, lead(b) OVER w AS next_b FROM g WINDOW w AS (PARTITION BY id ORDER BY g)),
j AS (SELECT id, a, total, CASE WHEN g = last_g - 1 AND next_size < 200 AND size >= 200 THEN next_b ELSE b END AS b, CASE WHEN g = last_g - 1 AND next_size < 200 AND size >= 200 THEN size + 1 + next_size ELSE size END AS size FROM m WHERE NOT (g = last_g AND g > 0 AND size < 200 AND prev_size >= 200)),
c AS (SELECT j.id, j.a, j.b, j.size, min(r.n) FILTER (r.k = j.a) AS start_line, min(r.n) FILTER (r.k = j.b) AS end_line, string_agg(r.s, chr(10) ORDER BY r.k) AS content FROM j JOIN r ON r.id = j.id AND r.k BETWEEN j.a - 5 AND j.b + 5 WHERE j.size >= 200 GROUP BY j.id, j.a, j.b, j.size),
rc AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start_line) - 1)::INTEGER AS chunk_order, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, size::INTEGER AS char_count, content FROM c)
"""
ROWS_SQL = f"WITH {_ROWS} SELECT id, chunk_order, start_line, end_line, char_count, md5(content) AS digest FROM rc"
MIDDLE_SQL = f"""
WITH {_ROWS}, {_HEADS.replace("l AS", "l2 AS", 1).replace("FROM l)", "FROM l2)").replace("li AS", "li2 AS").replace("FROM li WHERE", "FROM li2 WHERE")},
sp AS (SELECT a.id, a.line_no AS s, coalesce(min(b.line_no) - 1, any_value(a.n)) AS e, a.level, {_SLUG('any_value(a.heading)')} AS section_id FROM h a LEFT JOIN h b ON a.id = b.id AND b.line_no > a.line_no AND b.level <= a.level GROUP BY a.id, a.line_no, a.level),
x AS (SELECT rc.id, chunk_order, (start_line + end_line) // 2 AS middle FROM rc)
SELECT x.id, chunk_order, middle::BIGINT AS middle, coalesce(arg_max(section_id, (level, s)), '') AS section_id FROM x LEFT JOIN sp ON sp.id = x.id AND middle BETWEEN s AND e GROUP BY x.id, chunk_order, middle
"""


def chunk_parents(spark: SparkSession, folder: str) -> DataFrame:
    """The parent every chunk should have by heading levels, beside the one it has."""
    c = table(spark, folder, "chunks").select("id", "file_id", "chunk_order", F.col("heading_level").alias("level"), "parent_chunk_id").distinct()
    return D.nearest_parents(c.where("file_id is not null and chunk_order is not null")).select("id", "parent_id", F.col("parent_chunk_id").eqNullSafe(F.col("parent_id")).alias("agrees"))


PARENTS_SQL = """
WITH c AS (SELECT DISTINCT id, file_id, chunk_order, heading_level AS level, parent_chunk_id FROM chunks WHERE file_id IS NOT NULL AND chunk_order IS NOT NULL),
p AS (SELECT a.id, arg_max(b.id, (b.chunk_order, b.id)) AS parent_id FROM c a JOIN c b ON a.file_id = b.file_id AND (b.chunk_order, b.id) < (a.chunk_order, a.id) AND b.level BETWEEN 1 AND 5 AND b.level < a.level AND a.level BETWEEN 2 AND 6 GROUP BY a.id)
SELECT c.id, parent_id, parent_chunk_id IS NOT DISTINCT FROM parent_id AS agrees FROM c LEFT JOIN p ON c.id = p.id
"""


def doc_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).where("text is not null").select("id", D.title(F.col("text")).alias("title"), D.frontmatter(F.col("text")).isNotNull().alias("has_frontmatter"))


_FM = "nullif(regexp_extract(text, '^-{3,}[ \\t]*\\n((?s:.*?))\\n-{3,}[ \\t]*(?:\\n|$)', 1), '')"
TITLES_SQL = f"""
WITH f AS (SELECT doc_id AS id, text, {_FM} AS fm FROM documents WHERE text IS NOT NULL)
SELECT id, coalesce(nullif(regexp_replace(trim(regexp_extract(coalesce(fm, ''), '(?m)^(?:title|name):[ \\t]*(.*)$', 1), ' '), '^["'']|["'']$', '', 'g'), ''), trim(regexp_extract(text, '(?m)^##?[ \\t]+(.*)$', 1), ' '), '') AS title, fm IS NOT NULL AS has_frontmatter FROM f
"""


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("id", slug(F.col("heading")).alias("slug")).distinct()


SLUGS_SQL = f"SELECT DISTINCT id, {_SLUG('heading')} AS slug FROM chunks"


def extracted_links(spark: SparkSession, folder: str) -> DataFrame:
    return D.links(_docs(spark, folder))


LINKS_SQL = f"""
WITH {_LINES},
f AS (SELECT id, line_no, 'markdown' AS link_type, unnest(regexp_extract_all(line, '\\[[^\\]\\[]*\\]\\([^)\\s]+\\)')) AS raw FROM li
 UNION ALL SELECT id, line_no, 'wikilink', unnest(regexp_extract_all(line, '\\[\\[[^\\]\\[]+\\]\\]')) FROM li
 UNION ALL SELECT id, line_no, 'read_command', unnest(regexp_extract_all(line, '\\bmem[ \\t]+read[ \\t]+[^\\s`]+')) FROM li
 UNION ALL SELECT id, line_no, 'include', unnest(regexp_extract_all(line, '\\{{\\{{[ \\t]*include(?:-toc)?[ \\t]+[^}}\\s]+[ \\t]*\\}}\\}}')) FROM li
 UNION ALL SELECT id, line_no, 'path_ref', unnest(regexp_extract_all(line, '`[^` ]+\\.md(?:#[^` ]*)?`')) FROM li
 UNION ALL SELECT doc_id, 0, 'frontmatter_source', regexp_extract({_FM}, '(?m)^source:[ \\t]*["'']?(\\[\\[[^\\]\\[]+\\]\\])', 1) FROM documents),
t AS (SELECT *, trim(trim(CASE WHEN link_type = 'markdown' THEN regexp_extract(raw, '\\(([^)]+)\\)$', 1) WHEN link_type IN ('wikilink', 'frontmatter_source') THEN regexp_extract(raw, '^\\[\\[([^\\]|]+)', 1) WHEN link_type = 'read_command' THEN regexp_extract(raw, 'read[ \\t]+([^\\s`]+)$', 1) WHEN link_type = 'include' THEN regexp_extract(raw, 'include(?:-toc)?[ \\t]+([^}}\\s]+)', 1) ELSE regexp_extract(raw, '`([^`]+)`', 1) END, ' '), chr(34) || chr(39)) AS target FROM f WHERE raw <> ''),
p AS (SELECT *, trim(split_part(target, '#', 1), ' ') AS path FROM t WHERE NOT regexp_matches(lower(target), '^(https?|mailto):'))
SELECT DISTINCT id, line_no::INTEGER AS line_no, link_type, CASE WHEN link_type IN ('wikilink', 'frontmatter_source') AND NOT regexp_matches(path, '\\.[A-Za-z0-9]+$') THEN path || '.md' ELSE path END AS target_path,
 CASE WHEN contains(target, '#') THEN {_SLUG("regexp_replace(target, '^[^#]*#', '')")} ELSE '' END AS target_section, raw FROM p WHERE link_type NOT IN ('read_command', 'include', 'path_ref') OR ends_with(lower(path), '.md')
"""


def parsed_code_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The raw references of check reports taken apart."""
    refs = table(spark, folder, "ref_results").where("raw is not null").select("id", F.col("raw").alias("text")).distinct()
    return D.code_refs(refs).drop("line_no").distinct()


_REF, _ONE = T.code_reference(), T.code_reference(True)
_REFS_TAIL = f"""SELECT *, regexp_extract(raw, '{_ONE}', 1) AS path, try_cast(nullif(regexp_extract(raw, '{_ONE}', 3), '') AS INTEGER) AS "start", regexp_extract(raw, '{_ONE}', 4) AS start_token, try_cast(nullif(regexp_extract(raw, '{_ONE}', 5), '') AS INTEGER) AS "end", regexp_extract(raw, '{_ONE}', 6) AS end_token FROM f"""
PARSED_SQL = f"WITH f AS (SELECT id, unnest(regexp_extract_all(raw, '{_REF}')) AS raw FROM ref_results), x AS ({_REFS_TAIL}) SELECT DISTINCT * FROM x WHERE \"start\" >= 1 AND (\"end\" IS NULL OR \"end\" >= \"start\")"


def backlink_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Links to every resolved path from other files."""
    return resolved_links(spark, folder).where("target <> source_path").groupBy("target").agg(F.count("*").alias("backlinks"), F.count_distinct("source_path").alias("sources"))


_RESOLVE_LIST = RESOLVE_SQL
BACKLINK_SQL = f"WITH {FILES_SQL}, {RESOLVED_SQL} SELECT target, count(*) AS backlinks, count(DISTINCT source_path) AS sources FROM lk WHERE target <> source_path GROUP BY target"


def keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The eight best keywords of every folder of documents."""
    return D.top_keywords(D.keyword_scores(_docs(spark, folder))).select("directory", "place", "term", F.round("score", 6).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KW = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), lambda w: octet_length(encode(w)) >= 3 AND w NOT IN ({_STOP}))"
_BI = lambda x: f"list_concat({x}, list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
KEYWORD_SQL = f"""
WITH d AS (SELECT doc_id AS id, CASE WHEN contains(path, '/') THEN array_to_string(list_slice(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), 1, 2), '/') || '/' ELSE './' END AS directory, path,
 array_to_string(list_filter(regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: NOT regexp_matches(lower(w), '^https?://')), ' ') AS body FROM documents),
k AS (SELECT id, directory, CASE WHEN starts_with(body, '#') THEN 3 ELSE 1 END AS w, coalesce({_KW('body')}, []) AS t, {_KW("regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')")} AS nt FROM d),
e AS (SELECT id, directory, w, unnest({_BI('t')}) AS term FROM k UNION ALL SELECT id, directory, 2, unnest({_BI('nt')}) FROM k),
tf AS (SELECT id, directory, term, sum(w) AS w FROM e GROUP BY ALL),
pd AS (SELECT term, directory, sum(w) AS w, count(*) AS docs FROM tf GROUP BY ALL),
df AS (SELECT term, sum(docs) AS df FROM pd GROUP BY term),
s AS (SELECT directory, term, w * ln(1 + (SELECT count(DISTINCT directory) FROM d)::DOUBLE / df) AS score FROM pd JOIN df USING (term))
SELECT directory, row_number() OVER (PARTITION BY directory ORDER BY round(score, 9) DESC, contains(term, ' ') DESC, term)::INTEGER AS place, term, round(score, 6) AS score FROM s QUALIFY place <= 8
"""


def path_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Folder, name, extension, kind and name-derived title of every indexed path."""
    p = table(spark, folder, "files").select("path").distinct()
    return p.select("path", parent_of(F.col("path")).alias("folder"), basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), T.kind_of(extension(F.col("path"))).alias("kind"), T.title_from_name(basename(F.col("path"))).alias("title"))


PARTS_SQL = """
WITH p AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS name FROM files)
SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, name, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext,
 CASE WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.md', '.mdx', '.markdown', '.qmd') THEN 'markdown' WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.txt', '.log') THEN 'text' WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.json', '.jsonl', '.csv') THEN 'data' WHEN lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.toml', '.yml', '.yaml') THEN 'config' ELSE 'other' END AS kind,
 translate(regexp_replace(name, '\\.[^.]*$', ''), '-_', '  ') AS title FROM p
"""


def glob_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Files by two SQL globs, and whether gitignore-like patterns would skip them."""
    p = table(spark, folder, "files").select("path").distinct().where(T.matches_any(F.col("path"), "*/docs/*.md, *overview*"))
    return p.select("path", T.ignored(F.regexp_replace("path", "^/srv/kb/[^/]*/", ""), ["drafts/", "*.log", "# note", "docs/**/archive"]).alias("ignored"))


GLOB_SQL = """
WITH p AS (SELECT DISTINCT path, regexp_replace(path, '^/srv/kb/[^/]*/', '') AS rel FROM files WHERE path GLOB '*/docs/*.md' OR path GLOB '*overview*')
SELECT path, regexp_matches(rel, '(^|/)drafts(/|$)') OR regexp_matches(rel, '(^|/)[^/]*\\.log(/|$)') OR regexp_matches(rel, '^docs/(.*/)?archive(/|$)') AS ignored FROM p
"""


def doc_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Words, and digests of the whole text and of its first and last 500 words."""
    words = F.filter(F.split("text", r"[ \t\n\r\f\v]+"), lambda w: w != "")
    d = _docs(spark, folder).where("text is not null").withColumn("w", words)
    return d.select("id", F.size("w").alias("words"), F.md5("text").alias("content"), F.md5(F.array_join(F.slice("w", 1, 500), " ")).alias("head"), F.md5(F.array_join(F.slice("w", F.greatest(F.size("w") - 499, F.lit(1)), 500), " ")).alias("tail"))


SIGNATURE_SQL = "SELECT doc_id AS id, len(w)::INTEGER AS words, md5(text) AS content, md5(array_to_string(list_slice(w, 1, 500), ' ')) AS head, md5(array_to_string(list_slice(w, greatest(len(w) - 499, 1), len(w)), ' ')) AS tail FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"


def previews(spark: SparkSession, folder: str) -> DataFrame:
    """First sentence, two-line preview and tag-free start of every document."""
    body = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return _docs(spark, folder).where("text is not null").select("id", T.first_sentence(F.col("text")).alias("sentence"), T.truncate(F.array_join(F.slice(body, 1, 2), " "), 120).alias("preview"))


PREVIEW_SQL = "WITH p AS (SELECT doc_id AS id, text, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), 1, 2), ' ') AS b FROM documents WHERE text IS NOT NULL) SELECT id, trim(regexp_extract(text, '^([^.!?]*[.!?]?)', 1), ' ') AS sentence, CASE WHEN length(b) > 120 THEN substr(b, 1, 117) || '...' ELSE b END AS preview FROM p"

QUERIES = {
    "doc_headings": doc_headings, "section_spans": section_spans, "chunk_in_section": chunk_in_section, "row_chunks": row_chunks, "chunk_parents": chunk_parents, "doc_titles": doc_titles, "slugs": slugs,
    "extracted_links": extracted_links, "parsed_code_refs": parsed_code_refs, "backlink_counts": backlink_counts, "keywords": keywords, "path_parts": path_parts,
    "glob_filter": glob_filter, "doc_signatures": doc_signatures, "previews": previews,
}
SQL = {
    "doc_headings": HEADINGS_SQL, "section_spans": SPANS_SQL, "chunk_in_section": MIDDLE_SQL, "row_chunks": ROWS_SQL, "chunk_parents": PARENTS_SQL, "doc_titles": TITLES_SQL, "slugs": SLUGS_SQL,
    "extracted_links": LINKS_SQL, "parsed_code_refs": PARSED_SQL, "backlink_counts": BACKLINK_SQL, "keywords": KEYWORD_SQL, "path_parts": PARTS_SQL,
    "glob_filter": GLOB_SQL, "doc_signatures": SIGNATURE_SQL, "previews": PREVIEW_SQL,
}
