"""Queries that outline documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import documents as D
from corpusloom.operators import outline as O
from corpusloom.plans.corpus import _HEADS, _SLUG, TITLES_SQL
from corpusloom.plans.search import TERMS
from corpusloom.runtime import spread, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "path", "text"), "id")


def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return O.section_chunks(_docs(spark, folder)).withColumn("content", F.md5("content")).withColumnRenamed("content", "digest")


_FRONT = r"^(\s*\n)?([ \t]*(?:-{3,}[ \t\r]*\n(?:(?s:.*?)\n)?[ \t]*-{3,}|\+{3,}[ \t\r]*\n(?:(?s:.*?)\n)?[ \t]*\+{3,}))[ \t\r]*(?:\n|$)"
_BREAKS = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"
CHUNKS_SQL = f"""
WITH {_HEADS},
d AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS ls, regexp_extract(text, '{_FRONT}', 1) AS lead, regexp_extract(text, '{_FRONT}', 2) AS block FROM documents WHERE text IS NOT NULL),
f AS (SELECT id, ls, len(ls) AS n, block, {_BREAKS('lead')} + 1 AS lead, CASE WHEN block = '' THEN 0 ELSE {_BREAKS('lead')} + {_BREAKS('block')} + 1 END AS fm FROM d),
first AS (SELECT f.id, min(h.line_no) AS first FROM f LEFT JOIN h ON h.id = f.id GROUP BY f.id),
r AS (SELECT id, line_no, level, heading FROM h UNION ALL SELECT f.id, 1, 0, '' FROM f JOIN first USING (id) WHERE first > 1 AND regexp_matches(array_to_string(list_slice(ls, 1, first - 1), chr(10)), '\\S')
 UNION ALL SELECT f.id, fm + 1, 0, '' FROM f JOIN first USING (id) WHERE first IS NULL),
sp AS (SELECT a.id, a.line_no AS s, a.level, a.heading, (SELECT min(b.line_no) - 1 FROM r b WHERE b.id = a.id AND b.line_no > a.line_no AND (b.level <= a.level OR a.level = 0)) AS e FROM r a),
b AS (SELECT sp.id, s, coalesce(e, n) AS e, level, heading, greatest(s, fm + 1) AS a, array_to_string(list_slice(ls, greatest(s, fm + 1), coalesce(e, n)), chr(10)) AS whole, first IS NULL AS bare, ls FROM sp JOIN f USING (id) JOIN first USING (id) WHERE greatest(s, fm + 1) <= coalesce(e, n)),
j AS (SELECT *, e - a + 1 AS n_rows, CASE WHEN bare THEN rtrim(whole, chr(10)) ELSE whole END AS body FROM b WHERE regexp_matches(whole, '\\S')),
z AS (SELECT *, CASE WHEN octet_length(encode(body)) > 2000 THEN greatest(5, 2000 // ((octet_length(encode(whole)) + 1) // n_rows)) END AS step FROM j),
g AS (SELECT id, s, e, level, heading, s AS start_line, e AS end_line, body AS core, body AS content, 0 AS i FROM z WHERE step IS NULL
 UNION ALL SELECT id, s, e, level, heading, a + i, a + least(i + step, n_rows) - 1, array_to_string(list_slice(ls, a + i, a + least(i + step, n_rows) - 1), chr(10)), array_to_string(list_slice(ls, a + greatest(i - 5, 0), a + least(i + step + 5, n_rows) - 1), chr(10)), i FROM (SELECT *, unnest(range(0, n_rows, step)) AS i FROM z WHERE step IS NOT NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY i) AS p FROM g WHERE regexp_matches(core, '\\S')),
c AS (SELECT id, start_line, end_line, octet_length(encode(core)) AS char_count, CASE WHEN p = 1 THEN {_SLUG('heading')} WHEN {_SLUG('heading')} = '' THEN 'part-' || p ELSE {_SLUG('heading')} || '::' || p END AS section_id, heading, level, content, s, p FROM p
 UNION ALL SELECT id, lead, fm, octet_length(encode(array_to_string(list_slice(ls, lead + 1, fm - 1), chr(10)))), 'frontmatter', '', 0, array_to_string(list_slice(ls, lead + 1, fm - 1), chr(10)), 0, 0 FROM f WHERE fm > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, p) - 1 AS chunk_order FROM c)
SELECT id, chunk_order::INTEGER AS chunk_order, (SELECT max(q.chunk_order) FROM o q WHERE q.id = o.id AND q.chunk_order < o.chunk_order AND q.level > 0 AND q.level < o.level)::INTEGER AS parent_order, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, char_count::INTEGER AS char_count, section_id, heading, level::INTEGER AS level, md5(content) AS digest FROM o
"""


def line_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return O.line_snippets(_docs(spark, folder), TERMS)


SNIPPET_SQL = f"""
WITH d AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT id, text, len(ls) AS n, unnest(ls) AS s, generate_subscripts(ls, 1) AS k FROM d),
h AS (SELECT *, {" + ".join(f"contains(lower(s), '{t}')::INTEGER" for t in TERMS)} AS hits FROM l), b AS (SELECT id, arg_max(k, (hits, -k)) AS best FROM h GROUP BY id),
c AS (SELECT h.*, best, abs(k - best) AS far FROM h JOIN b USING (id) WHERE k = best OR length(regexp_replace(s, '[^A-Za-z0-9]', '', 'g')) >= 4),
t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY far, k > best) <= 7)
SELECT id, any_value(best)::INTEGER AS best_line, CASE WHEN any_value(n) <= 7 THEN any_value(text) ELSE CASE WHEN min(k) > 1 THEN '...' || chr(10) ELSE '' END || string_agg(s, chr(10) ORDER BY k) || CASE WHEN max(k) < any_value(n) THEN chr(10) || '...' ELSE '' END END AS snippet FROM t GROUP BY id
"""


def doc_outlines(spark: SparkSession, folder: str) -> DataFrame:
    return O.outlines(_docs(spark, folder)).withColumn("headings", F.array_join("headings", " | "))


OUTLINE_SQL = f"""
WITH d AS (SELECT doc_id AS id, path, text, regexp_replace(text, '{_FRONT}', '') AS body, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL),
l AS (SELECT id, trim(s, chr(32) || chr(9) || chr(13)) AS s, k FROM (SELECT id, unnest(string_split(body, chr(10))) AS s, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM d)),
m AS (SELECT *, regexp_matches(s, '^(```|~~~)') AS fence, coalesce(sum(regexp_matches(s, '^(```|~~~)')::INTEGER) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM l),
p AS (SELECT *, NOT fence AND NOT fenced AND s <> '' AND NOT regexp_matches(s, '^(#|\\||<!--|!\\[|\\[!\\[)') AS prose FROM m),
a AS (SELECT id, min(k) AS a FROM p WHERE prose GROUP BY id), z AS (SELECT a.id, a.a, min(k) AS z FROM a LEFT JOIN p ON p.id = a.id AND k > a.a AND s = '' AND NOT fenced GROUP BY ALL),
x AS (SELECT z.id, string_agg(s, ' ' ORDER BY k) AS x FROM z JOIN p ON p.id = z.id AND prose AND k >= z.a AND (z.z IS NULL OR k < z.z) GROUP BY z.id),
t AS (SELECT id, CASE WHEN strlen(x) <= 280 THEN x ELSE rtrim(left(x, list_max(list_filter(range(0, 278), lambda m: strlen(left(x, m)) <= 277))), ' ') || '...' END AS excerpt FROM x),
n AS (SELECT doc_id AS id, title FROM ({TITLES_SQL.replace("SELECT id, coalesce", "SELECT id AS doc_id, coalesce")}))
SELECT d.id, coalesce(nullif(n.title, ''), trim(translate(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '-_', '  '), ' '), '') AS title, words::INTEGER AS words, coalesce(excerpt, '') AS excerpt,
 array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^##?[ \\t]+.+$')), lambda s: trim(regexp_extract(s, '^##?[ \\t]+(.+)$', 1), ' ')), ' | ') AS headings FROM d JOIN n USING (id) LEFT JOIN t USING (id)
"""


def diverse_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Eight keywords of every folder of documents, without words that a chosen pair already holds."""
    return D.diverse_keywords(D.keyword_scores(_docs(spark, folder)))


QUERIES = {"section_chunks": section_chunks, "line_snippets": line_snippets, "doc_outlines": doc_outlines, "diverse_keywords": diverse_keywords}
SQL = {"section_chunks": CHUNKS_SQL, "line_snippets": SNIPPET_SQL, "doc_outlines": OUTLINE_SQL}
