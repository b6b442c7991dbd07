"""Retrieval quality, link expansion, rerank selection and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import documents as D
from corpusloom.operators import refresh as M
from corpusloom.operators import retrieval as R
from corpusloom.plans.corpus import _RESOLVE_LIST, _SLUG
from corpusloom.plans.links import FILES_SQL, LINKS_SQL, latest_files, resolved_links
from corpusloom.plans.search import distinct_chunks
from corpusloom.runtime import table
from corpusloom.streaming import events as E


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, link_type, path, section, query): links with a section as evaluation cases, those whose id is divisible by 100.

    The words of the section are the query; gold is every chunk of that section in the target file.
    """
    links = resolved_links(spark, folder).where("section <> '' and id % 100 = 0")
    return links.select(F.col("id").alias("case_id"), "link_type", F.col("target").alias("path"), "section", F.translate("section", "-", " ").alias("query"))


def _search_run(spark: SparkSession, folder: str, asked: DataFrame, text: str, variant: str) -> DataFrame:
    """(case_id, variant, rank): where a search of all chunks by the text column finds a gold chunk; no row for a miss."""
    texts = table(spark, folder, "chunks").select("id", F.col(text).alias("text"))
    found = R.search_many(asked.select("query").distinct(), texts, 20)
    homes = table(spark, folder, "chunks").select("id", "file_id", "section_id").distinct().join(latest_files(spark, folder).select("file_id", "path"), "file_id")
    hits = found.join(homes.select("id", "path", F.col("section_id").alias("section")), "id")
    return asked.join(hits, ["query", "path", "section"]).groupBy("case_id").agg(F.min("rank").alias("rank")).select("case_id", F.lit(variant).alias("variant"), "rank")


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hit rates and mean reciprocal rank per link type: every case is searched for among all chunks in one batch, twenty results each."""
    asked = cases(spark, folder)
    done = asked.join(_search_run(spark, folder, asked, "content", "content").select("case_id", "rank"), "case_id", "left")
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"hit_{k}")
    return done.groupBy("link_type").agg(F.count("*").alias("n"), hit(1), hit(3), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def _run_sql(column: str, name: str) -> str:
    return f"""
d_{name} AS (SELECT id, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM (SELECT DISTINCT id, {column} FROM chunks) WHERE {column} IS NOT NULL),
st_{name} AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS a FROM d_{name}),
tf_{name} AS (SELECT id, len(toks) AS dl, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM d_{name}, (SELECT DISTINCT term FROM terms) WHERE list_contains(toks, term)),
df_{name} AS (SELECT term, count(*) AS df FROM tf_{name} GROUP BY term),
sc_{name} AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM terms JOIN tf_{name} USING (term) JOIN df_{name} USING (term), st_{name} GROUP BY query, id),
rk_{name} AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM sc_{name} QUALIFY rank <= 20),
hit_{name} AS (SELECT case_id, min(rank) AS rank FROM cs JOIN rk_{name} USING (query) JOIN (SELECT DISTINCT id, file_id, section_id FROM chunks) c USING (id) JOIN files_l ON files_l.file_id = c.file_id WHERE f.p = path AND section_id = section GROUP BY case_id)"""


_CASES = f"""{FILES_SQL}, {LINKS_SQL},
cs AS (SELECT id AS case_id, link_type, target AS path, section, replace(section, '-', ' ') AS query FROM lk WHERE section <> '' AND id % 100 = 0),
terms AS (SELECT DISTINCT query, unnest(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}_]+')) AS term FROM cs)"""
METRICS_SQL = f"""
WITH {_CASES}, {_run_sql("content", "c")}
SELECT link_type, count(*) AS n, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6)::DOUBLE AS hit_{k}" for k in (1, 3, 10))}, round(avg(coalesce(1.0 / rank, 0)), 6)::DOUBLE AS mrr FROM cs LEFT JOIN hit_c USING (case_id) GROUP BY link_type
"""


def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The same cases under two variants: searched for in contents, and in headings."""
    asked = cases(spark, folder)
    runs = _search_run(spark, folder, asked, "content", "content").unionByName(_search_run(spark, folder, asked, "heading", "heading"))
    missed = asked.select("case_id", F.explode(F.array(F.lit("content"), F.lit("heading"))).alias("variant"), F.lit(None).cast("int").alias("rank"))
    out = M.compare_runs(runs.unionByName(missed), ["content", "heading"])
    return out.withColumns({v: F.round(v, 6) for v in ("content", "heading")})


COMPARE_SQL = f"""
WITH {_CASES}, {_run_sql("content", "c")}, {_run_sql("heading", "h")},
x AS (SELECT case_id, coalesce(1.0 / c.rank, 0)::DOUBLE AS a, coalesce(1.0 / h.rank, 0)::DOUBLE AS b FROM cs LEFT JOIN hit_c c USING (case_id) LEFT JOIN hit_h h USING (case_id))
SELECT case_id, round(a, 6) AS content, round(b, 6) AS heading, CASE WHEN b > a THEN 'heading' ELSE 'content' END AS best FROM x
"""


def one_hop(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of the ten files with most chunks and what is one link away, forth or back, at 0.8 of the score."""
    files = latest_files(spark, folder).select("file_id", "path")
    edges = resolved_links(spark, folder).select("source_path", "source_section", F.col("target").alias("target_path"), F.col("section").alias("target_section"))
    top = R.ranked(distinct_chunks(spark, folder).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("score")).where("id is not null"), 10)
    sections = distinct_chunks(spark, folder).select(F.col("file_id").alias("id"), F.coalesce("section_id", F.lit("")).alias("section")).distinct()
    results = top.join(sections, "id").join(files, F.col("id") == F.col("file_id")).select("path", "section", F.col("score").cast("double").alias("score"))
    return R.expand_one_hop(results, edges, 0.8).withColumn("score", F.round("score", 6))


HOP_SQL = f"""
WITH {FILES_SQL}, {LINKS_SQL}, f AS (SELECT id, arg_max(path, (last_indexed, coalesce(mtime, 0))) AS path FROM files GROUP BY id), c AS (SELECT DISTINCT id, file_id, coalesce(section_id, '') AS s FROM chunks),
e0 AS (SELECT DISTINCT source_path AS sp, source_section AS ss, target AS tp, section AS ts FROM lk),
e AS (FROM e0 UNION SELECT tp, ts, sp, ss FROM e0),
t AS (SELECT file_id, count(*) AS n FROM c WHERE file_id IS NOT NULL GROUP BY file_id ORDER BY n DESC, file_id LIMIT 10),
r AS (SELECT DISTINCT path, s AS section, n::DOUBLE AS score FROM t JOIN c USING (file_id) JOIN f ON f.id = file_id)
SELECT path, section, round(max(score), 6) AS score FROM (FROM r UNION ALL SELECT tp, ts, score * 0.8 FROM r JOIN e ON e.sp = path AND e.ss = section) GROUP BY ALL
"""


def rerank_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates for a reranker: of the 300 longest chunks the best of each file first, then by rank up to 75."""
    rows = R.ranked(distinct_chunks(spark, folder).where("char_count is not null and file_id is not null").select("id", F.col("file_id").alias("file"), F.col("char_count").alias("score")), 300)
    return R.diverse_candidates(rows, 75, 1).select("id", "file", "rank", "place")


RERANK_SQL = """
WITH t AS (SELECT id, file_id AS file, char_count, row_number() OVER (ORDER BY char_count DESC, id) AS rank FROM (SELECT DISTINCT id, file_id, char_count FROM chunks WHERE char_count IS NOT NULL AND file_id IS NOT NULL) ORDER BY char_count DESC, id LIMIT 300),
f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) <= 1 AS first FROM t), p AS (SELECT *, row_number() OVER (ORDER BY first DESC, rank) AS place, count(*) FILTER (first) OVER () AS nf FROM f)
SELECT id, file, rank::INTEGER AS rank, place::INTEGER AS place FROM p WHERE place <= greatest(75, nf)
"""


def heading_boosts(spark: SparkSession, folder: str) -> DataFrame:
    """The factor that a query of three words gives to each heading it touches."""
    h = distinct_chunks(spark, folder).select("id", R.heading_boost(F.col("heading"), ["Tune", "the", "glossary"], 1.5).alias("factor"))
    return h.where("factor > 1").withColumn("factor", F.round("factor", 6))


BOOST_SQL = "SELECT id, round(1 + 0.5 * (contains(lower(heading), 'tune')::INTEGER + contains(lower(heading), 'the')::INTEGER + contains(lower(heading), 'glossary')::INTEGER) / 3.0, 6)::DOUBLE AS factor FROM (SELECT DISTINCT id, heading FROM chunks) WHERE contains(lower(heading), 'tune') OR contains(lower(heading), 'the') OR contains(lower(heading), 'glossary')"


def document_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links found in documents with their targets made absolute, and whether a document of that path exists."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), "path").alias("source_path"), "text")
    found = D.resolved(D.links(docs).join(docs.select("id", "source_path"), "id"))
    there = docs.select(F.col("source_path").alias("target_path")).distinct().withColumn("there", F.lit(True))
    return found.join(there, "target_path", "left").select("id", "line_no", "raw", "target_path", "target_section", F.coalesce("there", F.lit(False)).alias("there"))


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows of the event stream sliding by twelve hours; the streaming plan, run over all that has arrived."""
    return E.tumbling(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "1 day", "12 hours")


WINDOWS_SQL = "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY ALL"


def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Paths that are only indexed, only deleted, or both."""
    a, b = table(spark, folder, "files").select("path").distinct(), table(spark, folder, "file_deletions").select("path").distinct()
    tag = lambda df, t: df.withColumn("state", F.lit(t))
    return tag(a.exceptAll(b), "indexed").unionByName(tag(b.exceptAll(a), "deleted")).unionByName(tag(a.intersect(b), "both"))


SETS_SQL = "SELECT path, 'indexed' AS state FROM (SELECT DISTINCT path FROM files EXCEPT SELECT path FROM file_deletions) UNION ALL SELECT path, 'deleted' FROM (SELECT DISTINCT path FROM file_deletions EXCEPT SELECT path FROM files) UNION ALL SELECT path, 'both' FROM (SELECT DISTINCT path FROM files INTERSECT SELECT path FROM file_deletions)"

QUERIES = {"retrieval_metrics": retrieval_metrics, "one_hop": one_hop, "rerank_selection": rerank_selection, "heading_boosts": heading_boosts, "resolved_links": document_links, "run_comparison": run_comparison, "event_windows": event_windows, "set_operations": set_operations}
SQL = {"retrieval_metrics": METRICS_SQL, "run_comparison": COMPARE_SQL, "one_hop": HOP_SQL, "rerank_selection": RERANK_SQL, "heading_boosts": BOOST_SQL, "event_windows": WINDOWS_SQL, "set_operations": SETS_SQL}

# p2_found in SQL: the same rules, judged on all rows
ORPHAN_SQL = f"""
WITH fi AS (SELECT id, arg_max(struct_pack(p := path, c := collection_id), (last_indexed, path)) AS x FROM files WHERE id IS NOT NULL GROUP BY id),
st AS (SELECT path, min(last_indexed) AS a, max(last_indexed) AS b FROM files GROUP BY path), de AS (SELECT path, max(deleted_at) AS d FROM file_deletions GROUP BY path),
se AS (SELECT DISTINCT x.p AS path, section_id FROM chunks JOIN fi ON fi.id = file_id WHERE section_id IS NOT NULL),
r AS (SELECT DISTINCT 'links' AS ref_table, l.id AS ref_id, c.path AS root, target_path, target_section, indexed_at AS t FROM links l LEFT JOIN fi ON fi.id = source_file_id LEFT JOIN collections c ON c.id = x.c
 UNION ALL SELECT DISTINCT 'ref_results', l.id, c.path, target_path, target_section, checked_at FROM ref_results l LEFT JOIN fi ON x.p = source_path LEFT JOIN collections c ON c.id = x.c),
p AS (SELECT ref_table, ref_id, t, CASE WHEN target_section <> '' THEN {_SLUG("target_section")} END AS s, CASE WHEN left(replace(target_path, chr(92), '/'), 1) = '/' THEN {_RESOLVE_LIST("target_path")} ELSE {_RESOLVE_LIST("(root || '/' || target_path)")} END AS path FROM r WHERE target_path <> ''),
j AS (SELECT ref_table, ref_id, CASE WHEN st.path IS NULL THEN 'missing' WHEN d > b THEN 'deleted' WHEN s IS NOT NULL AND se.path IS NULL THEN 'section' WHEN a > t THEN 'late' END AS reason FROM p LEFT JOIN st USING (path) LEFT JOIN de USING (path) LEFT JOIN se ON se.path = p.path AND se.section_id = s)
SELECT DISTINCT * FROM j WHERE reason IS NOT NULL
"""
SQL["p2_found"] = ORPHAN_SQL
