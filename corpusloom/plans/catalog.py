"""Queries over the catalog of the index, its maintenance, metrics and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import catalog as C
from corpusloom.plans.corpus import doc_signatures
from corpusloom.plans.search import distinct_chunks, latest_files
from corpusloom.runtime import table


def collection_membership(spark: SparkSession, folder: str) -> DataFrame:
    return C.membership(table(spark, folder, "files"), table(spark, folder, "collections"))


MEMBERSHIP_SQL = "SELECT f.path, c.id AS collection_id, row_number() OVER (PARTITION BY f.path ORDER BY length(c.path) DESC, c.name, c.id) = 1 AS is_primary FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) f JOIN collections c ON starts_with(f.path, c.path || '/')"


def section_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return C.section_rollup(distinct_chunks(spark, folder))


ROLLUP_SQL = """
WITH c AS (SELECT DISTINCT id, file_id, chunk_order, start_line, char_count, coalesce(heading, '') AS heading, parent_chunk_id, split_part(coalesce(section_id, ''), '::', 1) AS section FROM chunks WHERE id IS NOT NULL AND file_id IS NOT NULL),
l AS (SELECT a.file_id, a.section, a.chunk_order, a.id, b.file_id AS pf, b.section AS ps FROM c a JOIN c b ON a.parent_chunk_id = b.id WHERE NOT (a.file_id = b.file_id AND a.section = b.section)),
p AS (SELECT file_id, section, arg_min(ps, (chunk_order, id)) AS parent_section FROM l GROUP BY ALL),
k AS (SELECT pf AS file_id, ps AS section, count(DISTINCT (file_id, section)) AS n FROM l GROUP BY ALL),
o AS (SELECT file_id, section, sum(char_count)::BIGINT AS char_count, min(start_line) AS start_line, min(chunk_order) AS first_order, coalesce(arg_min(heading, (chunk_order, id)) FILTER (heading <> ''), '') AS heading, count(*) AS n_chunks FROM c GROUP BY ALL)
SELECT o.*, coalesce(parent_section, '') AS parent_section, coalesce(n, 0) AS n_subsections FROM o LEFT JOIN p USING (file_id, section) LEFT JOIN k USING (file_id, section)
"""


def indexing_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Between the first and the last indexing pass of every path: what changed."""
    f = table(spark, folder, "files").where("path is not null").dropDuplicates()
    state = F.struct("file_hash", "mtime")
    order = F.struct("last_indexed", F.coalesce("mtime", F.lit(0)), F.coalesce("file_hash", F.lit("")))
    first = f.groupBy("path").agg(F.min_by(state, order).alias("s")).select("path", "s.*")
    last = f.groupBy("path").agg(F.max_by(state, order).alias("s")).select("path", "s.*")
    gone = table(spark, folder, "file_deletions").select("path").distinct()
    return C.snapshot_diff(first, last.join(gone, "path", "left_anti")).groupBy("change").agg(F.count("*").alias("n"))


CHANGES_SQL = """
WITH f AS (SELECT path, struct_pack(h := file_hash, m := mtime) AS s, (last_indexed, coalesce(mtime, 0), coalesce(file_hash, '')) AS k FROM files WHERE path IS NOT NULL),
a AS (SELECT path, arg_min(s, k) AS o, arg_max(s, k) AS n FROM f GROUP BY path),
x AS (SELECT CASE WHEN path IN (SELECT path FROM file_deletions) THEN 'deleted' WHEN o.m IS NOT DISTINCT FROM n.m THEN 'unchanged' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'touched' ELSE 'changed' END AS change FROM a)
SELECT change, count(*) AS n FROM x GROUP BY change
"""


def freshness_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures of all documents against an older state in which some were absent, longer or differently begun."""
    now = doc_signatures(spark, folder)
    old = now.where("id % 7 <> 0").withColumns({
        "content": F.when(F.col("id") % 3 == 0, F.lit("older")).otherwise(F.col("content")),
        "head": F.when(F.col("id") % 5 == 0, F.lit("older")).otherwise(F.col("head")),
        "words": F.when(F.col("id") % 6 == 0, F.col("words") * 2).otherwise(F.col("words")),
    })
    return C.freshness(old, now.where("id % 11 <> 0"))


FRESHNESS_SQL = """
WITH n AS (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL),
x AS (SELECT id, id % 7 <> 0 AS o, id % 11 <> 0 AS n, id % 3 = 0 AS c, id % 5 = 0 AS h, words AS w1, CASE WHEN id % 6 = 0 THEN words * 2 ELSE words END AS w0 FROM n)
SELECT id, CASE WHEN NOT o THEN 'new' WHEN NOT n THEN 'deleted' WHEN NOT c THEN 'noop' WHEN h OR (greatest(w0, w1) > 0 AND abs(w0 - w1) / greatest(w0, w1)::DOUBLE >= 0.1) THEN 'regenerate' ELSE 'update_mechanical' END AS decision FROM x WHERE o OR n
"""


def cascade_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left in each table after the files of collection 1 are deleted with all that hangs on them."""
    t = {n: table(spark, folder, n) for n in ("files", "chunks", "chunk_vectors", "links")}
    left = C.cascade_delete(t, t["files"].where("collection_id = 1").select("id"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


CASCADE_SQL = """
WITH g AS (SELECT DISTINCT id FROM files WHERE collection_id = 1)
SELECT 'files' AS table_name, count(*) AS n FROM files WHERE id NOT IN (FROM g)
UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE file_id IS NULL OR file_id NOT IN (FROM g)
UNION ALL SELECT 'chunk_vectors', count(*) FROM chunk_vectors WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT id FROM chunks WHERE file_id IN (FROM g) AND id IS NOT NULL)
UNION ALL SELECT 'links', count(*) FROM links WHERE source_file_id IS NULL OR source_file_id NOT IN (FROM g)
"""


def upserted_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files with their latest pass merged into the first by path: rows and total size per collection."""
    f = latest_files(spark, folder).select("path", "collection_id", "size_bytes")
    base = f.withColumn("size_bytes", F.lit(0).cast("long"))
    return C.upsert(base, f.where("size_bytes > 20000"), ["path"]).groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"))


UPSERT_SQL = "WITH f AS (SELECT id, arg_max(struct_pack(c := collection_id, s := size_bytes), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id) SELECT x.c AS collection_id, count(*) AS n, sum(CASE WHEN x.s > 20000 THEN x.s ELSE 0 END)::BIGINT AS size_bytes FROM f GROUP BY x.c"


def chunks_without_vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "chunk_vectors").select(F.col("chunk_id").alias("id"))
    return distinct_chunks(spark, folder).where("trim(content) <> ''").join(v, "id", "left_anti").groupBy("file_id").agg(F.count("*").alias("n"))


MISSING_SQL = "SELECT file_id, count(*) AS n FROM (SELECT DISTINCT id, file_id, content FROM chunks) c WHERE trim(content, ' ') <> '' AND NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.chunk_id = c.id) GROUP BY file_id"


def filtered_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors by glob, collection and time of the file, before any similarity."""
    files = latest_files(spark, folder).where(T.matches_any(F.col("path"), "*/docs/*, */repos/*") & F.col("collection_id").isin(1, 2, 3) & (F.col("mtime") >= 1_740_000_000))
    chunks = distinct_chunks(spark, folder).select(F.col("id").alias("chunk_id"), "file_id").join(files.select("file_id"), "file_id", "left_semi")
    return table(spark, folder, "chunk_vectors").select("chunk_id", "model", "dimensions").distinct().join(chunks, "chunk_id")


FILTERED_SQL = """
WITH f AS (SELECT id, arg_max(struct_pack(p := path, c := collection_id, m := mtime), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id),
s AS (SELECT id FROM f WHERE (x.p GLOB '*/docs/*' OR x.p GLOB '*/repos/*') AND x.c IN (1, 2, 3) AND x.m >= 1740000000)
SELECT v.chunk_id, v.model, v.dimensions, c.file_id FROM (SELECT DISTINCT chunk_id, model, dimensions FROM chunk_vectors) v JOIN (SELECT DISTINCT id, file_id FROM chunks) c ON v.chunk_id = c.id WHERE c.file_id IN (SELECT id FROM s)
"""


def extension_counts(spark: SparkSession, folder: str) -> DataFrame:
    return C.extension_counts(table(spark, folder, "files"))


EXT_SQL = "SELECT ext, count(*) AS n FROM (SELECT lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext FROM (SELECT DISTINCT path FROM files)) WHERE ext <> '' GROUP BY ext"


def collection_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Files, chunks, vectors and share of chunks with a vector, per collection."""
    files = latest_files(spark, folder).select("file_id", "collection_id", "size_bytes")
    v = table(spark, folder, "chunk_vectors").select(F.col("chunk_id").alias("id")).distinct().withColumn("has_vector", F.lit(1))
    chunks = distinct_chunks(spark, folder).select("id", "file_id").join(v, "id", "left").groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.count("has_vector").alias("n_vectors"))
    per = files.join(chunks, "file_id", "left").groupBy("collection_id").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("n_vectors"), F.lit(0)).alias("n_vectors"))
    c = table(spark, folder, "collections").select(F.col("id").alias("collection_id"), "name")
    return c.join(per, "collection_id", "left").select("collection_id", "name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_files", "size_bytes", "n_chunks", "n_vectors")], F.round(F.coalesce(100.0 * F.col("n_vectors") / F.nullif("n_chunks", F.lit(0)), F.lit(0.0)), 4).alias("coverage"))


STATS_SQL = """
WITH f AS (SELECT id, arg_max(struct_pack(c := collection_id, s := size_bytes), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id),
k AS (SELECT file_id, count(*) AS n, count(*) FILTER (id IN (SELECT chunk_id FROM chunk_vectors WHERE chunk_id IS NOT NULL)) AS v FROM (SELECT DISTINCT id, file_id FROM chunks) GROUP BY file_id),
p AS (SELECT x.c AS cid, count(*) AS nf, sum(x.s) AS s, sum(n) AS n, sum(v) AS v FROM f LEFT JOIN k ON f.id = k.file_id GROUP BY x.c)
SELECT id AS collection_id, name, coalesce(nf, 0) AS n_files, coalesce(s, 0)::BIGINT AS size_bytes, coalesce(n, 0)::BIGINT AS n_chunks, coalesce(v, 0)::BIGINT AS n_vectors, round(coalesce(100.0 * v / nullif(n, 0), 0), 4)::DOUBLE AS coverage FROM collections LEFT JOIN p ON cid = id
"""


def health(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of the index as rows: wrong counts, stale hashes of equal texts, files without chunks, empty collections."""
    files, chunks = latest_files(spark, folder), distinct_chunks(spark, folder)
    per_file = chunks.groupBy("file_id").agg(F.count("*").alias("n"))
    drift = files.join(per_file, "file_id", "left").where(~F.col("chunk_count").eqNullSafe(F.coalesce("n", F.lit(0)).cast("int")))
    no_chunks = files.join(per_file, "file_id", "left_anti")
    hashes = chunks.where("content is not null and chunk_hash is not null").groupBy("content").agg(F.count_distinct("chunk_hash").alias("k")).where("k > 1")
    empty = table(spark, folder, "collections").join(files.select(F.col("collection_id").alias("id")), "id", "left_anti")
    wrong_size = chunks.where("content is not null and char_count is not null and char_count <> octet_length(content)")
    row = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")
    return row("chunk_count_drift", drift).unionByName(row("files_without_chunks", no_chunks)).unionByName(row("texts_with_several_hashes", hashes)).unionByName(row("empty_collections", empty)).unionByName(row("wrong_char_count", wrong_size))


HEALTH_SQL = """
WITH f AS (SELECT id, arg_max(struct_pack(c := collection_id, k := chunk_count), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id),
c AS (SELECT DISTINCT id, file_id, content, chunk_hash, char_count FROM chunks), p AS (SELECT file_id, count(*) AS n FROM c GROUP BY file_id)
SELECT 'chunk_count_drift' AS check_name, count(*) AS n FROM f LEFT JOIN p ON f.id = p.file_id WHERE x.k IS DISTINCT FROM coalesce(n, 0)
UNION ALL SELECT 'files_without_chunks', count(*) FROM f WHERE id NOT IN (SELECT file_id FROM c WHERE file_id IS NOT NULL)
UNION ALL SELECT 'texts_with_several_hashes', count(*) FROM (SELECT content FROM c WHERE content IS NOT NULL AND chunk_hash IS NOT NULL GROUP BY content HAVING count(DISTINCT chunk_hash) > 1)
UNION ALL SELECT 'empty_collections', count(*) FROM collections WHERE id NOT IN (SELECT x.c FROM f WHERE x.c IS NOT NULL)
UNION ALL SELECT 'wrong_char_count', count(*) FROM c WHERE char_count <> octet_length(encode(content))
"""


def related_sections(spark: SparkSession, folder: str) -> DataFrame:
    """For every heading, trimmed and in lower case, in how many files and collections it stands."""
    files = latest_files(spark, folder).select("file_id", "collection_id")
    heading = F.lower(F.btrim(F.col("heading")))
    return distinct_chunks(spark, folder).select("file_id", heading.alias("h")).where("h <> ''").join(files, "file_id").groupBy("h").agg(F.count_distinct("file_id").alias("n_files"), F.count_distinct("collection_id").alias("n_collections"))


RELATED_SQL = "WITH f AS (SELECT id, arg_max(collection_id, (last_indexed, coalesce(mtime, 0))) AS c FROM files GROUP BY id) SELECT lower(trim(heading, ' ')) AS h, count(DISTINCT file_id) AS n_files, count(DISTINCT f.c) AS n_collections FROM (SELECT DISTINCT id, file_id, heading FROM chunks) k JOIN f ON f.id = k.file_id WHERE trim(heading, ' ') <> '' GROUP BY h"


def siblings(spark: SparkSession, folder: str) -> DataFrame:
    """The next and the previous chunk under the same parent."""
    c = distinct_chunks(spark, folder).where("file_id is not null").select("id", "file_id", "chunk_order", "parent_chunk_id")
    w = Window.partitionBy("file_id", "parent_chunk_id").orderBy("chunk_order", "id")
    return c.select("id", F.lag("id").over(w).alias("previous_id"), F.lead("id").over(w).alias("next_id"))


SIBLING_SQL = "SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM (SELECT DISTINCT id, file_id, chunk_order, parent_chunk_id FROM chunks WHERE file_id IS NOT NULL) WINDOW w AS (PARTITION BY file_id, parent_chunk_id ORDER BY chunk_order, id)"


def folder_tree_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Per collection: folders, those with an index or a defect, files, words and deepest path."""
    f = table(spark, folder, "folders").dropDuplicates(["collection_id", "path"])
    depth = F.size(F.split("path", "/"))
    return f.groupBy("collection_id").agg(F.count("*").alias("n"), F.count_if("has_index").alias("indexed"), F.count_if("ignored").alias("ignored"), F.count("parse_error").alias("defects"), F.sum("file_count").alias("files"), F.sum("word_count").alias("words"), F.max(depth).alias("deepest"), F.count_if(F.col("depth") != depth).alias("wrong_depth"))


TREE_SQL = "SELECT collection_id, count(*) AS n, count(*) FILTER (has_index) AS indexed, count(*) FILTER (ignored) AS ignored, count(parse_error) AS defects, sum(file_count)::BIGINT AS files, sum(word_count)::BIGINT AS words, max(len(string_split(path, '/')))::INTEGER AS deepest, count(*) FILTER (depth <> len(string_split(path, '/'))) AS wrong_depth FROM (SELECT DISTINCT ON (collection_id, path) * FROM folders) GROUP BY collection_id"


def nearest_annotation(spark: SparkSession, folder: str) -> DataFrame:
    """For every file the nearest folder above it that states its purpose."""
    roots = table(spark, folder, "collections").select(F.col("id").alias("collection_id"), F.col("path").alias("root"))
    files = latest_files(spark, folder).join(roots, "collection_id").where(F.col("path").startswith(F.concat("root", F.lit("/")))).select("file_id", "collection_id", F.expr("substring(path, length(root) + 2)").alias("rel"))
    parts = F.split("rel", "/")
    up = files.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    notes = table(spark, folder, "folders").where("purpose is not null and purpose <> ''").select("collection_id", F.col("path").alias("dir"), "purpose").distinct()
    return up.join(notes, ["collection_id", "dir"]).groupBy("file_id").agg(F.max_by("dir", F.length("dir")).alias("folder_path"), F.max_by("purpose", F.length("dir")).alias("purpose"))


NOTE_SQL = """
WITH f AS (SELECT id, arg_max(struct_pack(p := path, c := collection_id), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id),
r AS (SELECT f.id AS file_id, x.c AS cid, substr(x.p, length(c.path) + 2) AS rel FROM f JOIN collections c ON c.id = x.c AND starts_with(x.p, c.path || '/')),
n AS (SELECT DISTINCT collection_id, path, purpose FROM folders WHERE purpose <> '')
SELECT file_id, arg_max(path, length(path)) AS folder_path, arg_max(purpose, length(path)) AS purpose FROM r JOIN n ON n.collection_id = cid AND starts_with(rel, n.path || '/') GROUP BY file_id
"""


def reference_status(spark: SparkSession, folder: str) -> DataFrame:
    """Check results per kind and status with mean confidence, totals included (grouping sets)."""
    r = table(spark, folder, "ref_results").dropDuplicates(["id"])
    return r.rollup("kind", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence")).select(F.coalesce("kind", F.lit("(all)")).alias("kind"), F.coalesce("status", F.lit("(all)")).alias("status"), "n", "confidence")


STATUS_SQL = "SELECT coalesce(kind, '(all)') AS kind, coalesce(s, '(all)') AS status, count(*) AS n, round(avg(confidence), 9) AS confidence FROM (SELECT DISTINCT ON (id) kind, coalesce(status, 'unknown') AS s, confidence FROM ref_results) GROUP BY ROLLUP (kind, s)"


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return C.latency_metrics(table(spark, folder, "events"), ["event_type"], "value")


LATENCY_SQL = "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, list(value ORDER BY value)[floor((count(*) - 1) * 0.5)::INTEGER + 1] AS low50, list(value ORDER BY value)[floor((count(*) - 1) * 0.95)::INTEGER + 1] AS low95 FROM events WHERE value IS NOT NULL GROUP BY event_type"


def weekly_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Events, users and values per Monday-based week and type: the log rotation of the index."""
    e = table(spark, folder, "events")
    return e.groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


WEEK_SQL = "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY ALL"


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users: events less than six hours apart belong together."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    e = table(spark, folder, "events").withColumn("starts", F.when(gap.isNull() | (gap > 6 * 3600 * 1_000_000), 1).otherwise(0)).withColumn("session", F.sum("starts").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


SESSION_SQL = "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, round(sum(value), 2) AS total FROM x GROUP BY ALL"


def cache_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Result-cache keys per user: time to the previous use within 300 seconds is a hit, else a miss; keys are quantised to 300 s."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    secs = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, folder, "events").withColumn("hit", F.coalesce((secs - F.lag(secs).over(w)) <= 300, F.lit(False))).withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 300_000_000))
    return e.groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_distinct("user_id", "bucket").alias("keys"))


CACHE_SQL = "SELECT event_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(DISTINCT (user_id, b)) AS keys FROM (SELECT event_type, user_id, epoch_us(ts) // 300000000 AS b, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 300 SECOND, false) AS hit FROM events) GROUP BY event_type"


def sql_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    """A read-only statement over the catalog as temporary views."""
    from corpusloom.plans.admin import run_sql

    return run_sql(spark, folder, SQL_TEXT, None)


SQL_TEXT = "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= DATE '1996-01-01' GROUP BY n_name"


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


PRICING_SQL = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"

QUERIES = {
    "collection_membership": collection_membership, "section_rollup": section_rollup, "indexing_changes": indexing_changes, "freshness_decisions": freshness_decisions, "cascade_counts": cascade_counts,
    "upserted_files": upserted_files, "chunks_without_vectors": chunks_without_vectors, "filtered_vectors": filtered_vectors, "extension_counts": extension_counts, "collection_stats": collection_stats, "health": health,
    "related_sections": related_sections, "siblings": siblings, "folder_tree_stats": folder_tree_stats, "nearest_annotation": nearest_annotation, "reference_status": reference_status,
    "latency_percentiles": latency_percentiles, "weekly_usage": weekly_usage, "user_sessions": user_sessions, "cache_expiry": cache_expiry, "sql_passthrough": sql_passthrough, "pricing_summary": pricing_summary,
}
SQL = {
    "collection_membership": MEMBERSHIP_SQL, "section_rollup": ROLLUP_SQL, "indexing_changes": CHANGES_SQL, "freshness_decisions": FRESHNESS_SQL, "cascade_counts": CASCADE_SQL,
    "upserted_files": UPSERT_SQL, "chunks_without_vectors": MISSING_SQL, "filtered_vectors": FILTERED_SQL, "extension_counts": EXT_SQL, "collection_stats": STATS_SQL, "health": HEALTH_SQL,
    "related_sections": RELATED_SQL, "siblings": SIBLING_SQL, "folder_tree_stats": TREE_SQL, "nearest_annotation": NOTE_SQL, "reference_status": STATUS_SQL,
    "latency_percentiles": LATENCY_SQL, "weekly_usage": WEEK_SQL, "user_sessions": SESSION_SQL, "cache_expiry": CACHE_SQL, "sql_passthrough": SQL_TEXT, "pricing_summary": PRICING_SQL,
}
