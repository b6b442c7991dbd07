"""Refreshing the index, reading sections, comparing runs, and formats at work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import formats as X
from corpusloom.functions.hashing import content_hash
from corpusloom.functions.paths import parent_of
from corpusloom.operators import documents as D
from corpusloom.operators import inspection as I
from corpusloom.operators import refresh as R
from corpusloom.plans.corpus import _HEADS, _SLUG, _docs
from corpusloom.plans.inspection import AUTHORITY_SQL
from corpusloom.plans.outline import CHUNKS_SQL
from corpusloom.plans.search import latest_files
from corpusloom.runtime import table


def refreshed_index(spark: SparkSession, folder: str) -> DataFrame:
    """Files and chunks per kind of change, after documents are refreshed against an older catalog in which some were absent, other or untouched."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.concat(F.lit("/docs/"), "doc_id").alias("path"), "text")
    scanned = d.where("doc_id % 11 <> 0").select("path", F.lit(200).cast("long").alias("mtime"), "text")
    known = d.where("doc_id % 7 <> 0")
    files = known.select(F.col("doc_id").alias("id"), "path", F.when(F.col("doc_id") % 5 == 0, F.lit("older")).otherwise(content_hash(F.col("text"))).alias("file_hash"), F.when(F.col("doc_id") % 3 == 0, 100).otherwise(200).cast("long").alias("mtime"))
    one = known.select("doc_id", F.col("doc_id").alias("file_id"), F.lit(0).alias("chunk_order"), F.lit("").alias("section_id"), F.lit("").alias("heading"), F.lit(0).alias("level"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("old").alias("content")).withColumnRenamed("doc_id", "id")
    new = R.refresh(scanned, files, one)
    per_file = new["chunks"].groupBy("file_id").agg(F.count("*").alias("n"))
    live = new["files"].join(per_file, F.col("id") == F.col("file_id"), "left").select("path", F.coalesce("n", F.lit(0)).alias("n"))
    return new["changes"].join(live, "path", "left").groupBy("change").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


REFRESH_SQL = f"""
WITH o AS (SELECT id, count(*) AS n FROM ({CHUNKS_SQL}) GROUP BY id), d AS (SELECT doc_id AS id, doc_id % 11 <> 0 AS there, doc_id % 7 <> 0 AS known FROM documents WHERE text IS NOT NULL),
x AS (SELECT id, CASE WHEN NOT known THEN 'new' WHEN NOT there THEN 'deleted' WHEN id % 3 <> 0 THEN 'unchanged' WHEN id % 5 <> 0 THEN 'touched' ELSE 'changed' END AS change FROM d WHERE there OR known)
SELECT change, count(*) AS files, sum(CASE WHEN change IN ('unchanged', 'touched') THEN 1 WHEN change = 'deleted' THEN 0 ELSE coalesce(n, 0) END)::BIGINT AS chunks FROM x LEFT JOIN o USING (id) GROUP BY change
"""


def read_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The last section of every document, asked for by its heading in small letters."""
    docs = _docs(spark, folder).select("id", "text")
    spans = D.sections(docs)
    wanted = spans.groupBy("id").agg(F.lower(F.max_by("heading", "start_line")).alias("name"))
    return R.read_sections(docs, spans, wanted).select("id", "start_line", "end_line", F.md5("text").alias("digest"))


READ_SQL = f"""
WITH {_HEADS}, sp AS (SELECT a.id, a.line_no AS s, coalesce(min(b.line_no) - 1, any_value(a.n)) AS e, any_value(a.heading) AS heading, {_SLUG('any_value(a.heading)')} AS slug FROM h a LEFT JOIN h b ON a.id = b.id AND b.line_no > a.line_no AND b.level <= a.level GROUP BY a.id, a.line_no),
w AS (SELECT id, lower(trim(lower(arg_max(heading, s)), ' ')) AS key FROM sp GROUP BY id),
m AS (SELECT sp.id, min(s) AS s, arg_min(e, s) AS e FROM sp JOIN w USING (id) WHERE key <> '' AND key IN (lower(trim(heading, ' ')), slug, regexp_replace(slug, '^[0-9]+-', '')) GROUP BY sp.id)
SELECT m.id, s::INTEGER AS start_line, e::INTEGER AS end_line, md5(array_to_string(list_slice(string_split(text, chr(10)), s, e), chr(10))) AS digest FROM m JOIN documents ON doc_id = m.id
"""


def authority_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The files of every folder in batches of five, from the most telling on."""
    f = latest_files(spark, folder).where("path is not null").select(parent_of(F.col("path")).alias("folder"), F.col("file_id").cast("string").alias("path"), F.round(I.authority(F.col("path"), F.col("size_bytes"), F.col("title")), 6).alias("authority"))
    return R.authority_batches(f, 5)


BATCH_SQL = f"""
WITH a AS ({AUTHORITY_SQL}), p AS (SELECT id AS file_id, regexp_replace(arg_max(path, (last_indexed, coalesce(mtime, 0))), '/[^/]*$', '') AS folder FROM files GROUP BY id),
r AS (SELECT folder, file_id::VARCHAR AS path, authority, row_number() OVER (PARTITION BY folder ORDER BY authority DESC NULLS LAST, file_id::VARCHAR) AS place FROM a JOIN p USING (file_id))
SELECT folder, path, authority, ((place - 1) // 5)::INTEGER AS batch, place::INTEGER AS place FROM r
"""


def formatted_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every indexed file with a label, its size and its age in words, and the label read back."""
    f = latest_files(spark, folder).select("file_id", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size"), "last_indexed")
    age = F.lit(1_800_000_000) - F.col("last_indexed")
    out = f.select("file_id", X.label(F.col("file_id")).alias("label"), X.format_bytes(F.col("size") * F.col("size")).alias("size"), X.format_duration(age).alias("age"))
    return out.withColumns({"label_index": X.label_index(F.col("label")), "age_seconds": X.duration_seconds(F.col("age"))})


_PLACES = [0, 26, 702, 18278, 475254]
_LABEL = "CASE " + " ".join(f"WHEN n < {_PLACES[k + 1]} THEN " + " || ".join(f"chr((97 + ((n - {_PLACES[k]}) // {26 ** (k - i)}) % 26)::INTEGER)" for i in range(k + 1)) for k in range(4)) + " END"
FORMAT_SQL = f"""
WITH f AS (SELECT id AS n, arg_max(struct_pack(s := size_bytes, l := last_indexed), (last_indexed, coalesce(mtime, 0))) AS x FROM files GROUP BY id), v AS (SELECT n, coalesce(x.s, 0)::BIGINT * coalesce(x.s, 0)::BIGINT AS b, 1800000000 - x.l AS age FROM f),
w AS (SELECT n AS file_id, {_LABEL} AS label, CASE WHEN b < 1024 THEN b || ' B' {" ".join(f"WHEN b < {1024 ** (k + 1)} THEN printf('%.1f', b / {1024 ** k}::DOUBLE) || ' {u}B'" for k, u in enumerate("KMGT", 1))} END AS size,
 CASE WHEN age < 3600 THEN (age // 60) || 'm' WHEN age < 86400 THEN (age // 3600) || 'h' ELSE (age // 86400) || 'd' END AS age, CASE WHEN age < 3600 THEN age // 60 * 60 WHEN age < 86400 THEN age // 3600 * 3600 ELSE age // 86400 * 86400 END AS age_seconds FROM v)
SELECT file_id, label, size, age, file_id AS label_index, age_seconds FROM w
"""


def json_in_text(spark: SparkSession, folder: str) -> DataFrame:
    """The properties of every event, taken out of plain, fenced and surrounding text."""
    e = table(spark, folder, "events").where("props is not null").select("event_id", "props")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nend"))).otherwise(F.concat(F.lit("as } told "), "props", F.lit(" and {more")))
    return e.select("event_id", F.get_json_object(X.json_text(text), "$.k").cast("int").alias("k"))


JSON_SQL = "SELECT event_id, (props ->> '$.k')::INTEGER AS k FROM events WHERE props IS NOT NULL"


def vector_codecs(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors to bytes and back: length in bytes, sum of squares after the round trip, and the sum of the vector times 100 as small integers."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding").withColumn("data", X.float_bytes(F.col("embedding"))).withColumn("back", X.floats_of(F.col("data")))
    ints = F.aggregate(X.small_ints(F.transform("embedding", lambda x: x * F.lit(100).cast("float"))), F.lit(0), lambda acc, x: acc + x.cast("int"))
    squares = F.aggregate("back", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return v.select("vec_id", F.length("data").alias("n_bytes"), F.round(squares, 6).alias("squares"), ints.alias("small_sum"))


CODEC_SQL = "SELECT vec_id, (4 * len(embedding))::INTEGER AS n_bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squares, list_sum(list_transform(embedding, lambda x: trunc(x * 100::FLOAT)::INTEGER))::INTEGER AS small_sum FROM embeddings"

QUERIES = {
    "refreshed_index": refreshed_index, "read_sections": read_sections, "authority_batches": authority_batches, "formatted_files": formatted_files,
    "json_in_text": json_in_text, "vector_codecs": vector_codecs,
}
SQL = {
    "refreshed_index": REFRESH_SQL, "read_sections": READ_SQL, "authority_batches": BATCH_SQL, "formatted_files": FORMAT_SQL, "json_in_text": JSON_SQL, "vector_codecs": CODEC_SQL,
}
