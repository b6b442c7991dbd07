"""Retrieval queries: lexical, vector, hybrid, and the steps that rank and thin out results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.operators import retrieval as R
from corpusloom.plans.links import FILES_SQL, LINKS_SQL, latest_files, resolved_links
from corpusloom.runtime import table

NOW = 1_780_000_000  # 'now' is a parameter everywhere, so results can be repeated
TERMS = ["threshold", "glossary", "snapshot", "orphan"]


@dataclass
class SearchConfig:
    """Tunables of hybrid search with their defaults."""

    model: str = "ember-64"
    top_k: int = 20
    rrf_k: int = 60
    boost_top: int = 3
    boost: float = 2.0
    weights: tuple[float, float] = (1.0, 1.0)
    recency_weight: float = 0.2
    half_life_days: float = 30.0
    backlink_weight: float = 0.1
    chunks_per_file: int = 3
    least_results: int = 10
    most_results: int = 20
    path_boosts: list[tuple[str, float]] = field(default_factory=lambda: [("**/docs/**", 1.1), ("**/archive/**", 0.8)])


def distinct_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").dropDuplicates(["id"])


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Contents with repeated rows, which the index drops by id once contents are reduced to terms."""
    return table(spark, folder, "chunks").select("id", F.col("content").alias("text"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.ranked(R.bm25(chunk_texts(spark, folder), TERMS), 20).select("id", F.round("score", 6).alias("score"), "rank")


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_CHUNKS = "SELECT DISTINCT id, file_id, chunk_order, start_line, end_line, char_count, section_id, heading, heading_level, parent_chunk_id, content FROM chunks"
_BM25 = f"""
docs AS (SELECT id, {_TOKENS} AS toks FROM (SELECT DISTINCT id, content AS text FROM chunks) WHERE text IS NOT NULL),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM docs),
tf AS (SELECT id, len(toks) AS dl, t AS term, len(list_filter(toks, lambda x: x = t)) AS tf FROM docs, (SELECT unnest({TERMS}) AS t)),
hit AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM hit JOIN df USING (term), stats GROUP BY id)
"""
BM25_SQL = f"WITH {_BM25} SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS rank FROM bm ORDER BY bm.score DESC, id LIMIT 20"


def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and total frequency of every term: the statistics of the inverted index."""
    p = R.postings(chunk_texts(spark, folder))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


TERM_SQL = f"""
WITH toks AS (SELECT id, unnest({_TOKENS}) AS term FROM (SELECT DISTINCT id, content AS text FROM chunks))
SELECT term, count(DISTINCT id) AS df, count(*)::BIGINT AS cf FROM toks GROUP BY term
"""


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return v, list(v.where("id = 0").first()["v"])


def vector_topk_dot(spark: SparkSession, folder: str) -> DataFrame:
    v, q = _vectors(spark, folder)
    return R.nearest(v, q, 20).select("id", F.round("score", 6).alias("score"), "rank")


def vector_topk_cosine_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The filter on the label comes before the similarity."""
    v, q = _vectors(spark, folder)
    return R.nearest(v.where("label in (1, 2)"), q, 20, "cosine").select("id", F.round("score", 6).alias("score"), "rank")


def vector_topk_hamming(spark: SparkSession, folder: str) -> DataFrame:
    v, q = _vectors(spark, folder)
    return R.nearest(v, q, 20, "hamming").select("id", F.round("score", 6).alias("score"), "rank")


def _vector_sql(score: str, where: str = "") -> str:
    return f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS id, {score} AS score FROM embeddings, q {where})
SELECT id, round(score, 6) AS score, (row_number() OVER (ORDER BY score DESC, id))::INTEGER AS rank FROM s ORDER BY s.score DESC, id LIMIT 20
"""


_DOT = "list_sum(list_transform(list_zip(embedding, qv), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
_HAMMING = "1 - len(list_filter(list_zip(embedding, qv), lambda p: (p[1] > 0) <> (p[2] > 0))) / len(qv)::DOUBLE"


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """Backlinks per target path, without links of a file to itself."""
    return resolved_links(spark, folder).where("target <> source_path").groupBy(F.col("target").alias("target_path")).agg(F.count("*").alias("backlinks"))


def hybrid_search(spark: SparkSession, folder: str, config: SearchConfig | None = None) -> DataFrame:
    """The whole read path: lexical and vector rankings, fusion, signals, one row per section, content dedup, per-file cap, adaptive size.

    The query vector is that of the best lexical hit that has one, among the vectors of its model.
    """
    c = config or SearchConfig()
    lexical = R.ranked(R.bm25(chunk_texts(spark, folder), TERMS), 3 * c.top_k)
    vectors = table(spark, folder, "chunk_vectors").where(F.col("vector").isNotNull() & (F.size("vector") == F.col("dimensions")) & (F.col("model") == c.model)).dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("id"), F.col("vector").alias("v"))
    seed = lexical.join(vectors, "id").orderBy("rank").select("v").first()
    rankings = R.nearest(vectors, list(seed["v"]), 3 * c.top_k, "cosine") if seed else lexical.limit(0)
    fused = R.rrf(lexical, rankings, c.rrf_k, c.boost_top, c.boost, c.weights)
    files = latest_files(spark, folder)
    # two rankings of top k candidates: the only rows whose contents are fetched
    chunks = table(spark, folder, "chunks").select("id", "file_id", "section_id", "heading", "content").join(F.broadcast(fused), "id").dropDuplicates(["id"])
    rows = chunks.join(files.select("file_id", F.col("path").alias("file"), "mtime"), "file_id")
    rows = rows.join(_signals(spark, folder), F.col("file") == F.col("target_path"), "left")
    score = S.final_score(F.col("score"), S.recency(F.col("mtime"), NOW, c.half_life_days), c.recency_weight, F.lit(1.0)) * S.backlink_boost(F.col("backlinks"), c.backlink_weight) * S.path_boost(F.col("file"), c.path_boosts)
    rows = R.best_per_section(rows.withColumn("score", score)).select("id", "file", "section", "heading", "score", "content")
    kept = R.capped_per_file(R.dedup_content(rows), c.chunks_per_file, [F.desc("score"), F.asc("id")])
    top = R.ranked(kept, c.most_results)
    n = R.adaptive_k(F.array_sort(F.collect_list("score").over(Window.partitionBy(F.lit(1))), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), c.least_results, c.most_results)
    return top.withColumn("keep", n).where("rank <= keep").select("rank", "id", "file", "section", F.round("score", 6).alias("score"), "n_duplicates")


_FILES = FILES_SQL
HYBRID_SQL = f"""
WITH {_BM25},
lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm ORDER BY score DESC, id LIMIT 60),
vec0 AS (SELECT DISTINCT chunk_id AS id, vector AS v FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) = dimensions AND model = 'ember-64'),
q AS (SELECT v AS qv FROM lex JOIN vec0 USING (id) ORDER BY r LIMIT 1),
sim AS (SELECT id, CASE WHEN nv > 0 AND nq > 0 THEN d / (nv * nq) ELSE 0 END AS s FROM (SELECT id, {_DOT.replace("embedding", "v")} AS d, {_NORM("v")} AS nv, {_NORM("qv")} AS nq FROM vec0, q)),
vr AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM sim ORDER BY s DESC, id LIMIT 60),
fused AS (SELECT coalesce(l.id, v.id) AS id, coalesce(CASE WHEN l.r <= 3 THEN 2.0 ELSE 1.0 END / (60 + l.r), 0) + coalesce(CASE WHEN v.r <= 3 THEN 2.0 ELSE 1.0 END / (60 + v.r), 0) AS score FROM lex l FULL JOIN vr v ON l.id = v.id),
{_FILES},
{LINKS_SQL}, back AS (SELECT target AS target_path, count(*) AS n FROM lk WHERE target <> source_path GROUP BY target),
c AS ({_CHUNKS}),
rows AS (SELECT c.id, f.p AS file, split_part(coalesce(section_id, ''), '::', 1) AS section, content,
  score * (1 + 0.2 * coalesce(pow(0.5, greatest(0, (1780000000 - f.m) / 86400.0) / 30), 1)) * (1 + 0.1 * log2(1.0 + coalesce(n, 0))) *
  CASE WHEN regexp_matches(f.p, '^(.*/)?docs/.*$') THEN 1.1 WHEN regexp_matches(f.p, '^(.*/)?archive/.*$') THEN 0.8 ELSE 1 END AS score
  FROM fused JOIN c ON c.id = fused.id JOIN files_l ON files_l.file_id = c.file_id LEFT JOIN back ON target_path = f.p),
sec AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY file, section ORDER BY score DESC, id) = 1),
ded AS (SELECT *, count(*) OVER (PARTITION BY content) - 1 AS n_duplicates FROM sec QUALIFY row_number() OVER (PARTITION BY content ORDER BY score DESC, id) = 1),
cap AS (SELECT * FROM ded QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, id) <= 3),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cap ORDER BY score DESC, id LIMIT 20),
a AS (SELECT list(score ORDER BY score DESC) AS s FROM top),
k AS (SELECT CASE WHEN len(s) < 5 THEN len(s) WHEN NOT ((s[1]-s[2])/s[1] > 0.05 OR (s[2]-s[3])/s[2] > 0.05 OR (s[3]-s[4])/s[3] > 0.05 OR (s[4]-s[5])/s[4] > 0.05) OR 1 - s[5]/s[1] <= 0.1 THEN 20 WHEN 1 - s[5]/s[1] >= 0.5 THEN 10 ELSE round(20 - (1 - s[5]/s[1] - 0.1) / 0.4 * 10) END AS keep FROM a)
SELECT rank::INTEGER AS rank, id, file, section, round(score, 6) AS score, n_duplicates FROM top, k WHERE rank <= keep
"""


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Two rankings of customers, by balance and by order volume, fused."""
    customers = R.ranked(table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 200)
    volume = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return R.rrf(customers, R.ranked(volume, 200)).select("id", F.round("score", 9).alias("score"), "lexical_rank", "vector_rank")


RRF_SQL = """
WITH l AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 200),
v0 AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey),
v AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM v0 ORDER BY s DESC, id LIMIT 200)
SELECT coalesce(l.id, v.id) AS id, round(coalesce(CASE WHEN l.r <= 3 THEN 2.0 ELSE 1.0 END / (60 + l.r), 0) + coalesce(CASE WHEN v.r <= 3 THEN 2.0 ELSE 1.0 END / (60 + v.r), 0), 9) AS score, l.r::INTEGER AS lexical_rank, v.r::INTEGER AS vector_rank FROM l FULL JOIN v ON l.id = v.id
"""


def dedup_content(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with equal content as one, the longest-lived of them kept, with the number of copies."""
    rows = table(spark, folder, "chunks").select("id", F.sha2("content", 256).alias("content"), F.coalesce("char_count", F.lit(0)).cast("double").alias("score")).distinct()
    return R.dedup_content(rows)


DEDUP_SQL = """
WITH c AS (SELECT DISTINCT id, content, coalesce(char_count, 0)::DOUBLE AS score, coalesce(content, '#' || id) AS k FROM chunks)
SELECT id, score, count(*) OVER (PARTITION BY k, content IS NULL) - 1 AS n_duplicates FROM c QUALIFY row_number() OVER (PARTITION BY k, content IS NULL ORDER BY score DESC, id) = 1
"""


def per_file_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The three longest chunks of every file."""
    rows = distinct_chunks(spark, folder).where("char_count is not null and file_id is not null").select("id", F.col("file_id").alias("file"), "char_count")
    return R.capped_per_file(rows, 3, [F.desc("char_count"), F.asc("id")])


CAP_SQL = "SELECT DISTINCT id, file_id AS file, char_count FROM (SELECT DISTINCT id, file_id, char_count FROM chunks WHERE char_count IS NOT NULL AND file_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY char_count DESC, id) <= 3"


def best_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The longest chunk of every section."""
    rows = distinct_chunks(spark, folder).where("file_id is not null").select("id", F.col("file_id").alias("file"), "section_id", F.coalesce("char_count", F.lit(0)).alias("score"))
    return R.best_per_section(rows).select("id", "file", "section", "score")


SECTIONS_SQL = "SELECT id, file_id AS file, split_part(coalesce(section_id, ''), '::', 1) AS section, coalesce(char_count, 0) AS score FROM (SELECT DISTINCT id, file_id, section_id, char_count FROM chunks WHERE file_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file_id, split_part(coalesce(section_id, ''), '::', 1) ORDER BY coalesce(char_count, 0) DESC, id) = 1"


def adaptive_results(spark: SparkSession, folder: str) -> DataFrame:
    """For every part brand: how many of its parts by price an adaptive result list would keep."""
    p = table(spark, folder, "part").groupBy("p_brand").agg(F.reverse(F.array_sort(F.collect_list("p_retailprice"))).alias("s"))
    return p.select("p_brand", R.adaptive_k(F.transform("s", lambda x: x - 850.0), 10, 20).alias("keep"))


ADAPTIVE_SQL = """
WITH a AS (SELECT p_brand, list_transform(list(p_retailprice ORDER BY p_retailprice DESC), lambda x: x - 850.0) AS s FROM part GROUP BY p_brand)
SELECT p_brand, (CASE WHEN len(s) < 5 THEN len(s) WHEN s[1] = 0 THEN 20
 WHEN NOT ((s[1] > 0 AND (s[1]-s[2])/s[1] > 0.05) OR (s[2] > 0 AND (s[2]-s[3])/s[2] > 0.05) OR (s[3] > 0 AND (s[3]-s[4])/s[3] > 0.05) OR (s[4] > 0 AND (s[4]-s[5])/s[4] > 0.05)) OR 1 - s[5]/s[1] <= 0.1 THEN 20
 WHEN 1 - s[5]/s[1] >= 0.5 THEN 10 ELSE round(20 - (1 - s[5]/s[1] - 0.1) / 0.4 * 10) END)::INTEGER AS keep FROM a
"""


def signal_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: recency, backlink boost, path boost and the final score of a base of 1."""
    files = latest_files(spark, folder).join(_signals(spark, folder), F.col("path") == F.col("target_path"), "left")
    recent = S.recency(F.col("mtime"), NOW, 30)
    boost = S.path_boost(F.col("path"), SearchConfig().path_boosts)
    final = S.final_score(F.lit(1.0), recent, 0.2, F.lit(1.0)) * S.backlink_boost(F.col("backlinks"), 0.1) * boost
    return files.select("file_id", F.round(recent, 6).alias("recency"), F.round(S.backlink_boost(F.col("backlinks"), 0.1), 6).alias("backlink"), boost.alias("path_boost"), F.round(final, 6).alias("score"))


SIGNALS_SQL = f"""
WITH {_FILES},
{LINKS_SQL}, back AS (SELECT target AS target_path, count(*) AS n FROM lk WHERE target <> source_path GROUP BY target),
x AS (SELECT file_id, coalesce(pow(0.5, greatest(0, (1780000000 - f.m) / 86400.0) / 30), 1) AS rec, 1 + 0.1 * log2(1.0 + coalesce(n, 0)) AS b, CASE WHEN regexp_matches(f.p, '^(.*/)?docs/.*$') THEN 1.1::DOUBLE WHEN regexp_matches(f.p, '^(.*/)?archive/.*$') THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS pb FROM files_l LEFT JOIN back ON target_path = f.p)
SELECT file_id, round(rec, 6) AS recency, round(b, 6) AS backlink, pb AS path_boost, round((1 + rec * 0.2) * b * pb, 6) AS score FROM x
"""


def feedback_boosts(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback per user of the event stream: purchases speak for, errors against."""
    e = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("event_type") == "view").alias("reads"))
    return e.select("user_id", "good", "bad", F.round(S.feedback_boost(F.col("good"), F.col("bad")), 6).alias("boost"), F.round(S.read_boost(F.col("reads"), 0.05), 6).alias("read_boost"))


FEEDBACK_SQL = """
SELECT user_id, good, bad, round(CASE WHEN good + bad = 0 THEN 1 ELSE 0.7 + 0.6 * (good + 1) / (good + bad + 2) END, 6)::DOUBLE AS boost, round(1 + 0.05 * sqrt(reads), 6)::DOUBLE AS read_boost
FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'view') AS reads FROM events GROUP BY user_id)
"""


def line_search(spark: SparkSession, folder: str) -> DataFrame:
    """Search of single lines: the statistics are those of each document, hits come with a line of context on either side.

    All is counted within a document's row: only lines that are hit leave it, with the lines beside them.
    """
    once = lambda c: F.explode(F.array(c))
    docs = table(spark, folder, "documents").where(F.lower("text").rlike("|".join(TERMS))).select("doc_id", once(F.split("text", "\n")).alias("lines"))
    counted = F.filter(F.transform("lines", lambda s, k: F.struct(k.alias("k"), s.alias("line"), R.tokens(s).alias("toks"))), lambda x: F.trim(x["line"]) != "")
    docs = docs.select("doc_id", "lines", once(counted).alias("c"))
    dl = F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + F.size(x["toks"])) / F.size("c")
    hit = F.filter("c", lambda x: F.arrays_overlap(x["toks"], F.array(*[F.lit(t) for t in TERMS])))
    beside = lambda k: F.coalesce(F.when(k >= 0, F.get("lines", k)), F.lit(""))
    uses = lambda toks, t: F.size(F.filter(toks, lambda y: y == t))
    lines_with = lambda i: F.size(F.filter("hits", lambda x: F.get(x["tf"], F.lit(i)) > 0))
    rich = F.transform(hit, lambda x: F.struct(x["k"].alias("k"), x["line"].alias("line"), F.size(x["toks"]).alias("dl"), F.array(*[uses(x["toks"], t) for t in TERMS]).alias("tf"), beside(x["k"] - 1).alias("before"), beside(x["k"] + 1).alias("after")))
    found = docs.where(F.size("c") > 0).select("doc_id", F.size("c").alias("n"), dl.alias("avg_dl"), once(rich).alias("hits")).where(F.size("hits") > 0)
    df = F.array(*[lines_with(i) for i in range(len(TERMS))])
    found = found.select("doc_id", "n", "avg_dl", df.alias("df"), F.explode("hits").alias("x")).select("doc_id", "n", "avg_dl", "df", "x.*")

    def weight(i: int) -> Column:
        tf, d = F.get("tf", F.lit(i)), F.get("df", F.lit(i))
        return F.when(tf > 0, F.log(1.0 + (F.col("n") - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avg_dl")))).otherwise(0.0)

    hits = found.select("doc_id", (F.col("k") + 1).alias("line_no"), sum(map(weight, range(len(TERMS)))).alias("score"), "before", "line", "after")
    return hits.orderBy(F.desc(F.round("score", 9)), "doc_id", "line_no").limit(50).withColumn("score", F.round("score", 6))


LINE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM d),
t AS (SELECT *, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM l WHERE trim(line, ' ') <> ''),
p AS (SELECT doc_id, count(*) AS n, avg(len(toks)) AS adl FROM t GROUP BY doc_id),
h AS (SELECT doc_id, k, lines, line, toks, x AS term, len(list_filter(toks, lambda y: y = x)) AS tf FROM t, (SELECT unnest({TERMS}) AS x) WHERE list_contains(toks, x)),
df AS (SELECT doc_id, term, count(*) AS df FROM h GROUP BY doc_id, term),
s AS (SELECT doc_id, k, any_value(lines) AS lines, any_value(line) AS line, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / adl))) AS score FROM h JOIN df USING (doc_id, term) JOIN p USING (doc_id) GROUP BY doc_id, k)
SELECT doc_id, k::INTEGER AS line_no, round(score, 6) AS score, CASE WHEN k > 1 THEN lines[k - 1] ELSE '' END AS before, line, coalesce(lines[k + 1], '') AS after FROM s ORDER BY round(s.score, 9) DESC, doc_id, k LIMIT 50
"""

QUERIES = {
    "hybrid_search": hybrid_search, "bm25_topk": bm25_topk, "term_statistics": term_statistics, "vector_topk_dot": vector_topk_dot, "vector_topk_cosine_filtered": vector_topk_cosine_filtered,
    "vector_topk_hamming": vector_topk_hamming, "rrf_fusion": rrf_fusion, "dedup_content": dedup_content, "per_file_cap": per_file_cap, "best_sections": best_sections,
    "adaptive_results": adaptive_results, "signal_scores": signal_scores, "feedback_boosts": feedback_boosts, "line_search": line_search,
}
SQL = {
    "hybrid_search": HYBRID_SQL, "bm25_topk": BM25_SQL, "term_statistics": TERM_SQL, "vector_topk_dot": _vector_sql(_DOT), "vector_topk_cosine_filtered": _vector_sql(f"{_DOT} / ({_NORM('embedding')} * {_NORM('qv')})", "WHERE label IN (1, 2)"),
    "vector_topk_hamming": _vector_sql(_HAMMING), "rrf_fusion": RRF_SQL, "dedup_content": DEDUP_SQL, "per_file_cap": CAP_SQL, "best_sections": SECTIONS_SQL,
    "adaptive_results": ADAPTIVE_SQL, "signal_scores": SIGNALS_SQL, "feedback_boosts": FEEDBACK_SQL, "line_search": LINE_SQL,
}
