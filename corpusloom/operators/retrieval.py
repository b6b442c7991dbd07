"""Lexical, vector and hybrid retrieval as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scoring as S
from corpusloom.functions.text import tokens
from corpusloom.runtime import cut


def postings(texts: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, id, tf, dl) of (id, text); only `terms` if given. dl counts all tokens of the text. Repeated rows of an id count once."""
    t = texts.select("id", tokens(F.col("text")).alias("tokens")).withColumn("dl", F.size("tokens"))
    if terms is not None:
        t = t.withColumn("tokens", F.filter("tokens", lambda x: x.isin(terms)))
    counted = t.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    copies = texts.where("text is not null").groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    return counted.join(copies, "id", "left").select("term", "id", (F.col("tf") / F.coalesce("copies", F.lit(1))).cast("long").alias("tf"), "dl")


def lexical_stats(texts: DataFrame) -> tuple[float, float]:
    """Number of texts and mean number of tokens."""
    r = texts.select("id", F.size(tokens(F.col("text"))).alias("dl")).where("dl >= 0").dropDuplicates(["id"]).agg(F.count("*"), F.avg("dl")).first()
    return float(r[0]), float(r[1] or 1.0)


def bm25(texts: DataFrame, query: list[str]) -> DataFrame:
    """(id, score) of the texts that hold a term of the query. Terms are counted once; null texts are not counted, repeated rows of an id once.

    Texts are tokenised once: their length and the counts of the query's terms are all that is kept.
    """
    terms = sorted({t.lower() for t in query})
    toks = texts.where("text is not null").select("id", F.explode(F.array(tokens(F.col("text")))).alias("toks"))
    counts = F.array(*[_count(t) for t in terms])
    profile = cut(toks.select("id", F.size("toks").alias("dl"), counts.alias("tf")).dropDuplicates(["id"]))
    each = [F.sum((F.get("tf", k) > 0).cast("long")).alias(f"df{k}") for k in range(len(terms))]
    figures = profile.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"), *each).first()
    n, avg_dl = float(figures["n"]), float(figures["avg_dl"] or 1.0)
    weights = [F.when(F.get("tf", k) > 0, S.bm25_term(F.get("tf", k), F.col("dl"), F.lit(float(figures[f"df{k}"] or 0)), n, avg_dl)).otherwise(0.0) for k in range(len(terms))]
    return profile.where(F.exists("tf", lambda x: x > 0)).select("id", sum(weights, F.lit(0.0)).alias("score"))


def search_many(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the k best of (id, text) by BM25 for each of (query), all queries in one join on their terms.

    Only postings of terms that some query has are kept. Scores tie at nine digits, then the smaller id comes first.
    """
    terms = queries.select("query", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).distinct()
    words = texts.where("text is not null").select("id", tokens(F.col("text")).alias("toks")).select("id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))
    n, avg_dl = lexical_stats(texts)
    kept = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    copies = texts.where("text is not null").groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1")
    kept = cut(kept.join(copies, "id", "left").withColumn("tf", (F.col("tf") / F.coalesce("copies", F.lit(1))).cast("long")).drop("copies"))
    weighed = kept.join(kept.groupBy("term").agg(F.count("*").alias("df")), "term").select("term", "id", S.bm25_term(F.col("tf"), F.col("dl"), F.col("df"), n, avg_dl).alias("w"))
    scored = terms.join(weighed, "term").groupBy("query", "id").agg(F.sum("w").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _count(term: str) -> Column:
    return F.size(F.filter("toks", lambda x: x == term))


def ranked(scored: DataFrame, k: int, key: str = "id", score: str = "score") -> DataFrame:
    """The k best rows with their rank; ties go to the smaller key. Only k rows reach the window."""
    best = scored.orderBy(F.desc(score), F.asc(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def nearest(vectors: DataFrame, query: list[float], k: int, similarity: str = "dot") -> DataFrame:
    """(id, score, rank): exact top k of (id, v) by dot product, cosine or Hamming similarity of signs."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if similarity == "hamming":
        score = S.hamming_similarity(S.sign_bits(F.col("v")), S.sign_bits(q), F.lit(float(len(query))))
    else:
        score = (S.dot if similarity == "dot" else S.cosine)(F.col("v"), q)
    return ranked(vectors.select("id", score.alias("score")), k)


def rrf(lexical: DataFrame, vector: DataFrame, k: int = 60, boost_top: int = 3, boost: float = 2.0, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(id, score, lexical_rank, vector_rank): sum of weight * boost / (k + rank) over two rankings (id, rank); a missing rank adds nothing."""
    part = lambda r, w: F.coalesce(w * F.when(F.col(r) <= boost_top, boost).otherwise(1.0) / (k + F.col(r)), F.lit(0.0))
    both = lexical.select("id", F.col("rank").alias("lexical_rank")).join(vector.select("id", F.col("rank").alias("vector_rank")), "id", "full_outer")
    return both.withColumn("score", part("lexical_rank", weights[0]) + part("vector_rank", weights[1]))


MOST_CANDIDATES = 10_000  # of one query; a reranker takes a few hundred


def diverse_candidates(ranked_rows: DataFrame, most: int, per_file: int) -> DataFrame:
    """First the `per_file` best of every file, however many, then others by rank up to `most` in all. Needs (file, rank)."""
    rows = ranked_rows.withColumn("first", F.row_number().over(Window.partitionBy("file").orderBy("rank")) <= per_file)
    everything = Window.partitionBy(F.lit(1))  # the candidates of one query, bounded by its top k: the first MOST_CANDIDATES by rank
    rows = rows.orderBy("rank").limit(MOST_CANDIDATES)
    rows = rows.withColumn("n_first", F.sum(F.col("first").cast("int")).over(everything)).withColumn("place", F.row_number().over(everything.orderBy(F.desc("first"), "rank")))
    return rows.where(F.col("place") <= F.greatest(F.lit(most), F.col("n_first"))).drop("first", "n_first")


def dedup_content(rows: DataFrame, content: str = "content", score: str = "score", key: str = "id") -> DataFrame:
    """Of rows with equal content the best scored, with the number and keys of the others. Null contents stay apart."""
    same = F.coalesce(F.sha2(F.col(content), 256), F.concat(F.lit("#"), F.col(key).cast("string")))
    best = F.max_by(F.struct(*[c for c in rows.columns if c != content]), F.struct(F.col(score), -F.col(key))).alias("best")
    grouped = rows.withColumn("_same", same).groupBy("_same").agg(best, F.count("*").alias("_n"), F.min(key).alias("_least"), F.max(key).alias("_most"))
    return grouped.select("best.*", (F.col("_n") - 1).alias("n_duplicates"))


def capped_per_file(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """At most n rows of every file in rank order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def adaptive_k(scores: Column, least: int, most: int) -> Column:
    """How many results to keep, from the descending array of scores.

    All if there are fewer than five. The top is flat, and `most` are kept, if no step among the first five loses over 5 %.
    Otherwise the loss from first to fifth decides: 10 % or less keeps `most`, 50 % or more keeps `least`, linear between.
    """
    if least >= most:
        return F.lit(most)
    top = F.slice(scores, 1, 5)
    cliff = F.exists(F.zip_with(F.slice(top, 1, 4), F.slice(top, 2, 4), lambda a, b: (a > 0) & ((a - b) / a > 0.05)), lambda x: x)
    loss = 1.0 - F.element_at(top, 5) / F.element_at(top, 1)
    between = F.round(most - (loss - 0.1) / 0.4 * (most - least))
    kept = F.when(F.get(top, 0) == 0, most).when(~cliff | (loss <= 0.1), most).when(loss >= 0.5, least).otherwise(between)
    return F.when(F.size(scores) < 5, F.size(scores)).otherwise(kept).cast("int")


def best_per_section(rows: DataFrame) -> DataFrame:
    """The best scored row of each (file, section_id), parts of a section counting as one."""
    canonical = F.substring_index(F.coalesce("section_id", F.lit("")), "::", 1)
    w = Window.partitionBy("file", "section").orderBy(F.desc("score"), "id")
    return rows.withColumn("section", canonical).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def expand_one_hop(results: DataFrame, links: DataFrame, decay: float) -> DataFrame:
    """(path, section, score): results (path, section, score) and what they link to or are linked from, at score * decay; the best counts."""
    edges = links.select("source_path", "source_section", "target_path", "target_section")
    both = edges.unionByName(edges.select(F.col("target_path").alias("source_path"), F.col("target_section").alias("source_section"), F.col("source_path").alias("target_path"), F.col("source_section").alias("target_section"))).distinct()
    hop = results.join(both, (F.col("path") == F.col("source_path")) & (F.col("section") == F.col("source_section"))).select(F.col("target_path").alias("path"), F.col("target_section").alias("section"), (F.col("score") * decay).alias("score"))
    return results.select("path", "section", "score").unionByName(hop).groupBy("path", "section").agg(F.max("score").alias("score"))


def heading_boost(heading: Column, query: list[str], factor: float) -> Column:
    """Factor if the heading holds every term, else 1 + (factor - 1) * share of terms in it."""
    terms = [t for t in ({q.strip(".,;:!?\"'()[]").lower() for q in query}) if t]
    if not terms:
        return F.lit(1.0)
    n = sum(F.coalesce(F.lower(heading).contains(t).cast("int"), F.lit(0)) for t in sorted(terms))
    return 1.0 + (factor - 1.0) * n / len(terms)
