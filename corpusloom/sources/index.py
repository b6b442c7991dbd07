"""The inverted index as a partitioned table: build, upsert, delete, count and query without reading texts again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scoring import bm25_term
from corpusloom.functions.text import tokens
from corpusloom.operators.retrieval import postings
from corpusloom.runtime import cut

BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _lengths(texts: DataFrame) -> DataFrame:
    return texts.where("text is not null").select("id", F.size(tokens(F.col("text"))).alias("dl")).dropDuplicates(["id"]).withColumn("bucket", _bucket("id"))


def _write(rows: DataFrame, path: str, order: list[str]) -> None:
    """Replace the partitions that the rows fall into."""
    rows.repartition("bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def build(texts: DataFrame, folder: str) -> None:
    """Write postings by term bucket and lengths by id bucket for (id, text); repeated rows of an id count once, null texts are not indexed."""
    postings(texts).withColumn("bucket", _bucket("term")).repartition("bucket").sortWithinPartitions("term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    _lengths(texts).repartition("bucket").sortWithinPartitions("id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/texts")


def apply(spark: SparkSession, folder: str, texts: DataFrame, deleted: DataFrame) -> None:
    """Upsert (id, text) and delete (id) in one batch: ids given in both are upserted. Ids that are not indexed are no error.

    The buckets that hold one of these ids or new terms are written anew from checkpointed rows, lengths last: a batch that failed half
    way is applied again with the same result.
    """
    old = spark.read.parquet(f"{folder}/postings")
    gone = cut(texts.select("id").unionByName(deleted.select("id")).distinct())
    new = cut(postings(texts).withColumn("bucket", _bucket("term")))
    touched = old.join(gone, "id", "left_semi").select("bucket").unionByName(new.select("bucket")).distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(gone, "id", "left_anti")  # at most BUCKETS rows
    empty = touched.join(kept.select("bucket").unionByName(new.select("bucket")).distinct(), "bucket", "left_anti")
    rows = kept.select("term", "id", "tf", "dl", "bucket").unionByName(new.select("term", "id", "tf", "dl", "bucket"))
    # a bucket that loses its last row keeps a row without a term, as partitions without rows are not replaced
    hollow = empty.select(F.lit(None).cast("string").alias("term"), F.lit(None).cast(old.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("tf"), F.lit(0).alias("dl"), "bucket")
    _write(cut(rows.unionByName(hollow)), f"{folder}/postings", ["term", "id"])
    lengths = spark.read.parquet(f"{folder}/texts")
    fresh = _lengths(texts).unionByName(lengths.join(gone, "id", "left_anti").select("id", "dl", "bucket"))
    holes = lengths.select("bucket").distinct().join(fresh.select("bucket").distinct(), "bucket", "left_anti").select(F.lit(None).cast(lengths.schema["id"].dataType).alias("id"), F.lit(0).alias("dl"), "bucket")
    _write(cut(fresh.unionByName(holes)), f"{folder}/texts", ["id"])


def doc_count(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/texts").where("id is not null").count()


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """All postings (term, id, tf, dl)."""
    return spark.read.parquet(f"{folder}/postings").where("term is not null").drop("bucket")


def search(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(id, score): only the buckets of the query's terms are read."""
    n, avg_dl = spark.read.parquet(f"{folder}/texts").where("id is not null").agg(F.count("*"), F.avg("dl")).first()
    buckets = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term")).distinct().collect()
    hits = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin([b[0] for b in buckets]) & F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return hits.join(df, "term").groupBy("id").agg(F.sum(bm25_term(F.col("tf"), F.col("dl"), F.col("df"), float(n), float(avg_dl or 1.0))).alias("score"))
