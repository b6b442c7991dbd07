"""Registered queries of the package. Each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, mojibake, multiindex, neardup, packing, split, tokens
from corpusloom.runtime import cut, table

SECTION_WORDS, SECTION_SIMILARITY, SECTION_LEAST = 3, 0.6, 20  # as TESTDATA.md states the problem for chunks


def _near_chunks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, folder, "chunks").select("id", F.col("content").alias("text"))
    return neardup.near_duplicates(texts, SECTION_WORDS, SECTION_SIMILARITY, SECTION_LEAST)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks whose word triples agree to 0.6 or more."""
    return neardup.all_pairs(*_near_chunks(spark, folder)).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


P1_FOUND_SQL = f"""
WITH c AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL),
t AS (SELECT DISTINCT id, list_slice(w, i, i + {SECTION_WORDS - 1}) AS g FROM (SELECT id, w, unnest(range(1, len(w) - {SECTION_WORDS - 2})) AS i FROM c)),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id HAVING count(*) >= {SECTION_LEAST}),
k AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM t a JOIN t b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE m >= {SECTION_SIMILARITY} * (x.n + y.n - m) - 1e-9
"""


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk that is long enough to compare: its class and its number of links."""
    return neardup.classes(*_near_chunks(spark, folder)).withColumnRenamed("id", "chunk_id")


NEIGHBOURS, PAIR_SIMILARITY = 10, 0.90
TOPK_SHARE = 0.35  # of a model's entries that a query of p4_topk passes; its neighbours may be far away


def _chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return multiindex.usable(table(spark, folder, "chunk_vectors"), "chunk_id", "vector", "model", "dimensions")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with a cosine of 0.90 or more of which one is among the other's ten most similar."""
    near = multiindex.top_similar(_chunk_vectors(spark, folder), NEIGHBOURS, PAIR_SIMILARITY)
    return near.select(F.least("id", "near_id").alias("chunk_id_a"), F.greatest("id", "near_id").alias("chunk_id_b")).distinct()


def p4_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar vectors, whatever their similarity, of every chunk whose id is divisible by 100."""
    points = _chunk_vectors(spark, folder)
    return multiindex.top_similar(points, NEIGHBOURS, queries=points.where("id % 100 = 0").select("id", "model"), share=TOPK_SHARE).select("model", F.col("id").alias("chunk_id"), F.col("near_id").alias("near_chunk_id"), F.round("similarity", 6).alias("similarity"), "rank")


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with the limits of their file's collection; a chunk without file or collection has no limit and is left out."""
    files = table(spark, folder, "files").groupBy(F.col("id").alias("file_id")).agg(F.max_by("collection_id", "last_indexed").alias("collection_id"))
    limits = table(spark, folder, "section_options").groupBy("collection_id").agg(F.max("max_section_chars").alias("max_bytes"), F.max("overlap_lines").alias("overlap_lines"))
    # contents that are within the lowest limit of all leave before the join
    least = limits.agg(F.min("max_bytes")).first()[0]
    chunks = table(spark, folder, "chunks").select("id", "file_id", "heading_level", F.col("content").alias("text")).where(F.octet_length("text") > F.lit(least))
    return chunks.join(files.join(limits, "collection_id").select("file_id", "max_bytes", "overlap_lines"), "file_id").where(F.col("max_bytes").isNotNull() & (F.octet_length("text") > F.greatest(F.col("max_bytes"), F.lit(1)))).dropDuplicates(["id"])


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized chunks as pieces under the limit of their collection, with heading level and overlap."""
    return split.split_oversized(_sections(spark, folder).withColumn("limit", F.col("max_bytes")), ("heading_level", "limit")).withColumnRenamed("limit", "max_bytes").withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be split."""
    return split.split_oversized(_sections(spark, folder).select("id", "text", "max_bytes", "overlap_lines")).where("piece_no = 1").select(F.col("id").alias("chunk_id"))


P5_FOUND_SQL = """
SELECT DISTINCT c.id AS chunk_id FROM chunks c
JOIN (SELECT id, arg_max(collection_id, last_indexed) AS collection_id FROM files GROUP BY id) f ON f.id = c.file_id
JOIN section_options o ON o.collection_id = f.collection_id
WHERE octet_length(encode(c.content)) > o.max_section_chars
"""


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents; a tokenizer is run once over each text."""
    docs = table(spark, folder, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    return cut(tokens.with_tokens(docs))


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of every pack size."""
    return packing.pack(_sizes(spark, folder).select("doc_id", "n_tokens"), table(spark, folder, "pack_sizes"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and used space per pack size."""
    return packing.fill_report(p6_pack(spark, folder))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every mix of mix_targets: the documents of each output shard in order."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of every mix."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))[1]


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents with their restored text."""
    return mojibake.restore(table(spark, folder, "documents").select("doc_id", "source", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with traces of a wrong decoding."""
    return p8_restored(spark, folder).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p4_found": p4_found, "p4_topk": p4_topk, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_pack": p6_pack, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}
SQL: dict[str, str] = {"p1_found": P1_FOUND_SQL, "p5_found": P5_FOUND_SQL}
