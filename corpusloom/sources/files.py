"""Text files of a folder tree, and small structured inputs, as DataFrames."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import basename, extension
from corpusloom.functions.text import ignored
from corpusloom.runtime import let_workers_import

# fixed values: extensions that are indexed, and folders that never are
INDEXABLE = [".md", ".txt", ".jsonl", ".json", ".yml", ".yaml", ".toml", ".csv", ".log", ".qmd"]
SKIPPED = [".git", ".obsidian", "node_modules", ".venv", "venv", "__pycache__"]

CASES = "id string, corpus string, query string, gold array<struct<path string, section_id string, start_line int>>, family string"
READS = "doc_path string, total_reads int, unique_days int, last_read string"


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """(path, relative, mtime, size_bytes, text) of the indexable files below root; ignored paths are never opened for their text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    relative = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(root.rstrip('/')) + 2})")
    rows = raw.withColumn("relative", relative).where(extension(F.col("relative")).isin(INDEXABLE) & ~ignored(F.col("relative"), [f"{s}/" for s in SKIPPED] + (patterns or [])))
    columns = [path.alias("path"), F.col("relative"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size_bytes")]
    if with_text:
        columns.append(F.decode("content", "UTF-8").alias("text"))
    return rows.select(*columns)


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file, without comments and blank lines; such files are short."""
    return [r[0].strip() for r in spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'").collect()]


def signal_paths(root: str, configured: list[str]) -> list[str]:
    """Paths of read-signal exports as configured: '~' is the home folder, others that are not absolute start at the collection's root. Globs stay for Spark."""
    return sorted({os.path.normpath(os.path.join(root, os.path.expanduser(p))) for p in configured if p.strip()})


def read_signals(spark: SparkSession, paths: list[str], today: str, max_age_days: int = 14) -> DataFrame:
    """Reads per document from tab-separated exports: counts add up over exports, rows last read too long ago are left out.

    A first line that repeats the column names is no row. A path that leaves its collection ('..') is an error.
    """
    rows = spark.read.csv(paths, sep="\t", schema=READS, mode="PERMISSIVE").where("doc_path is not null and doc_path <> 'doc_path'")
    fresh = rows.where(F.try_to_date("last_read") >= F.date_sub(F.lit(today).cast("date"), max_age_days))
    safe = F.when(F.col("doc_path").rlike(r"(^|/)\.\.(/|$)"), F.raise_error(F.concat(F.lit("path leaves its collection: "), "doc_path"))).otherwise(F.col("doc_path"))
    return fresh.withColumn("doc_path", safe).groupBy("doc_path").agg(F.sum("total_reads").alias("total_reads"), F.sum("unique_days").alias("unique_days"), F.max("last_read").alias("last_read"))


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(CASES).option("mode", "FAILFAST").json(path)


def attention_links(blocks: DataFrame) -> DataFrame:
    """(path, target) from (path, text) of *.attention.json: each block's document, beside the file."""
    parsed = blocks.where(F.col("path").endswith(".attention.json")).select("path", F.from_json("text", "document string, blocks array<struct<path string>>").alias("j"))
    return parsed.select("path", F.explode("j.blocks").alias("b")).select("path", F.col("b.path").alias("target")).where("target is not null")


def folder_indexes(files: DataFrame) -> DataFrame:
    """(path, schema_version, ignored, purpose, use_when, n_files, error) of folder index files (path, text) in TOML, one per folder."""
    let_workers_import(files.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    t, error = tomllib.loads(text or ""), None
                    if t.get("schema_version", 1) > 1:
                        error = "newer schema"
                except tomllib.TOMLDecodeError as e:
                    t, error = {}, str(e)
                rows.append((path, t.get("schema_version", 1), bool(t.get("ignore", False)), t.get("purpose"), t.get("use_when"), len(t.get("files", {})), error))
            yield pd.DataFrame(rows, columns=["path", "schema_version", "ignored", "purpose", "use_when", "n_files", "error"])

    return files.where(basename(F.col("path")) == "index.toml").select("path", "text").mapInPandas(parse, "path string, schema_version int, ignored boolean, purpose string, use_when array<string>, n_files int, error string")


def write_log(entries: DataFrame, folder: str, time: str = "ts") -> None:
    """Append entries as JSON lines, a folder per Monday-based week."""
    entries.withColumn("week", F.date_format(F.date_trunc("week", time), "yyyy-MM-dd")).write.mode("append").partitionBy("week").json(folder)


def retained_log(spark: SparkSession, folder: str, schema: str, today: str, weeks: int) -> DataFrame:
    """Entries of this week and the `weeks` before it: what is kept when older weeks are dropped; older folders are not read."""
    first = F.date_format(F.date_sub(F.date_trunc("week", F.lit(today).cast("date")).cast("date"), 7 * weeks), "yyyy-MM-dd")
    return spark.read.schema(f"{schema}, week string").json(folder).where(F.col("week") >= first)


def recent_log(spark: SparkSession, folder: str, schema: str, n: int, since_week: str = "0000-00-00") -> DataFrame:
    """The n newest entries; weeks before `since_week` are not read."""
    return spark.read.schema(f"{schema}, week string").json(folder).where(F.col("week") >= since_week).orderBy(F.desc("week"), F.desc("ts")).limit(n)
