"""Read-only SQL over the catalog."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from corpusloom.runtime import table

_READS = re.compile(r"^\s*(select|with|values|from|table)\b", re.IGNORECASE)


def run_sql(spark: SparkSession, folder: str, statement: str, limit: int | None = 100) -> DataFrame:
    """The result of one reading statement over all tables of the folder as views; at most `limit` rows unless None."""
    if not _READS.match(statement) or ";" in statement.strip().rstrip(";"):
        raise ValueError("only a single reading statement is allowed")
    for name in list_tables(folder):
        if re.search(rf"\b{name}\b", statement):
            table(spark, folder, name).createOrReplaceTempView(name)
    out = spark.sql(statement.strip().rstrip(";"))
    return out if limit is None else out.limit(limit)


def list_tables(folder: str) -> list[str]:
    return sorted(n[: -len(".parquet")] for n in os.listdir(folder) if n.endswith(".parquet"))
