"""Round trips of readers and writers, and the streaming forms on files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.plans.admin import run_sql
from corpusloom.plans.search import TERMS, chunk_texts
from corpusloom.sources import files as S
from corpusloom.sources import index as I
from corpusloom.streaming import events as E


def test_scan_skips_what_is_ignored(spark, tmp_path):
    for name in ("a.md", "b.png", "drafts/c.md", ".git/d.md", "sub/e.TXT"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("héllo")
    rows = S.scan(spark, str(tmp_path), ["drafts/"]).collect()
    assert sorted((r["relative"], r["text"]) for r in rows) == [("a.md", "héllo"), ("sub/e.TXT", "héllo")]


def test_read_signals(spark, tmp_path):
    f = tmp_path / "r.tsv"
    f.write_text("doc_path\ttotal_reads\tunique_days\tlast_read\nk/a.md\t12\t5\t2026-03-17\nk/old.md\t3\t2\t2026-01-01\n")
    assert [tuple(r) for r in S.read_signals(spark, [str(f)] * 1, "2026-03-17").collect()] == [("k/a.md", 12, 5, "2026-03-17")]
    f.write_text("../escape.md\t1\t1\t2026-03-17\n")
    with pytest.raises(Exception, match="leaves its collection"):
        S.read_signals(spark, [str(f)], "2026-03-17").collect()


def test_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2026-03-01 10:00:00", 1), ("2026-03-02 10:00:00", 2)], "ts string, v int")
    S.write_log(rows, str(tmp_path / "log"))
    got = S.recent_log(spark, str(tmp_path / "log"), "ts string, v int", 1).first()
    assert got["v"] == 2 and str(got["week"]) == "2026-03-02"


def test_cases_and_folder_index(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(["", json.dumps({"id": "1", "query": "q", "gold": [{"path": "a", "section_id": "s", "start_line": 1}]}), ""]))
    assert S.evaluation_cases(spark, str(tmp_path / "c.jsonl")).where("id is not null").count() == 1
    files = spark.createDataFrame([("x/index.toml", 'schema_version = 1\nignore = true\npurpose = "p"\n'), ("y/index.toml", "= broken"), ("z/a.md", "")], "path string, text string")
    got = {r["path"]: r for r in S.folder_indexes(files).collect()}
    assert got["x/index.toml"]["ignored"] and got["y/index.toml"]["error"] and len(got) == 2


def test_index_gives_the_scores_of_a_scan(spark, data, tmp_path):
    texts = chunk_texts(spark, data)
    I.build(texts, str(tmp_path / "index"))
    rounded = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
    assert rounded(I.search(spark, str(tmp_path / "index"), TERMS)) == rounded(R.bm25(texts, TERMS)) != {}


def test_only_reading_statements(spark, data):
    assert run_sql(spark, data, "select count(*) as n from files").first()["n"] > 0
    for bad in ("drop table files", "select 1; select 2", "insert into files values (1)"):
        with pytest.raises(ValueError):
            run_sql(spark, data, bad)


def test_streamed_windows_equal_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.read_events(spark, str(tmp_path / "in")), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, E.tumbling(batch, "1 day").collect()))


def test_ingest_sees_every_row_once(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    E.ingest(E.read_events(spark, str(tmp_path / "in")), lambda df, n: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == spark.read.parquet(f"{data}/events.parquet").count() and len(seen) == 3
