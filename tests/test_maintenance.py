"""Refresh, section reads, run comparison, batches, and formats on small cases."""

import math

import xxhash
from pyspark.sql import functions as F

from corpusloom.functions import formats as X
from corpusloom.operators import documents as D
from corpusloom.operators import refresh as R

SCAN, FILES = "path string, mtime long, text string", "id long, path string, file_hash string, mtime long"
CHUNKS = "id long, file_id long, chunk_order int, section_id string, heading string, level int, start_line int, end_line int, content string"


def test_refresh_reads_only_what_changed(spark):
    h = xxhash.xxh64_hexdigest
    scanned = [("same", 1, "# A\nnew text that is not looked at"), ("touched", 2, "# B\nb"), ("changed", 2, "# C\nc\n# D\nd"), ("new", 1, "e"), ("empty", 1, None), (None, 1, "x")]
    files = [(1, "same", "old", 1), (2, "touched", h(b"# B\nb"), 1), (3, "changed", "old", 1), (4, "gone", "old", 1)]
    chunks = [(10 * k, k, 0, "s", "S", 1, 1, 1, f"old {k}") for k in (1, 2, 3, 4)]
    make = lambda rows, schema: spark.createDataFrame(rows + rows[:1], schema)
    got = R.refresh(make(scanned, SCAN), make(files, FILES), make(chunks, CHUNKS))
    assert {r["path"]: r["change"] for r in got["changes"].collect()} == {"same": "unchanged", "touched": "touched", "changed": "changed", "new": "new", "empty": "new", "gone": "deleted"}
    after = {r["path"]: r for r in got["files"].collect()}
    assert set(after) == {"same", "touched", "changed", "new", "empty"} and after["touched"]["mtime"] == 2 and after["changed"]["file_hash"] == h(b"# C\nc\n# D\nd") and after["same"]["file_hash"] == "old"
    by_id = {r["id"]: p for p, r in after.items()}
    assert sorted((by_id[r["file_id"]], r["content"]) for r in got["chunks"].collect()) == [("changed", "# C\nc"), ("changed", "# D\nd"), ("new", "e"), ("same", "old 1"), ("touched", "old 2")]
    again = R.refresh(make(scanned, SCAN), got["files"], got["chunks"])
    assert {r["change"] for r in again["changes"].collect()} == {"unchanged"}
    assert sorted(map(tuple, again["chunks"].collect())) == sorted(map(tuple, got["chunks"].collect()))


def test_read_sections(spark):
    docs = spark.createDataFrame([(1, "# 3. Foo Bar\na\n## Sub\nb\n# Foo Bar\nc"), (2, "none"), (3, None)], "id long, text string")
    wanted = spark.createDataFrame([(1, "foo-bar"), (1, "SUB"), (1, "3. foo bar"), (1, "x"), (2, "foo-bar"), (1, None)], "id long, name string")
    got = {r["name"]: r["text"] for r in R.read_sections(docs, D.sections(docs), wanted).collect()}
    assert got == {"foo-bar": "# 3. Foo Bar\na\n## Sub\nb", "SUB": "## Sub\nb", "3. foo bar": "# 3. Foo Bar\na\n## Sub\nb"}


def test_compare_runs(spark):
    rows = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2), ("b", "v2", 4), ("c", "v1", None), ("d", "v1", 3), ("d", "v2", 3)], "case_id string, variant string, rank int")
    got = {r["case_id"]: (r["v1"], r["v2"], r["best"]) for r in R.compare_runs(rows, ["v1", "v2"]).collect()}
    assert got == {"a": (1.0, 0.5, "v1"), "b": (0.0, 0.25, "v2"), "c": (0.0, 0.0, "v1"), "d": (1 / 3, 1 / 3, "v1")}


def test_batches_follow_the_order(spark):
    rows = [("f", f"p{k:03}", None if k % 17 == 0 else float(k * 7 % 23) / 3) for k in range(200)] + [("g", "x", 1.0)]
    got = R.authority_batches(spark.createDataFrame(rows, "folder string, path string, authority double"), 10).where("folder = 'f'").orderBy("place").collect()
    want = sorted((r for r in rows if r[0] == "f"), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
    assert [r["path"] for r in got] == [r[1] for r in want]
    assert [r["batch"] for r in got] == [k // 10 for k in range(200)]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_labels(spark):
    def plain(n):
        return (plain(n // 26 - 1) if n >= 26 else "") + chr(97 + n % 26)

    ns = [0, 1, 25, 26, 51, 52, 701, 702, 703, 18277, 18278, 475253]
    df = spark.createDataFrame([(n,) for n in [*ns, -1, 475254, None]], "n long").withColumn("l", X.label(F.col("n"))).withColumn("back", X.label_index(F.col("l")))
    rows = df.collect()
    assert [r["l"] for r in rows] == [plain(n) for n in ns] + [None] * 3
    assert [r["back"] for r in rows] == ns + [None] * 3
    assert one(spark, "A1", X.label_index) is None


def test_times_and_sizes(spark):
    assert [one(spark, s, X.duration_seconds) for s in ("12h", "2d", "1w", "30m", "x", "", None)] == [43200, 172800, 604800, 1800, None, None, None]
    assert [one(spark, n, X.format_duration, "long") for n in (59, 1800, 7300, 200_000)] == ["0m", "30m", "2h", "2d"]
    assert [one(spark, n, X.format_bytes, "long") for n in (0, 1023, 1536, 2 * 1024**2, 3 * 1024**6)] == ["0 B", "1023 B", "1.5 KB", "2.0 MB", "3.0 EB"]
    stamps = [one(spark, s, X.parse_date) for s in ("2026-03-17", "2026-03-17T10:00:00Z", "2026-03-17T12:00:00.123456789+02:00", "17.3.2026", "2026-13-01")]
    assert [s is None for s in stamps] == [False, False, False, True, True] and stamps[1].hour == stamps[2].hour


def test_json_within_text(spark):
    cases = {'{"a": 1}': '{"a": 1}', 'x {"a": "}{\\"", "b": {}} y }': '{"a": "}{\\"", "b": {}}', "t\n```json\n{\"a\": 2}\n```\n": '{"a": 2}', "no": None, "": None, "{broken": None, "} {": None}
    assert {t: one(spark, t, X.json_text) for t in cases} == cases
    assert one(spark, None, X.json_text) is None


def test_vectors_as_bytes(spark):
    df = spark.createDataFrame([([1.5, -2.0, float("nan")],), ([],), (None,)], "v array<float>").withColumn("b", X.float_bytes(F.col("v"))).withColumn("back", X.floats_of(F.col("b")))
    rows = df.collect()
    assert len(rows[0]["b"]) == 12 and rows[0]["back"][:2] == [1.5, -2.0] and math.isnan(rows[0]["back"][2])
    assert rows[1]["back"] == [] and rows[2]["back"] is None
    assert one(spark, [200.0, -300.0, 1.9, -1.9], X.small_ints, "array<float>") == [127, -128, 1, -1]
