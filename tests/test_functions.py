"""Column builders on awkward values, and the small cases that define ranking rules."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import scoring as S
from corpusloom.functions import text as T
from corpusloom.operators import catalog as C
from corpusloom.operators import documents as D
from corpusloom.operators import retrieval as R


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("path, want", [("a//b/./c/../d", "/a/b/d"), ("\\x\\y", "/x/y"), ("/../a", "/a"), ("", "/"), (None, None), ("/a/b", "/a/b"), ("/a/b/", "/a/b")])
def test_resolve(spark, path, want):
    assert one(spark, P.resolve(F.col("p")), p=("string", path)) == want


@pytest.mark.parametrize("heading, want", [("Step 2: Choose The Webhook Secret", "step-2-choose-the-webhook-secret"), ("--A--  B--", "a-b"), ("é", ""), (None, None)])
def test_slug(spark, heading, want):
    assert one(spark, P.slug(F.col("h")), h=("string", heading)) == want


@pytest.mark.parametrize("scores, want", [([1.0, 0.9, 0.8, 0.7, 0.65], 14), ([], 0), ([1.0] * 4, 4), ([1.0, 0.5, 0.3, 0.2, 0.1], 10), ([1.0, 0.99, 0.98, 0.97, 0.96], 20), ([0.0] * 6, 20)])
def test_adaptive_k(spark, scores, want):
    assert one(spark, R.adaptive_k(F.col("s"), 10, 20), s=("array<double>", scores)) == want


def test_boosts(spark):
    assert [one(spark, F.round(S.backlink_boost(F.col("n"), 0.1), 6), n=("int", n)) for n in (0, 1, 3, None)] == [1.0, 1.1, 1.2, 1.0]
    assert [one(spark, F.round(S.read_boost(F.col("n"), 0.05), 6), n=("int", n)) for n in (0, 1, 9)] == [1.0, 1.05, 1.15]
    assert one(spark, S.feedback_boost(F.col("g"), F.lit(0)), g=("int", 0)) == 1.0


def test_rrf_of_two_lists(spark):
    lexical = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, rank int")
    vector = spark.createDataFrame([(3, 1), (1, 2)], "id long, rank int")
    got = {r["id"]: r["score"] for r in R.rrf(lexical, vector, boost_top=0).collect()}
    assert got[1] == pytest.approx(1 / 61 + 1 / 62) and sorted(got, key=got.get, reverse=True) == [1, 3, 2]


def test_identifier_expansion():
    assert T.expand_identifiers("swapId") == "(swapId OR swap_id OR swap id)"
    assert T.expand_identifiers("HTMLParser") == "(HTMLParser OR html_parser OR html parser)"
    assert T.expand_identifiers("plain words") == "plain words"


@pytest.mark.parametrize("path, want", [("a/x.json", True), ("skip-me/b.md", True), ("a/skip-me/b.md", True), ("p/drafts/q.md", True), ("a/b.md", False)])
def test_ignored(spark, path, want):
    assert one(spark, T.ignored(F.col("p"), ["*.json", "skip-me/", "**/drafts/**", "# a.md"]), p=("string", path)) is want


def test_vectors(spark):
    v = "array<float>"
    assert one(spark, S.dot(F.col("a"), F.col("b")), a=(v, [1.0, 2.0]), b=(v, [3.0, 4.0])) == 11.0
    assert one(spark, S.dot(F.col("a"), F.col("b")), a=(v, [1.0]), b=(v, [3.0, 4.0])) == 0.0
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=(v, [0.0, 0.0]), b=(v, [3.0, 4.0])) == 0.0
    bits = F.lit(4.0)
    assert one(spark, S.hamming_similarity(S.sign_bits(F.col("a")), S.sign_bits(F.col("b")), bits), a=(v, [1.0, -1.0, 1.0, 1.0]), b=(v, [1.0, 1.0, 1.0, 1.0])) == 0.75


def test_sections_nest_and_rows_merge(spark):
    text = "# Introduction\nx\n## Details\n\n### Sub-details\ny"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no heading")], "id long, text string")
    got = [(r["start_line"], r["end_line"]) for r in D.sections(docs).orderBy("start_line").collect()]
    assert got == [(1, 6), (3, 6), (5, 6)]
    rows = spark.createDataFrame([(1, "\n".join(["word " * 10] * 52))], "id long, text string")
    assert [(r["start_line"], r["end_line"]) for r in D.row_chunks(rows).orderBy("chunk_order").collect()] == [(1, 25), (26, 52)]


def test_links(spark):
    docs = spark.createDataFrame([(1, "[t](a.md#H x) [u](b.md#Two) [[Doc#H|d]] `x.md` {{include y.md}} [w](https://z)")], "id long, text string")
    got = {(r["link_type"], r["target_path"], r["target_section"]) for r in D.links(docs).collect()}
    assert got == {("markdown", "b.md", "two"), ("wikilink", "Doc.md", "h"), ("path_ref", "x.md", ""), ("include", "y.md", "")}


def test_freshness_and_diff(spark):
    sig = "id long, content string, head string, tail string, words int"
    old = spark.createDataFrame([(1, "a", "h", "t", 100), (2, "a", "h", "t", 100), (3, "a", "h", "t", 100), (4, "a", "h", "t", 1)], sig)
    new = spark.createDataFrame([(1, "a", "h", "t", 100), (2, "b", "h", "t", 101), (3, "b", "h", "t", 120), (5, "a", "h", "t", 1)], sig)
    assert {r["id"]: r["decision"] for r in C.freshness(old, new).collect()} == {1: "noop", 2: "update_mechanical", 3: "regenerate", 4: "deleted", 5: "new"}
