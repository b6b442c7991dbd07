"""Section chunks, snippets, excerpts and keywords on small and long texts."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.operators import outline as O

SCHEMA = "id long, text string"


def chunks(spark, text, **k):
    return O.section_chunks(spark.createDataFrame([(1, text)], SCHEMA), **k).orderBy("chunk_order").collect()


def test_three_sections(spark):
    got = chunks(spark, "## Introduction\na\n## Methods\nb\n### Deep er\nc\n## Results\nd")
    assert [(r["section_id"], r["level"], r["start_line"], r["end_line"], r["parent_order"]) for r in got] == [("introduction", 2, 1, 2, None), ("methods", 2, 3, 6, None), ("deep-er", 3, 5, 6, 1), ("results", 2, 7, 8, None)]


def test_front_and_preamble(spark):
    got = chunks(spark, "\n---\ntitle: x\n---\nhello\n# A\nb")
    assert [(r["section_id"], r["start_line"], r["end_line"], r["content"]) for r in got] == [("frontmatter", 2, 4, "title: x"), ("", 1, 5, "hello"), ("a", 6, 7, "# A\nb")]
    assert [r["content"] for r in chunks(spark, "+++\n+++\nbody\n\n")] == ["", "body"]


def test_no_headings_and_blank(spark):
    assert [r["content"] for r in chunks(spark, "one\ntwo\n\n")] == ["one\ntwo"]
    assert not chunks(spark, "") and not chunks(spark, " \n\t\n") and not chunks(spark, None)


def test_oversize_is_cut_with_overlap(spark):
    lines = ["# Top"] + [f"line {k:03} " + "x" * 40 for k in range(200)]
    got = chunks(spark, "\n".join(lines), max_chars=500, overlap=2)
    assert [r["section_id"] for r in got[:3]] == ["top", "top::2", "top::3"]
    assert [k for r in got for k in range(r["start_line"], r["end_line"] + 1)] == list(range(1, 202))
    for r in got:
        assert r["content"] == "\n".join(lines[max(r["start_line"] - 3, 0) : r["end_line"] + 2])


def test_many_headings_in_one_text(spark):
    text = "\n".join(f"{'#' * (1 + k % 6)} H{k}\nbody" for k in range(20_000))
    rows = O.section_chunks(spark.createDataFrame([(1, text)], SCHEMA), max_chars=10**9)
    assert rows.where("level = 6").count() == 20_000 // 6


def test_snippets(spark):
    text = "\n".join(["alpha one", "--", "beta two", "-", "gamma snapshot orphan", "", "delta four", "epsilon five", "zeta six"])
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None), (5, "\n".join("abcd" for _ in range(9)))], SCHEMA)
    got = {r["id"]: (r["best_line"], r["snippet"]) for r in O.line_snippets(docs, ["Snapshot", "orphan"], 3).collect()}
    assert got == {1: (5, "...\nbeta two\ngamma snapshot orphan\ndelta four\n..."), 2: (1, "short"), 3: (1, ""), 5: (1, "abcd\nabcd\nabcd\n...")}


def test_excerpt(spark):
    text = "---\ntitle: x\n---\n# H\n\n```\ncode\n```\n| t |\n![i](x)\n\nfirst line\nsecond\n\nother"
    docs = spark.createDataFrame([(1, "d/my-file.md", text), (2, "", ""), (3, None, "é" * 400)], "id long, path string, text string")
    got = {r["id"]: r for r in O.outlines(docs).collect()}
    assert (got[1]["title"], got[1]["excerpt"], got[1]["headings"]) == ("x", "first line second", ["H"])
    assert got[2]["excerpt"] == "" and got[3]["title"] == "" and got[3]["excerpt"] == "é" * 138 + "..."


def test_truncate_keeps_lost_characters(spark):
    df = spark.createDataFrame([("�" * 10,)], "t string")
    assert df.select(T.truncate_bytes(F.col("t"), 15)).first()[0] == "�" * 4 + "..."


def plain_keywords(scored, n):
    chosen = [t for t in scored if " " in t][:1]
    for t in scored:
        if len(chosen) >= n:
            break
        if t not in chosen:
            chosen = [c for c in chosen if c not in t.split(" ")] if " " in t else chosen
            chosen = chosen + [t]
    return chosen


def test_keywords_without_overlaps(spark):
    rng = random.Random(3)
    words, rows, want = [f"w{k}" for k in range(12)], [], {}
    for d in range(40):
        terms = words + [f"{a} {b}" for a in words for b in words if rng.random() < 0.2]
        rng.shuffle(terms)
        rows += [(f"d{d}", t, float(len(terms) - k)) for k, t in enumerate(terms)]
        want[f"d{d}"] = plain_keywords(terms, 8)
    got = {r["directory"]: r["terms"] for r in D.diverse_keywords(spark.createDataFrame(rows, "directory string, term string, score double")).collect()}
    assert got == want
