"""Folder defects, digests, blocks and grounding on small cases."""

from corpusloom.operators import catalog as C
from corpusloom.operators import folders as O

SCHEMA = "collection_id long, path string, depth int, has_index boolean, ignored boolean, parse_error string, purpose string, use_when array<string>, file_count int, word_count long, children array<string>"


def folders(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, "a", 1, True, False, None, "Holds A. More.", ["x", None, "x"], 2, 10, ["b", "gone", "b", None]),
    (1, "a/b", 2, False, False, None, None, None, 1, 5, None),
    (1, "a/c", 5, True, None, None, " ", None, 0, 0, ["../b"]),
    (1, "d", 1, True, False, "line 3", None, None, 1, 1, []),
    (1, "hid", 1, False, True, "line 1", None, None, 9, 1, ["q"]),
    (1, "hid/z", 7, False, False, None, None, None, 9, 1, None),
]


def test_defects(spark):
    got = {tuple(r) for r in O.defects(folders(spark, ROWS + ROWS[:1])).collect()}
    assert got == {
        (1, "a", "orphaned", "a/gone"), (1, "a", "repeated", "a/b"), (1, "a", "unlisted", "a/c"), (1, "a/b", "missing_index", ""),
        (1, "a/c", "missing_purpose", ""), (1, "a/c", "wrong_depth", "5"), (1, "d", "parse_error", "line 3"), (1, "a/c", "orphaned", "b"),
    }
    assert O.defects(folders(spark, [])).count() == 0


def test_digest_is_cut_and_bounded(spark):
    rows = [(1, f"p{k:03}", 1, True, False, None, f"{'x' * 60}{k}. Rest.", None, 1, 1, None) for k in range(50)] + [(2, "q", 1, True, False, None, "One\nline! Two", None, 1, 1, None), (3, "r", 1, True, False, None, None, None, 1, 1, None)]
    got = {r["collection_id"]: r["digest"] for r in O.digests(folders(spark, rows)).collect()}
    assert set(got) == {1, 2} and got[2] == "One line!" and len(got[1]) <= 503 and got[1].endswith("...")


def test_blocks(spark, tmp_path):
    got = {r["path"]: r["block"] for r in O.markdown(folders(spark, ROWS[:2])).collect()}
    assert got["a"] == "# a\n\nHolds A. More.\n\n2 files, 10 words\n\nUse when:\n- x\n\nFolders:\n- b\n- gone"
    assert got["a/b"] == "## a/b\n\n1 files, 5 words"
    O.write_markdown(folders(spark, ROWS), str(tmp_path / "m"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    assert text.count("# ") >= len(ROWS)


def test_grounding(spark):
    purposes = spark.createDataFrame([("r/q3-plans", "Holds Acme’s Q3–Q4 plans, the 12-slide Zeta deck. Records BetaCo and The rest"), ("r/empty", None)], "folder string, purpose string")
    texts = spark.createDataFrame([("r/q3-plans", "acme did it"), ("r/q3-plans", None), ("r/x", "zeta"), ("r/q3-plans", "q4")], "folder string, text string")
    assert {r["word"] for r in O.ungrounded(purposes, texts).collect()} == {"zeta", "betaco"}


def test_renamed_and_removed(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2"), ("n", None)], "path string, file_hash string")
    new = spark.createDataFrame([("c", "h2"), ("x", "h1"), ("y", "h2"), ("m", None)], "path string, file_hash string")
    assert [tuple(r) for r in C.renamed(old, new).collect()] == [("x", "a", "h1")]
    roots = spark.createDataFrame([(1, "/s/a", "one"), (2, "/s", "two")], "id long, path string, name string")
    members = C.membership(spark.createDataFrame([("/s/a/f",), ("/s/g",)], "path string"), roots)
    assert [tuple(r) for r in C.without_collection(members, roots, 1).collect()] == [("/s/a/f", 2, False)]
    assert [tuple(r) for r in C.without_collection(members, roots, 2).orderBy("path").collect()] == [("/s/a/f", 1, False), ("/s/g", None, True)]
