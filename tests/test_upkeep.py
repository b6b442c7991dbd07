"""The inverted index kept up to date against a rebuild, link forms, code references, percentiles and small functions."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import formats as X
from corpusloom.functions import text as T
from corpusloom.operators import catalog as C
from corpusloom.operators import documents as D
from corpusloom.operators import retrieval as R
from corpusloom.sources import files as S
from corpusloom.sources import index

TEXT = "id long, text string"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_index_equals_a_rebuild(spark, tmp_path):
    rng, folder = random.Random(2), str(tmp_path / "index")
    words = ["alpha", "beta", "gamma", "delta", "Ωmega", "x_1"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6)))
    state = {i: text() for i in range(60)} | {60: None, 61: "only once"}
    index.build(spark.createDataFrame([*state.items(), (3, state[3])], TEXT), folder)
    for gone, new in [([1, 2, 999], {5: "alpha alpha new", 70: text(), 71: None}), ([61], {}), ([70, 5], {70: "again"}), ([], {4: ""}), (list(range(80)), {})]:
        index.apply(spark, folder, spark.createDataFrame(list(new.items()), TEXT), spark.createDataFrame([(i,) for i in gone], "id long"))
        state = {i: t for i, t in state.items() if i not in gone} | new
        whole = spark.createDataFrame(list(state.items()), TEXT)
        assert sorted(map(tuple, index.rows(spark, folder).select("term", "id", "tf", "dl").collect())) == sorted(map(tuple, R.postings(whole).collect()))
        assert index.doc_count(spark, folder) == sum(t is not None for t in state.values())
        close = lambda df: {r["id"]: round(r["score"], 9) for r in df.collect()}
        assert close(index.search(spark, folder, ["alpha", "once"])) == close(R.bm25(whole, ["alpha", "once"]))


def test_link_forms(spark):
    text = "---\nsource: \"[[PLAN.2026]]\"\n---\nrun mem read notes/a.md#Top Part or `mem read b.md`\n`src/c.md#x` `d.txt` {{include \"e.md\"}} [t](<f.md>) [w](https://x.y)"
    got = {(r["line_no"], r["link_type"], r["target_path"], r["target_section"]) for r in D.links(spark.createDataFrame([(1, text), (2, None), (3, "")], TEXT)).collect()}
    assert {(0, "frontmatter_source", "PLAN.2026", ""), (4, "read_command", "notes/a.md", "top"), (4, "read_command", "b.md", ""), (5, "path_ref", "src/c.md", "x")} <= got
    assert not any("d.txt" in p or "x.y" in p for _, _, p, _ in got)


def test_targets_resolve_from_root_folders(spark):
    rows = [("/k/docs/sub/a.md", "docs/b.md"), ("/k/docs/sub/a.md", "../../memory/c.md"), ("/k/docs/sub/a.md", "./d.md"), ("/k/docs/sub/a.md", "/e.md"), ("/k/docs/sub/a.md", ""), ("/other/a.md", "docs/b.md")]
    got = [r["target_path"] for r in D.resolved(spark.createDataFrame(rows, "source_path string, target_path string")).collect()]
    assert got == ["/k/docs/b.md", "/k/memory/c.md", "/k/docs/sub/d.md", "/e.md", "/k/docs/sub/a.md", "/other/docs/b.md"]


def test_code_is_blanked_before_links_are_checked(spark):
    text = "[a](a.md) `[b](b.md)`\n```\n[c](c.md)\n```\n[d](d.md)\n~~~\n[e](e.md)"
    assert one(spark, text, D.without_code) == "[a](a.md) \n\n\n\n[d](d.md)\n\n"
    assert one(spark, "plain [x](y.md)", D.without_code) == "plain [x](y.md)"


def test_both_forms_of_code_references(spark):
    rows = D.code_refs(spark.createDataFrame([(1, "see a/b.go:12@abc-20@xyz, c.py#L3-L9 and d.rs#L7@ab; e.md:0 f.go:9-2")], TEXT)).collect()
    got = {(r["raw"], r["path"], r["start"], r["start_token"], r["end"], r["end_token"]) for r in rows}
    assert got == {("a/b.go:12@abc-20@xyz", "a/b.go", 12, "abc", 20, "xyz"), ("c.py#L3-L9", "c.py", 3, "", 9, ""), ("d.rs#L7@ab", "d.rs", 7, "ab", None, "")}


def test_located_takes_the_first_place(spark):
    refs = spark.createDataFrame([(1, "/r1/d/a.md", "b.md"), (2, "/r1/d/a.md", "c.md"), (3, None, "c.md"), (4, "/r1/a.md", "none.md"), (5, "/x/a.md", "/r2/c.md"), (1, "/r1/d/a.md", "b.md")], "id long, source_path string, path string")
    roots = spark.createDataFrame([("/r1",), ("/r2",)], "root string")
    files = spark.createDataFrame([("/r1/d/b.md",), ("/r1/b.md",), ("/r2/c.md",)], "path string")
    got = {r["id"]: r["resolved"] for r in D.located(refs, roots, files).collect()}
    assert got == {1: "/r1/d/b.md", 2: "/r2/c.md", 3: "/r2/c.md", 4: None, 5: "/r2/c.md"}


def test_percentiles_of_skewed_values(spark):
    rng = random.Random(1)
    rows = [("a", float(rng.choice([1, 1, 1, rng.random()]))) for _ in range(501)] + [("b", 3.0), ("c", None)] + [("d", 1.0), ("d", 2.0)]
    got = {r["g"]: r for r in C.latency_metrics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("a", "b", "d"):
        s = sorted(v for k, v in rows if k == g)
        for p, name in ((0.5, "50"), (0.95, "95")):
            at = (len(s) - 1) * p
            lo, hi = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert got[g][f"low{name}"] == lo
            assert abs(got[g][f"p{name}"] - (lo + (hi - lo) * (at - int(at)))) < 1e-6
    assert set(got) == {"a", "b", "d"}


def test_cuts_and_lists(spark):
    cut = lambda t, n: one(spark, t, lambda c: T.truncate_at_sentence(c, n))
    assert cut("One. Two is long here.", 10) == "One." and cut("no sentence end here", 12) == "no sentence…" and cut("short", 10) == "short" and cut(None, 5) is None
    window = lambda t: one(spark, t, lambda c: T.highlight_preview(c, ["Needle"], 8))
    assert window("0123456789needle tail") == "...89needle..." and window("nothing") == "nothing" and window("0123456789") == "01234567..."
    assert one(spark, "a, C ,aa", X.label_list) == [0, 2, 26] and one(spark, "a,1", X.label_list) is None and one(spark, "", X.label_list) is None
    same = lambda a, b: spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(X.same_members(F.col("a"), F.col("b"))).first()[0]
    assert same([1, 2], [2, 1]) and not same([1, 1], [1]) and same(None, [])


def test_signal_paths_and_retention(spark, tmp_path):
    assert S.signal_paths("/root/c", ["x/*.tsv", "/abs/y.tsv", " ", "x/*.tsv"]) == ["/abs/y.tsv", "/root/c/x/*.tsv"]
    log = spark.createDataFrame([("2026-01-05 10:00:00", 1), ("2026-01-19 10:00:00", 2), ("2026-01-27 10:00:00", 3)], "t string, n int").select(F.to_timestamp("t").alias("ts"), "n")
    S.write_log(log, str(tmp_path / "log"))
    kept = S.retained_log(spark, str(tmp_path / "log"), "ts timestamp, n int", "2026-01-28", 1)
    assert sorted(r["n"] for r in kept.collect()) == [2, 3]
