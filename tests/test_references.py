"""p2 against a plain Python reading of the rules, on the small tables and on a fixture with awkward rows."""

import re
from collections import defaultdict

from corpusloom.operators import references as R
from corpusloom.plans.integrity import REFERENCE_TABLES, p2_found, p2_report
from corpusloom.runtime import table


def resolve(path):
    out = []
    for s in path.replace("\\", "/").split("/"):
        if s == "..":
            out[-1:] = []
        elif s not in ("", "."):
            out.append(s)
    return "/" + "/".join(out)


def slug(s):
    return re.sub("-{2,}", "-", re.sub("[^a-z0-9-]+", "-", s.lower())).strip("-")


def brute(t):
    root = {r["id"]: r["path"] for r in t["collections"]}
    ids, paths, seen, gone, sections = {}, {}, defaultdict(list), {}, defaultdict(set)
    for r in t["files"]:
        ids[r["id"]], paths[r["path"]] = r["path"], r["collection_id"]
        seen[r["path"]].append(r["last_indexed"])
    for r in t["file_deletions"]:
        gone[r["path"]] = max(gone.get(r["path"], 0), r["deleted_at"])
    for r in t["chunks"]:
        sections[ids.get(r["file_id"])].add(r["section_id"])
    found = set()
    for name in ("links", "ref_results"):
        for r in t[name]:
            if not r["target_path"]:
                continue
            source = ids.get(r["source_file_id"]) if name == "links" else r["source_path"]
            p = r["target_path"].replace("\\", "/")
            p = resolve(p if p.startswith("/") else root.get(paths.get(source), "?") + "/" + p)
            at, s = r["indexed_at" if name == "links" else "checked_at"], r["target_section"]
            if p not in seen:
                reason = "missing"
            elif gone.get(p, 0) > max(seen[p]):
                reason = "deleted"
            elif s and slug(s) not in sections[p]:
                reason = "section"
            elif at is not None and min(seen[p]) > at:
                reason = "late"
            else:
                continue
            found.add((name, r["id"], reason))
    return found


def test_found_equals_brute_force(spark, data):
    folder = "/root/testdata/sf0.01"
    rows = {n: [r.asDict() for r in table(spark, folder, n).collect()] for n in REFERENCE_TABLES}
    got = [tuple(r) for r in p2_found(spark, folder).collect()]
    assert len(got) == len(set(got)) > 50
    assert set(got) == brute(rows)


def test_report_counts_everything(spark, data):
    report = p2_report(spark, data).collect()
    found = p2_found(spark, data).count()
    assert sum(r["n_rows"] for r in report if r["edge"] == "target") == found


def test_cascade_follows_chains_and_stops_on_cycles(spark):
    parents = [(i + 1, i) for i in range(1, 40)] + [(101, 102), (102, 101)]
    p = spark.createDataFrame(parents, "chunk_id long, parent_id long")
    o = spark.createDataFrame([(3, 0), (20, 0), (101, 0)], "chunk_id long, level int")
    got = {r["chunk_id"]: r["level"] for r in R.cascade_chunks(p, o).collect()}
    want = {i: (i - 20 if i >= 20 else i - 3) for i in range(3, 41)} | {101: 0, 102: 1}
    assert got == want


def test_empty_tables(spark, data):
    t = {n: table(spark, data, n).limit(0) for n in REFERENCE_TABLES}
    assert R.orphan_cascade(t).count() == 0


def test_cascade_covers_every_edge(spark, data):
    t = {n: table(spark, data, n).limit(0) for n in REFERENCE_TABLES}
    add = lambda name, rows: t.__setitem__(name, t[name].unionByName(spark.createDataFrame(rows), allowMissingColumns=True))
    add("collections", [{"id": 1, "path": "/c"}])
    add("files", [{"id": 10, "path": "/c/a.md", "collection_id": 1, "last_indexed": 5}, {"id": 11, "path": "/c/b.md", "collection_id": 9, "last_indexed": 5}, {"id": 10, "path": "/c/a.md", "collection_id": 1, "last_indexed": 5}])
    add("file_deletions", [{"collection_id": 1, "path": "/c/never.md", "deleted_at": 7}, {"collection_id": 8, "path": "/c/b.md", "deleted_at": 2}])
    rows = [(100, 10, "ok", None), (101, 10, "gone", 999), (102, 10, "below", 101), (103, 11, "far", None), (104, 77, "lost", None), (105, 10, "both", 102), (106, 10, "both", 100)]
    add("chunks", [{"id": i, "file_id": f, "section_id": s, "parent_chunk_id": p, "created_at": 3} for i, f, s, p in rows])
    add("chunk_vectors", [{"chunk_id": 105}, {"chunk_id": 500}, {"chunk_id": 100}])
    link = lambda i, f, own, path, s: {"id": i, "source_file_id": f, "source_section_id": own, "target_path": path, "target_section": s, "indexed_at": 9}
    add("links", [link(1, 10, "ok", "a.md", "below"), link(2, 10, "below", "a.md", "ok"), link(3, 11, "x", "/c/a.md", "both"), link(4, 55, "x", "/c/a.md", None)])
    add("ref_results", [{"id": 1, "source_path": "/c/none.md", "target_path": "/c/a.md", "target_section": "gone", "checked_at": 9}])
    got = {(r["ref_table"], r["ref_id"], r["edge"], r["kind"], r["reason"], r["level"]) for r in R.orphan_cascade(t).collect()}
    assert got == {
        ("files", "11", "collection", "direct", "missing", 0), ("file_deletions", "/c/never.md", "path", "direct", "missing", 0), ("file_deletions", "/c/b.md", "collection", "direct", "missing", 0),
        ("chunks", "101", "parent", "direct", "missing", 0), ("chunks", "102", "parent", "inherited", None, 1), ("chunks", "105", "parent", "inherited", None, 2),
        ("chunks", "103", "file", "inherited", None, 1), ("chunks", "104", "file", "direct", "missing", 0),
        ("chunk_vectors", "500", "chunk", "direct", "missing", 0), ("chunk_vectors", "105", "chunk", "inherited", None, 3),
        ("links", "1", "target", "inherited", None, 2), ("links", "2", "source_section", "inherited", None, 2), ("links", "3", "source", "inherited", None, 1), ("links", "4", "source", "direct", "missing", 0),
        ("ref_results", "1", "source", "direct", "missing", 0), ("ref_results", "1", "target", "inherited", None, 1),
    }
