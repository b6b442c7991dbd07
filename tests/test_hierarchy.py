"""p3 against plain Python on random graphs, deep chains and the small tables."""

import random
from collections import defaultdict

from corpusloom.operators import hierarchy as H
from corpusloom.plans.integrity import p3_found, p3_hierarchy


def reachable(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    loops = set()
    for v in list(out):
        todo, seen = list(out[v]), set()
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo.extend(out.get(w, ()))
        if v in seen:
            loops.add(v)
    return loops


def frame(spark, edges):
    return spark.createDataFrame([(str(a), str(b)) for a, b in edges], "parent string, child string")


def test_cycles_in_random_digraphs(spark):
    rng = random.Random(5)
    for n, m in ((12, 14), (30, 34)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        got = {r["node"] for r in H.cycle_nodes(frame(spark, edges)).collect()}
        assert got == {str(v) for v in reachable(edges)}


def test_junction_between_cycles_and_tail(spark):
    # 1->2->3->1 leads into the junction 5, which is also fed by the tail 4 and closes 5->6->7->5; 8 hangs below
    edges = [(1, 2), (2, 3), (3, 1), (3, 5), (4, 5), (5, 6), (6, 7), (7, 5), (7, 8), (9, 9)]
    assert {r["node"] for r in H.cycle_nodes(frame(spark, edges)).collect()} == set("1235679")


def test_deep_chain_and_flat_parent(spark):
    edges = [(i, i + 1) for i in range(200)] + [("p", f"k{i}") for i in range(50)]
    nodes = spark.createDataFrame([(str(v),) for e in edges for v in e], "node string")
    rows = {r["node"]: r for r in H.hierarchy(nodes, frame(spark, edges)).collect()}
    assert rows["150"]["depth"] == 150 and rows["0"]["n_descendants"] == 200 and rows["200"]["root"] == "0"
    assert rows["3"]["path"] == "0 > 1 > 2 > 3"
    assert rows["p"]["n_descendants"] == 50 and all(rows[f"k{i}"]["depth"] == 1 for i in range(50))


def test_intervals_are_the_descendants(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN_OUT", 2)  # several buckets of siblings
    rng = random.Random(3)
    edges = [(rng.randrange(i), i) for i in range(1, 40)]
    nodes = spark.createDataFrame([(str(v),) for v in range(40)], "node string")
    rows = H.hierarchy(nodes, frame(spark, edges)).collect()
    up = {b: a for a, b in edges}
    for r in rows:
        v, chain = int(r["node"]), []
        while v in up:
            v = up[v]
            chain.append(v)
        assert r["depth"] == len(chain)
        inside = {int(x["node"]) for x in rows if x["entry"] < r["entry"] and r["exit"] < x["exit"]}
        assert inside == set(chain)


def test_descendants_over_every_parent_and_cycle(spark):
    rng = random.Random(8)
    for n, m in ((14, 18), (40, 44)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        nodes = spark.createDataFrame([(str(v),) for v in range(n)], "node string")
        rows = {int(r["node"]): r for r in H.hierarchy(nodes, frame(spark, edges)).collect()}
        out = defaultdict(set)
        for a, b in edges:
            out[a].add(b)
        for v in range(n):
            todo, seen = list(out[v]), set()
            while todo:
                w = todo.pop()
                if w not in seen:
                    seen.add(w)
                    todo.extend(out.get(w, ()))
            assert rows[v]["n_descendants"] == len(seen - {v}), (v, rows[v])
            below = lambda x: {w for w, r in rows.items() if x == w or (r["root"] == rows[x]["root"] and r["root"] and rows[x]["entry"] < r["entry"] and r["exit"] < rows[x]["exit"])}
            assert seen - {v} == set().union(*[below(int(t)) for t in rows[v]["further_tops"]], below(v) if not rows[v]["in_cycle"] else set()) - {v}


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([(None, "a"), ("b", None)], "parent string, child string")
    assert H.cycle_nodes(none).count() == 0
    got = H.hierarchy(spark.createDataFrame([("a",), ("a",), (None,)], "node string"), none).collect()
    assert [(r["node"], r["depth"], r["in_cycle"]) for r in got] == [("a", 0, False)]


def test_children_entries(spark):
    rows = [(1, "a/b", ["c", "./d", "a/x", None, "", "c", "../e", "gone"]), (1, "a/b/c", None), (1, "a/x", []), (1, "d", None), (1, "e", None)]
    f = spark.createDataFrame(rows, "collection_id long, path string, children array<string>")
    got = {(r["parent"], r["child"]) for r in H.folder_edges(f).collect()}
    assert got == {("folders:a/b", "folders:a/b/c"), ("folders:a/b", "folders:d"), ("folders:a/b", "folders:a/x"), ("folders:a/b", "folders:e")}


def test_queries_on_the_tables(spark, data):
    loops = {(r["node_table"], r["node_key"]) for r in p3_found(spark, data).collect()}
    rows = p3_hierarchy(spark, data).collect()
    assert {(r["node_table"], r["node_key"]) for r in rows if r["in_cycle"]} == loops
    assert all(r["in_cycle"] or r["depth"] is not None for r in rows)
