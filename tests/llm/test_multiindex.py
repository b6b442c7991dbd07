import numpy as np

from corpusloom.llm import multiindex as M
from corpusloom.llm.queries import p4_found, p4_topk
from corpusloom.runtime import table


def brute(points, k):
    """(model, id) -> ordered ids and similarities."""
    out = {}
    for model in {m for m, _, _ in points}:
        own = sorted((i, v) for m, i, v in points if m == model)
        ids, x = np.array([i for i, _ in own]), M.unit(np.array([v for _, v in own]))
        sim = np.round(x @ x.T, 9)
        for n, i in enumerate(ids):
            order = [j for j in np.lexsort((ids, -sim[n])) if j != n][:k]
            out[model, int(i)] = [(int(ids[j]), float(sim[n, j])) for j in order]
    return out


def usable_rows(spark, folder):
    return M.usable(table(spark, folder, "chunk_vectors"), "chunk_id", "vector", "model", "dimensions")


def test_found_recall(spark):
    folder = "/root/testdata/sf0.01"
    near = brute([(r["model"], r["id"], r["v"]) for r in usable_rows(spark, folder).collect()], 10)
    want = {tuple(sorted((i, j))) for (_, i), js in near.items() for j, s in js if s >= 0.9}
    got = [tuple(r) for r in p4_found(spark, folder).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.99 * len(want) and len(set(got) - want) <= 0.01 * len(want)


def test_topk_recall(spark):
    folder = "/root/testdata/sf0.01"
    near = brute([(r["model"], r["id"], r["v"]) for r in usable_rows(spark, folder).collect()], 10)
    want = {(m, i, j) for (m, i), js in near.items() if i % 100 == 0 for j, _ in js}
    got = {(r["model"], r["chunk_id"], r["near_chunk_id"]) for r in p4_topk(spark, folder).collect()}
    assert len(got & want) >= 0.9 * len(want) > 0


def test_copies_ties_and_unusable(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)  # cells in several blocks
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i % 40].tolist(), "a", 8, "x") for i in range(120)] + [(200 + i, base[0].tolist(), "a", 8, "x") for i in range(50)]
    rows += [(900, None, "a", 8, "x"), (901, [0.0] * 8, "a", 8, "x"), (902, [float("nan")] + [1.0] * 7, "a", 8, "x"), (903, [1.0] * 7, "a", 8, "x"), (904, [1.0] * 8, "b", 8, "x"), (0, base[0].tolist(), "a", 8, "x")]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<float>, model string, dimensions int, rep string")
    points = M.usable(df, "chunk_id", "vector", "model", "dimensions")
    want = brute([(r["model"], r["id"], r["v"]) for r in points.collect()], 5)
    got = {}
    for r in M.top_similar(points, 5, enough=10_000).orderBy("rank").collect():
        got.setdefault((r["model"], r["id"]), []).append((r["near_id"], round(r["similarity"], 6)))
    assert {k: [(j, round(s, 6)) for j, s in v] for k, v in want.items() if v} == got
    assert ("b", 904) not in got


def test_walk_is_in_order():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(7), rng.random(5)
    cells = M.walk(d1, d2, [1] * 35, 10_000)
    sums = [d1[c // 5] + d2[c % 5] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == 35


def test_empty(spark):
    points = spark.createDataFrame([], "id long, model string, v array<float>")
    assert M.top_similar(points, 3).count() == 0
