from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusloom.llm import mixing, packing
from corpusloom.llm.queries import p6_fill, p6_pack, p7_mix, p7_shares
from corpusloom.llm.tokens import count_tokens, encoder


def test_assign_fills_and_balances():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 500, 2000))[::-1]
    seq = packing.assign(sizes, 512)
    load = np.bincount(seq, sizes)
    assert load.max() <= 512 and load.sum() == sizes.sum()
    assert sizes.sum() / (512 * len(load)) > 0.9


def test_every_token_has_one_place(spark, data):
    rows = p6_pack(spark, data).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["pack_name"], r["doc_id"]].append(r)
    sizes = {}
    for (name, doc), pieces in by.items():
        pieces.sort(key=lambda r: r["start_token"])
        assert [p["start_token"] for p in pieces] == list(np.cumsum([0] + [p["n_tokens"] for p in pieces])[:-1])
        total = sum(p["n_tokens"] for p in pieces)
        assert sizes.setdefault(doc, total) == total
        assert len(pieces) == max(1, -(-total // pieces[0]["capacity"]))
    loads = Counter()
    for r in rows:
        if r["container"] is not None:
            loads[r["pack_name"], r["container"], r["capacity"]] += r["n_tokens"]
    assert all(n <= capacity for (_, _, capacity), n in loads.items())
    assert len({len([d for p, d in by if p == name]) for name in {p for p, _ in by}}) == 1
    assert all(r["fill"] > 0.98 for r in p6_fill(spark, "/root/testdata/sf0.01").collect())


def test_packing_edges(spark):
    items = spark.createDataFrame([(1, 0), (2, None), (3, 10), (4, 25), (5, 10)], "doc_id long, n_tokens long")
    sizes = spark.createDataFrame([("a", 10), ("none", 0)], "pack_name string, capacity_tokens int")
    got = [(r["doc_id"], r["piece_no"], r["n_tokens"], r["container"] is None) for r in packing.pack(items, sizes).collect()]
    assert sorted(got) == [(1, 1, 0, True), (2, 1, 0, True), (3, 1, 10, False), (4, 1, 10, False), (4, 2, 10, False), (4, 3, 5, False), (5, 1, 10, False)]
    assert packing.pack(items.limit(0), sizes).count() == 0
    assert packing.pack(items, sizes.limit(0)).count() == 0


def test_token_counts_of_long_texts_add_up():
    text = ("Größe and naïve words, " * 20_000) + "end"
    whole = len(encoder.__wrapped__("/opt/tokenizers/byte_bpe_multi_50k.tiktoken").encode_ordinary(text))
    assert count_tokens(text) == whole
    assert count_tokens(None) == count_tokens("") == 0 and count_tokens("\ud800x") > 0


def test_token_counts_of_long_texts_are_exact():
    e, rng = encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken"), np.random.default_rng(5)
    parts = np.array(["word", " ", "  ", "\n\n   ", "\t", "\r\n", "12,345", "don't", "\u00a0", "żółw", "…", "\x1c", "x" * 70_000, " " * 9000, "\n" * 4096 + " ", "\u3000" * 5000])
    weights = np.array([30] * 12 + [0.02] * 4) / sum([30] * 12 + [0.02] * 4)
    for _ in range(12):
        text = "".join(rng.choice(parts, 60_000, p=weights))
        assert count_tokens(text) == len(e.encode_ordinary(text))
    assert count_tokens(" " * 1_000_000) == len(e._encode_single_piece(" " * 1_000_000))


def test_slots_are_a_permutation_all_over_the_passes(spark):
    df = spark.range(5000).selectExpr("'m' AS mix_name", "'s' AS source", "id AS unit", "5000L AS units")
    rows = sorted((r["unit"], r["slot"]) for r in mixing.permuted(df).collect())
    slots = np.array([s for _, s in rows])
    assert sorted(slots.tolist()) == list(range(5000))
    assert abs(np.corrcoef(np.arange(5000), slots)[0, 1]) < 0.05
    assert (np.diff(slots) % 5000 == 1).mean() < 0.01  # no rotation: neighbours part


def test_leaves_take_all_units_once():
    units = np.array([13, 0, 7, 101])
    for n in (1, 2, 5, 8):
        taken = [[] for _ in units]
        for s in range(n):
            first, count = mixing.leaf(units, n, s, 5)
            for k in range(len(units)):
                taken[k] += range(first[k], first[k] + count[k])
        assert [sorted(t) for t in taken] == [list(range(u)) for u in units]


def test_shares_and_repeats(spark):
    rng = np.random.default_rng(2)
    docs = [(i, s, int(rng.integers(20, 200))) for i, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["small"] * 30)]
    df = spark.createDataFrame(docs + [(9000, None, 5), (9001, "big", 0)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("m", " Big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.1, 40), ("m", "absent", 0.1, 3)], "mix_name string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(df, targets)
    rows, share = selection.collect(), {r["source"]: r for r in shares.collect()}
    uses = Counter(r["doc_id"] for r in rows)
    caps = {"big": 1, "mid": 2, "small": 40}
    source = {i: s for i, s, _ in docs}
    assert all(n <= caps[source[i]] for i, n in uses.items())
    assert len({(r["doc_id"], r["pass_no"]) for r in rows}) == len(rows)
    assert share["absent"]["used_tokens"] == 0
    for s, t in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert share[s]["actual_share"] == pytest.approx(t, abs=0.01)
        assert share[s]["used_tokens"] == sum(r["n_tokens"] for r in rows if r["source"] == s)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["position"] for r in rows if r["shard"] == shard) == list(range(1, 1 + sum(r["shard"] == shard for r in rows)))


def test_queries(spark, data):
    shares = {(r["mix_name"], r["source"]): r for r in p7_shares(spark, data).collect()}
    used, uses = Counter(), Counter()
    for r in p7_mix(spark, data).collect():
        used[r["mix_name"], r["source"]] += r["n_tokens"]
        uses[r["mix_name"], r["source"], r["doc_id"]] += 1
    assert {k: r["used_tokens"] for k, r in shares.items() if r["used_tokens"]} == dict(used)
    assert all(n <= shares[m, s]["max_repeats"] for (m, s, _), n in uses.items())
