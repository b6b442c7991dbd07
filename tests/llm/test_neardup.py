import random
import re

import numpy as np

from corpusloom.llm import neardup as N
from corpusloom.llm.queries import p1_classes, p1_found
from corpusloom.llm.shingles import shingle_sets
from corpusloom.runtime import table


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def truth(texts, width, s, least):
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, t in texts for w in [words(t)]}
    ids = sorted(i for i in sets if len(sets[i]) >= max(1, least))
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
    out += ["", None, "short", "A-b " * 30, "x" * 50_000, "Ünï " * 20, out[0].upper(), out[0]]
    return list(enumerate(out))


def test_shingles_as_by_hand():
    texts = ["One two, three-four", None, "", "a b", "İK one two three", "x x x x x"]
    owner, h = shingle_sets(texts)
    assert np.bincount(owner, minlength=6).tolist() == [2, 0, 0, 0, len({tuple(w) for t in [words(texts[4])] for w in zip(t, t[1:], t[2:])}), 1]
    assert len(set(h[owner == 0]) & set(shingle_sets(["two THREE four"])[1])) == 1


def run(spark, texts, width, s, least):
    df = spark.createDataFrame([(i, t, "extra") for i, t in texts], "id long, text string, similarity string").repartition(3)
    pairs, members = N.near_duplicates(df, width, s, least)
    got = [tuple(r) for r in N.all_pairs(pairs, members).collect()]
    assert len(got) == len(set(got))
    return set(got), pairs, members


def test_pairs_equal_brute_force(spark):
    texts = corpus()
    got, pairs, members = run(spark, texts, 3, 0.6, 20)
    want = truth(texts, 3, 0.6, 20)
    assert got <= want and len(want - got) <= 1 and len(want) > 60
    rows = {r["id"]: (r["class_id"], r["n_links"]) for r in N.classes(pairs, members).collect()}
    for a, b in got:
        assert rows[a][0] == rows[b][0]
    assert all(c <= i for i, (c, _) in rows.items())


def test_crowded_signatures_lose_nothing(spark):
    # half of each text is boilerplate that all share: signatures of it are crowded and must not be probed
    texts = []
    shared = " ".join(f"boiler{k}" for k in range(16))
    for i, t in corpus(4, 60):
        texts.append((i, f"{shared} {t}" if t and len(t) > 60 else t))
    got, _, _ = run(spark, texts, 3, 0.6, 20)
    want = truth(texts, 3, 0.6, 20)
    assert got <= want and len(want - got) <= 1 and len(want) > 60


def test_thresholds_turn_from_crowded_to_rare():
    cost = np.full((1, N.PARTS, 2), 3.0)
    cost[0, :, 1] = 7.0
    cost[0, 2], cost[0, 9, 1] = 5000.0, 4.0
    t = N.allocate(cost)[0]
    assert t[2] == -1 and t[9] == 1 and (t == -1).sum() == 1 and (t == 1).sum() == N.SKIP + 2


def test_symbols_that_crowd_together_are_paired():
    rng = np.random.default_rng(1)
    crowding = rng.random((500, 2 * N.PARTS))
    crowding[:, 20] = crowding[:, 3] + 0.01 * rng.random(500)
    pairs = N.pair_up(crowding)
    assert sorted(pairs.ravel().tolist()) == list(range(2 * N.PARTS)) and [3, 20] in pairs.tolist()
    assert N.pair_up(np.zeros((0, 2 * N.PARTS))).shape == (N.PARTS, 2)


def test_default_width_and_similarity(spark):
    texts = corpus(9, 20)
    df = spark.createDataFrame(texts, "id long, text string")
    got = {tuple(r) for r in N.all_pairs(*N.near_duplicates(df)).collect()}
    assert got == truth(texts, 5, 0.8, 1)


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(3)
    cost = rng.integers(1, 50, (3, N.PARTS, 2)).astype(float) * rng.choice([1, 40], (3, N.PARTS, 1))
    t = N.allocate(cost)
    covers = lambda t: (t + 1).sum() >= N.PARTS + (N.SKIP + 1) * (t == -1).sum()
    total = lambda t, c: sum(c[i, t[i]] for i in range(len(t)) if t[i] >= 0)
    for r in range(3):
        assert covers(t[r])
        for _ in range(2000):
            other = rng.integers(-1, 2, N.PARTS)
            if covers(other):
                assert total(t[r], cost[r]) <= total(other, cost[r])
        for i in range(N.PARTS):  # no single step down is allowed and cheaper
            for k in range(-1, t[r, i]):
                other = t[r].copy()
                other[i] = k
                assert not covers(other) or total(t[r], cost[r]) <= total(other, cost[r])


def test_empty(spark):
    assert run(spark, [], 3, 0.6, 20)[0] == set()


def test_queries(spark):
    folder = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in table(spark, folder, "chunks").select("id", "content").distinct().collect()]
    got = {tuple(r) for r in p1_found(spark, folder).collect()}
    want = truth(texts[:], 3, 0.6, 20) if len(texts) < 3000 else set()
    assert got <= want and len(want - got) <= 0.01 * len(want)
    assert p1_classes(spark, folder).count() > 500
