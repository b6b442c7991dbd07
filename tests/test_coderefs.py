"""Validation of code references against a plain version, and rewritten texts."""

import random

from corpusloom.functions.hashing import line_token
from corpusloom.operators import coderefs as R

SCHEMA = "id long, raw string, path string, start int, start_token string, end int, end_token string"


def plain(files, path, start, st, end, et, window, slack):
    if path not in files:
        return ("missing_file", None, None)
    ls, has_end = files[path], end is not None
    stop = end if has_end else start
    if start < 1 or stop < start or stop > len(ls):
        return ("out_of_bounds", None, None)
    at = lambda k, t: 1 <= k <= len(ls) and line_token(ls[k - 1], max(len(t), 2)) == t
    if (not st or at(start, st)) and (not et or at(stop, et)):
        return ("valid_exact" if st and (not has_end or et) else "valid_unchecked", start, stop)
    near = lambda t, c, w: [k for k in range(max(1, c - w), min(len(ls), c + w) + 1) if at(k, t)]
    gap = stop - start
    if st and et:
        found = {(a, b) for a in near(st, start, window) for b in near(et, a + gap, slack) if b >= a}
    elif st:
        found = {(a, a + gap) for a in near(st, start, window)}
    else:
        found = {(b - gap, b) for b in near(et, stop, window)}
    found = sorted((a, b) for a, b in found if a >= 1 and b <= len(ls))
    return ("valid_shifted", *found[0]) if len(found) == 1 else ("stale_ambiguous" if found else "stale", None, None)


def test_against_plain_version(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    files = {f"f{k}.go": [rng.choice(words) for _ in range(rng.randint(1, 700))] for k in range(5)}
    rows = []
    for k in range(400):
        path = rng.choice([*files, "gone.go"])
        ls = files.get(path, ["x"])
        start, n = rng.randint(1, len(ls) + 2), rng.choice([2, 3, 8])
        end = rng.choice([None, start + rng.randint(0, 5)])
        pick = lambda at: rng.choice(["", line_token(ls[min(max(at + rng.choice([0, 0, 1, -2, 30]), 1), len(ls)) - 1], n)])
        st, et = pick(start), pick(end) if end else ""
        raw = f"{path}:{start}" + (f"@{st}" if st else "") + (f"-{end}" + (f"@{et}" if et else "") if end else "")
        rows.append((k, raw, path, start, st, end, et))
    lines = spark.createDataFrame([(p, i + 1, s) for p, ls in files.items() for i, s in enumerate(ls)], "path string, line_no int, line string")
    got = {r["id"]: r for r in R.validate(spark.createDataFrame(rows + rows[:9], SCHEMA), lines, window=12, slack=3).collect()}
    assert len(got) == len(rows)
    for k, raw, path, start, st, end, et in rows:
        status, a, b = plain(files, path, start, st, end, et, 12, 3)
        assert (got[k]["status"], got[k]["suggested_start"], got[k]["suggested_end"]) == (status, a, b), raw
        if a is not None:
            n = len(st) or len(et) or 3
            want = f"{path}:{a}@{st or line_token(files[path][a - 1], n)}" + (f"-{b}@{et or line_token(files[path][b - 1], n)}" if end else "")
            assert got[k]["suggested_raw"] == want
    assert {r["status"] for r in got.values()} >= {"valid_exact", "valid_shifted", "stale", "missing_file", "out_of_bounds"}


def test_rewrite(spark):
    docs = spark.createDataFrame([(1, "see a.go:3 and (a.go:3), b.go:1@abc-2."), (2, "nothing"), (3, None), (4, "a.go:31")], "id long, text string")
    found = spark.createDataFrame([(1, "a.go:3", "a.go:4@xyz"), (1, "b.go:1@abc-2", None), (4, "a.go:3", "a.go:4@xyz"), (1, "a.go:3", "a.go:9@xyz")], "id long, raw string, suggested_raw string")
    assert [tuple(r) for r in R.rewrite(docs, found).collect()] == [(1, "see a.go:4@xyz and (a.go:4@xyz), b.go:1@abc-2.", 2)]


def test_empty(spark):
    lines = spark.createDataFrame([], "path string, line_no int, line string")
    assert R.validate(spark.createDataFrame([], SCHEMA), lines).count() == 0
    assert R.validate(spark.createDataFrame([(1, "a.go:1", "a.go", 1, None, None, None)], SCHEMA), lines).first()["status"] == "missing_file"
