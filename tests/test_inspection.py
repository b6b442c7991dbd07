"""Hashes, line tokens and reference checks."""

import re

import xxhash

from corpusloom.plans.inspection import stamped_locations
from corpusloom.functions.hashing import line_token
from corpusloom.operators import inspection as I
from corpusloom.plans.inspection import checked_code_refs, stale_hashes
from corpusloom.runtime import table


def test_line_tokens_ignore_outer_blanks():
    a, b, c = line_token("  return err  "), line_token("return err"), line_token("return err\r")
    assert a == b == c and re.fullmatch("[a-z2-7]{3}", a)
    assert len(line_token("x", 1)) == 2 and len(line_token("x", 99)) == 8


def test_stale_hashes(spark, data):
    rows = {r["id"]: r for r in table(spark, data, "chunks").collect() if r["content"] is not None}
    want = {i for i, r in rows.items() if r["chunk_hash"] != xxhash.xxh64_hexdigest(r["content"].encode())}
    assert {r["id"] for r in stale_hashes(spark, data).collect()} == want
    assert 0 < len(want) < len(rows)


def test_statuses(spark):
    text = ["alpha", "beta", "gamma", "beta", "delta"]
    lines = spark.createDataFrame([("a.go", k + 1, s) for k, s in enumerate(text)], "path string, line_no int, line string")
    t = {s: line_token(s) for s in text}
    refs = [(1, "r1", "a.go", 1, t["alpha"]), (2, "r2", "a.go", 1, t["gamma"]), (3, "r3", "a.go", 3, t["beta"]), (4, "r4", "a.go", 9, t["alpha"]), (5, "r5", "b.go", 1, ""), (6, "r6", "a.go", 2, ""), (7, "r7", "a.go", 2, "zzz")]
    got = {r["id"]: (r["status"], r["at"]) for r in I.check_code_refs(spark.createDataFrame(refs, "id long, raw string, path string, start int, start_token string"), lines).collect()}
    assert got == {1: ("exact", None), 2: ("shifted", 3), 3: ("ambiguous", None), 4: ("out_of_bounds", None), 5: ("unresolved", None), 6: ("unchecked", None), 7: ("stale", None)}


def test_query(spark, data):
    assert checked_code_refs(spark, data).columns == ["id", "raw", "status", "at"]


def test_chunk_locations_are_stamped(spark, data):
    first = {r["id"]: r["content"].split("\n")[0] for r in table(spark, data, "chunks").where("content is not null").collect()}
    rows = stamped_locations(spark, data).collect()
    right = sum(r["text"].rsplit("@", 1)[1] == line_token(first[r["id"]]) for r in rows)
    assert len(rows) > 100 and all(r["n_changed"] == 1 for r in rows)
    assert right >= 0.95 * len(rows)  # chunks of a file may claim the same line
