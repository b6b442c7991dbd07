from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.queries import P5_FOUND_SQL, p5_found, p5_pieces
from corpusloom.llm.split import split_oversized, split_text
from tests.oracle import connect, spark_rows, sql_rows

pieces_of_text = st.lists(st.sampled_from(["alpha ", "Größe ", "x", "end. ", "# H\n", "- item\n", "```\n", "\n", "\n\n", "日本語", "\r\n", "é"]), max_size=80).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces_of_text, st.integers(1, 120), st.integers(0, 4))
def test_pieces_make_up_the_text_and_fit(text, limit, lines):
    pieces = split_text(text, limit, lines)
    assert "".join(own for _, _, own in pieces) == text
    for start, lap, own in pieces:
        assert len((lap + own).encode()) <= limit or (len(own) <= 1 and not lap)
        assert text[:start].endswith(lap) and text[start : start + len(own)] == own


def test_boundaries_and_overlap():
    text = "# One\nfirst line\nsecond line\n\n# Two\nthird line\nfourth line\n"
    own = [o for _, _, o in split_text(text, 40, 0)]
    assert own == ["# One\nfirst line\nsecond line\n\n", "# Two\nthird line\nfourth line\n"]
    assert split_text(text, 45, 1)[1][1] in ("\n", "second line\n\n")


def test_overlap_is_whole_lines_that_fit():
    lines = [f"line {k} " + "word " * 12 + "\n" for k in range(40)]
    text = "".join(lines)
    for limit, n in ((400, 3), (400, 5), (300, 3)):
        for start, lap, own in split_text(text, limit, n)[1:]:
            whole = text[:start].splitlines(keepends=True)[-n:]
            assert lap == "".join(whole)
            assert len(lap + own) <= limit


def test_long_texts(spark):
    rows = [(1, "word " * 100_000, 2000, 3), (2, "y" * 300_000, 2000, 0), (3, None, 10, 1), (4, "", 10, 1), (5, "small", 10, 1), (6, "abc", None, 1), (7, "abcdef", 2, None), (8, "é" * 10, 0, 0)]
    got = split_oversized(spark.createDataFrame(rows, "id long, text string, max_bytes int, overlap_lines int")).collect()
    assert {r["id"] for r in got} == {1, 2, 7, 8}
    limits = {1: 2000, 2: 2000, 7: 2, 8: 2}
    assert all(r["n_bytes"] <= limits[r["id"]] for r in got)
    for i in (1, 2):
        assert "".join(r["text"][r["overlap_chars"] :] for r in sorted(got, key=lambda r: r["piece_no"]) if r["id"] == i) == rows[i - 1][1]


def test_queries(spark, data):
    got, want = spark_rows(p5_found(spark, data)), sql_rows(connect(data), P5_FOUND_SQL)
    assert got == want and got[1]
    pieces = p5_pieces(spark, data).collect()
    assert {r["chunk_id"] for r in pieces} == {r[0] for r in got[1]}
    assert all(r["n_bytes"] <= r["max_bytes"] for r in pieces)
