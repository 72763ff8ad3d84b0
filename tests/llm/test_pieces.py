import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import pieces


def check(text, limit, overlap):
    got = pieces.cut(text, limit, overlap)
    if len(text) <= limit:
        assert got == []
        return got
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b in got)
    return got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n。!", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_any_text_is_covered(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries_come_first():
    para = "A sentence of some length stands here. " * 20
    text = "\n\n".join(para.strip() for _ in range(6))
    got = check(text, 2400, 150)
    assert all(text[:b].endswith("\n\n") for _, b in got[:-1])
    lines = "\n".join("word " * 30 for _ in range(40))
    assert all(lines[:b].endswith("\n") for _, b in check(lines, 2400, 150)[:-1])
    one = "Short sentence number one. " * 300
    assert all(one[:b].endswith(". ") for _, b in check(one, 2400, 150)[:-1])


def test_no_boundary_and_very_long():
    got = check("x" * 100_000, 2400, 150)
    assert all(b - c == 150 for (_, b), (c, _) in zip(got, got[1:]))
    rng = random.Random(1)
    check("".join(rng.choice("ab \n.") for _ in range(300_000)), 2400, 150)


def test_operator_cases(spark):
    long = "word " * 1000
    rows = [("page", 1, long), ("page", 1, long), ("page", 2, None), ("page", 3, ""), ("page", 4, "x" * 2400), ("chunk", None, "x" * 2401)]
    df = spark.createDataFrame(rows, "item_kind string, item_id long, text string").selectExpr("*", "'clash' AS piece", "7 AS piece_no")
    got = pieces.split_oversized(df, ["item_kind", "item_id"]).collect()
    assert sorted({(r.item_kind, r.item_id) for r in got}, key=str) == [("chunk", None), ("page", 1)]
    assert all(r.piece == (long if r.item_kind == "page" else "x" * 2401)[r.start_pos : r.end_pos] for r in got)
    assert pieces.split_oversized(df.limit(0), ["item_kind", "item_id"]).count() == 0


def test_query(spark, sf_dir):
    want = {(k, i) for k, t, c in (("page", "pdf_pages", "page_seq"), ("chunk", "chunks", "chunk_seq")) for i, x in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text").collect() if x and len(x) > 2400}
    assert {tuple(r) for r in pieces.p4_found(spark, sf_dir).collect()} == want
    assert {(r.item_kind, r.item_id) for r in pieces.p4_pieces(spark, sf_dir).collect()} == want
