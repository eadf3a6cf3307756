"""Repeated rows: same doc_id and text twice, and equal rows without an id."""

from chronogrid.llm import line_dedup

SCHEMA = "doc_id long, text string"
LAST = (1 << 63) - 1


def test_line_dedup_keeps_repeated_rows(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "red green blue black white"
    rows = [(1, f"{a}\n{b}"), (1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (None, "only without an id here"), (None, "only without an id here"), (5, f"{c}\n{c}")]
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = [(LAST if i is None else i, k, frozenset(s.split())) for i, t in rows for k, s in enumerate(t.split("\n"))]
    want = {(i, k) for i, k, s in lines if any((x, y) < (i, k) and 100 * len(s & u) >= 80 * len(s | u) for x, y, u in lines)}
    assert {tuple(r) for r in line_dedup.removed_lines(docs).collect()} == want == {(2, 0), (5, 0), (5, 1)}
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([("1", f"{a}\n{b}"), ("1", f"{a}\n{b}"), ("2", c), ("None", "only without an id here"), ("None", "only without an id here"), ("5", "")])
