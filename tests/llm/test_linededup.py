"""Thresholds of repeated lines."""

import corpus_pipeline

from quartzite.llm import linededup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(50))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_empty_source_is_a_site(spark):
    docs = frame(spark, [(i, f"own {i}\nshared", s) for i, s in enumerate(["", "a", "b", "c", "d"])])
    assert texts(linededup.drop_spread_lines(docs, 5)) == {0: "own 0\nshared"} | {i: f"own {i}" for i in range(1, 5)}


def test_stage_drops_passages_on_two_sources(spark):
    """Short lines need five sources, copies of a whole text are left whole, one source is not enough."""
    one_site = PASSAGE + " again"
    rows = [(1, f"first\n{PASSAGE}\nshort", "a"), (2, f"second\n{PASSAGE}\nshort", "b"), (3, f"x {PASSAGE}", "a"), (4, f"x {PASSAGE}", "b"), (5, f"fifth\n{one_site}", "a"), (6, f"sixth\n{one_site}", "a")]
    want = {i: t for i, t, _ in rows} | {2: "second\nshort"}
    assert texts(corpus_pipeline.lines(spark, frame(spark, rows), "")) == want
    assert texts(linededup.drop_spread_lines(frame(spark, rows), 5)) == {i: t for i, t, _ in rows}


def test_carriage_returns_do_not_hide_a_line(spark):
    docs = frame(spark, [(i, f"own {i}\nshared{end}\nlast", s) for i, (s, end) in enumerate(zip("abc", ["", "\r", " \r"]))])
    assert texts(linededup.drop_spread_lines(docs, 3)) == {0: "own 0\nshared\nlast", 1: "own 1", 2: "own 2"}


def test_many_dropped_lines_of_one_text(spark):
    """Copies of 60,000 lines on three sources: the filter is linear, or this would take minutes."""
    text = "\n".join(f"line {i}" for i in range(60_000))
    got = linededup.drop_spread_lines(frame(spark, [(1, text, "a"), (2, text, "b"), (3, text + "\nown", "c")]), 3)
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert rows == {1: (text, 60_000, 0), 2: ("", 60_000, 60_000), 3: ("own", 60_001, 60_000)}


def test_rows_and_columns_of_all_kinds(spark):
    """Repeated rows are treated alike, nulls stay, columns of clashing names stay as they were."""
    rows = [(1, "a b\nshared", "x", 7, "t"), (1, "a b\nshared", "x", 7, "t"), (2, "shared\n\nc", "y", 8, None), (None, "shared", None, 9, "u"), (3, None, "y", 1, "v"), (4, "", "", 2, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, at int, tag string")
    got = sorted(map(tuple, linededup.drop_spread_lines(docs, 3).collect()), key=str)
    want = [(1, "a b\nshared", "x", 7, "t", 2, 0)] * 2 + [(2, "\nc", "y", 8, None, 2, 1), (None, "", None, 9, "u", 1, 1), (3, None, "y", 1, "v", 0, 0), (4, "", "", 2, "w", 0, 0)]
    assert got == sorted(want, key=str)
