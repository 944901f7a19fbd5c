"""Layout, rubric, version and range operators on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from evalloom.operators import cases as C
from evalloom.operators import datasets as D
from evalloom.operators import layout as L


def word(doc, page, top, x0, text, size=10.0, font="Sans"):
    return (doc, page, float(top), float(top) + size, float(x0), float(x0) + 6.0 * len(text), text, size, font)


WORDS = (
    [word(1, 1, 0, 0, "Leave", 20.0, "A+Sans-Bold"), word(1, 1, 0, 150, "Policy", 20.0, "A+Sans-Bold"), word(1, 1, 40, 0, "1.", 14.0, "Sans-Bold"), word(1, 1, 40, 30, "Scope", 14.0, "Sans-Bold")]
    + [word(1, 1, 60, 0, "Every"), word(1, 1, 60.5, 40, "em-"), word(1, 1, 72, 0, "ployee"), word(1, 1, 72, 50, "may"), word(1, 1, 72, 300, "go ."), word(1, 1, 100, 0, "An"), word(1, 1, 100, 30, "employee"), word(1, 1, 100, 200, "rests.")]
    + [word(1, 1, 120, 0, "•"), word(1, 1, 120, 10, "first"), word(1, 1, 131, 10, "more"), word(1, 1, 142, 0, "•"), word(1, 1, 142, 10, "second"), word(1, 1, 400, 0, "Page"), word(1, 1, 400, 40, "1"), word(1, 1, 400, 50, "of"), word(1, 1, 400, 60, "2")]
    + [word(1, 1, 380, 0, "Part", 14.0, "Sans-Bold"), word(1, 1, 380, 40, "two", 14.0, "Sans-Bold"), word(1, 2, 0, 0, "and", 14.0, "Sans-Bold"), word(1, 2, 0, 40, "three", 14.0, "Sans-Bold"), word(1, 2, 30, 0, "Body"), word(1, 2, 30, 500, "text.")]
)
SCHEMA = "doc long, page int, top double, bottom double, x0 double, x1 double, text string, size double, font string"


def test_layout(spark):
    lines = L.lines(spark.createDataFrame(WORDS, SCHEMA), "doc")
    found = {(r["page"], r["text"]): (r["size"], r["bold"]) for r in lines.collect()}
    assert found[1, "Leave Policy"] == (20.0, True) and found[1, "Every em-"] == (10.0, False) and found[1, "ployee may go."] == (10.0, False)
    levels = {r["text"]: (r["body"], r["level"]) for r in L.levels(lines, "doc").collect()}
    assert levels["Leave Policy"] == (10.0, 1) and levels["1. Scope"] == (10.0, 2) and levels["Every em-"] == (10.0, None)
    blocks = L.blocks(L.levels(lines, "doc"), "doc").orderBy("pos").collect()
    assert [(r["kind"], r["level"], r["text"]) for r in blocks] == [
        ("heading", 1, "Leave Policy"), ("heading", 2, "1. Scope"), ("paragraph", None, "Every employee may go."), ("paragraph", None, "An employee rests."),
        ("list", None, "• first more\n• second"), ("heading", 2, "Part two and three"), ("paragraph", None, "Body text."),
    ]
    assert L.lines(spark.createDataFrame([], SCHEMA), "doc").count() == 0


def test_joined(spark):
    """Wrapped lines, hyphens that stay and that go, items, hanging lines, and a heading over pages."""
    def block(*texts, page=1, x0=0.0, level=None, start=0):
        return [(page, start + i, t, 12.0 * (start + i), 12.0 * (start + i) + 10, x0, x0 + 400.0, 10.0, False, 10.0, 400.0, level) for i, t in enumerate(texts)]

    def text(rows):
        df = spark.createDataFrame([(1, *r) for r in rows], "k int, page int, line int, text string, top double, bottom double, x0 double, x1 double, size double, bold boolean, body double, right_edge double, level int")
        return [r["text"] for r in L.blocks(df, "k").orderBy("pos").collect()]

    assert text(block("a well-", "known fact")) == ["a well-known fact"] and text(block("an em-", "ployee here", "and Employee there")) == ["an employee here and Employee there"]
    assert text(block("one", "two")) == ["one two"] and text(block("a -", "x")) == ["a - x"] and text(block("em-", "Ployee employee")) == ["em-Ployee employee"]
    assert text(block("• one") + block("goes on", x0=9.0, start=1) + block("• two", start=2) + block("text", start=3)) == ["• one goes on\n• two", "text"]
    turn = lambda second, level: text(block("Part on Travel and", level=1, page=1) + block(second, level=level, page=2) + block("Body", page=2, start=1))
    assert turn("Meals", 1) == ["Part on Travel and Meals", "Body"] and turn("2. Pay", 1) == ["Part on Travel and", "2. Pay", "Body"] and turn("Meals", 2) == ["Part on Travel and", "Meals", "Body"]
    assert text(block("A title", level=2, page=1) + block("over three", level=2, page=2) + block("pages", level=2, page=3)) == ["A title over three pages"]


def test_contents_and_outline(spark):
    rows = [(0, 1, "heading", 1, "Acme"), (1, 1, "heading", 1, "Leave"), (2, 1, "paragraph", None, "x"), (3, 1, "heading", 2, "Table of Contents"), (4, 1, "heading", 3, "1 Scope"), (5, 1, "paragraph", None, "..."), (6, 2, "heading", 2, "1. Scope"), (7, 2, "heading", 1, "Part 2 – Pay"), (8, 2, "heading", 2, "contents")]
    blocks = spark.createDataFrame([(1, *r) for r in rows], "k long, pos int, page int, kind string, level int, text string")
    kept = L.without_contents(blocks, "k")
    assert [r["pos"] for r in kept.orderBy("pos").collect()] == [0, 1, 2, 6, 7, 8]  # nothing follows the last one, so it stays
    assert [(r["number"], r["title"]) for r in L.outline(kept, "k").orderBy("pos").collect()] == [("1", "Scope"), ("Part 2", "Pay"), (None, "contents")]
    assert L.title_lines(kept, "k").first()["title_lines"] == ["Acme", "Leave"]


def test_ranges():
    today = dt.date(2024, 3, 10)
    assert D.resolve_range("7d", None, None, today) == ("7d", dt.date(2024, 3, 4), today, 7, "day")
    assert D.resolve_range("custom", "2024-03-01", "2024-04-01", today) == ("custom", dt.date(2024, 3, 1), today, 10, "day")
    assert D.resolve_range("custom", "2020-01-01", "2024-03-10", today)[1:4] == (today - dt.timedelta(365), today, 366)
    assert D.resolve_range("custom", "2023-12-01", "2024-03-10", today)[4] == "week"
    for bad in (("custom", "2024-03-02", "2024-03-01"), ("custom", "2024-13-01", "2024-12-01"), ("custom", None, "2024-01-01"), ("year", None, None)):
        assert D.resolve_range(*bad, today)[0] == "30d"


def test_page_shapes():
    assert C.page_ranges({"A": [1, "3-4"], "B": {"pages": {"page": 7}}}) == [("A", 1, 1), ("A", 3, 4), ("B", 7, 7)]
    assert C.page_ranges(True) == C.page_ranges("x-1") == C.page_ranges({"page": "1"}) == [] and C.page_ranges("5 - ") == [(None, 5, 5)]


def test_countries(spark):
    named = lambda text, j: spark.range(1).select(C.names_country(F.lit(text), F.lit(j)).alias("x")).first()["x"]
    assert named("In the U.K. it is so", "GB") and named("We germans", "DE") is False and named("German law", "DE") and named("See XY.", "XY") and not named("xyz", "XY") and named(None, "DE") is False
