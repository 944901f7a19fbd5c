"""Chunks by the rules of sections, packing, overlap, tables and remnants: fixed cases, and every document's words in order."""

import re
from collections import defaultdict

import duckdb
import pytest

from evalloom.operators import documents as D
from evalloom.plans import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "k int, pos int, kind string, level int, text string, page int"
SENTENCE = "Every traveller has to keep all receipts of a trip for years. "  # 13 tokens


def made(spark, blocks, **kw):
    rows = [(1, i, *b) for i, b in enumerate(blocks)]
    return D.chunks(spark.createDataFrame(rows, SCHEMA), "k", **kw).orderBy("k", "chunk_index").collect()


def words(n, of="w"):
    return " ".join(f"{of}{i}" for i in range(n))


def test_long_sections_are_split_with_overlap(spark):
    blocks = [("heading", 2, "4.2 Travel", 10)] + [("paragraph", None, (SENTENCE * 12).strip(), 10 + i // 3) for i in range(12)] + [("heading", 2, "4.3 Meals", 14), ("paragraph", None, "Meals are paid.", 14)]
    got = made(spark, blocks)
    travel = [r for r in got if r["section_number"] == "4.2"]
    assert len(travel) > 1 and all(r["tokens"] <= D.MOST and r["tokens"] == D.count_tokens(r["text"]) for r in got)
    tail = "… " + (SENTENCE * 5).strip()  # five sentences have 65 tokens, the first number over 0.6 * 90
    assert all(r["text"].startswith(tail + "\n\n") for r in travel[1:]) and travel[0]["text"].startswith("4.2 Travel\n\n")
    meals = [r for r in got if r["section_number"] == "4.3"]
    assert len(meals) == 1 and meals[0]["text"] == "4.3 Meals\n\nMeals are paid." and meals[0]["section_title"] == "Meals" and meals[0]["page_start"] == 14
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and all(10 <= r["page_start"] <= r["page_end"] <= 14 for r in got)


def test_sections(spark):
    """Titles, parts of headings alone, subheadings inside, a new level that closes what is below."""
    blocks = [
        ("heading", 1, "Acme", 1), ("heading", 1, "Manual", 1), ("paragraph", None, "Before any section.", 1), ("heading", 1, "Acme", 1), ("heading", 1, "Part 3 – Rules", 2),
        ("heading", 2, "3.1 Complaints", 2), ("paragraph", None, words(50, "a"), 2), ("heading", 3, "Steps", 3), ("paragraph", None, words(50, "b"), 3), ("heading", 2, "3.2 Empty", 3), ("heading", 2, "Notes", 3), ("paragraph", None, words(50, "c"), 4), ("heading", 1, "Appendix B – Forms", 5), ("list", None, "• one\n• two " + words(50), 5),
    ]
    got = made(spark, blocks, titles=True)
    assert [(r["section"], r["section_number"], r["section_title"], r["page_start"], r["page_end"], r["content_type"]) for r in got] == [
        ("", None, None, 1, 1, "prose"), ("Part 3 – Rules › 3.1 Complaints", "3.1", "Complaints", 2, 3, "prose"), ("Part 3 – Rules › Notes", None, "Notes", 3, 4, "prose"), ("Appendix B – Forms", "B", "Forms", 5, 5, "list"),
    ]
    assert got[1]["text"] == f"3.1 Complaints\n\n{words(50, 'a')}\n\nSteps\n\n{words(50, 'b')}"
    assert made(spark, blocks)[0]["section"] == "Manual"  # without titles they are sections like others


def test_tables_stand_alone(spark):
    table = "| Step | Task |\n|---|---|\n" + "\n".join(f"| {i} | {words(60)} |" for i in range(30))
    got = made(spark, [("heading", 2, "3.1 Open", 1), ("paragraph", None, words(60), 1), ("heading", 3, "Steps", 1), ("table", None, table, 2), ("paragraph", None, words(60, "z"), 2), ("table", None, "| a |\n|---|\n| 1 |", 3)])
    assert [r["content_type"] for r in got][:2] == ["prose", "table"] and got[0]["text"] == f"3.1 Open\n\n{words(60)}"
    tables = [r for r in got if r["text"].startswith("Steps\n\n| Step | Task |\n|---|---|\n| ")]
    assert len(tables) > 1 and all(r["tokens"] <= D.MOST for r in tables)
    assert [m for r in tables for m in re.findall(r"^\| (\d+) \|", r["text"], re.M)] == [str(i) for i in range(30)]
    assert got[-1]["text"] == f"{words(60, 'z')}\n\nSteps\n\n| a |\n|---|\n| 1 |" and got[-1]["content_type"] == "prose"  # a small table joins what is before it
    wide = made(spark, [("heading", 2, "2 Wide", 1), ("table", None, f"h\n-\n{words(2000)}", 1)])
    assert len(wide) == 3 and all(r["text"].startswith("2 Wide\n\nh\n-\n") and r["tokens"] <= D.MOST for r in wide)
    assert "".join(r["text"].removeprefix("2 Wide\n\nh\n-\n") for r in wide) == words(2000)


def test_lists_are_split_at_items_and_long_runs_by_tokens():
    items = "\n".join(f"• item {i} {words(30)}" for i in range(40))
    parts = list(D.split_unit(D.unit("list", items, 1, ()), 300))
    assert len(parts) > 3 and all(p.text.startswith("• item") and p.size <= 301 for p in parts) and "\n".join(p.text for p in parts) == items
    parts = list(D.split_unit(D.unit("paragraph", f"One here. A {words(999)}. Two there. Three.", 1, ()), 300))
    assert [p.size - 1 for p in parts] == [3, 300, 300, 300, 101, 5] and " ".join(p.text.strip() for p in parts) == f"One here. A {words(999)}. Two there. Three."
    assert D.every_tokens("a b c d e", 2) == ["a b ", "c d ", "e"] and D.every_tokens("", 3) == [""]


def test_tails():
    p = lambda text: [D.unit("paragraph", text, 1, ())]
    assert D.tail_of(p(f"{words(200)}. Then {words(60)}.")).text == f"… Then {words(60)}."
    assert D.tail_of(p(f"{words(200)}. Short end.")).text == "… Short end." and D.tail_of(p(f"{words(100)}. Short end.")) is None
    assert D.tail_of(p(words(300))).text == "… " + " ".join(f"w{i}" for i in range(211, 300))  # of 90 tokens the first, which may be cut, goes
    assert D.tail_of(p("All of it.")) is None and D.tail_of([D.unit("heading", "H", 1, ())]) is None


def test_remnants():
    d = lambda n, kind=(0, 0, 1): D.Draft(words(n), ("P", f"s{n}"), (n, n), n, kind, "t")
    got = D.merged([d(10), d(500), d(20), d(790), d(30), d(35)])
    assert [(x.size, x.pages, x.path) for x in got] == [(530, (10, 500), ("P",)), (790, (790, 790), ("P", "s790")), (30, (30, 30), ("P", "s30"))][:2] + [(65, (30, 35), ("P",))]
    assert [x.size for x in D.merged([d(10), d(20)])] == [30] and D.merged([]) == [] and [x.size for x in D.merged([d(10)])] == [10]
    assert [x.size for x in D.merged([d(39), d(780), d(39)])] == [39, 780, 39]


def test_html_and_odd_rows(spark):
    html = "<h1>Part</h1><h2>Leave</h2><p>One. Two.</p><ul><li>x</li></ul><h2>Pay</h2><table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>"
    blocks = D.html_blocks(spark.createDataFrame([(1, html), (2, None), (None, "<p>no key</p>")], "k int, html string"), "k", "html")
    got = D.chunks(blocks, "k").orderBy("k", "chunk_index").collect()
    assert [(r["k"], r["section"], r["content_type"], r["text"]) for r in got] == [(None, "", "prose", "no key"), (1, "Part › Leave", "prose", "Leave\n\nOne. Two.\n\nx"), (1, "Part › Pay", "table", "Pay\n\na b\n1")]
    assert D.chunks(blocks.limit(0), "k").count() == 0
    twice = spark.createDataFrame([(5, "Leave\nsome text"), (5, "Leave\nsome text")], "k int, t string").coalesce(1)
    assert [(r["k"], r["chunk_index"]) for r in D.chunks(D.text_blocks(twice, "k", "t"), "k", in_order=True).collect()] == [(5, 0), (5, 0)]


def test_every_word_of_a_document_is_in_its_chunks(spark):
    got = defaultdict(list)
    for r in QUERIES["doc14_chunks"](spark, SF).collect():
        got[r["doc_id"]].append(r)
    for i, t in duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        lines = [x for x in (t or "").split("\n") if x.strip()]
        head = [len(x) <= 30 and x[0].isupper() for x in lines]
        sections = [[None, [], False]]
        for x, is_head in zip(lines, head, strict=True):
            if is_head and x != sections[-1][0]:  # a heading that repeats stays in its section
                sections.append([x, [], False])
            sections[-1][1] += x.split()
            sections[-1][2] |= not is_head
        want = [w for _, found, body in sections if body for w in found]
        own = []
        for r in sorted(got[i], key=lambda r: r["chunk_index"]):
            for part in r["text"].split("\n\n"):
                if part.startswith("… "):  # repeats what is before; in the middle where a remnant has joined
                    assert " ".join(part[2:].split()) in " ".join(own)
                else:
                    own += part.split()
            assert r["tokens"] == D.count_tokens(r["text"]) and r["tokens"] <= D.MOST + D.LEAST
        assert own == want
