import pytest

from terrace.functions import markdown
from terrace.operators.chunking import last_by_path, sliding_windows, split_chapters

SCHEMA = "id string, title string, text string, path string, pieces string, window int"


def cut(spark, rows, **options):
    df = spark.createDataFrame([(*r, "p", "q", 7) for r in rows], SCHEMA)
    return [(r.path, r.content) for r in split_chapters(df, "id", "title", "text", **options).orderBy("document_id", "ordinal").collect()]


def titles(text):
    return [(h.level, h.title) for h in markdown.headings(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("# One\n\ntext\n\n## Two ##\n", [(1, "One"), (2, "Two")]),
        ("Set\n===\n\nnext\n---\n", [(1, "Set"), (2, "next")]),
        ("```\n# code\n```\n# real\n", [(1, "real")]),
        ("~~~~\n# code\n~~~\n# still\n~~~~\n# real", [(1, "real")]),
        ("    # indented code\n\n#nothing\n####### seven\n# real", [(1, "real")]),
        ("> # quoted\n\n- item\n  # in the item\n\n# real", [(1, "real")]),
        ("<div>\n# in html\n</div>\n\n# real\n<!-- # comment\n# too\n-->\n# last", [(1, "real"), (1, "last")]),
        ("# **Bold** and [link](x) with `code`", [(1, "Bold and link with code")]),
        ("一、概述\n文字\n（二）细节\n\n| 一、表 |\n", [(2, "一、概述"), (3, "（二）细节")]),
        ("1. Overview\n\n1.1 Part\n", []),
        ("***\n---\ntext\n", []),
        ("#\n\n# \n\n", []),
    ],
)
def test_headings(text, found):
    assert titles(text) == found


def test_front_matter():
    assert markdown.without_front_matter("---\na: b\n---\n# x") == "# x"
    assert markdown.without_front_matter("a\n---\nplain\n---\nb") == "a\n---\nplain\n---\nb"
    assert markdown.without_front_matter("x\n---\nk: v") == "x\n---\nk: v"


def test_a_subtree_that_fits_is_one_chapter(spark):
    text = "intro\n\n# A\n\nalpha\n\n## B\n\nbeta\n"
    assert cut(spark, [("d", "T", text)]) == [("d/A", "intro\n\n#\n\n# A\n\nalpha\n\n##\n\n## B\n\nbeta")]


def test_a_large_section_is_cut_into_windows(spark):
    text = "# A\n\n" + "word " * 200
    parts = cut(spark, [("d", "T", text)], budget=64, stride=32)
    assert [p for p, _ in parts] == [f"d/A/{k}" for k in range(1, len(parts) + 1)]
    assert len(parts) == 1 + -(-(len(("word " * 200).strip()) - 256) // 128)


def test_texts_without_headings_nulls_and_blanks(spark):
    rows = [("a", "T/x", "plain"), ("b", "", None), ("c", None, "  "), ("e", "T", "x" * 3000), (None, "T", "text")]
    got = cut(spark, rows)
    assert got[:3] == [("a/T-x", "plain"), ("b/body", ""), ("c/body", "")]
    assert [p for p, _ in got[3:]] == ["e/__root__/1", "e/__root__/2", "e/__root__/3", "e/__root__/4"]
    assert cut(spark, []) == []


def test_repeated_headings_keep_the_last(spark):
    df = spark.createDataFrame([("d", "T", "# A\n\none\n\n# A\n\ntwo\n")], "id string, title string, text string")
    assert [(r.path, r.content) for r in last_by_path(split_chapters(df, "id", "title", "text")).collect()] == [("d/A", "two")]


def test_windows_overlap_and_cover(spark):
    text = "".join(chr(97 + k % 26) for k in range(5000))
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id int, t string")
    rows = sorted(sliding_windows(df, "t").collect(), key=lambda r: r.window)
    assert all(r.id == 1 for r in rows) and [r.chunk for r in rows] == [text[k * 400 : k * 400 + 2048] for k in range(len(rows))]
    assert rows[-1].chunk.endswith(text[-10:]) and len(rows) == rows[0].windows


def test_a_marker_stays_with_the_text_before_it(spark):
    """A section too large with its part: the part's marker ends its own text, the first marker goes before the first chapter."""
    text = "# Level One\n\n## Level Two\n\n" + "xyztuv " * 200
    got = cut(spark, [("n", "T", text)], budget=128, stride=64)
    assert got[0] == ("n/Level One", "#\n\n##")
    assert [p for p, _ in got[1:]] == [f"n/Level One/Level Two/{k}" for k in range(1, len(got))]
    assert all(len(c) <= 512 for _, c in got[1:])


def test_text_before_the_first_heading_may_exceed_the_budget(spark):
    text = "x" * 500 + "\n\n# A\n\n" + "y" * 200
    assert [len(c) for _, c in cut(spark, [("n", "T", text)], budget=128, stride=64)] == [500 + 2 + 1 + 2 + 200]


def test_windows_of_oversized_texts(spark):
    """Paths and sizes at a budget of 128 and a stride of 64, for texts without headings, below one and below two."""
    words = ("all work and no play " * 300)[:20_000]
    cases = {"none": words[:1979], "one": "# Parent Section\n\n" + words[:4499], "two": "# Level One\n\n## Level Two\n\n" + words[:5599], "before": "ahead\n\n# Parent Section\n\n" + words[:600]}
    df = spark.createDataFrame([(k, "Title", x) for k, x in cases.items()], "id string, t string, c string")
    got = {}
    for r in split_chapters(df, "id", "t", "c", budget=128, stride=64).orderBy("ordinal").collect():
        got.setdefault(r.document_id, []).append((r.path, r.tokens))
    assert [p for p, _ in got["none"]] == [f"none/__root__/{k}" for k in range(1, 8)] and got["none"][-1][1] == 111
    assert [p for p, _ in got["one"]] == [f"one/Parent Section/{k}" for k in range(1, 18)]
    assert [p for p, _ in got["two"]] == ["two/Level One", *[f"two/Level One/Level Two/{k}" for k in range(1, 22)]] and got["two"][0][1] == 2
    assert [p for p, _ in got["before"]] == [f"before/Parent Section/{k}" for k in (1, 2)] and got["before"][0][1] == 131
    assert all(t in (127, 128) for k in ("none", "one", "two") for p, t in got[k][1:-1])


def test_trees_and_kinds_of_headings():
    marks = markdown.headings("# A\n\n### B\n\n## C\n\n一、总则\n\ntext\n\n（一）细则\n\n# 一、D\n\n```\n二、no\n```\n")
    assert [(m.level, m.title) for m in marks] == [(1, "A"), (3, "B"), (2, "C"), (2, "一、总则"), (3, "（一）细则"), (1, "一、D")]
    assert markdown.parents(marks) == [-1, 0, 0, 0, 3, -1] and [markdown.chinese(m) for m in marks] == [False, False, False, True, True, False]
    assert markdown.parents([]) == []
