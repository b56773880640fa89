"""The block structure of Markdown that decides where sections begin: small helpers for one text at a time."""

from __future__ import annotations

import re
from typing import NamedTuple

_ATX = re.compile(r"( {0,3})(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_RAW = re.compile(r" {0,3}<(script|pre|style|textarea)\b", re.I)
_TAG = re.compile(
    r" {0,3}</?(?:address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|"
    r"h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:\s|/?>|$)",
    re.I,
)
_DENSE = re.compile("[\u2e80-\u2fdf\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]")
_CHINESE = (re.compile("[一二三四五六七八九十百]+、.+$"), 2), (re.compile("（[一二三四五六七八九十百]+）.+$"), 3)
_INLINE = (
    (re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"),
    (re.compile(r"(`+)(.+?)\1"), r"\2"),
    (re.compile(r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (re.compile(r"(?<![\w*])\*(?=\S)(.+?)(?<=\S)\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), r"\1"),
)


class Heading(NamedTuple):
    """A heading's characters ``start .. end`` (without its markers), level and title."""

    start: int
    end: int
    level: int
    title: str


def plain(title: str) -> str:
    """A title without the markers of emphasis, code, links and images."""
    for pattern, kept in _INLINE:
        title = pattern.sub(kept, title)
    return title.strip()


def headings(text: str) -> list[Heading]:
    """The headings that stand in no quote, list, code or HTML block, with the numbered Chinese lines that serve as headings.

    Line ends are ``\\n``. Headings without a title don't count.
    """
    found: list[Heading] = []
    paragraph: list[tuple[int, str]] = []  # lines of the open paragraph, with their places
    fence, raw, item = "", "", 0
    at = 0
    for line in text.split("\n"):
        here, at = at, at + len(line) + 1
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and set(bare) == {fence[0]} and not line.startswith("    "):
                fence = ""
            continue
        if raw:
            if raw in line.lower() if raw != "blank" else not bare:
                raw = ""
            continue
        if not bare:
            paragraph = []
            continue
        indent = len(line) - len(line.lstrip(" "))
        if item and indent >= item:
            paragraph = []
            continue
        if indent >= 4 or line.startswith("\t"):  # code, or more of a paragraph
            if paragraph:
                paragraph.append((here, line))
            elif not item:
                continue
            continue
        if m := _ATX.match(line):
            title = (m[3] or "").strip()
            if title and set(title) != {"#"}:
                start = here + line.index(title, len(m[1]) + len(m[2]))
                found.append(Heading(start, start + len(title), len(m[2]), plain(title)))
            paragraph, item = [], 0
        elif paragraph and not item and (m := _UNDERLINE.match(line)):
            first, last = paragraph[0], paragraph[-1]
            start = first[0] + len(first[1]) - len(first[1].lstrip())
            title = plain(" ".join(x.strip() for _, x in paragraph))
            if title:
                found.append(Heading(start, last[0] + len(last[1].rstrip()), 1 if m[1][0] == "=" else 2, title))
            paragraph = []
        elif m := _FENCE.match(line):
            fence, paragraph, item = m[1], [], 0
        elif _RULE.match(line):
            paragraph, item = [], 0
        elif bare.startswith(">"):
            paragraph = []
        elif (m := _ITEM.match(line)) and (not paragraph or m.end() < len(line)):
            paragraph, item = [], max(2, m.end())
        elif bare.startswith("<!--"):
            raw = "" if "-->" in bare else "-->"
            paragraph, item = [], 0
        elif m := _RAW.match(line):
            end = f"</{m[1].lower()}>"
            raw, paragraph, item = "" if end in line.lower() else end, [], 0
        elif _TAG.match(line):
            raw, paragraph, item = "blank", [], 0
        else:
            if not paragraph:
                item = 0
            level = next((k for pattern, k in _CHINESE if pattern.match(bare)), 0)
            if level:
                found.append(Heading(here, min(len(text), at), level, bare))
                paragraph = []
            else:
                paragraph.append((here, line))
    return found


def chinese(mark: Heading) -> bool:
    """Whether a heading is a numbered Chinese line."""
    return any(pattern.match(mark.title) and mark.level == level for pattern, level in _CHINESE)


def parents(marks: list[Heading]) -> list[int]:
    """For each heading the place of the one above it: the last before it of a smaller level, -1 for none."""
    out, open_marks = [], []
    for k, mark in enumerate(marks):
        while open_marks and marks[open_marks[-1]].level >= mark.level:
            open_marks.pop()
        out.append(open_marks[-1] if open_marks else -1)
        open_marks.append(k)
    return out


def without_front_matter(text: str) -> str:
    """A text without its blocks between two lines ``---`` of which an inner line holds a colon, wherever they stand."""
    kept, open_at = [], None
    for line in text.split("\n"):
        kept.append(line)
        if line.strip() != "---":
            continue
        if open_at is None:
            open_at = len(kept) - 1
        else:
            if any(":" in x for x in kept[open_at + 1 : -1]):
                del kept[open_at:]
            open_at = None
    return "\n".join(kept)


class Piece(NamedTuple):
    """A chapter before it is cut to size: the titles above it, its text, and what stands before it in the root."""

    titles: list[str]
    text: str
    preamble: str


def estimated_tokens(text: str) -> int:
    """One for each character of the East Asian scripts and their punctuation, one for every four others."""
    dense = 0 if text.isascii() else len(text) - len(_DENSE.sub("", text))
    return dense + (len(text) - dense + 3) // 4


def pieces(text: str | None, budget: int) -> list[Piece]:
    """A Markdown text as chapters that follow its headings.

    A heading with all that is below it is one chapter if it fits into ``budget`` estimated tokens, with the headings
    written back; else its own text is a chapter and its parts are looked at one by one. Sections are gone through
    from the last to the first, so that the parts of each are done before it. A marker before a title stays with the
    text before it, and the text before the first heading goes before the first chapter, however long that is.
    """
    text = without_front_matter((text or "").replace("\r\n", "\n").replace("\r", "\n"))
    marks = headings(text)
    bodies = [text[a.end : b].strip() for a, b in zip(marks, [m.start for m in marks[1:]] + [len(text)])]
    preamble = text[: marks[0].start].strip() if marks else text.strip()
    if not marks:
        return [Piece([], preamble, "")] if preamble else []

    waiting: list[tuple[int, str, list[Piece]]] = []  # later sections not yet below another: level, heading line, pieces
    for mark, body in zip(reversed(marks), reversed(bodies)):
        line = f"{'#' * mark.level} {mark.title}"
        parts = []
        while waiting and waiting[-1][0] > mark.level:
            parts.append(waiting.pop())
        own = [Piece([mark.title], body, "")] if body else []
        if parts:
            merged = [line, *([body] if body else [])]
            for _, below, of in parts:
                merged += [f"{below}\n\n{p.text}" if not k else p.text for k, p in enumerate(of)]
            whole = "\n\n".join(merged).strip()
            if estimated_tokens(whole) <= budget:
                own = [Piece([mark.title], whole, "")]
            else:
                own += [p._replace(titles=[mark.title, *p.titles]) for _, _, of in parts for p in of]
        waiting.append((mark.level, line, own))
    out = [p for _, _, of in reversed(waiting) for p in of]
    if not out:
        return [Piece([], preamble, "")] if preamble else []
    return [out[0]._replace(preamble=preamble), *out[1:]]
