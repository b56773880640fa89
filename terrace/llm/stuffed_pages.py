"""Keyword-stuffed and link-list pages.

A page is read as its lines, and a line of several sentences as its sentences. Each is described by a few small marks
(sentence end, links, separators, function words, repeated pairs of words and words that fill the page, length, form of
a table or code). A hidden Markov model labels them as prose, link list, tag list or menu, or as what is neither prose nor a
list: headings and notes, and rows of tables and lines of code. It is fitted to all pages by expectation maximisation
from the chances stated below. A page is flagged when its links, tags and menus hold more than half of its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.words import words
from terrace.plans.lineage import written

STATES = ("prose", "link list", "tag list", "menu", "heading", "table or code")
LISTING = [1, 2, 3]
#: Marks of a line and how many values each takes.
MARKS = {"sentence end": 3, "links": 3, "separators": 3, "function words": 4, "repeats": 4, "length": 4, "table or code": 3}
#: Chance of each value of each mark in a line of each state, before fitting.
START = {
    "sentence end": [(0.05, 0.02, 0.93), (0.60, 0.37, 0.03), (0.45, 0.30, 0.25), (0.85, 0.12, 0.03), (0.93, 0.02, 0.05), (0.95, 0.03, 0.02)],
    "links": [(0.97, 0.02, 0.01), (0.04, 0.16, 0.80), (0.94, 0.04, 0.02), (0.85, 0.10, 0.05), (0.98, 0.01, 0.01), (0.97, 0.02, 0.01)],
    "separators": [(0.80, 0.17, 0.03), (0.40, 0.30, 0.30), (0.30, 0.20, 0.50), (0.30, 0.20, 0.50), (0.94, 0.03, 0.03), (0.40, 0.20, 0.40)],
    "function words": [(0.08, 0.32, 0.35, 0.25), (0.90, 0.08, 0.01, 0.01), (0.85, 0.13, 0.015, 0.005), (0.90, 0.08, 0.01, 0.01), (0.75, 0.10, 0.10, 0.05), (0.95, 0.03, 0.01, 0.01)],
    "repeats": [(0.65, 0.30, 0.04, 0.01), (0.50, 0.25, 0.15, 0.10), (0.12, 0.15, 0.30, 0.43), (0.60, 0.20, 0.10, 0.10), (0.75, 0.15, 0.07, 0.03), (0.80, 0.12, 0.05, 0.03)],
    "length": [(0.02, 0.20, 0.70, 0.08), (0.25, 0.40, 0.20, 0.15), (0.15, 0.40, 0.25, 0.20), (0.60, 0.35, 0.04, 0.01), (0.45, 0.50, 0.04, 0.01), (0.40, 0.55, 0.04, 0.01)],
    "table or code": [(0.990, 0.005, 0.005), (0.94, 0.05, 0.01), (0.89, 0.10, 0.01), (0.79, 0.20, 0.01), (0.990, 0.005, 0.005), (0.05, 0.15, 0.80)],
}
#: Chance of each state in a page's first line, and in the line after each state, before fitting.
FIRST = (0.35, 0.05, 0.05, 0.03, 0.50, 0.02)
AFTER = (
    (0.88, 0.01, 0.01, 0.01, 0.07, 0.02),
    (0.04, 0.88, 0.02, 0.02, 0.03, 0.01),
    (0.04, 0.02, 0.88, 0.02, 0.03, 0.01),
    (0.05, 0.03, 0.02, 0.86, 0.03, 0.01),
    (0.80, 0.05, 0.05, 0.02, 0.03, 0.05),
    (0.10, 0.01, 0.01, 0.01, 0.04, 0.83),
)
#: Common English function words and Chinese function characters.
FUNCTION_WORDS = frozenset(
    "a an the of to in on at by for from with without and or but not no nor as is are was were be been it its that this these those "
    "which who what when where while if unless until since than then so because despite between within during before after under "
    "over our we they he she you i his her their has have had do does did can may must will would more most less rather any each "
    "every some all both either neither there here also only just how why whether into out up down about per".split()
) | frozenset("的了是在和与也把被将对从到又而且但若则时就只没不都已再或为之其此那这有会能可后前先每由给让")

_CUT = re.compile(r"""[.!?]["'”’)\]]*\s+|[。！？]""")
_SENTENCE = re.compile(r"""[.!?。！？]["'”’)\]]*\s*$""")
_LINK = re.compile(r"https?://|www\.|<a\s|\]\(|\bhref=|(?<=[\w-])\.(?:com|org|net|io|test|example|invalid|html?)\b", re.I)
_DOTTED = re.compile(r"\.\w")
_SEPARATOR = re.compile(r"[,;/|>»›·•、，；｜#+]|\s[-–—:]\s")
_CODE = re.compile(r"^\s*[A-Za-z_]\w*\s*(?:=|:=|\+=)\s*\S")
_FIGURE = re.compile(r"[\d.,%+-]*\d[\d.,%]*$")
_URL_TEXT = re.compile(r"https?://\S+|www\.\S+|<[^>]*>", re.I)


def _sentences(line: str) -> list[str]:
    ends = [m.end() for m in _CUT.finditer(line)]
    return [line[a:b] for a, b in zip([0, *ends], [*ends, len(line)])] if ends else [line]


def _links(line: str) -> int:
    """How many links a line holds; most lines hold nothing that any link has."""
    may = "/" in line or "<" in line or "](" in line or "=" in line or "w." in line or "W." in line or _DOTTED.search(line)
    return len(_LINK.findall(line)) if may else 0


def steps(text: str | None) -> list[tuple[str, list[str], int]]:
    """The lines of a page that hold words, cut at the ends of sentences, with their words and how much they look like a row of a table or code.

    A line beside one with as many bars may be a row (1); with a cell that is a figure it looks like one (2), and so does an assignment.
    """
    lines = (text or "").split("\n")
    cells = [line.strip().strip("|").split("|") for line in lines]
    out = []
    for k, line in enumerate(lines):
        row = len(cells[k]) > 1 and (k > 0 and len(cells[k - 1]) == len(cells[k]) or k + 1 < len(lines) and len(cells[k + 1]) == len(cells[k]))
        form = 2 if _CODE.match(line) or row and any(_FIGURE.match(c.strip()) for c in cells[k]) else int(row)
        out += [(part, w, form) for part in ([line] if form else _sentences(line)) if (w := words(part))]
    return out


def line_marks(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each step of a page, its marks and how many words it has."""
    page = steps(text)
    pairs = Counter(p for _, w, _ in page for p in zip(w, w[1:]))
    own = Counter(x for _, w, _ in page for x in w if x not in FUNCTION_WORDS)
    often, filling = max(3, sum(len(w) for _, w, _ in page) / 100), max(3, own.total() * 0.03)
    repeated, filler = {p for p, n in pairs.items() if n >= often}, {x for x, n in own.items() if n >= filling}
    codes, sizes = np.zeros((len(page), len(MARKS)), np.uint8), np.zeros(len(page), np.int32)
    for k, (line, w, form) in enumerate(page):
        n = len(w)
        links = _links(line)
        bare = _URL_TEXT.sub(" ", line) if links or "<" in line else line
        between = len(_SEPARATOR.findall(bare))
        held = [x for x in w if x not in FUNCTION_WORDS]
        glue = n - len(held)
        again = sum(map(repeated.__contains__, zip(w, w[1:]))) / max(1, n - 1) if repeated else 0
        again = (again + sum(map(filler.__contains__, held)) / max(1, len(held))) / 2
        codes[k] = (
            2 if _SENTENCE.search(bare) else int(n > 25),  # a long line without a sentence's end says more
            0 if not links else 1 if links * 12 < n else 2,
            0 if between * 12 < n else 1 if between * 5 < n else 2,
            0 if glue < 0.04 * n else 1 if glue < 0.2 * n else 2 if glue < 0.35 * n else 3,
            0 if again < 0.1 else 1 if again < 0.33 else 2 if again < 0.6 else 3,
            0 if n <= 3 else 1 if n <= 8 else 2 if n <= 25 else 3,
            form,
        )
        sizes[k] = n
    return codes, sizes


@dataclass
class Model:
    """Chances as logarithms: of a page's first state, of each state after each, of each mark's value in each state."""

    first: np.ndarray
    after: np.ndarray
    marks: list[np.ndarray]

    @classmethod
    def start(cls) -> Model:
        return cls(np.log(FIRST), np.log(AFTER), [np.log(START[m]) for m in MARKS])

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.marks[m][:, codes[:, m]].T for m in range(len(MARKS)))

    def shares(self, pages: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each page the chance of each state in each line, and the summed chances of moves between states.

        Pages of like length run side by side, one step for each line.
        """
        out: list[np.ndarray] = [np.empty((0, len(STATES)))] * len(pages)
        moves = np.zeros((len(STATES), len(STATES)))
        by_length = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        first, after = np.exp(self.first), np.exp(self.after)
        at = 0
        while at < len(by_length):
            end = at + 1
            longest = max(8, int(len(pages[by_length[at]]) * 1.3))
            while end < len(by_length) and len(pages[by_length[end]]) <= longest and (end - at) * longest < 400_000:
                end += 1
            group, at = by_length[at:end], end
            sizes = np.array([len(pages[k]) for k in group])
            steps = sizes[-1]
            seen = np.ones((steps, len(group), len(STATES)))
            for c, k in enumerate(group):
                e = self.emissions(pages[k])
                seen[: sizes[c], c] = np.exp(e - e.max(1, keepdims=True))
            ahead = np.empty_like(seen)
            ahead[0] = first * seen[0]
            ahead[0] /= ahead[0].sum(1, keepdims=True)
            for t in range(1, steps):
                ahead[t] = (ahead[t - 1] @ after) * seen[t]
                ahead[t] /= ahead[t].sum(1, keepdims=True)
            behind = np.ones((len(group), len(STATES)))
            for t in range(steps - 1, -1, -1):
                inside = (t < sizes)[:, None]
                share = ahead[t] * behind
                share /= share.sum(1, keepdims=True)
                ahead[t] = share
                if t:
                    both = seen[t] * behind
                    joint = ahead[t - 1][:, :, None] * after * both[:, None, :]
                    total = joint.sum((1, 2), keepdims=True)
                    moves += (joint / total * inside[:, :, None]).sum(0)
                    behind = np.where(inside, both @ after.T, 1.0)
                    behind /= behind.sum(1, keepdims=True)
            for c, k in enumerate(group):
                out[k] = ahead[: sizes[c], c]
        return out, moves

    def counts(self, pages: list[np.ndarray]) -> np.ndarray:
        """The summed chances from which a better model follows, as one row of numbers."""
        shares, moves = self.shares(pages)
        first = sum((s[0] for s in shares if len(s)), np.zeros(len(STATES)))
        if not any(len(s) for s in shares):
            return np.zeros(len(STATES) + len(STATES) ** 2 + len(STATES) * sum(MARKS.values()))
        codes, share = np.concatenate([p for p in pages if len(p)]), np.concatenate([s for s in shares if len(s)])
        marks = [np.stack([np.bincount(codes[:, m], share[:, s], size) for s in range(len(STATES))]).ravel() for m, size in enumerate(MARKS.values())]
        return np.concatenate([first, moves.ravel(), *marks])

    def improved(self, counts: np.ndarray, hold: float) -> Model:
        """The model of the counts; the start counts like ``hold`` lines of each state, so that its weight falls as the data grow."""
        start, shares = Model.start(), []
        tables = [start.first[None], start.after, *start.marks]
        for table in tables:
            part, counts = counts[: table.size].reshape(table.shape), counts[table.size :]
            held = part + hold * np.exp(table)
            shares.append(np.log(held / held.sum(1, keepdims=True)))
        return Model(shares[0][0], shares[1], shares[2:])

    def listed(self, pages: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """For each page, how many of its words stand in lines that are likelier links, tags or menus than anything else."""
        shares, _ = self.shares(pages)
        return np.array([int(n[s[:, LISTING].sum(1) > 0.5].sum()) if len(s) else 0 for s, n in zip(shares, sizes)], np.int64)


def marked_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, codes, sizes``: the marks and word counts of each page's lines, written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [line_marks(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c, _ in pages], pa.binary()), pa.array([n.tobytes() for _, n in pages], pa.binary())], ["id", "codes", "sizes"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    return written(source.mapInArrow(encode, "id bigint, codes binary, sizes binary"), "lines")


def _pages(column) -> list[np.ndarray]:
    return [np.frombuffer(c.as_buffer(), np.uint8).reshape(-1, len(MARKS)) for c in column]


def fitted(pages: DataFrame, rounds: int = 3, hold: float = 1000) -> Model:
    """The model fitted to all pages; each round sums the counts of all partitions."""
    model = Model.start()
    for _ in range(rounds):
        counts = pages.select("codes").mapInArrow(_counter(model), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        if counts.empty:
            return model
        model = model.improved(counts.sort_values("place")["value"].to_numpy(), hold)
    return model


def _counter(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            total = total + model.counts(_pages(b.column(0)))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "value"])

    return count


def page_shares(df: DataFrame, id_col: str, text_col: str, *, rounds: int = 3) -> DataFrame:
    """``doc_id, words, other_words`` for each page with an id: its words, and those in links, tags and menus.

    Null and empty pages have no words. Repeated ids give a row each. Other columns are not read.
    """
    pages = marked_pages(df, id_col, text_col)
    model = fitted(pages, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [np.frombuffer(c.as_buffer(), np.int32) for c in b.column(2)]
            other = model.listed(_pages(b.column(1)), sizes)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(n.sum()) for n in sizes], pa.int64()), pa.array(other)], ["doc_id", "words", "other_words"])

    return pages.mapInArrow(score, "doc_id bigint, words bigint, other_words bigint")


def stuffed_pages(df: DataFrame, id_col: str, text_col: str, *, share: float = 0.5, rounds: int = 3) -> DataFrame:
    """``doc_id`` of the pages of which more than ``share`` of the words stand in links, tags and menus; a page without words is none."""
    return page_shares(df, id_col, text_col, rounds=rounds).filter(F.col("other_words") > F.lit(share) * F.col("words")).select("doc_id")
