"""Evaluation texts leaking into training text.

The corpus is cut into shards of whole documents. For each shard a full-text index in the manner of Ferragina and
Manzini is built over word numbers: the suffix order by prefix doubling, its Burrows-Wheeler transform in a wavelet
matrix, and every eighth suffix position. The words are numbered over all evaluation passages, so that the shards'
orders are made and written once and serve every block of passages. All runs of ``least`` words of a block are
searched backwards, all at once, through wavelet ranks; occurrences are located by walking to the next sampled
position, and overlapping ones of the same item are merged into spans that a cleaner would remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.llm.words import WordHashes, words
from terrace.plans.lineage import written

SPANS = "doc_id bigint, item_id bigint, first_word bigint, last_word bigint"
SHARDS = "docs binary, offsets binary, starts binary, words binary, suffixes binary"
_SAMPLED = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, with a table of counts for each bit level."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.bits, self.length = bits, len(sequence)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            count = np.zeros(self.length + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(self.length - int(count[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, end = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = (symbol >> level) & 1
            a, b = self.ones[k][start], self.ones[k][end]
            start, end = np.where(bit, self.zeros[k] + a, start - a), np.where(bit, self.zeros[k] + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        symbol = np.zeros_like(at)
        for k in range(self.bits):
            a = self.ones[k][at]
            bit = self.ones[k][at + 1] - a
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[k] + a, at - a)
        return symbol


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """The order of all suffixes by prefix doubling; only suffixes still tied are sorted again.

    A suffix that ends comes before its extensions.
    """
    n = len(sequence)
    order = np.argsort(sequence, kind="stable")
    ordered = sequence[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 1
    while True:
        starts = rank[order]
        same = np.zeros(n, bool)
        same[1:] = starts[1:] == starts[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        rows = order[places]
        after = rows + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        again = np.lexsort((follow, rank[rows]))
        rows, follow = rows[again], follow[again]
        order[places] = rows
        base = rank[rows]
        first = np.r_[True, (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])]
        rank[rows] = places[np.flatnonzero(first)[np.cumsum(first) - 1]]
        step *= 2


class FullTextIndex:
    """Backward search over a sequence of symbols from 1 on."""

    def __init__(self, sequence: np.ndarray, symbols: int, order: np.ndarray | None = None) -> None:
        text = np.r_[sequence, 0].astype(np.int64)
        order = suffix_order(text) if order is None else order.astype(np.int64)
        transform = text[order - 1]
        self.tree = WaveletMatrix(transform, max(1, int(symbols).bit_length()))
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols + 1))]
        self.marked = order % _SAMPLED == 0
        self.marks_before = np.r_[0, np.cumsum(self.marked)]
        self.sampled = order[self.marked]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and position of every occurrence of the patterns (rows of equal length)."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.tree.length, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, k]
            # runs that agree in what has been searched so far share their range; each range is searched once
            key, back = np.unique(np.stack([symbol, low, high], axis=1), axis=0, return_inverse=True)
            start = self.before[key[:, 0]] + self.tree.rank(key[:, 0], key[:, 1])
            end = self.before[key[:, 0]] + self.tree.rank(key[:, 0], key[:, 2])
            back = back.ravel()
            low, high = start[back], end[back]
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
            if not len(alive):
                break
        counts = high - low
        pattern = np.repeat(alive, counts)
        row = np.repeat(low, counts) + np.arange(len(pattern)) - np.repeat(np.cumsum(counts) - counts, counts)
        distinct, back = np.unique(row, return_inverse=True)
        return pattern, self._positions(distinct)[back]

    def _positions(self, row: np.ndarray) -> np.ndarray:
        walked, out = np.zeros_like(row), np.empty_like(row)
        todo = np.arange(len(row))
        while len(todo):
            here = self.marked[row[todo]]
            done = todo[here]
            out[done] = self.sampled[self.marks_before[row[done]]] + walked[done]
            todo = todo[~here]
            at = row[todo]
            symbol = self.tree.access(at)
            row[todo] = self.before[symbol] + self.tree.rank(symbol, at)
            walked[todo] += 1
        return out


def numbers_of(text: str | None, vocabulary: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """The words' numbers from 1 in a sorted vocabulary of hashes; one more than it has for every word that isn't there."""
    found = hashes(words(text))
    at = np.searchsorted(vocabulary, found)
    known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == found if len(vocabulary) else np.zeros(len(found), bool)
    return np.where(known, at + 1, len(vocabulary) + 1).astype(np.int64)


def passage_runs(items: list[tuple[int, str | None]], least: int, vocabulary: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct runs of ``least`` words, and the items that hold each."""
    held: dict[bytes, set[int]] = {}
    hashes = WordHashes()
    for item, passage in items:
        found = numbers_of(passage, vocabulary, hashes)
        for k in range(len(found) - least + 1):
            held.setdefault(found[k : k + least].tobytes(), set()).add(item)
    return np.frombuffer(b"".join(held), np.int64).reshape(-1, least), [np.array(sorted(s), np.int64) for s in held.values()]


def merged(doc: np.ndarray, item: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs found in documents to the spans that they cover; runs of one item that touch or overlap are one span."""
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > start[:-1] + least)] if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1 if len(first) else first
    return doc[first], item[first], start[first], start[last] + least - 1


def leaked_spans(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, passage_col: str, *, least: int = 12, shard_words: int = 1_000_000, block_words: int = 2_000_000) -> DataFrame:
    """Where the passages of ``items`` stand in the texts of ``df``: ``doc_id, item_id, first_word, last_word``.

    A span is a longest stretch of a document, counted in words from 0, that runs of ``least`` consecutive words of
    the item's passage cover; parts of a passage count like whole ones. Null, empty and shorter texts and passages
    give nothing, rows without id are left out, repeated passages are reported for each item, spans of a repeated id
    are put together. Other columns are not read. A text longer than a shard is indexed in pieces that overlap by
    ``least - 1`` words, and spans are merged after the search.

    The passages' vocabulary, as 64-bit hashes, reaches the tasks by broadcast when the shards are made, then the
    passages in blocks of about ``block_words`` words, one block after the other.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    tests = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(passage_col).alias("passage")).filter("item_id IS NOT NULL AND passage IS NOT NULL")
    hashed = tests.select("passage").mapInArrow(_words_of(least), "word bigint").distinct().toArrow()["word"].to_numpy()
    vocabulary = np.sort(hashed.view(np.uint64))
    shared = spark.sparkContext.broadcast(vocabulary)
    shards = written(source.mapInArrow(_indexer(shared, least, shard_words), SHARDS), "shards")
    shared.destroy()

    letters = tests.agg(F.sum(F.length("passage"))).first()[0] or 0  # at least as many as words
    blocks = max(1, -(-letters // block_words))
    found = None
    for block in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else tests
        sent = spark.sparkContext.broadcast(passage_runs([tuple(r) for r in part.toLocalIterator()], least, vocabulary))
        spans = written(shards.mapInArrow(_searcher(sent, len(vocabulary) + 1, least), SPANS), "spans")
        sent.destroy()
        found = spans if found is None else found.unionByName(spans)
    return merged_spans(found)


def merged_spans(spans: DataFrame) -> DataFrame:
    """Spans of one document and item that touch or overlap as one."""
    order = Window.partitionBy("doc_id", "item_id").orderBy("first_word", "last_word")
    before = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.when(F.col("first_word") <= before + 1, 0).otherwise(1))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "item_id", "part").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).drop("part")


def _words_of(least: int):
    """The hashes of the words of passages that are long enough to be found."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [hashes(w) for t in b.column(0) if len(w := words(t.as_py())) >= least]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.uint64), *found])).view(np.int64))], ["word"])

    return hashed


def _indexer(shared, least: int, shard_words: int):
    """Texts to shards: their stretches of passage words with the documents and places these come from, joined, and the suffix order."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, hashes = shared.value, WordHashes()
        other = len(vocabulary) + 1  # stands for every word that no passage holds, and between stretches

        def shard(pieces: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            joined = np.concatenate([x for _, _, seq in pieces for x in (seq, [other])])
            starts = np.cumsum([0] + [len(seq) + 1 for _, _, seq in pieces[:-1]])
            columns = np.array([d for d, _, _ in pieces], np.int64), np.array([o for _, o, _ in pieces], np.int64), starts, joined.astype(np.int32), suffix_order(np.r_[joined, 0]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["docs", "offsets", "starts", "words", "suffixes"])

        pieces, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                sequence = numbers_of(text.as_py(), vocabulary, hashes)
                for at in range(0, max(1, len(sequence) - least + 1), shard_words):
                    for offset, part in _shortened(sequence[at : at + shard_words + least - 1], other, least):
                        pieces.append((doc, at + offset, part))
                        size += len(part) + 1
                    if size >= shard_words:
                        yield shard(pieces)
                        pieces, size = [], 0
        if pieces:
            yield shard(pieces)

    return index


def _searcher(sent, other: int, least: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, holders = sent.value
        if not len(patterns):
            return
        sizes = np.array([len(h) for h in holders])
        flat, begins = np.concatenate(holders), np.cumsum(sizes) - sizes
        for b in batches:
            for docs, offsets, starts, joined, suffixes in zip(*(b.column(k) for k in range(5))):
                docs, offsets, starts = (np.frombuffer(x.as_buffer(), np.int64) for x in (docs, offsets, starts))
                index = FullTextIndex(np.frombuffer(joined.as_buffer(), np.int32), other, np.frombuffer(suffixes.as_buffer(), np.int32))
                run, at = index.find(patterns)
                piece = np.searchsorted(starts, at, "right") - 1
                doc, place = docs[piece], at - starts[piece] + offsets[piece]
                many = sizes[run]
                item = flat[np.repeat(begins[run], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                columns = merged(np.repeat(doc, many), item, np.repeat(place, many), least)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_word", "last_word"])

    return search


def _shortened(sequence: np.ndarray, other: int, least: int) -> list[tuple[int, np.ndarray]]:
    """The stretches of a text, with their offsets, between words that no passage holds, where these are long enough to hold a run."""
    cuts = np.r_[-1, np.flatnonzero(sequence == other), len(sequence)]
    wide = np.flatnonzero(np.diff(cuts) > least)
    return [(int(cuts[k] + 1), sequence[cuts[k] + 1 : cuts[k + 1]]) for k in wide]
