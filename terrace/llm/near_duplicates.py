"""Near-duplicate records with small edits.

Every record gets a signature of minimum hashes over its runs of words. The signature is cut into fewer segments
than a plain banding would need, so that a similar record differs in at most one symbol of some segment. Each segment
is indexed under its variants with one symbol left out, equal variants are joined, and the joined pairs are verified
on the exact sets of runs.

The symbols are 16-bit minimum hashes rather than single bits: at a similarity of 0.5 a quarter of all bits of a
binary signature differ, and segments of bits that differ in one place at most would then select nothing. ``layout``
derives the number of segments and their length from the similarity: 16 of 4 for 0.5, where a pair of exactly that
similarity is joined with probability 0.997 and one of 0.6 with 0.99999, and 7 of 7 for 0.8.

A variant that many classes share is no single task's work: its classes are dealt out to tiles and compared there by
their signatures. Before the sets of runs travel, pairs whose signatures agree in too few symbols are dropped, at
four standard deviations below what the similarity asks for.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.llm.components import components
from terrace.llm.words import WordHashes, mixed, shingle_hashes, words
from terrace.plans.lineage import written

MOST_SYMBOLS, MISSED = 64, 0.003
TILE = 512  # classes of a variant, or records of a class, that are paired within one key
_CHUNK = 4096


def layout(similarity: float) -> tuple[int, int]:
    """How many segments of how many symbols: the longest for which few enough segments miss a pair of the similarity with probability 0.003 at most."""
    for symbols in range(8, 2, -1):
        found = symbols * similarity ** (symbols - 1) * (1 - similarity) + similarity**symbols
        segments = 1 if found >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log(1 - found))
        if segments * symbols <= MOST_SYMBOLS:
            return segments, symbols
    return MOST_SYMBOLS // 3, 3


def multipliers(count: int) -> np.ndarray:
    """Odd 64-bit factors, one for each hash function."""
    return np.random.default_rng(20_04).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(runs: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The 16-bit minimum hashes of a non-empty set of runs."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), _CHUNK):
        np.minimum(least, (runs[at : at + _CHUNK, None] * factors).min(0), out=least)
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.uint16)


def variant_keys(signatures: np.ndarray, segments: int, symbols: int) -> np.ndarray:
    """For each signature, a 64-bit key of every segment with one of its symbols left out."""
    seg = signatures.reshape(-1, segments, symbols).astype(np.uint64)
    keys = np.empty((len(seg), segments, symbols), np.uint64)
    for out in range(symbols):
        place = np.arange(segments, dtype=np.uint64) * np.uint64(symbols) + np.uint64(out)
        key = np.broadcast_to(mixed(place * np.uint64(0x9E3779B97F4A7C15)), seg.shape[:2])
        for s in range(symbols):
            if s != out:
                key = mixed(key ^ (seg[:, :, s] * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(s))
        keys[:, :, out] = key
    return keys.reshape(len(seg), -1).view(np.int64)


def least_agreeing(similarity: float, count: int) -> int:
    """How many of ``count`` symbols agree in a pair of the similarity, less four standard deviations."""
    return max(1, math.floor(count * similarity - 4 * math.sqrt(count * similarity * (1 - similarity))))


def run_set(text: str | None, size: int, least_words: int, hashes: WordHashes) -> np.ndarray | None:
    """The distinct runs of ``size`` words of a text, sorted; None for a text of fewer than ``least_words`` words."""
    found = words(text)
    if len(found) < max(least_words, size):
        return None
    return np.unique(shingle_hashes(hashes(found), size))


def signer(size: int, least_words: int, symbols: int):
    """Arrow batches of ``id, text`` to ``id, mark, signature``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = WordHashes(), multipliers(symbols)
        for b in batches:
            ids, marks, signatures = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                runs = run_set(text.as_py(), size, least_words, hashes)
                if runs is not None:
                    ids.append(i)
                    marks.append(hashlib.blake2b(runs.tobytes(), digest_size=16).digest())
                    signatures.append(signature(runs, factors).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(signatures, pa.binary())], ["id", "mark", "signature"])

    return sign


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


class NearDuplicates:
    """Near duplicates among the records of ``df``: ids unique, ``text`` any string expression over its columns.

    Records with a null id or fewer than ``least_words`` words have no part. Records with the same set of runs form
    a class, whose smallest id stands for it; all later steps work on classes, so copies cost one row each however
    many there are. Columns of ``df`` other than those named are not read. Empty tables give no rows.
    """

    def __init__(self, df: DataFrame, id_col: str, text: Column, *, similarity: float = 0.8, size: int = 5, least_words: int = 20) -> None:
        self.similarity, self.size, self.least_words = similarity, size, least_words
        self.segments, self.symbols = layout(similarity)
        self.source = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).filter("id IS NOT NULL")
        signed = written(self.source.mapInArrow(signer(size, least_words, self.segments * self.symbols), "id bigint, mark binary, signature binary"), "signed")
        first = signed.groupBy("mark").agg(F.min("id").alias("first_id"), F.min("signature").alias("signature"))
        first = written(first, "classes")
        #: ``id, first_id`` for every record.
        self.members = written(signed.select("id", "mark").join(first.select("mark", "first_id"), "mark").select("id", "first_id"), "members")
        self.pairs = self._verified(self._candidates(first))

    def _candidates(self, first: DataFrame) -> DataFrame:
        """``a < b``: pairs of classes that share a variant and whose signatures agree in enough symbols."""
        segments, symbols = self.segments, self.symbols
        enough = least_agreeing(self.similarity, segments * symbols)

        def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    keys = variant_keys(_signatures(b.column(1)), segments, symbols)
                    ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], ["id", "key"])

        def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = (_signatures(b.column(2)) == _signatures(b.column(3))).sum(1) >= enough if b.num_rows else []
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def tile(key: tuple, group: pa.Table) -> pa.Table:
            ids, block = group["id"].to_numpy(), group["block"].to_numpy()
            signs = _signatures(group["signature"].combine_chunks())
            keys = variant_keys(signs, segments, symbols)
            low, high = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
            found = [np.empty((2, 0), np.int64)]
            for part in np.array_split(low, len(low) * len(high) * signs.shape[1] // 8_000_000 + 1):
                x, y = np.nonzero((signs[part][:, None, :] == signs[high][None, :, :]).sum(2, dtype=np.int16) >= enough)
                x, y = part[x], high[y]
                x, y = x[ids[x] != ids[y]], y[ids[x] != ids[y]]
                same = keys[x] == keys[y]
                here = keys[x, same.argmax(1)] == key[0].as_py()  # a pair is told under the first variant that it shares
                found.append(np.stack([ids[x[here]], ids[y[here]]]))
            a, b = np.concatenate(found, axis=1)
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

        signed = first.select(F.col("first_id").alias("id"), "signature")
        indexed = signed.mapInArrow(variants, "id bigint, key bigint")
        counts = indexed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        shared = written(indexed.join(counts, "key"), "shared")
        few, many = shared.filter(F.col("n") <= TILE), shared.filter(F.col("n") > TILE)
        pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b").distinct()
        left, right = (signed.select(F.col("id").alias(x), F.col("signature").alias(f"signature_{x}")) for x in "ab")
        close = pairs.join(left, "a").join(right, "b").select("a", "b", "signature_a", "signature_b").mapInArrow(agree, "a bigint, b bigint")
        if not many.isEmpty():
            blocks = F.ceil(F.col("n") / TILE).cast("int")
            dealt = many.join(signed, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            tiles = dealt.select("key", "id", "signature", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            tiles = tiles.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "block", "signature")
            close = close.unionByName(tiles.groupBy("key", "low", "high").applyInArrow(tile, "a bigint, b bigint")).distinct()
        return written(close, "candidates")

    def _verified(self, candidates: DataFrame) -> DataFrame:
        """``a, b, shared, either, similarity`` for the pairs of classes that are similar enough."""
        named = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()

        size, least_words = self.size, self.least_words

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                sets = [run_set(t.as_py(), size, least_words, hashes).tobytes() for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "runs"])

        sets = written(self.source.join(named, "id", "left_semi").select("id", "text").mapInArrow(runs, "id bigint, runs binary"), "runs")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                shared, either = [], []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    shared.append(n), either.append(len(x) + len(y) - n)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "shared", "either"])

        both = candidates.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b")
        counted = both.select("a", "b", "runs_a", "runs_b").mapInArrow(compare, "a bigint, b bigint, shared bigint, either bigint")
        close = counted.withColumn("similarity", F.col("shared") / F.col("either")).filter(F.col("shared") >= F.lit(self.similarity) * F.col("either") - 1e-9)
        return written(close, "near")

    def all_pairs(self) -> DataFrame:
        """``doc_a < doc_b`` for all similar records, copies in full: as many rows as there are such pairs.

        The members of a class are dealt out to blocks, and links are made for pairs of blocks, so that no class however
        large is one key of the joins.
        """
        sizes = self.members.groupBy("first_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"), F.count("*").alias("n"))
        held = self.members.join(sizes, "first_id").select("first_id", "id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
        alone = sizes.filter("n > 1").select(F.col("first_id").alias("a"), F.col("first_id").alias("b"), F.col("blocks").alias("blocks_a"), F.col("blocks").alias("blocks_b"))
        size = lambda x: sizes.select(F.col("first_id").alias(x), F.col("blocks").alias(f"blocks_{x}"))
        links = self.pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b").select("a", "b", "blocks_a", "blocks_b").unionByName(alone)
        parts = links.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
        parts = parts.filter("a <> b OR i <= j").select("a", "i", "b", "j")
        left, right = held.select(F.col("first_id").alias("a"), F.col("block").alias("i"), F.col("id").alias("x")), held.select(F.col("first_id").alias("b"), F.col("block").alias("j"), F.col("id").alias("y"))
        met = parts.join(left, ["a", "i"]).join(right, ["b", "j"]).filter("a <> b OR i < j OR x < y")
        return met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def groups(self) -> DataFrame:
        """``doc_id, class_id, group_id, links`` for every record: its class of copies, the smallest id of its group of linked classes, and how many other classes its class is similar to."""
        links = self.pairs.select(F.explode(F.array("a", "b")).alias("first_id")).groupBy("first_id").agg(F.count("*").alias("links"))
        joined = self.members.join(components(self.pairs.select("a", "b")).select(F.col("node").alias("first_id"), "component"), "first_id", "left").join(links, "first_id", "left")
        return joined.select(F.col("id").alias("doc_id"), F.col("first_id").alias("class_id"), F.coalesce("component", "first_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
