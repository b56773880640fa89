"""Filling fixed-capacity containers with items.

Lengths fall into classes. Patterns of a few classes that nearly fill a container are enumerated, and non-negative
least squares finds how often to repeat each so that together they use up the histogram of classes. The repeats are
rounded down; what is left is packed by patterns of exact lengths, each repeated until one of its lengths runs out.
Only histograms and patterns, whose number depends on the capacity alone, are worked on at one place: every item
finds its container from its place among the items of its class.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.lineage import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer cuts a text before pairing bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PART_ROWS = 100_000
_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, read once in each process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


# The plan -----------------------------------------------------------------------------------------------------


def patterns(tops: np.ndarray, capacity: int, slack: int) -> np.ndarray:
    """Columns that say how many items of each class fill a container; ``tops``: the classes' greatest lengths.

    Copies of one class, copies of another, then the largest third that fits; those that leave more than ``slack``
    empty are kept only if each class would otherwise be without any.
    """
    n = len(tops)
    columns: set[tuple[tuple[int, int], ...]] = set()
    for a in range(n):
        most = capacity // tops[a]
        for k in sorted({1, 2, 3, 4, most // 2, most}):
            if not 1 <= k <= most:
                continue
            for b in range(n):
                room = capacity - k * tops[a]
                for m in sorted({0, 1, room // tops[b]}):
                    left = room - m * tops[b]
                    if left < 0:
                        continue
                    used = {a: k}
                    if m:
                        used[b] = used.get(b, 0) + int(m)
                    while (c := int(np.searchsorted(tops, left, "right")) - 1) >= 0:
                        times = int(left // tops[c])
                        used[c] = used.get(c, 0) + times
                        left -= times * tops[c]
                    if left <= slack or k == most:
                        columns.add(tuple(sorted(used.items())))
    out = np.zeros((n, len(columns)))
    for j, column in enumerate(sorted(columns)):
        for c, k in column:
            out[c, j] = k
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x >= 0`` of least ``|a x - b|``, by an active set of columns."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(4 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-7 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            solved = np.zeros_like(x)
            solved[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (solved <= 1e-9)
            if not low.any():
                x = solved
                break
            step = np.min(x[low] / np.maximum(x[low] - solved[low], 1e-300))
            x = x + step * (solved - x)
            active &= x > 1e-9
            x[~active] = 0
            if not active.any():
                break
    return x


def repeats(histogram: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whole repeats of each pattern that use no class more often than it occurs."""
    times = np.floor(non_negative_least_squares(columns, histogram.astype(float)) + 1e-6).astype(np.int64)
    whole = columns.astype(np.int64)
    while True:
        over = whole @ times - histogram
        c = int(over.argmax())
        if over[c] <= 0:
            return times
        j = max(np.flatnonzero((whole[c] > 0) & (times > 0)), key=lambda j: (times[j], j))
        times[j] -= min(times[j], -(-over[c] // whole[c, j]))


def leftover_patterns(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns of exact lengths with their repeats that use up a histogram (by length): the longest item, then always the longest that fits."""
    left, out = histogram.astype(np.int64).copy(), []
    left[0] = 0
    while left.any():
        lengths = np.flatnonzero(left)
        room, used = capacity, {}
        while True:
            free = [x for x in (lengths[: np.searchsorted(lengths, room, "right")])[::-1] if left[x] > used.get(int(x), 0)][:1]
            if not free:
                break
            x = int(free[0])
            k = int(min(left[x] - used.get(x, 0), room // x, max(1, room // x)))
            used[x] = used.get(x, 0) + k
            room -= k * x
        times = int(min(left[x] // k for x, k in used.items()))
        for x, k in used.items():
            left[x] -= k * times
        out.append((used, times))
    return out


class Slots:
    """For each key, which container takes the key's n-th item."""

    def __init__(self) -> None:
        self.begins: dict[int, list[tuple[int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.containers = 0

    def add(self, pattern: dict[int, int], times: int) -> None:
        for key, k in pattern.items():
            at = self.used.get(key, 0)
            self.begins.setdefault(key, []).append((at, k, self.containers))
            self.used[key] = at + k * times
        self.containers += times

    def place(self, keys: np.ndarray, number: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for key in np.unique(keys).tolist():
            if key in self.begins:
                begin, k, base = np.array(self.begins[key], np.int64).T
                rows = np.flatnonzero((keys == key) & (number < self.used[key]))
                slot = np.searchsorted(begin, number[rows], "right") - 1
                out[rows] = base[slot] + (number[rows] - begin[slot]) // k[slot]
        return out


# As Spark jobs ------------------------------------------------------------------------------------------------


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str) -> DataFrame:
    """``doc_id, piece, tokens``: a row for each text, or for each piece of a text longer than ``capacity``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            sizes = np.array([len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(1)], np.int64)
            pieces = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            tokens = np.minimum(capacity, sizes[row] - piece * capacity)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece), pa.array(tokens)], ["doc_id", "piece", "tokens"])

    source = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    return source.mapInArrow(count, "doc_id bigint, piece bigint, tokens bigint")


def numbered(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Adds ``number``: each row's place, from 0, among the rows of its ``key``. Keys are counted in parts, more of them the more ``rows`` there are, so that none is one task's work."""
    parted = df.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(16, rows // PART_ROWS))))
    ahead = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parted.groupBy(key, "part").agg(F.count("*").alias("n")).select(key, "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy(key, "part").orderBy("doc_id", "piece"))
    return parted.withColumn("within", within).join(bases, [key, "part"]).withColumn("number", F.col("base") + F.col("within") - 1).drop("part", "base", "within")


def filled_containers(df: DataFrame, id_col: str, text_col: str, *, capacity: int = 2048, tokenizer: str = TOKENIZER, classes: int = 128, slack: int = 16) -> DataFrame:
    """``doc_id, piece, first_token, tokens, container``: every text of ``df`` laid into containers of ``capacity`` tokens.

    Texts longer than a container are cut into full pieces and a rest, numbered from 0; all others are piece 0. A piece
    is the text's ``tokens`` tokens from ``first_token`` on.
    Null and empty texts have no tokens and lie in container 0. Rows without id are left out; a repeated id gets a row
    for each of its texts. Containers are numbered from 0; other columns are not read.
    """
    spark = df.sparkSession
    width = max(1, -(-capacity // classes))
    pieces = written(token_pieces(df, id_col, text_col, capacity, tokenizer), "pieces")
    rows = pieces.count()
    full = pieces.filter(F.col("tokens") == capacity)
    loose = pieces.filter((F.col("tokens") > 0) & (F.col("tokens") < capacity)).withColumn("class", F.ceil(F.col("tokens") / width).cast("int"))

    counted = dict(loose.groupBy("class").count().collect())  # at most ``classes`` rows
    slots = Slots()
    keys = sorted(k for k in counted if k * width <= capacity)
    if keys:
        tops = np.array(keys, np.int64) * width
        columns = patterns(tops, capacity, slack)
        times = repeats(np.array([counted[k] for k in keys], np.int64), columns)
        for j in np.flatnonzero(times):
            slots.add({keys[c]: int(columns[c, j]) for c in np.flatnonzero(columns[:, j])}, int(times[j]))
    placed = written(numbered(loose, "class", rows).mapInArrow(_placer(spark, slots, "class"), "doc_id bigint, piece bigint, tokens bigint, container bigint"), "placed")

    rest = placed.filter("container < 0").drop("container")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in rest.groupBy("tokens").count().collect():  # at most ``capacity`` rows
        histogram[length] = n
    last = Slots()
    last.containers = slots.containers
    for used, k in leftover_patterns(histogram, capacity):
        last.add(used, k)
    late = numbered(rest, "tokens", rows).mapInArrow(_placer(spark, last, "tokens"), "doc_id bigint, piece bigint, tokens bigint, container bigint")
    whole = numbered(full, "tokens", rows).select("doc_id", "piece", "tokens", (F.col("number") + last.containers).alias("container"))
    empty = pieces.filter("tokens = 0").withColumn("container", F.lit(0).cast("bigint"))
    every = placed.filter("container >= 0").unionByName(late).unionByName(whole).unionByName(empty)
    return every.select("doc_id", "piece", (F.col("piece") * capacity).alias("first_token"), "tokens", "container")


def _placer(spark, slots: Slots, key: str):
    sent = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            container = sent.value.place(b.column(key).to_numpy(zero_copy_only=False).astype(np.int64), b.column("number").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("tokens"), pa.array(container)], ["doc_id", "piece", "tokens", "container"])

    return place


def fill(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``containers, tokens, most, filled``: how many containers there are, the tokens in all and in the fullest, and the share of space used."""
    of = placed.filter("tokens > 0").groupBy("container").agg(F.sum("tokens").alias("t"))
    return of.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("most"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("filled"))


def kept_whole(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``doc_id, whole, overfull``: whether a document's pieces follow each other without a gap, each once, and how many of them lie in containers of more than ``capacity`` tokens."""
    sizes = placed.groupBy("container").agg(F.sum("tokens").alias("held"))
    last = F.max(F.struct("piece", "tokens"))
    gapless = (F.count("*") == F.countDistinct("piece")) & (F.count("*") == F.max("piece") + 1) & (F.sum("tokens") == F.max("piece") * capacity + last["tokens"])
    return placed.join(sizes, "container").groupBy("doc_id").agg(gapless.alias("whole"), F.count_if(F.col("held") > capacity).alias("overfull"))
