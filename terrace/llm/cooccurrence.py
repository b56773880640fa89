"""Items that appear together.

Items are divided by frequency into heavy and light ones: an item that at least one basket in 64 holds is heavy, since
its row of bits is then no longer than its list of baskets, and there are at most 64 times as many of them as the usual
basket has items. For each block of baskets, heavy pairs are counted by the ones in the conjunction of two rows of a
bit matrix (a row for each heavy item, a bit for each basket), worked off in tiles of heavy items; mixed pairs by
probing the matrix along the baskets of each light item; light pairs by hash counting. Baskets of very many light items
are not expanded: their pairs are looked up for the pairs known from other baskets, and only items that stand in enough
such baskets are paired there. The results are put together and scored by lift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.plans.lineage import written

BLOCK, DENSE, TILE, LONG = 8192, 64, 2048, 256


def basket(column: str) -> Column:
    """A basket's items trimmed, in lower case, without blanks and repeats, in order; null for an empty basket."""
    clean = F.transform(F.filter(column, lambda x: x.isNotNull()), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    items = F.array_sort(F.array_distinct(F.filter(clean, lambda x: x != "")))
    return F.when(F.size(items) > 0, items)


def _pack(rows: np.ndarray, columns: np.ndarray, heavy: int, baskets: int) -> np.ndarray:
    bits = np.zeros((heavy, -(-baskets // 64) * 64), np.uint8)
    bits[columns, rows] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def cooccurrence(baskets: DataFrame, *, least_together: int = 1, dense: int = DENSE, tile: int = TILE, long: int = LONG) -> DataFrame:
    """``item_a < item_b, n_ab, n_a, n_b, baskets`` for each pair of items that at least ``least_together`` baskets hold.

    ``baskets (items array<string>)``: each row one basket, made by ``basket``; null and empty ones don't count.
    Items are ordered by code point. Items that at least one basket in ``dense`` holds are heavy; they are numbered and
    sent to the tasks, ``tile`` of them in a tile of the matrix. A basket of more than ``long`` light items is a long
    one. Items in fewer than ``least_together`` baskets can't be in a pair that counts and are left out before
    pairing, which loses nothing.
    """
    kept = baskets.select("items").filter("size(items) > 0")
    counts = written(kept.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n")), "items")
    total = kept.count()
    often = counts.filter(F.col("n") >= least_together)
    is_heavy = F.col("n") * dense >= total
    top = [r[0] for r in often.filter(is_heavy).orderBy(F.desc("n"), "item").select("item").collect()]  # bounded by the usual basket's size
    sent = baskets.sparkSession.sparkContext.broadcast({item: k for k, item in enumerate(top)})

    numbered = written(kept.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    lights = numbered.select("basket", F.explode("items").alias("item")).join(often.filter(~is_heavy).select("item"), "item")
    lights = lights.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("light"))
    split = written(numbered.join(lights, "basket", "left").select("basket", "items", F.coalesce("light", F.array().cast("array<string>")).alias("light")), "split")

    pairs = _light_pairs(split, least_together, long)
    tiles = -(-len(top) // tile)
    for a in range(tiles):
        for b in range(a, tiles):
            pairs = pairs.unionByName(split.select("items", "light").mapInArrow(_counter(sent, a, b, tile), "x string, y string, n_ab bigint"))
    pairs = pairs.groupBy(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(F.sum("n_ab").alias("n_ab"))
    pairs = pairs.filter(F.col("n_ab") >= least_together)
    pairs = pairs.join(counts.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(counts.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(total).cast("bigint").alias("baskets"))


def _counter(sent, a: int, b: int, tile: int):
    """Counts pairs of the heavy items of two tiles and, for a tile with itself, those of its items with light ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, names = sent.value, list(sent.value)
        low, high = a * tile, b * tile
        span = [*range(low, min(low + tile, len(names)))] + ([*range(high, min(high + tile, len(names)))] if b > a else [])
        local = {names[k]: n for n, k in enumerate(span)}
        width = min(low + tile, len(names)) - low  # rows of the first tile come first
        both = np.zeros((len(span), len(span)), np.int32 if tile <= 4096 else np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                items, light = batch.column(0).slice(at, BLOCK), batch.column(1).slice(at, BLOCK)
                size = len(items)
                listed = items.flatten().dictionary_encode()
                if not len(listed):
                    continue
                place = np.array([local.get(x, -1) for x in listed.dictionary.to_pylist()], np.int64)[listed.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(size), items.value_lengths().to_numpy(zero_copy_only=False))
                row, place = row[place >= 0], place[place >= 0]
                bits = _pack(row, place, len(span), size)
                present = np.unique(place)
                for k, h in enumerate(present):
                    rest = present[k + 1 :] if b == a else present[present >= width] if h < width else present[:0]
                    both[h, rest] += np.bitwise_count(bits[h] & bits[rest]).sum(1, dtype=both.dtype)
                if a == b and len(present):
                    yield from _probed(bits, present, [names[k] for k in span], light, size)
        x, y = np.nonzero(both)
        if len(x):
            left, right = (pa.array([names[span[k]] for k in side], pa.string()) for side in (x, y))
            yield pa.RecordBatch.from_arrays([left, right, pa.array(both[x, y].astype(np.int64))], ["x", "y", "n_ab"])

    return count


def _probed(bits: np.ndarray, present: np.ndarray, names: list[str], light: pa.Array, size: int) -> Iterator[pa.RecordBatch]:
    """Each light item's list of baskets probes the rows of the heavy items."""
    listed = light.flatten().dictionary_encode()
    if not len(listed):
        return
    code = listed.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    where = np.repeat(np.arange(size), light.value_lengths().to_numpy(zero_copy_only=False))[order]
    code = code[order]
    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    found = []
    for h in present:
        counted = np.add.reduceat(np.unpackbits(bits[h].view(np.uint8))[where], begin, dtype=np.int64)
        some = np.flatnonzero(counted)
        found.append((np.full(len(some), h), code[begin[some]], counted[some]))
    h, item, n = (np.concatenate(x) for x in zip(*found))
    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in h], pa.string()), listed.dictionary.take(pa.array(item)).cast(pa.string()), pa.array(n)], ["x", "y", "n_ab"])


def _light_pairs(split: DataFrame, least: int, long: int) -> DataFrame:
    """``x < y, n_ab``: pairs of light items; of those in fewer than ``least`` baskets some may be missing."""
    lists = split.select("basket", "light").filter("size(light) > 1")
    short, longer = lists.filter(F.size("light") <= long), lists.filter(F.size("light") > long)
    each = short.select(F.posexplode("light").alias("k", "x"), "light")
    pairs = each.select("x", F.explode(F.slice("light", F.col("k") + 2, F.size("light"))).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n_ab"))
    if longer.isEmpty():
        return pairs

    # pairs that short baskets hold: how many long ones hold both is looked up
    pairs = written(pairs, "short_pairs")
    held = written(longer.select("basket", F.explode("light").alias("item")), "long_items")
    in_long = held.groupBy("item").agg(F.count("*").alias("n"))
    enough = pairs.join(in_long.select(F.col("item").alias("x"), F.col("n").alias("n_x")), "x").join(in_long.select(F.col("item").alias("y"), F.col("n").alias("n_y")), "y")
    enough = enough.filter(F.col("n_ab") + F.least("n_x", "n_y") >= least).select("x", "y")
    common = enough.join(held.select(F.col("item").alias("x"), "basket"), "x").join(held.select(F.col("item").alias("y"), "basket"), ["y", "basket"])
    more = common.groupBy("x", "y").agg(F.count("*").alias("n_ab"))

    # pairs that only long baskets hold: their items stand in enough of these; the pairs are made chunk by chunk
    items = held.join(in_long.filter(F.col("n") >= least).select("item"), "item").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    chunks = items.select("basket", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / F.lit(long)).cast("int")), lambda c: F.slice("items", c * long + 1, F.lit(long)))).alias("i", "left"))
    met = chunks.join(chunks.select("basket", F.col("i").alias("j"), F.col("left").alias("right")), "basket").filter("i <= j").repartition("basket", "i", "j")
    only = met.select(F.explode("left").alias("x"), "right").select("x", F.explode("right").alias("y")).filter("x < y").groupBy("x", "y").agg(F.count("*").alias("n_ab"))
    return pairs.unionByName(more).unionByName(only.filter(F.col("n_ab") >= least).join(pairs, ["x", "y"], "left_anti"))


def with_lift(pairs: DataFrame) -> DataFrame:
    """Adds ``lift``: how many times as often the pair stands together as chance would have it."""
    return pairs.withColumn("lift", F.col("n_ab") * F.col("baskets") / (F.col("n_a") * F.col("n_b")))


def found_together(baskets: DataFrame, least: int = 4, ratio: int = 3) -> DataFrame:
    """``tag_a, tag_b`` of the pairs in ``least`` baskets at least and ``ratio`` times as often as by chance, in whole numbers."""
    pairs = cooccurrence(baskets, least_together=least)
    kept = pairs.filter((F.col("n_ab").cast("decimal(19)") * F.col("baskets").cast("decimal(19)")) >= F.col("n_a").cast("decimal(19)") * F.col("n_b").cast("decimal(19)") * ratio)
    return kept.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))
