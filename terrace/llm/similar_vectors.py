"""Most similar vectors for every vector.

A forest of random-projection trees is searched through one priority queue for each query. It has two levels.
The upper trees are fitted on a bounded sample and route every vector to cells, so that each cell is one task's
work; within a cell the trees go on over the cell's own rows down to small leaves. At either level a query visits
the nodes of all trees in the order of one shared queue whose priority is the smallest signed margin on the way
from the root. Candidates of the visited leaves are reranked by their exact cosine.

Only the nodes that the queue can still reach are looked at: below a node whose priority is negative some leaf has
the same priority, so at each level the best nodes of all trees, as many as leaves are wanted and one more for each
tree, hold all the leaves that the queue gives out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.lineage import written

SCHEMA = "id bigint, neighbour bigint, cosine double"


# Inside tasks -------------------------------------------------------------------------------------------------


def usable_rows(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that hold ``dim`` finite values, not all zero."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    keep = (sizes == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
    vectors, ids = vectors.filter(pa.array(keep)), ids.filter(pa.array(keep))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    norm = lengths(x)
    good = np.isfinite(norm) & (norm > 0)
    return ids.to_numpy(zero_copy_only=False)[good].astype(np.int64), np.ascontiguousarray(x[good])


def lengths(x: np.ndarray) -> np.ndarray:
    """In double precision, so that very large and very small vectors keep their direction."""
    return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))


def units(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x / lengths(x)[:, None], np.float32)


def to_binary(x: np.ndarray) -> pa.Array:
    n, width = x.shape
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (width * 4)).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])


def from_binary(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.frombuffer(c.buffers()[2], np.float32)[c.offset * dim : (c.offset + len(c)) * dim] for c in chunks if len(c)]
    return np.concatenate(parts).reshape(-1, dim) if parts else np.empty((0, dim), np.float32)


class Tree:
    """A complete binary tree of hyperplanes; node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator, fit_rows: int = 512) -> None:
        self.depth = depth
        nodes = 2**depth - 1
        self.planes = np.zeros((nodes, x.shape[1]), np.float32)
        self.cuts = np.zeros(nodes, np.float32)
        rows: dict[int, np.ndarray] = {0: np.arange(len(x))}
        for node in range(nodes):
            at = rows.pop(node, np.empty(0, int))
            plane, cut, side = _split(x, at, rng, fit_rows)
            self.planes[node], self.cuts[node] = plane, cut
            rows[2 * node + 1], rows[2 * node + 2] = at[~side], at[side]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that holds each row."""
        return first_of_queue([self], x, 1)[0].ravel()


def first_of_queue(forest: list[Tree], x: np.ndarray, visits: int, dense: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The leaves that a queue shared by all trees gives out first, each row's as numbers over all trees, and the leaf of each tree that holds the row.

    Walks all trees level by level. A level of at most ``dense`` planes is worked off as one matrix product, in others
    each row meets the planes of its own nodes only.
    """
    depth, trees, rows = forest[0].depth, len(forest), len(x)
    keep = visits + trees
    node = np.tile(np.arange(trees), (rows, 1))  # tree * 2^level + place within the level
    rank = np.full((rows, trees), np.inf, np.float32)
    for level in range(depth):
        wide = 2**level
        begin, end = wide - 1, 2 * wide - 1
        planes, cuts = np.concatenate([t.planes[begin:end] for t in forest]), np.concatenate([t.cuts[begin:end] for t in forest])
        if len(planes) <= dense:
            margin = np.take_along_axis(x @ planes.T - cuts, node, 1)
        else:
            margin = np.empty(node.shape, np.float32)
            for at in range(0, rows, 512):
                some = slice(at, at + 512)
                margin[some] = np.einsum("rd,rnd->rn", x[some], planes[node[some]]) - cuts[node[some]]
        node = np.concatenate([2 * node, 2 * node + 1], axis=1)
        rank = np.concatenate([np.minimum(rank, -margin), np.minimum(rank, margin)], axis=1)
        if node.shape[1] > keep:
            best = np.argpartition(-rank, keep - 1, axis=1)[:, :keep]
            node, rank = np.take_along_axis(node, best, 1), np.take_along_axis(rank, best, 1)
    visits = min(visits, node.shape[1])
    first = np.take_along_axis(node, np.argpartition(-rank, visits - 1, axis=1)[:, :visits], 1)
    own = np.stack([np.take_along_axis(node, np.where(node >> depth == t, rank, -np.inf).argmax(1)[:, None], 1)[:, 0] for t in range(trees)], axis=1)
    return first, own


def _split(x: np.ndarray, at: np.ndarray, rng: np.random.Generator, fit_rows: int) -> tuple[np.ndarray, float, np.ndarray]:
    """A plane between two centres started at random rows, moved to the median where the sides would be uneven."""
    if len(at) < 2:
        plane = rng.standard_normal(x.shape[1]).astype(np.float32)
        plane /= np.linalg.norm(plane)
        return plane, 0.0, x[at] @ plane > 0
    some = x[at if len(at) <= fit_rows else rng.choice(at, fit_rows, replace=False)]
    a, b = some[rng.choice(len(some), 2, replace=False)]
    for _ in range(4):
        near_b = some @ (b - a) > (b @ b - a @ a) / 2
        if near_b.all() or not near_b.any():
            break
        a, b = some[~near_b].mean(0), some[near_b].mean(0)
    plane = b - a
    length = np.linalg.norm(plane)
    plane = plane / length if length > 0 else rng.standard_normal(x.shape[1]).astype(np.float32)
    along = x[at] @ plane
    cut = float((a + b) @ plane / 2)
    share = (along > cut).mean()
    if not 0.25 <= share <= 0.75:
        cut = float(np.median(along))
    side = along > cut
    if len(at) > 1 and (side.all() or not side.any()):  # all on the cut: ties are dealt out evenly
        side = np.arange(len(at)) % 2 == 1
    return plane.astype(np.float32), cut, side


def nearest_in_cell(ids: np.ndarray, given: np.ndarray, role: np.ndarray, k: int, trees: int, leaf_rows: int, visits: int, floor: float, seed: int):
    """The best ``k`` items of a cell, of cosine ``floor`` at least, for each of its queries; ``role``: 1 for a query, 2 for an item, 3 for both."""
    rng, x, size = np.random.default_rng(seed), units(given), lengths(given)
    own, queries = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
    if not len(own) or not len(queries):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    depth = max(0, int(np.ceil(np.log2(max(1, len(own)) / leaf_rows))))
    forest = [Tree(x[own], depth, rng) for _ in range(trees if depth else 1)]
    visited, _ = first_of_queue(forest, x[queries], max(visits, len(forest)))
    found_q, found_i, found_s = [], [], []
    for t, tree in enumerate(forest):
        leaf_of = tree.leaves(x[own])
        for leaf in range(2**depth):
            rows = own[leaf_of == leaf]
            ask = queries[(visited == t * 2**depth + leaf).any(1)]
            if not len(rows) or not len(ask):
                continue
            for part in np.array_split(ask, max(1, len(ask) * len(rows) // 4_000_000)):
                score = x[part] @ x[rows].T
                score[ids[part][:, None] == ids[rows][None, :]] = -2
                best = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(rows) > k else np.tile(np.arange(len(rows)), (len(part), 1))
                s = np.take_along_axis(score, best, 1)
                q, c = np.nonzero(s >= floor - 1e-4)
                found_q.append(part[q]), found_i.append(rows[best[q, c]]), found_s.append(s[q, c])
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, i, s = np.concatenate(found_q), np.concatenate(found_i), np.concatenate(found_s)
    _, once = np.unique(q.astype(np.int64) * len(x) + i, return_index=True)
    q, i, s = q[once], i[once], s[once]
    exact = np.concatenate([np.einsum("ij,ij->i", given[a], given[b], dtype=np.float64) / (size[a] * size[b]) for a, b in zip(np.array_split(q, len(q) // 20_000 + 1), np.array_split(i, len(q) // 20_000 + 1))])
    exact = np.round(exact, 9)
    order = np.lexsort((ids[i], -exact, q))
    q, i, exact = q[order], i[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = (place < k) & (exact >= floor)
    return ids[q[keep]], ids[i[keep]], exact[keep]


# As Spark jobs ------------------------------------------------------------------------------------------------


def similar_vectors(
    df: DataFrame, id_col: str, vec_col: str, *, k: int = 10, dim: int = 384, floor: float = -1.0, cell_rows: int = 4096,
    trees: int = 4, probes: int = 5, sample_rows: int = 32_768, most_rows: int = 16_384, local_trees: int = 2, local_visits: int = 4, leaf_rows: int = 512, seed: int = 7,
) -> DataFrame:
    """The ``k`` vectors most similar to each vector: ``id, neighbour, cosine``, both ways, ids unique in ``df``.

    Rows without a usable vector (null, another length than ``dim``, a value that is null or not finite, all zero)
    and rows without id have no part. Equal cosines go to the smaller id. Rows below ``floor`` are left out. Other
    columns of ``df`` are not read. An empty table gives no rows.

    ``sample_rows`` bounds the sample on which the upper trees are fitted, and so their depth; every row is indexed. A
    cell that by the sample has more than ``most_rows`` rows is dealt out to smaller ones of that size, in each of which
    all of its queries are asked, so that no task's share grows with the data. Equal vectors are
    routed once, through the smallest id that holds them, so that a vector held by a third of all rows is no hot
    cell; the first ``k + 1`` holders of a vector are enough to fill any list.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    rows = source.count()
    every = max(1, rows // max(1, sample_rows))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable_rows(b.column(0), b.column(1), dim)
            x = units(x)
            taken = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(every) == 0
            marks = pa.array([hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x], pa.binary())
            sample = pa.array([v.tobytes() if t else None for v, t in zip(x, taken)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids), marks, sample], ["id", "mark", "sample"])

    marked = written(source.mapInArrow(prints, "id bigint, mark binary, sample binary"), "vectors")
    sample = marked.filter("sample IS NOT NULL").select("sample").limit(2 * sample_rows).toArrow()
    sampled = from_binary(sample.column(0), dim)
    depth = max(0, int(np.ceil(np.log2(max(1, rows) / cell_rows))))
    while depth and 2**depth * 8 > len(sampled):
        depth -= 1
    rng = np.random.default_rng(seed)
    upper = [Tree(sampled, depth, rng) for _ in range(trees if depth else 1)]
    forest = spark.sparkContext.broadcast(upper)  # at most sample_rows / 8 planes a tree
    visits = probes if depth else 1
    share = [np.bincount(t.leaves(sampled), minlength=2**depth) / max(1, len(sampled)) if len(sampled) else np.zeros(2**depth) for t in upper]
    parts = np.maximum(1, np.ceil(np.concatenate(share) * rows / most_rows)).astype(np.int64)

    classes = marked.groupBy("mark").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1").select("mark", "first_id")
    held = written(marked.select("id", "mark").join(classes, "mark").select("id", "first_id"), "holders")
    repeats = held.filter("id <> first_id").select("id")
    copies = not repeats.isEmpty()
    routed = source.join(repeats, "id", "left_anti") if copies else source

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable_rows(b.column(0), b.column(1), dim)
            if not len(ids):
                continue
            first, own = first_of_queue(forest.value, units(x), visits)
            wanted = np.zeros((len(ids), len(parts)), np.int8)
            np.put_along_axis(wanted, first, 1, axis=1)
            np.put_along_axis(wanted, own, 3, axis=1)
            row, cell = np.nonzero(wanted)
            for some in np.array_split(np.arange(len(row)), len(row) // 2048 + 1):
                r, c, i, j, role = dealt(row[some], cell[some], wanted[row[some], cell[some]], ids, parts)
                for at in range(0, len(r), 4096):
                    p = slice(at, at + 4096)
                    yield pa.RecordBatch.from_arrays([pa.array(c[p].astype(np.int32)), pa.array(i[p].astype(np.int32)), pa.array(j[p].astype(np.int32)), pa.array(ids[r[p]]), pa.array(role[p].astype(np.int8)), to_binary(x[r[p]])], ["cell", "i", "j", "id", "role", "vec"])

    def search(key: tuple, group: pa.Table) -> pa.Table:
        x = from_binary(group.column("vec"), dim)
        q, i, s = nearest_in_cell(group.column("id").to_numpy(), x, group.column("role").to_numpy(), k, local_trees, leaf_rows, local_visits, floor, seed + key[0].as_py())
        return pa.table({"id": pa.array(q, pa.int64()), "neighbour": pa.array(i, pa.int64()), "cosine": pa.array(s, pa.float64())})

    near = routed.mapInArrow(route, "cell int, i int, j int, id bigint, role tinyint, vec binary").groupBy("cell", "i", "j").applyInArrow(search, SCHEMA)
    if copies:
        near = _with_copies(near, held, k)
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("away"), "neighbour"))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("b")).select("id", F.col("b.neighbour").alias("neighbour"), (-F.col("b.away")).alias("cosine"))


def dealt(row: np.ndarray, cell: np.ndarray, role: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, cell, i, j, role`` where each row goes: items of part ``i`` of a cell meet the queries of its part ``j``."""
    n = parts[cell]
    own = ((ids[row].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)
    again = np.repeat(np.arange(len(row)), n)
    other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    as_query = again, other, own[again], np.where(role[again] == 3, np.where(other == own[again], 3, 1), 1)
    items = (role[again] == 3) & (other != own[again])
    as_item = again[items], own[again][items], other[items], np.full(items.sum(), 2)
    at, i, j, role = (np.concatenate(x) for x in zip(as_query, as_item))
    return row[at], cell[at], i, j, role


def _with_copies(near: DataFrame, held: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """Puts the holders of equal vectors in the place of the one that was routed.

    The holders of a vector are dealt out to blocks and what they take over is repeated for each block, so that a
    vector held by very many rows is no one key of the joins.
    """
    sizes = held.groupBy("first_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    held = held.join(sizes, "first_id").select("first_id", "id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    place = F.row_number().over(Window.partitionBy("first_id").orderBy("id"))
    local = F.row_number().over(Window.partitionBy("first_id", "block").orderBy("id"))
    few = held.withColumn("place", local).filter(F.col("place") <= k + 1).withColumn("place", place).filter(F.col("place") <= k + 1)
    few = written(few.select("first_id", F.col("id").alias("holder")), "few")
    spread = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("first_id", "block")
    among = held.join(few.join(spread, "first_id"), ["first_id", "block"]).filter("id <> holder").select("id", F.col("holder").alias("neighbour"), F.lit(1.0).alias("cosine"))
    lists = near.join(spread.withColumnRenamed("first_id", "r"), F.col("id") == F.col("r"), "left").select("id", "neighbour", "cosine", F.coalesce("block", F.lit(0)).alias("block"))
    lists = lists.join(held.select(F.col("first_id").alias("r"), F.col("block").alias("own"), F.col("id").alias("asker")), (F.col("id") == F.col("r")) & (F.col("block") == F.col("own")), "left")
    lists = lists.select(F.coalesce("asker", "id").alias("id"), "neighbour", "cosine")
    lists = lists.join(few, F.col("neighbour") == F.col("first_id"), "left").select("id", F.coalesce("holder", "neighbour").alias("neighbour"), "cosine")
    return lists.unionByName(among)


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, least: float = 0.8, k: int = 10, **options) -> DataFrame:
    """Pairs ``doc_a < doc_b`` of cosine ``least`` at least where one is among the ``k`` most similar of the other."""
    near = similar_vectors(df, id_col, vec_col, k=k, floor=least, **options)
    return near.select(F.least("id", "neighbour").alias("doc_a"), F.greatest("id", "neighbour").alias("doc_b")).distinct()
