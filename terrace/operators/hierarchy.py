"""Parent-child links to full hierarchies.

Subtree sizes are computed upwards; then every node hands its children, in the order of their ids, successive ranges
of preorder numbers, so that prefix sums of sizes downwards give each node the range ``first .. first + size - 1`` of
its subtree within its root's tree. A node's ancestors are the nodes of its tree whose ranges hold its number, its
descendants those whose numbers its range holds: its root is the one root's range that holds it, its depth the number
of ranges that do. Nodes that the passes leave unfinished lie on cycles or hang from them.

Groups of at most ``small_rows`` rows (traces, mostly) are worked off in tasks, many groups together, level by level.
Larger groups are first divided into their trees: every node looks for its root in steps of doubled length, so that the
number of rounds grows with the logarithm of the depth, not with the depth. Trees that are larger still are worked off
as joins over all executors, both passes in steps of doubled length too. All ways give the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.plans.lineage import dropped, written

NODES = "grp string, node string, parent string, root string, depth bigint, size bigint, first bigint, cyclic boolean, path string"
BLOCK = 4096


# Groups of bounded size, inside tasks --------------------------------------------------------------------------


def solve(parent: np.ndarray, name: np.ndarray, paths: bool) -> dict[str, np.ndarray]:
    """Roots, depths, sizes, first numbers and paths of many trees; siblings come in the order of the rows.

    ``parent``: row of the parent, -1 for roots.
    """
    n = len(parent)
    has = parent >= 0
    waiting = np.bincount(parent[has], minlength=n)
    size, done = np.ones(n, np.int64), np.zeros(n, bool)
    ready = np.flatnonzero(waiting == 0)
    while len(ready):  # upwards: a node is finished when all its children are
        done[ready] = True
        up = ready[has[ready]]
        np.add.at(size, parent[up], size[up])
        np.subtract.at(waiting, parent[up], 1)
        above = np.unique(parent[up])
        ready = above[(waiting[above] == 0) & ~done[above]]
    cyclic = ~done

    # downwards: the roots, then each node's children, share out successive ranges in the order of the rows
    tops, children = np.flatnonzero(~has), np.flatnonzero(has & done)
    children = children[np.argsort(parent[children], kind="stable")]
    of = parent[children]
    before = np.cumsum(size[children]) - size[children]
    start = np.searchsorted(of, of)
    offset = np.zeros(n, np.int64)
    offset[children] = 1 + before - before[start] if len(children) else 0  # sizes of the earlier siblings
    place = np.full(n, -1, np.int64)
    place[tops] = np.cumsum(size[tops]) - size[tops]
    begin, end = np.searchsorted(of, np.arange(n), "left"), np.searchsorted(of, np.arange(n), "right")

    def below(level: np.ndarray) -> np.ndarray:
        counts = end[level] - begin[level]
        return children[np.repeat(begin[level], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]

    path = np.full(n, None, object)
    path[tops] = name[tops]
    level = below(tops)
    while len(level):
        place[level] = place[parent[level]] + offset[level]
        if paths:
            path[level] = path[parent[level]] + "/" + name[level]
        level = below(level)

    # ancestors by ranges: every node before a number has opened its range, and those that ended there don't hold it
    root, depth, first = np.full(n, -1), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    inside = np.flatnonzero(place >= 0)
    at = place[inside]
    depth[inside] = at - np.searchsorted(np.sort(at + size[inside]), at, "right")
    root[inside] = tops[np.searchsorted(place[tops], at, "right") - 1]
    first[inside] = at - place[root[inside]]

    for ring in _cycles(parent, np.flatnonzero(cyclic)):
        root[ring] = min(ring.tolist(), key=name.__getitem__)
    level = below(np.flatnonzero(cyclic))  # what hangs from cycles
    while len(level):
        root[level] = root[parent[level]]
        level = below(level)
    return {"path": path if paths else np.full(n, None, object), "root": root, "depth": depth, "size": np.where(depth >= 0, size, -1), "first": first, "cyclic": cyclic}


def _cycles(parent: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    seen, out = set(), []
    for row in rows.tolist():
        ring = []
        while row not in seen:
            seen.add(row)
            ring.append(row)
            row = int(parent[row])
        if ring:
            out.append(np.array(ring))
    return out


def _bundles(paths: bool):
    def bundle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("node", "ascending"), ("parent", "ascending")])
        group, name = table["grp"].combine_chunks().dictionary_encode().indices.to_numpy(), table["node"].to_numpy()
        again = np.r_[False, (group[1:] == group[:-1]) & (name[1:] == name[:-1])]
        if again.any():  # given with several parents: the smallest counts
            table, group, name = table.filter(pa.array(~again)), group[~again], name[~again]
        group = group.tolist()
        row = {key: k for k, key in enumerate(zip(group, name))}
        parent = np.fromiter((row.get(key, -1) for key in zip(group, table["parent"].to_pylist())), np.int64, len(name))
        made = solve(parent, name, paths)
        kept = pa.array(np.where(parent >= 0, table["parent"].to_numpy(), None), pa.string())
        columns = [table["grp"], table["node"], kept, pa.array(name[made["root"]], pa.string()), *(pa.array(made[x]) for x in ("depth", "size", "first", "cyclic")), pa.array(made["path"], pa.string())]
        return pa.table(columns, names=["grp", "node", "parent", "root", "depth", "size", "first", "cyclic", "path"])

    return bundle


# Large groups, as joins ----------------------------------------------------------------------------------------


def _units(links: DataFrame) -> DataFrame:
    """``links`` with ``unit``: the root of each node's tree, or null for nodes whose chain runs into a cycle.

    After round ``k`` a node knows the node 2^k steps above it, unless its chain ends before. As long as a chain is
    still to end, some chain ends in the next round; so when a round ends none, the rest are unfinished for good: they
    run into cycles. A child of a root knows its root from the start, so that no round joins on a root.
    """
    unit = F.when(F.col("parent").isNull(), F.col("node")).when(F.col("top"), F.col("parent"))
    known = written(links.select("grp", "node", F.col("parent").alias("up"), unit.alias("unit")), "up")
    left = known.filter("unit IS NULL").count()
    while left:
        active, ended = known.filter("unit IS NULL").drop("unit"), known.filter("unit IS NOT NULL")
        target = known.select("grp", F.col("node").alias("up"), F.col("up").alias("up2"), "unit")
        step = active.join(target, ["grp", "up"]).select("grp", "node", F.col("up2").alias("up"), "unit")
        known, old = written(step.unionByName(ended), "up"), known
        dropped(old)
        now = known.filter("unit IS NULL").count()
        if now == left:
            break
        left = now
    return links.join(known.select("grp", "node", "unit"), ["grp", "node"])


def _doubled(links: DataFrame, paths: bool) -> DataFrame:
    """The same columns as ``_bundles`` for trees of any size.

    After round ``k`` a node knows the node 2^k steps above it, unless it is nearer to its root, and ``size`` counts
    the descendants fewer than 2^k steps below it; those at exactly that distance then add theirs. ``top`` says that
    the node above is the root, beyond which there is nothing to look up, so that no round joins on a root.
    """
    key = ["grp", "node"]
    known = written(links.select(*key, F.col("parent").alias("up"), "top", F.lit(1).cast("bigint").alias("size")), "up")
    while not known.filter("up IS NOT NULL").isEmpty():
        added = known.filter("up IS NOT NULL").groupBy("grp", F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        grown = known.join(added, key, "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        step = _stepped(grown, known, [], lambda joined: {}, lambda ended: {})
        known, old = written(step, "up"), known
        dropped(old)
    sized = written(links.join(known.select(*key, "size"), key), "sized")

    offsets = _earlier_siblings(sized.filter("parent IS NOT NULL"))
    down = sized.join(offsets, key, "left").select(*key, F.col("parent").alias("up"), "top", F.coalesce("offset", F.lit(0)).cast("bigint").alias("first"), (F.col("node") if paths else F.lit(None).cast("string")).alias("path"))
    down = written(down, "down")
    while not down.filter("up IS NOT NULL").isEmpty():
        further = lambda j: {"first": F.col("first") + F.col("first2"), "path": F.concat_ws("/", "path2", "path")}
        at_root = lambda e: {"path": F.when(F.col("up").isNotNull() & F.col("path").isNotNull(), F.concat_ws("/", "up", "path")).otherwise(F.col("path"))}
        step = _stepped(down, down, ["first", "path"], further, at_root)
        down, old = written(step, "down"), down
        dropped(old)
    path = F.when(F.lit(paths), F.col("path"))
    ranged = written(sized.join(down.select(*key, "first", path.alias("path")), key), "ranged")
    return ranged.join(_depths(ranged), key).select("grp", "node", "parent", F.col("unit").alias("root"), "depth", "size", "first", F.lit(False).alias("cyclic"), "path")


def _stepped(rows: DataFrame, above: DataFrame, carried: list[str], further, at_root) -> DataFrame:
    """``rows`` with ``up`` and ``top`` of the node above taken over; below a root or without a node above, there is none any more."""
    ending = F.col("up").isNull() | F.col("top")
    ended = rows.filter(ending)
    ended = ended.withColumns({**at_root(ended), "up": F.lit(None).cast("string"), "top": F.lit(False)})
    target = above.select("grp", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), *[F.col(c).alias(f"{c}2") for c in carried])
    joined = rows.filter(~ending).join(target, ["grp", "up"])
    joined = joined.withColumns({**further(joined), "up": F.col("up2"), "top": F.col("top2")})
    return ended.unionByName(joined.select(*ended.columns))


def _earlier_siblings(sized: DataFrame) -> DataFrame:
    """``grp, node, offset``: one more than the sizes of the siblings that come earlier, by node.

    The nodes are dealt out in ranges of their ids, and a parent's children are summed range by range, so that a
    parent of very many children is no single task's work.
    """
    parted = written(sized.select("grp", "parent", "node", "size").repartitionByRange("node").withColumn("part", F.spark_partition_id()), "siblings")
    sums = parted.groupBy("grp", "parent", "part").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("grp", "parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("grp", "parent", "part", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("grp", "parent", "part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    local = parted.withColumn("local", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return local.join(sums, ["grp", "parent", "part"]).select("grp", "node", (F.col("base") + F.col("local") + 1).alias("offset"))


def _depths(ranged: DataFrame) -> DataFrame:
    """``grp, node, depth``: how many ranges of its tree hold each node's number, itself not counted.

    Every earlier number has opened a range; those that ended at the number or before don't hold it. Ends are counted
    in blocks of numbers, so that a tree's numbers need not be in one task.
    """
    tree = ["grp", "unit", "block"]
    start = ranged.select("grp", "unit", "node", F.col("first").alias("at"), F.lit(1).alias("kind"))
    ends = ranged.select("grp", "unit", F.lit(None).cast("string").alias("node"), (F.col("first") + F.col("size")).alias("at"), F.lit(0).alias("kind"))
    events = start.unionByName(ends).withColumn("block", F.floor(F.col("at") / BLOCK))
    sums = events.groupBy(*tree).agg(F.count_if(F.col("kind") == 0).alias("n"))
    ahead = Window.partitionBy("grp", "unit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*tree, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ended"))
    inner = Window.partitionBy(*tree).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    local = events.withColumn("local", F.count_if(F.col("kind") == 0).over(inner)).filter("kind = 1")
    return local.join(sums, tree).select("grp", "node", (F.col("at") - F.col("ended") - F.col("local")).alias("depth"))


def _below_cycles(links: DataFrame) -> DataFrame:
    """Nodes on cycles and those hanging from them, named by the smallest id on the cycle.

    After enough doubled steps every node has arrived on its cycle, and the
    nodes arrived at are the cycle. The smallest id within 2^k steps of a cycle's node is the cycle's once 2^k
    reaches the number of nodes.
    """
    key = ["grp", "node"]
    count = links.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    known = written(links.select(*key, F.col("parent").alias("up")), "ring0")
    rounds = max(1, int(count).bit_length())
    for _ in range(rounds):
        known = written(known.join(known.select("grp", F.col("node").alias("up"), F.col("up").alias("up2")), ["grp", "up"]).select(*key, F.col("up2").alias("up")), "ring")
    ring = written(known.select("grp", F.col("up").alias("node")).distinct(), "on_ring")
    walk = links.join(ring, key, "left_semi").select(*key, F.col("parent").alias("up"), F.col("node").alias("least"))
    for _ in range(rounds):
        ahead = walk.select("grp", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        walk = written(walk.join(ahead, ["grp", "up"]).select(*key, F.col("up2").alias("up"), F.least("least", "least2").alias("least")), "least")
    named = walk.select("grp", F.col("node").alias("up"), F.col("least").alias("root"))
    on = ring.withColumn("cyclic", F.lit(True))
    whole = links.join(known, key).join(named, ["grp", "up"]).join(on, key, "left")
    minus = F.lit(-1).cast("bigint")
    return whole.select("grp", "node", "parent", "root", minus.alias("depth"), minus.alias("size"), minus.alias("first"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.lit(None).cast("string").alias("path"))


# Both together -------------------------------------------------------------------------------------------------


def tidy(column: str) -> Column:
    """An id without space around it and in lower case; null for an empty one."""
    trimmed = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


def hierarchy(df: DataFrame, group_col: str, node_col: str, parent_col: str, *, small_rows: int = 10_000, bundle_rows: int = 50_000, paths: bool = False) -> DataFrame:
    """One row for each distinct (group, node): ``grp, node, parent, root, depth, size, first, cyclic, path``.

    Ids are compared trimmed and in lower case. A node whose parent is null, empty or no node of its group is a root:
    depth 0, its parent null. ``size`` counts the node and its descendants, ``first`` is its preorder number in its
    root's tree, siblings in the order of their ids, and ``path``, if asked for, joins the ids from the root down with
    ``/``. Nodes on cycles (``cyclic``) and below them have depth, size and first -1, no path, and as root the smallest
    id on the cycle. Rows with a null or empty group or node are left out; a node given several times counts once, with
    its smallest parent. Other columns are not read; an empty table gives no rows.
    """
    links = df.select(tidy(group_col).alias("grp"), tidy(node_col).alias("node"), tidy(parent_col).alias("parent")).filter("grp IS NOT NULL AND node IS NOT NULL")
    links = written(links.distinct(), "links")
    counts = links.groupBy("grp").agg(F.count("*").alias("n"))
    large = written(counts.filter(F.col("n") > small_rows).select("grp"), "large")
    has_large = not large.isEmpty()
    bounded, others = (links.join(large, "grp", "left_anti") if has_large else links).withColumn("unit", F.lit(None).cast("string")), []
    if has_large:
        big = links.join(large, "grp", "left_semi").groupBy("grp", "node").agg(F.min("parent").alias("parent"))
        parents = big.select("grp", F.col("node").alias("parent"), F.lit(True).alias("found"))
        big = written(big.join(parents, ["grp", "parent"], "left").select("grp", "node", F.when(F.col("found"), F.col("parent")).alias("parent")), "big")
        tops = big.filter("parent IS NULL").select("grp", F.col("node").alias("parent"), F.lit(True).alias("top"))
        big = big.join(tops, ["grp", "parent"], "left").select("grp", "node", "parent", F.coalesce("top", F.lit(False)).alias("top"))
        units = written(_units(written(big, "linked")), "units")
        same = ["grp", F.coalesce("unit", F.lit("")).alias("u")]  # no id is empty
        larger = written(units.groupBy(*same).agg(F.count("*").alias("n")).filter(F.col("n") > small_rows).select("grp", "u"), "larger")
        marked = units.withColumn("u", F.coalesce("unit", F.lit("")))
        bounded = bounded.unionByName(marked.join(larger, ["grp", "u"], "left_anti").drop("u", "top"))
        if not larger.isEmpty():
            rest = written(marked.join(larger, ["grp", "u"], "left_semi").drop("u"), "rest")
            trees, hung = rest.filter("unit IS NOT NULL"), rest.filter("unit IS NULL")
            others += [_doubled(trees, paths)] if not trees.isEmpty() else []
            others += [_below_cycles(hung)] if not hung.isEmpty() else []
    bundles = max(1, links.count() // bundle_rows)
    bundled = bounded.withColumn("bundle", F.pmod(F.xxhash64("grp", "unit"), F.lit(bundles))).drop("unit")
    out = bundled.groupBy("bundle").applyInArrow(_bundles(paths), NODES)
    for more in others:
        out = out.unionByName(more)
    return out


# Ancestors and descendants by ranges ---------------------------------------------------------------------------


def holding_blocks(number: Column, levels: int) -> Column:
    """The dyadic blocks ``level, block`` that hold a number: one for each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.floor(number / F.pow(F.lit(2.0), level)).alias("block")))


def covering_blocks(low: Column, high: Column, levels: int) -> Column:
    """The dyadic blocks ``level, block`` that together make up ``low .. high - 1``; at most two for each level."""

    def at(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level)
        start, end = F.ceil(low / width), F.floor(high / width)
        wider = lambda b: (F.floor(b / 2) >= F.ceil(low / (width * 2))) & (F.floor(b / 2) < F.floor(high / (width * 2)))
        edges = F.filter(F.array_distinct(F.array(start, end - 1)), lambda b: (start < end) & ~wider(b))
        return F.transform(edges, lambda b: F.struct(level.alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def _levels(nodes: DataFrame) -> int:
    return int(nodes.agg(F.max("size")).first()[0] or 1).bit_length()


def counted_below(nodes: DataFrame, marked: Column) -> DataFrame:
    """``grp, node, n``: how many nodes of each node's subtree, itself included, are ``marked``; 0 below cycles.

    ``nodes``: a result of ``hierarchy``. Marked nodes are counted once for each dyadic block of preorder numbers that
    holds theirs, and each node sums the few blocks that its range consists of; no pairs are made.
    """
    key, levels = ["grp", "root", "level", "block"], _levels(nodes)
    points = nodes.filter((F.col("depth") >= 0) & marked).select("grp", "root", F.explode(holding_blocks(F.col("first"), levels)).alias("b"))
    held = points.groupBy("grp", "root", F.col("b.level").alias("level"), F.col("b.block").alias("block")).agg(F.count("*").alias("n"))
    ranges = nodes.filter("depth >= 0").select("grp", "node", "root", F.explode(covering_blocks(F.col("first"), F.col("first") + F.col("size"), levels)).alias("b"))
    sums = ranges.select("grp", "node", "root", "b.level", "b.block").join(held, key).groupBy("grp", "node").agg(F.sum("n").alias("n"))
    return nodes.select("grp", "node").join(sums, ["grp", "node"], "left").select("grp", "node", F.coalesce("n", F.lit(0)).alias("n"))


def descendant_pairs(nodes: DataFrame, ancestors: DataFrame | None = None, *, small_pairs: int = 200_000, bundle_pairs: int = 250_000) -> DataFrame:
    """``grp, ancestor, node``: all proper descendants of the nodes in ``ancestors (grp, node)``, or of every node, found by ranges alone.

    Trees of at most ``small_pairs`` pairs are worked off in tasks, many together; larger ones by joins of the dyadic
    blocks of preorder numbers that make up a range.
    """
    key, nodes = ["grp", "root"], nodes.filter("depth >= 0")
    trees = written(nodes.groupBy(*key).agg(F.sum("depth").alias("pairs")).filter("pairs > 0"), "trees")
    large = trees.filter(F.col("pairs") > small_pairs).select(*key)
    nodes = nodes.withColumn("asked", F.lit(True)) if ancestors is None else nodes.join(ancestors.select("grp", "node").distinct().withColumn("asked", F.lit(True)), ["grp", "node"], "left")
    nodes = nodes.select(*key, "node", "size", "first", F.coalesce("asked", F.lit(False)).alias("asked"))
    has_large = not large.isEmpty()
    bundles = max(1, (trees.agg(F.sum("pairs")).first()[0] or 0) // bundle_pairs)
    bundled = (nodes.join(large, key, "left_anti") if has_large else nodes).withColumn("bundle", F.pmod(F.xxhash64(*key), F.lit(bundles)))
    out = bundled.groupBy("bundle").applyInArrow(_expanded, "grp string, ancestor string, node string")
    return out.unionByName(_pairs_by_blocks(nodes.join(large, key, "left_semi"))) if has_large else out


def _expanded(table: pa.Table) -> pa.Table:
    """Pairs of whole trees: in the order of the numbers, a node's descendants are the rows that follow it."""
    table = table.sort_by([("grp", "ascending"), ("root", "ascending"), ("first", "ascending")])
    count = np.where(table["asked"].to_numpy(), table["size"].to_numpy() - 1, 0)
    above = np.repeat(np.arange(len(count)), count)
    below = above + 1 + np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count)
    node = table["node"]
    return pa.table([table["grp"].take(above), node.take(above), node.take(below)], names=["grp", "ancestor", "node"])


def _pairs_by_blocks(nodes: DataFrame) -> DataFrame:
    levels = _levels(nodes)
    ranges = nodes.filter("asked AND size > 1")
    ranges = ranges.select("grp", "root", F.col("node").alias("ancestor"), F.explode(covering_blocks(F.col("first") + 1, F.col("first") + F.col("size"), levels)).alias("b")).select("grp", "root", "ancestor", "b.level", "b.block")
    points = nodes.filter("first > 0").select("grp", "root", "node", F.explode(holding_blocks(F.col("first"), levels)).alias("b")).select("grp", "root", "node", "b.level", "b.block")
    return ranges.join(points, ["grp", "root", "level", "block"]).select("grp", "ancestor", "node")
