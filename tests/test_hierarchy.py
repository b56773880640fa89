import random

import pytest
from pyspark.sql import functions as F

from terrace.operators.hierarchy import counted_below, descendant_pairs, hierarchy
from terrace.plans.hierarchies import p3_descendants
from terrace.plans.lineage import written

SCHEMA = "trace string, span string, parent string, grp string, node string, root int"


def brute(rows):
    parent = {}
    for t, s, p in rows:
        tidy = [x.strip().lower() if x is not None else "" for x in (t, s, p)]
        if tidy[0] and tidy[1]:
            key = (tidy[0], tidy[1])
            known = [x for x in (parent.get(key), tidy[2]) if x]
            parent[key] = min(known) if known else None
    out = {}
    for key in parent:
        way, at = [key], key
        while True:
            up = parent[at] and (at[0], parent[at])
            if not up or up not in parent:
                out[key] = (at[1], len(way) - 1, "/".join(x[1] for x in reversed(way)))
                break
            if up in way:
                out[key] = (min(x[1] for x in way[way.index(up) :]), -1, None)
                break
            way.append(up)
            at = up
    return out


def frame(spark, rows):
    return spark.createDataFrame([(t, s, p, "x", "y", 1) for t, s, p in rows], SCHEMA)


def made_rows(seed):
    rng = random.Random(seed)
    rows = []
    for t in range(3):
        for k in range(40):
            up = rng.choice([None, "", "  ", "gone", f"n{rng.randrange(40)}", f"n{max(0, k - 1)}", f" N{max(0, k - 1)} "])
            rows.append((f"T{t} ", f"n{k}" if rng.random() < 0.7 else f" N{k}", up))
    return rows + rows[:10] + [(None, "a", "b"), ("t", None, "b"), (" ", "a", None), ("t9", "solo", "solo"), ("t9", "leaf", "solo")]


@pytest.mark.parametrize("small_rows", [10_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, small_rows, seed):
    """Both ways through the operator give the same as following every chain; clashing columns, nulls and repeats included."""
    rows = made_rows(seed)
    nodes = written(hierarchy(frame(spark, rows), "trace", "span", "parent", small_rows=small_rows, paths=True), "test")
    got = {(r.grp, r.node): r for r in nodes.collect()}
    want = brute(rows)
    assert {k: (r.root, r.depth, r.path) for k, r in got.items()} == want
    below = {k: 0 for k in want}
    for (g, _), (_, _, path) in want.items():
        for part in (path or "").split("/"):
            if path:
                below[g, part] += 1
    assert all(r.size == below[k] for k, r in got.items() if r.depth >= 0)
    trees = {}
    for r in got.values():
        if r.depth >= 0:
            trees.setdefault((r.grp, r.root), []).append(r.first)
    assert all(sorted(v) == list(range(len(v))) for v in trees.values())

    odd = F.col("node").rlike("[13579]$")
    counts = {(r.grp, r.node): r.n for r in counted_below(nodes, odd).collect()}
    wanted = {k: 0 for k in want}
    for (g, n), (_, _, path) in want.items():
        if path and n[-1] in "13579":
            for part in path.split("/"):
                wanted[g, part] += 1
    assert counts == wanted
    pairs = {(r.grp, r.ancestor, r.node) for r in descendant_pairs(nodes, nodes).collect()}
    assert pairs == {(g, part, n) for (g, n), (_, _, path) in want.items() if path for part in path.split("/")[:-1]}


def test_deep_chain_and_wide_parent_in_a_large_group(spark):
    rows = [("t", f"c{k:03}", f"c{k - 1:03}" if k else None) for k in range(150)] + [("t", f"w{k:03}", "c149") for k in range(150)]
    got = {r.node: r for r in hierarchy(frame(spark, rows), "trace", "span", "parent", small_rows=50).collect()}
    assert got["c149"].depth == 149 and got["w000"].depth == 150 and got["c000"].size == 300 and {r.root for r in got.values()} == {"c000"}


def test_the_query_gives_the_descendants_of_every_span(spark, tmp_path):
    rows = made_rows(3) + [("deep", f"c{k}", f"c{k - 1}" if k else None) for k in range(9)]
    frame(spark, rows).toDF("trace_id", "span_id", "parent_span_id", "a", "b", "c").write.parquet(f"{tmp_path}/otel_spans.parquet")
    got = [tuple(r) for r in p3_descendants(spark, str(tmp_path)).collect()]
    want = {(g, part, n) for (g, n), (_, _, path) in brute(rows).items() if path for part in path.split("/")[:-1]}
    assert len(got) == len(want) and set(got) == want
    assert sum(t == "deep" for t, _, _ in got) == 36
    nodes = written(hierarchy(frame(spark, rows), "trace", "span", "parent"), "test")
    for small_pairs in (0, 20):  # all by joins; some by joins, some in tasks
        assert sorted(map(tuple, descendant_pairs(nodes, small_pairs=small_pairs).collect())) == sorted(want)
    some = descendant_pairs(nodes, nodes.filter("depth = 1"), small_pairs=20)
    depth = {key: d for key, (_, d, _) in brute(rows).items()}
    assert sorted(map(tuple, some.collect())) == sorted(x for x in want if depth[x[0], x[1]] == 1)


def test_empty(spark):
    assert hierarchy(frame(spark, []), "trace", "span", "parent").collect() == []
