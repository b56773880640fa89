import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm.components import components
from terrace.llm.cooccurrence import basket, cooccurrence, found_together
from terrace.llm import near_duplicates
from terrace.llm.near_duplicates import NearDuplicates, layout, least_agreeing, multipliers, run_set, signature, variant_keys
from terrace.llm.similar_vectors import Tree, dealt, first_of_queue, similar_pairs, similar_vectors
from terrace.llm.words import WordHashes, shingle_hashes, words

VECTORS = "doc bigint, v array<float>, id string, neighbour int, vec string, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, "i", 1, "v", 2) for i, x in rows], VECTORS)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dim))).astype(np.float32)


def test_words():
    assert words("Hello, World_2 中文x9ÉCOLE") == ["hello", "world", "2", "中", "文", "x9école"]
    assert words(None) == words("") == words(" ,") == []
    h = WordHashes()(words("a b c a b c d"))
    runs = shingle_hashes(h, 3)
    assert len(runs) == 5 and runs[0] == runs[3] and len(set(runs.tolist())) == 4
    assert len(shingle_hashes(h[:2], 3)) == 0


@pytest.mark.parametrize("dense", [64, 0])
def test_queue_gives_leaves_as_a_heap_would(dense):
    """What the walk by levels keeps is what a shared heap pops first; equal priorities may change places."""
    import heapq

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    forest = [Tree(x, 5, rng) for _ in range(3)]
    got, own = first_of_queue(forest, x[:40], 6, dense)

    def rank(row, leaf):
        t, place, way = forest[leaf >> 5], (leaf & 31) + 31, []
        while place:
            up = (place - 1) // 2
            m = float(x[row] @ t.planes[up] - t.cuts[up])
            way.append(m if place == 2 * up + 2 else -m)
            place = up
        return min(way)

    for row in range(40):
        heap, popped = [(-np.inf, t, 0) for t in range(3)], []
        while len(popped) < 6:
            priority, t, node = heapq.heappop(heap)
            if node >= 31:
                popped.append(t * 32 + node - 31)
                continue
            m = float(x[row] @ forest[t].planes[node] - forest[t].cuts[node])
            heapq.heappush(heap, (max(priority, m), t, 2 * node + 1))
            heapq.heappush(heap, (max(priority, -m), t, 2 * node + 2))
        assert len(set(got[row])) == 6 and np.allclose(sorted(rank(row, n) for n in popped), sorted(rank(row, int(n)) for n in got[row]), atol=1e-4)
        assert [int(n) >> 5 for n in own[row]] == [0, 1, 2] and all(rank(row, int(n)) >= -1e-5 for n in own[row])


@pytest.mark.parametrize("options", [{"cell_rows": 200}, {"cell_rows": 10_000, "most_rows": 30}, {"cell_rows": 200, "most_rows": 50}])
def test_recall_against_brute_force(spark, options):
    """Cells by the upper trees; one cell fifty times too large, dealt out; both."""
    x = clustered(1500, 16, 1)
    df = vectors(spark, [(k, row.tolist()) for k, row in enumerate(x)])
    got = {(r.id, r.neighbour) for r in similar_vectors(df, "doc", "v", k=5, dim=16, leaf_rows=64, **options).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(k, int(j)) for k in range(len(x)) for j in np.argsort(-s[k])[:5]}
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)


def test_large_cells_are_dealt_out():
    """Every query of a cell meets every item of it once, and no part has more than its share."""
    rng = np.random.default_rng(8)
    ids, cell, parts = rng.permutation(5000), rng.integers(0, 2, 5000), np.array([1, 50])
    role = np.where(rng.random(5000) < 0.6, 3, 1)
    row, c, i, j, r = dealt(np.arange(5000), cell, role, ids, parts)
    groups = {}
    for at, *key, what in zip(row.tolist(), c.tolist(), i.tolist(), j.tolist(), r.tolist()):
        groups.setdefault(tuple(key), []).append((at, what))
    assert len(groups) == 1 + 50 * 50 and max(len(g) for k, g in groups.items() if k[0]) < 4 * 2500 / 50
    met = Counter((q, t) for g in groups.values() for q, a in g if a & 1 for t, b in g if b & 2 and q != t)
    want = {(q, t) for n in (0, 1) for q in np.flatnonzero(cell == n).tolist() for t in np.flatnonzero((cell == n) & (role == 3)).tolist() if q != t}
    assert set(met) == want and set(met.values()) == {1}


def test_unusable_vectors_copies_and_ties(spark):
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(8)] + [(20, [2.0, 0.1, 0.0]), (21, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 0.0]), (31, [1.0, 2.0]), (32, None), (33, [float("nan"), 1.0, 1.0]), (34, [float("inf"), 1.0, 1.0]), (35, [None, 1.0, 1.0]), (36, []), (None, [1.0, 0.0, 0.0])]
    got = {}
    for r in similar_vectors(vectors(spark, rows), "doc", "v", k=3, dim=3).collect():
        got.setdefault(r.id, []).append((r.neighbour, round(r.cosine, 4)))
    assert set(got) == {*range(8), 20, 21}
    assert sorted(n for n, _ in got[0]) == [1, 2, 3] and sorted(n for n, _ in got[7]) == [0, 1, 2] and sorted(n for n, _ in got[20]) == [0, 1, 2]
    assert sorted(got[21])[0][0] in (0, 20) and (20, 0.0499) in got[21]
    pairs = {(r.doc_a, r.doc_b) for r in similar_pairs(vectors(spark, rows), "doc", "v", 0.8, 3, dim=3).collect()}
    assert all(a < b for a, b in pairs) and (0, 1) in pairs and (0, 20) in pairs and not any(21 in p for p in pairs)


def test_a_vector_that_very_many_rows_hold(spark):
    from terrace.llm.similar_vectors import _with_copies

    held = spark.range(1, 400).select(F.lit(1).cast("bigint").alias("first_id"), "id").unionByName(spark.createDataFrame([(500, 500), (500, 501)], "first_id bigint, id bigint"))
    near = spark.createDataFrame([(1, 500, 0.5), (500, 1, 0.5), (700, 1, 0.4), (700, 800, 0.3)], "id bigint, neighbour bigint, cosine double")
    got = Counter((r.id, r.neighbour) for r in _with_copies(near, held, 2, block=16).collect())
    first = (1, 2, 3)
    want = {(a, b) for a in range(1, 400) for b in (500, 501, *first) if a != b} | {(a, b) for a in (500, 501) for b in first} | {(500, 501), (501, 500)} | {(700, b) for b in (*first, 800)}
    assert set(got) == want and set(got.values()) == {1}


def test_only_the_direction_counts(spark):
    rows = [(1, [3e38, 3e38, 0.0]), (2, [1e-30, 1e-30, 0.0]), (3, [1.0, 1.0, 0.0]), (4, [0.0, 0.0, -2.0])]
    got = {(r.id, r.neighbour): round(r.cosine, 6) for r in similar_vectors(vectors(spark, rows), "doc", "v", k=2, dim=3, floor=0.5).collect()}
    assert got == {(a, b): 1.0 for a in (1, 2, 3) for b in (1, 2, 3) if a != b}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0, 3.0])]])
def test_hardly_any_vectors(spark, rows):
    assert similar_vectors(vectors(spark, rows), "doc", "v", k=3, dim=3).collect() == []


# Near duplicates

TEXTS = "doc bigint, title string, content string, id string, mark string, first_id int, a int, b int, key string"


def texts(spark, rows):
    return spark.createDataFrame([(*r, "i", "m", 1, 2, 3, "k") for r in rows], TEXTS)


def joined():
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))


def near_rows():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 4000, 120)]
        rows.append((10 * k, "title", " ".join(base)))
        for e in range(3):
            edited = list(base)
            for place in rng.choice(120, int(rng.integers(1, 8)), replace=False):
                edited[place] = f"x{rng.integers(0, 10**6)}"
            rows.append((10 * k + 1 + e, "title", " ".join(edited)))
        if k % 4 == 0:
            rows += [(10 * k + 5, "TITLE", "  ".join(base).upper()), (10 * k + 6, "title", " ".join(base))]
    return rows + [(9001, None, None), (9002, "", ""), (9003, "short", "only a few words here"), (9004, "short", "only a few words here"), (None, "title", "a " * 50), (9005, "long", "lorem ipsum dolor " * 20_000), (9006, "long", "lorem ipsum dolor " * 20_001)]


def brute_pairs(rows, least):
    h, sets = WordHashes(), {}
    for i, a, b in rows:
        s = run_set(f"{a or ''} {b or ''}", 5, 20, h)
        if i is not None and s is not None:
            sets[i] = set(s.tolist())
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}, sets


@pytest.mark.parametrize("tile", [512, 2])
def test_pairs_groups_and_links(spark, monkeypatch, tile):
    """With tiles of two, nearly all variants and classes are divided."""
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    rows = near_rows()
    found = NearDuplicates(texts(spark, rows), "doc", joined(), similarity=0.5)
    got = {(r.doc_a, r.doc_b) for r in found.all_pairs().collect()}
    want, sets = brute_pairs(rows, 0.5)
    assert got <= set(want) and len(got) >= 0.99 * len(want) and all(p in got for p, s in want.items() if s == 1)
    groups = {r.doc_id: r for r in found.groups().collect()}
    assert set(groups) == set(sets)
    assert all(groups[a].group_id == groups[b].group_id for a, b in got)
    assert groups[0].class_id == groups[5].class_id == groups[6].class_id == 0 and groups[9005].links == 0 and groups[9006].class_id == 9005
    assert all(r.links == len({groups[b if a == i else a].class_id for a, b in got if i in (a, b)} - {r.class_id}) for i, r in groups.items())


def test_many_records_that_share_a_passage(spark):
    """20,000 records of which a quarter is the same passage: none is similar to another, but for those made so."""
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(110)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(50_000)))), " ")
    shared = " ".join(f"boiler{k}" for k in range(40))
    rows = spark.range(20_000).select(F.col("id").alias("doc"), F.lit(shared).alias("title"), own.alias("content"))
    near = rows.filter("doc % 1000 = 7").select((F.col("doc") + 1_000_000).alias("doc"), "title", F.concat("content", F.lit(" and a few words more")).alias("content"))
    found = NearDuplicates(rows.unionByName(near), "doc", joined(), similarity=0.5)
    assert {(r.doc_a, r.doc_b) for r in found.all_pairs().collect()} == {(k, k + 1_000_000) for k in range(7, 20_000, 1000)}


def test_a_variant_of_very_many_classes_is_dealt_out(spark, monkeypatch):
    """What the tasks get to compare stays small, however many classes share a variant."""
    monkeypatch.setattr(near_duplicates, "TILE", 16)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, "t", " ".join([*base, f"own{k}", f"end{k}"])) for k in range(100)]
    found = NearDuplicates(texts(spark, rows), "doc", joined(), similarity=0.5)
    assert found.pairs.count() == 4950 and found.all_pairs().count() == 4950
    assert {r.links for r in found.groups().collect()} == {99} and {r.group_id for r in found.groups().collect()} == {0}


def test_one_class_of_very_many_records(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "TILE", 16)
    text = " ".join(f"w{k}" for k in range(40))
    found = NearDuplicates(texts(spark, [(k, "t", text) for k in range(150)] + [(999, "t", text + " x")]), "doc", joined())
    got = [(r.doc_a, r.doc_b) for r in found.all_pairs().collect()]
    assert len(got) == len(set(got)) == 151 * 150 // 2 and all(a < b for a, b in got)


def test_layouts():
    assert layout(0.5) == (16, 4)
    for s in (0.3, 0.5, 0.6, 0.8, 0.9, 1.0):
        segments, symbols = layout(s)
        found = symbols * s ** (symbols - 1) * (1 - s) + s**symbols
        assert segments * symbols <= 64 and (1 - found) ** segments <= (0.003 if s >= 0.5 else 1)
        assert 1 <= least_agreeing(s, segments * symbols) <= segments * symbols * s


def test_no_texts(spark):
    found = NearDuplicates(texts(spark, []), "doc", joined())
    assert found.all_pairs().collect() == [] and found.groups().collect() == []


def test_variants_meet_when_one_symbol_of_a_segment_differs():
    rng = np.random.default_rng(1)
    sig = signature(rng.integers(0, 2**63, 500, np.uint64), multipliers(64))
    other = sig.copy()
    other[::4] ^= 1  # one symbol of each segment
    assert len(set(variant_keys(sig, 16, 4)[0]) & set(variant_keys(other, 16, 4)[0])) == 16
    other[1::4] ^= 1
    assert not set(variant_keys(sig, 16, 4)[0]) & set(variant_keys(other, 16, 4)[0])


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (100, 102), (7, 7)] + [(200, k) for k in range(201, 230)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in (100, 101, 102)}, **{k: 200 for k in range(200, 230)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# Items together


@pytest.mark.parametrize(("dense", "tile", "long"), [(0, 8, 256), (20, 3, 256), (20, 2048, 2), (10**6, 7, 256), (0, 8, 2)])
def test_pairs_of_items(spark, dense, tile, long):
    """All light, both, and all heavy; matrices in tiles; baskets of more than two light items treated as long ones."""
    rng = np.random.default_rng(2)
    raw = [[f" Tag{x}" if x % 2 else f"tag{x}" for x in rng.zipf(1.5, int(rng.integers(0, 9))).tolist() if x < 60] for _ in range(400)]
    raw += [None, [], [" ", None, ""], ["TAG1", "tag1 "]] + [["hot", "hotter"]] * 200
    clean = [sorted({x.strip().lower() for x in b or [] if x and x.strip()}) for b in raw]
    n, n2 = {}, {}
    for b in clean:
        for x in b:
            n[x] = n.get(x, 0) + 1
        for p in itertools.combinations(b, 2):
            n2[p] = n2.get(p, 0) + 1
    total = sum(map(bool, clean))
    df = spark.createDataFrame([(b, "c", 1) for b in raw], "tags array<string>, items string, basket int").select(basket("tags").alias("items"))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.baskets) for r in cooccurrence(df, dense=dense, tile=tile, long=long).collect()}
    assert got == {(a, b): (k, n[a], n[b], total) for (a, b), k in n2.items()}
    for least in (2, 5):
        got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence(df, least_together=least, dense=dense, tile=tile, long=long).collect()}
        assert got == {p: k for p, k in n2.items() if k >= least}
    often = {(r.tag_a, r.tag_b) for r in found_together(df).collect()}
    assert often == {(a, b) for (a, b), k in n2.items() if k >= 4 and k * total >= 3 * n[a] * n[b]}


def test_baskets_of_twenty_thousand_items(spark):
    """Two such baskets beside small ones: pairs of three baskets at least, without the 200 million pairs of each."""
    rng = np.random.default_rng(3)
    small = [sorted(f"i{x:05}" for x in set(rng.integers(0, 20_000, 4).tolist())) for _ in range(30_000)]
    small += [["i00001", "i00002"], ["i19998", "i19999"], ["i19998", "i19999"]]
    n2 = Counter(p for b in small for p in itertools.combinations(b, 2))
    want = {p: k + 2 for p, k in n2.items() if k + 2 >= 3}
    df = spark.createDataFrame([(b,) for b in small], "items array<string>")
    huge = spark.range(2).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda k: F.format_string("i%05d", k)).alias("items"))
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence(df.unionByName(huge), least_together=3).collect()}
    assert got == want


def test_no_baskets(spark):
    df = spark.createDataFrame([(None,), ([],)], "tags array<string>").select(basket("tags").alias("items"))
    assert cooccurrence(df).collect() == []


