import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm.containers import Slots, fill, filled_containers, kept_whole, leftover_patterns, non_negative_least_squares, patterns, repeats
from terrace.llm.leaks import FullTextIndex, WaveletMatrix, leaked_spans, suffix_order
from terrace.llm.stuffed_pages import MARKS, STATES, Model, line_marks, page_shares, steps, stuffed_pages
from terrace.llm.subjects import Block, Parameters, document_subjects, paragraphs
from terrace.llm.words import words
from terrace.plans.lineage import written

# Leaks


def test_suffix_order_wavelets_and_search():
    rng = np.random.default_rng(1)
    for size, symbols in ((1, 1), (50, 2), (400, 5), (300, 200)):
        seq = rng.integers(1, symbols + 1, size)
        seq[size // 2 :] = seq[: size - size // 2]  # long repeats
        text = np.r_[seq, 0]
        assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        tree = WaveletMatrix(seq, max(1, int(symbols).bit_length()))
        at, c = rng.integers(0, size + 1, 50), rng.integers(1, symbols + 1, 50)
        assert tree.rank(c, at).tolist() == [int((seq[:a] == x).sum()) for a, x in zip(at, c)]
        assert tree.access(np.arange(size)).tolist() == seq.tolist()
        runs = [seq[k : k + 3] for k in range(size - 2)] + [np.array([symbols] * 3)]
        found = set(zip(*(x.tolist() for x in FullTextIndex(seq, symbols).find(np.array(runs)))))
        assert found == {(r, k) for r, run in enumerate(runs) for k in range(size - len(run) + 1) if (seq[k : k + 3] == run).all()}


def brute_spans(docs, items, least):
    covered = {}
    for d, text in docs:
        w = words(text)
        for i, passage in items:
            p = words(passage)
            runs = {tuple(p[k : k + least]) for k in range(len(p) - least + 1)}
            hits = [k for k in range(len(w) - least + 1) if tuple(w[k : k + least]) in runs]
            if d is not None and i is not None and hits:
                covered[d, i] = {x for k in hits for x in range(k, k + least)}
    return covered


@pytest.mark.parametrize("shard_words", [1_000_000, 50])
@pytest.mark.parametrize("block_words", [2_000_000, 300])
def test_leaks(spark, shard_words, block_words):
    rng = np.random.default_rng(4)
    make = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 30, n))
    items = [(k, make(20)) for k in range(12)] + [(50, None), (51, ""), (52, make(3)), (None, make(20)), (53, "中文" * 8)]
    items += [(60, items[0][1]), (61, items[1][1] + " " + make(10))]
    docs = []
    for k in range(30):
        passage = items[k % 12][1].split()
        start = int(rng.integers(0, 10))
        docs.append((k, f"{make(int(rng.integers(0, 40)))}, {' '.join(passage[start : start + int(rng.integers(4, 20))]).upper()}\n{make(15)}"))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "x " * 200 + items[2][1] + " y" * 300), (103, items[3][1] + " " + items[3][1]), (104, "文中文" + "中文" * 20)]
    docs += [(200, docs[0][1]), (200, docs[0][1])]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc bigint, txt string, text string, item_id int")
    held = spark.createDataFrame([(i, p, "c") for i, p in items], "nr bigint, p string, passage string")
    got = {}
    for r in leaked_spans(df, "doc", "txt", held, "nr", "p", least=8, shard_words=shard_words, block_words=block_words).collect():
        got.setdefault((r.doc_id, r.item_id), set()).update(range(r.first_word, r.last_word + 1))
    assert got == brute_spans(docs, items, 8) and got


@pytest.mark.parametrize("shard_words", [50, 1_000_000])
def test_spans_are_whole_across_shards(spark, shard_words):
    passage = [f"p{k}" for k in range(200)]
    held = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(passage[60:90]))], "nr bigint, p string")
    docs = [(1, " ".join(passage)), (2, " ".join(["x", *passage[:40], "y", *passage[40:]])), (3, " ".join(passage[:12] + passage[:11]))]
    got = sorted(map(tuple, leaked_spans(spark.createDataFrame(docs, "doc bigint, txt string"), "doc", "txt", held, "nr", "p", shard_words=shard_words).collect()))
    assert got == [(1, 1, 0, 199), (1, 2, 60, 89), (2, 1, 1, 40), (2, 1, 42, 201), (2, 2, 62, 91), (3, 1, 0, 11)]


def test_no_leaks(spark):
    some = spark.createDataFrame([(1, "a b c")], "id bigint, t string")
    assert leaked_spans(some.limit(0), "id", "t", some, "id", "t", least=2).collect() == []
    assert leaked_spans(some, "id", "t", some.limit(0), "id", "t", least=2).collect() == []


# Stuffed pages

PROSE = "The old bridge was closed on Monday because of the flood. We went over the hill with them, but it was not far.\n"


def pages():
    keywords = "\n".join(f"cheap shoes {c} online, buy shoes {c}, best shoes {c} price" for c in ("berlin", "paris", "rome", "oslo", "bern") * 4)
    links = "\n".join(f"- item {k} https://shop{k}.example/p/{k}.html" for k in range(30))
    menu = "\n".join(f"Home | About {k} | Contact | Basket" for k in range(30))
    chinese = "、".join(f"便宜鞋子{c}价格" for c in "甲乙丙丁戊己庚辛" * 6)
    table = PROSE + "\n".join(f"part {k} | blue | {k}.5" for k in range(40))
    code = PROSE + "\n".join(f"value_{k} = {k}" for k in range(40))
    bad = {1: keywords, 2: links, 3: menu, 4: chinese, 5: PROSE + keywords, 6: "shoes cheap shoes online " * 3000}
    good = {10: PROSE * 8, 11: "## Heading\n\n" + PROSE * 3 + "\nSee also\n- https://a.example/x.html\n- https://b.example/y.html", 12: table, 13: code, 14: "在桥边，大家都说这条路不好走。我们从山上下来，没有看到他们。" * 5, 15: "TODO", 16: "", 17: None, 18: PROSE.replace("bridge", "shoes") * 900, 19: "\n \n"}
    return bad, good


def test_stuffed_pages(spark):
    bad, good = pages()
    rows = [(k, t, "x", 1) for k, t in {**bad, **good}.items()] + [(None, bad[1], "x", 1), (1, bad[1], "x", 1)]
    rows += [(1000 + k, PROSE * (1 + k % 5) + f"\nNote {k}\n", "x", 1) for k in range(40)]
    df = spark.createDataFrame(rows, "page bigint, body string, id string, codes int")
    assert sorted(r.doc_id for r in stuffed_pages(df, "page", "body").collect()) == sorted([*bad, 1])
    counted = {r.doc_id: r for r in page_shares(df, "page", "body").collect()}
    assert counted[17].words == counted[16].words == 0 and counted[10].other_words == 0 and counted[18].words == 900 * len(words(PROSE))
    assert stuffed_pages(df.limit(0), "page", "body").collect() == []


def test_chances_of_states_against_enumeration():
    import itertools

    model = Model.start()
    codes = line_marks("Buy shoes now, buy shoes here\nThe bridge was closed because of the flood.\nhttps://a.example/x\nx = 3")[0]
    (share,), moves = model.shares([codes])
    n = len(STATES)
    e, total, want, pairs = model.emissions(codes), 0, np.zeros((4, n)), np.zeros((n, n))
    for path in itertools.product(range(n), repeat=4):
        p = np.exp(model.first[path[0]] + sum(e[k, s] for k, s in enumerate(path)) + sum(model.after[a, b] for a, b in zip(path, path[1:])))
        total += p
        for k, s in enumerate(path):
            want[k, s] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    assert np.allclose(share, want / total) and np.allclose(moves, pairs / total) and len(MARKS) == codes.shape[1]


def test_steps_of_a_page_and_counts_of_a_model():
    text = "Title\n\nFirst one. Second one! 第一句。第二句\n\na | b\nc | 1,200\ne f | g\n\nx = 1. y"
    assert [(p.strip(), form) for p, _, form in steps(text)] == [("Title", 0), ("First one.", 0), ("Second one!", 0), ("第一句。", 0), ("第二句", 0), ("a | b", 1), ("c | 1,200", 2), ("e f | g", 1), ("x = 1. y", 2)]
    assert steps("red shoes | blue shoes | shoes 2024")[0][2] == 0 and steps(None) == steps("\n \n") == []
    model = Model.start()
    same = model.improved(model.counts([]), 1000)
    assert np.allclose(same.after, model.after) and all(np.allclose(a, b) for a, b in zip(same.marks, model.marks))
    codes = line_marks(text)[0]
    free = model.improved(model.counts([codes] * 50), 1e-9)
    assert np.allclose(np.exp(free.first).sum(), 1) and all(np.allclose(np.exp(m).sum(1), 1) for m in free.marks)


# Subjects

TOPICS = {"t1": "kernel compiler thread cache socket".split(), "t2": "court statute verdict appeal clause".split(), "t3": "violin chorus melody tempo drum".split()}


def page(rng, topics, stray=None):
    parts = ["# Page\n"]
    for k, t in enumerate(topics):
        say = lambda s: " ".join(f"the {rng.choice(TOPICS[s])} was near the {rng.choice(TOPICS[s])} today." for _ in range(6))
        parts.append(f"## Part {k}\n\n{say(t)}\n\n{say(t)}\n")
        if stray:
            parts.append(say(stray)[:60] + "\n")
    return "\n".join(parts)


def test_subjects_on_held_out_pages(spark):
    rng = np.random.default_rng(6)
    rows, labels, want = [], [], {}
    for k in range(400):
        kind = k % 5
        names = list(rng.permutation(list(TOPICS)))
        if kind == 4:
            text, has = "Lunch is in the small room. Bring the badge. The lift is slow.", []
        elif kind == 3:
            text, has = page(rng, [names[0], names[0], names[1]]), [names[0], names[1]]
        else:
            text, has = page(rng, [names[0]] * 2, names[1] if kind == 2 else None), [names[0]]
        rows.append((k, text, ["Draft", None, " "] if k % 2 else None, "x"))
        want[k] = set(has)
        if k < 250:
            labels += [(k, str(t)) for t in has] if has else [(k, None)]
            if k % 20 == 0:
                labels.append((k, "t3"))  # wrong
    rows += [(900, None, None, "x"), (901, "", [], "x"), (None, page(rng, ["t1"]), None, "x"), (902, page(rng, ["t2"] * 200), None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, content string, tags array<string>, topic_id string")
    topics = spark.createDataFrame([*[(t, t.upper()) for t in TOPICS], ("shelf", "All")], "id string, name string")
    marked = spark.createDataFrame([*labels, (None, "t1"), (5000, "t1"), labels[0]], "doc_id bigint, topic_id string")
    got = {}
    for r in written(document_subjects(df, marked, topics, ["All"], steps=60, rate=0.1), "found").collect():
        got.setdefault(r.doc_id, set()).add(r.topic_id)
    held_out = range(250, 400)
    assert sum(got.get(k, set()) == want[k] for k in held_out) >= 0.93 * len(held_out)
    assert 900 not in got and 901 not in got and None not in got and got[902] == {"t2"}
    none = document_subjects(df.limit(0), marked, topics, ["All"], steps=1)
    assert none.collect() == []


def test_gradient_against_differences():
    rng = np.random.default_rng(8)
    block = Block([["a", "bcdefgh", "a"], ["ä"], ["bcdefgh", "x"]], [["tag:x"], [], []], np.array([[1, 0], [0, 0], [1, 1]]))
    p = Parameters.start(2, 1)
    flat = p.flat().astype(np.float64)

    def loss(f):
        out = block.outputs(Parameters.of(f, 2))[1]
        return -(block.wanted * np.log(out) + (1 - block.wanted) * np.log(1 - out)).sum()

    g = block.gradient(p)
    spots = [*(np.flatnonzero(g[:-1])[rng.integers(0, np.count_nonzero(g[:-1]), 12)]), len(flat) - 1]
    for k in spots:
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-3
        down[k] -= 1e-3
        assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(g[k], rel=2e-2, abs=2e-4)


def test_paragraphs_and_sections():
    text = "---\ntitle: x\n---\nintro\n\n# A\nline one\nline two\n\nmore\n\nB\n---\nlast\n\n```\n# code\n\nx = 1\n```\n"
    assert paragraphs(text) == [(0, "intro"), (1, "line one\nline two"), (1, "more"), (2, "last"), (2, "# code\n\nx = 1")]
    assert paragraphs(None) == paragraphs("") == []


# Containers


def test_least_squares_and_repeats():
    rng = np.random.default_rng(0)
    tops = np.arange(1, 17) * 8
    columns = patterns(tops, 128, 8)
    assert ((columns * tops[:, None]).sum(0) <= 128).all()
    truth = np.zeros(columns.shape[1])
    truth[rng.choice(columns.shape[1], 5, replace=False)] = rng.integers(5, 50, 5)
    histogram = (columns @ truth).astype(np.int64)
    x = non_negative_least_squares(columns, histogram.astype(float))
    assert (x >= 0).all() and np.abs(columns @ x - histogram).max() < 1e-6
    times = repeats(histogram, columns)
    assert (columns.astype(int) @ times <= histogram).all() and (columns.astype(int) @ times).sum() >= 0.9 * histogram.sum()


def test_leftovers_use_everything_once():
    h = np.zeros(101, np.int64)
    h[[100, 60, 40, 33, 7]] = [2, 5, 3, 10, 4]
    used = np.zeros_like(h)
    for p, k in leftover_patterns(h, 100):
        assert sum(x * n for x, n in p.items()) <= 100
        for x, n in p.items():
            used[x] += n * k
    assert (used == h).all()
    slots = Slots()
    slots.add({1: 2, 2: 1}, 3)
    slots.add({1: 1}, 2)
    assert slots.place(np.array([1] * 9 + [2] * 4), np.r_[np.arange(9), np.arange(4)]).tolist() == [0, 0, 1, 1, 2, 2, 3, 4, -1, 0, 1, 2, -1]


def test_containers(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "word " * int(rng.integers(1, 300)), "c", 1) for k in range(300)] + [(900, None, "c", 1), (901, "", "c", 1), (902, "word " * 3000, "c", 1), (903, "word " * 255 + "word", "c", 1), (3000, "word word", "c", 1), (3000, "word", "c", 1), (None, "word", "c", 1)]
    rows += [(2000 + k, "same text of nine words that repeats very often", "c", 1) for k in range(300)]
    df = spark.createDataFrame(rows, "doc bigint, body string, text string, container int")
    placed = written(filled_containers(df, "doc", "body", capacity=256, classes=32, slack=16), "placed")
    got = placed.collect()
    sums = {}
    for r in got:
        sums[r.container] = sums.get(r.container, 0) + r.tokens
    assert max(sums.values()) <= 256 and {r.doc_id for r in got} == {r[0] for r in rows if r[0] is not None}
    assert sorted(r.piece for r in got if r.doc_id == 902) == list(range(12)) and [r.tokens for r in got if r.doc_id in (900, 901)] == [0, 0]
    assert len([r for r in got if r.doc_id == 3000]) == 2 and len(got) == len(rows) - 1 + 11 + sum(r.piece > 0 and r.doc_id < 300 for r in got)
    assert all(r.first_token == 256 * r.piece for r in got)
    checked = {r.doc_id: r for r in kept_whole(placed, 256).collect()}
    assert all(r.overfull == 0 and r.whole == (k != 3000) for k, r in checked.items()) and len(checked) == len({r.doc_id for r in got})  # 3000 is given twice
    assert {r.overfull for r in kept_whole(placed, 200).collect()} - {0} and not kept_whole(placed.filter("piece <> 3"), 256).filter("doc_id = 902").first().whole
    total = fill(placed, 256).first()
    assert total.filled > 0.93 and total.containers == len([c for c, n in sums.items() if n])
    assert filled_containers(df.limit(0), "doc", "body", capacity=256).collect() == []
    assert fill(placed.filter(F.col("tokens") < 0)).first().containers == 0
