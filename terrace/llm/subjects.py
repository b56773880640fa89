"""Subject areas of documents.

A text is the average of its words' vectors, a word the average of the vectors of its own bucket and of its
subwords' buckets, and every subject has a logistic output of its own. Training keeps the labelled texts in blocks;
each step sends the parameters to the blocks, sums the gradients of all partitions and takes one Adam step. A first
phase learns from whole labelled documents, a second from their paragraphs, each under those labels of its document
that the first phase finds in it, so that wrong and missing labels lose their weight. Every document is then scored
paragraph by paragraph, each output against its own threshold, and has the subjects that fill a section.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.words import words
from terrace.plans.lineage import written

BUCKETS, WIDTH, GRAM = 1 << 15, 16, 5
TAG_WEIGHT = 0.05
SMOOTH = 6  # words that say nothing, which a text is taken to hold besides its own, so that few words say little
_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_ATX = re.compile(r"^\s{0,3}#{1,6}(\s|$)")
_SETEXT = re.compile(r"^\s{0,3}(=+|-+)\s*$")
_HAN = re.compile("[一-鿿]")


def paragraphs(content: str | None) -> list[tuple[int, str]]:
    """The paragraphs of a Markdown text with the number of their section; a heading opens a section and isn't a paragraph.

    Front matter is left out. Without headings all is section 0, and so is what stands before the first one.
    """
    lines = (content or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if lines and lines[0].strip() == "---":
        end = next((k for k in range(1, len(lines)) if lines[k].strip() == "---"), None)
        if end is not None and all(":" in x or not x.strip() for x in lines[1:end]):
            lines = lines[end + 1 :]
    out: list[tuple[int, str]] = []
    section, held, fenced = 0, [], False

    def close() -> None:
        if held:
            out.append((section, "\n".join(held)))
            held.clear()

    for line in lines:
        if fenced and not line.lstrip().startswith(("`", "~")) or line[:1].isalpha():  # neither fence nor marker
            held.append(line)
            continue
        if _FENCE.match(line):
            fenced = not fenced
            if not fenced:
                close()
            continue
        if not fenced and _ATX.match(line):
            close()
            section += 1
        elif not fenced and _SETEXT.match(line) and len(held) == 1:
            held.clear()
            section += 1
        elif not line.strip() and not fenced:
            close()
        else:
            held.append(line)
    close()
    return out


def buckets_of(word: str) -> list[int]:
    """The bucket of a word, then those of its runs of letters; a Chinese text passes pairs of characters as words too."""
    marked = f"<{word}>"
    grams = [marked[k : k + GRAM] for k in range(len(marked) - GRAM + 1)] if len(marked) > GRAM else []
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in [word, *grams]]


def tokens(text: str | None) -> list[str]:
    """Words, and for Chinese the pairs of neighbouring characters."""
    found = words(text)
    if not found or text.isascii():
        return found
    return found + [a + b for a, b in zip(found, found[1:]) if "一" <= a <= "鿿" and "一" <= b <= "鿿"]  # characters stand alone


def tag_tokens(tags) -> list[str]:
    return sorted({"tag:" + t.strip().lower() for t in tags or [] if t and t.strip()})


class Parameters:
    """Bucket vectors, output weights and offsets."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> None:
        self.vectors, self.weights, self.offsets = vectors, weights, offsets

    @classmethod
    def start(cls, subjects: int, seed: int) -> Parameters:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, subjects)).astype(np.float32), np.full(subjects, -2, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.vectors.ravel(), self.weights.ravel(), self.offsets])

    @classmethod
    def of(cls, flat: np.ndarray, subjects: int) -> Parameters:
        a, b = BUCKETS * WIDTH, WIDTH * subjects
        return cls(flat[:a].reshape(BUCKETS, WIDTH), flat[a : a + b].reshape(WIDTH, subjects), flat[a + b :])


class Block:
    """Some labelled texts as sparse matrices: texts by words, and words by buckets."""

    def __init__(self, texts: list[list[str]], tags: list[list[str]], wanted: np.ndarray) -> None:
        number: dict[str, int] = {}
        row, word, weight = [], [], []
        for k, (text, held) in enumerate(zip(texts, tags)):
            for part, share in ((text, 1 - TAG_WEIGHT if held else 1.0), (held, TAG_WEIGHT)):
                for w, n in Counter(part).items():
                    row.append(k), word.append(number.setdefault(w, len(number))), weight.append(share * n / len(part) * len(text) / (len(text) + SMOOTH))
        self.row, self.word, self.weight = np.array(row, np.int32), np.array(word, np.int32), np.array(weight, np.float32)
        spread = [buckets_of(w) for w in number]
        self.sizes = np.array([len(s) for s in spread], np.int32)
        self.buckets = np.array([b for s in spread for b in s], np.int32)
        self.wanted = wanted.astype(np.float32)

    def outputs(self, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
        begins = np.cumsum(self.sizes) - self.sizes
        word_vectors = np.add.reduceat(p.vectors[self.buckets], begins, axis=0) / self.sizes[:, None]
        text_vectors = np.zeros((len(self.wanted), WIDTH), np.float32)
        for d in range(WIDTH):
            text_vectors[:, d] = np.bincount(self.row, word_vectors[self.word, d] * self.weight, len(self.wanted))
        return text_vectors, 1 / (1 + np.exp(-(text_vectors @ p.weights + p.offsets).clip(-30, 30)))

    def gradient(self, p: Parameters) -> np.ndarray:
        text_vectors, share = self.outputs(p)
        miss = share - self.wanted
        to_text = miss @ p.weights.T
        vectors = np.zeros((BUCKETS, WIDTH), np.float32)
        for d in range(WIDTH):
            to_word = np.bincount(self.word, to_text[self.row, d] * self.weight, len(self.sizes)) / self.sizes
            vectors[:, d] = np.bincount(self.buckets, np.repeat(to_word, self.sizes), BUCKETS)
        return np.concatenate([vectors.ravel(), (text_vectors.T @ miss).ravel(), miss.sum(0), [len(miss)]]).astype(np.float32)


def _fit(blocks: DataFrame, start: np.ndarray, subjects: int, steps: int, rate: float) -> np.ndarray:
    """Adam steps from ``start`` on the gradients summed over all partitions; their size doesn't depend on the data's."""
    sc = blocks.sparkSession.sparkContext
    flat, first, second = start.astype(np.float32), 0, 0
    for step in range(1, steps + 1):
        sent = sc.broadcast(flat)

        def part(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total, p = None, Parameters.of(sent.value, subjects)
            for b in batches:
                for x in b.column(0):
                    g = pickle.loads(x.as_py()).gradient(p)
                    total = g if total is None else total + g
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gradient"])

        sums = [np.frombuffer(r[0], np.float32) for r in blocks.mapInArrow(part, "gradient binary").collect()]
        sent.destroy()
        if not sums:
            return flat
        total = np.sum(sums, axis=0)
        g = total[:-1] / max(1.0, total[-1])
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        flat = (flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)).astype(np.float32)
    return flat


def _blocks(labelled: DataFrame, subjects: int, model: np.ndarray | None, block_texts: int = 1024) -> DataFrame:
    """Training blocks of whole documents or, given a model, of those paragraphs whose subject it finds among their document's labels."""
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, tags, wanted = [], [], []

        def block() -> pa.RecordBatch:
            made = Block(texts, tags, np.array(wanted))
            if sent.value is not None:
                share = made.outputs(Parameters.of(sent.value, subjects))[1]
                labels, sure = made.wanted, share >= 0.3
                made.wanted = (sure & (labels > 0)).astype(np.float32)
                keep = np.where(labels.any(1), made.wanted.any(1), ~sure.any(1))
                kept = np.flatnonzero(keep)
                place = np.full(len(keep), -1)
                place[kept] = np.arange(len(kept))
                inside = keep[made.row]
                made.row, made.word, made.weight, made.wanted = place[made.row[inside]].astype(np.int32), made.word[inside], made.weight[inside], made.wanted[kept]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.binary())], ["block"])

        for b in batches:
            for content, held, want in zip(*(b.column(k).to_pylist() for k in range(3))):
                row = np.zeros(subjects)
                row[want] = 1
                parts = [t for _, t in paragraphs(content)]
                for text in [content] if sent.value is None else parts:
                    found = tokens(text)
                    if len(found) >= 6 or sent.value is None and found:
                        texts.append(found), tags.append(tag_tokens(held)), wanted.append(row)
                    if len(texts) >= block_texts:
                        yield block()
                        texts, tags, wanted = [], [], []
        if texts:
            yield block()

    return written(labelled.select("content", "tags", "wanted").mapInArrow(pack, "block binary"), "blocks")


class SubjectModel:
    """Fitted to at most about ``most_labelled`` labelled documents, chosen by a hash of their id."""

    def __init__(self, documents: DataFrame, labels: DataFrame, topics: list[str], *, most_labelled: int = 4000, steps: int = 30, rate: float = 0.06, seed: int = 11) -> None:
        self.topics, self.spark = sorted(topics), documents.sparkSession
        n = len(self.topics)
        place = F.array_position(F.array(*[F.lit(t) for t in self.topics]), F.col("topic_id")) - 1 if n else F.lit(-1)
        by_doc = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set(place.cast("int"))).alias("places"))
        by_doc = by_doc.select("doc_id", F.filter("places", lambda x: x >= 0).alias("wanted"))
        total = by_doc.count()
        if total > most_labelled:
            by_doc = by_doc.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_labelled / total))
        chosen = written(documents.select("doc_id", "content", "tags").join(by_doc, "doc_id").repartition(8), "labelled")
        start = Parameters.start(n, seed).flat()
        whole = _fit(_blocks(chosen, n, None), start, n, steps, rate)
        self.flat = _fit(_blocks(chosen, n, whole), whole, n, steps // 2, rate / 2)

    def subjects(self, documents: DataFrame, *, least: float = 0.5, share: float = 0.65) -> DataFrame:
        """``doc_id, topic_id, words`` for each subject that fills ``share`` of a section with subject, or half of the document's."""
        sent = self.spark.sparkContext.broadcast((self.flat, self.topics))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, topics = sent.value
            p = Parameters.of(flat, len(topics))
            known: dict[str, int] = {}
            bound = np.log(least / (1 - least))
            table = np.empty((1 << 12, len(topics)), np.float32)

            def outputs(found: list[str]) -> np.ndarray:
                """The words' parts of the outputs; as all is linear, a text's output is the mean of its words'."""
                nonlocal table
                for w in set(found):
                    if w not in known:
                        if len(known) == len(table):
                            table = np.concatenate([table, np.empty_like(table)])
                        table[len(known)] = p.vectors[buckets_of(w)].mean(0) @ p.weights
                        known[w] = len(known)
                return table[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].mean(0)

            for b in batches:
                docs, names, counts = [], [], []
                if len(known) > 400_000:
                    known.clear()
                for doc, content, held in zip(*(b.column(k).to_pylist() for k in range(3))):
                    tags = tag_tokens(held)
                    hint = outputs(tags) * TAG_WEIGHT if tags else None
                    sections: dict[int, dict[int, float]] = {}  # words of the paragraphs of each subject, and of any
                    all_of: dict[int, float] = {}
                    parts = paragraphs(content)
                    headed = any(section for section, _ in parts)
                    for section, text in parts:
                        found = tokens(text)
                        if not found or headed and not section:  # what stands before the first heading is no section
                            continue
                        out = outputs(found)
                        out = (out if hint is None else out * (1 - TAG_WEIGHT) + hint) * (len(found) / (len(found) + SMOOTH)) + p.offsets
                        has = np.flatnonzero(out >= bound)
                        if len(has):
                            size = len(found) * (0.4 if _HAN.search(text) else 1.0)
                            of, all_of[section] = sections.setdefault(section, {}), all_of.get(section, 0) + size
                            for s in has.tolist():
                                of[s] = of.get(s, 0) + size
                    whole: dict[int, float] = {}
                    for of in sections.values():
                        for s, n in of.items():
                            whole[s] = whole.get(s, 0) + n
                    fills = {s for section, of in sections.items() for s, n in of.items() if n >= share * all_of[section]}
                    fills |= {s for s, n in whole.items() if n > 0.5 * sum(all_of.values())}
                    for s in sorted(fills):
                        docs.append(doc), names.append(topics[s]), counts.append(whole[s])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(names, pa.string()), pa.array(counts, pa.float64())], ["doc_id", "topic_id", "words"])

        source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "content", "tags").filter("doc_id IS NOT NULL")
        return source.mapInArrow(score, "doc_id bigint, topic_id string, words double")


def document_subjects(documents: DataFrame, labels: DataFrame, topics: DataFrame, shelves: list[str], *, stuffed: DataFrame | None = None, **options) -> DataFrame:
    """``doc_id, topic_id`` for every subject of every document.

    ``documents``: ``doc_id, content, tags``; ``labels``: ``doc_id, topic_id``, null for no subject; ``topics``:
    ``id, name``, of which ``shelves`` are no subjects. Documents in ``stuffed (doc_id)`` have none. Null and empty
    contents have none; null ids are left out; a repeated id gets rows for each of its contents. Without labels or
    topics there are no rows.
    """
    names = topics.filter(~F.col("name").isin(shelves)).select("id").distinct().collect()  # a catalogue, not documents
    model = SubjectModel(documents, labels, [r[0] for r in names], **options)
    found = model.subjects(documents).select("doc_id", "topic_id").distinct()
    return found.join(stuffed, "doc_id", "left_anti") if stuffed is not None else found
