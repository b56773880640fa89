"""Search over chapters: postings and BM25, vectors by cosine, their fusion, the funnel, and the merged answer list.

All searches take a table of questions and answer them together; rankings are (score descending, key ascending).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import terms
from terrace.functions.vectors import hash_counts
from terrace.plans.lineage import written

HITS = "question_id string, key string, score double"


def ranked(hits: DataFrame, k: int | Column, *, by: str = "question_id", score: str = "score", key: str = "key") -> DataFrame:
    """The first ``k`` hits of each question with their ``rank``; equal scores in the order of the keys."""
    order = Window.partitionBy(by).orderBy(F.desc(score), key)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# Lexical ------------------------------------------------------------------------------------------------------


def postings(rows: DataFrame, key_col: str, *texts: str) -> DataFrame:
    """``key, term, tf, length``: how often each term stands in the texts of a row, and how many terms these have."""
    words = terms(F.concat_ws(" ", *texts))
    each = rows.select(F.col(key_col).cast("string").alias("key"), words.alias("t")).withColumn("length", F.size("t"))
    return each.select("key", "length", F.explode("t").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def question_terms(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``question_id, term``: the distinct terms of each question."""
    return questions.select(F.col(id_col).cast("string").alias("question_id"), F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))


def index_rows(rows: DataFrame, key_col: str, texts: list[str], vector_text: str | None = None) -> DataFrame:
    """``rows`` with ``key``, ``t``, all terms of their texts in order, and with ``v``, the hashed counts of ``vector_text``: what searches read. Write it once."""
    added = rows.withColumn("key", F.col(key_col).cast("string")).withColumn("t", terms(F.concat_ws(" ", *texts)))
    return added.withColumn("v", hash_counts(F.col(vector_text))) if vector_text else added


class Best:
    """The best ``k`` keys of each question among the scores seen so far; equal scores in the order of the keys."""

    def __init__(self, asked: list[str], k: int) -> None:
        self.asked, self.k = asked, k
        self.score, self.key = np.full((len(asked), k), -np.inf), np.full((len(asked), k), "", "U1")

    def add(self, keys: list[str], score: np.ndarray) -> None:
        """``score``: a row for each question, a column for each key; what is no hit has minus infinity."""
        names = np.array(keys, str)
        alike = np.argsort(names, kind="stable")  # ties go to the smaller key
        names, score = names[alike], score[:, alike]
        top = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        s = np.concatenate([self.score, np.take_along_axis(score, top, 1)], axis=1)
        n = np.concatenate([self.key, names[top]], axis=1)
        order = np.lexsort((n, -s), axis=1)[:, : self.k]
        self.score, self.key = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)

    def hits(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array([self.asked[r] for r in row], pa.string()), pa.array(self.key[row, col].tolist(), pa.string()), pa.array(self.score[row, col])], ["question_id", "key", "score"])


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _in_blocks(asked: DataFrame, id_col: str, blocks: int, search) -> DataFrame:
    """The hits of all questions, block by block: each block's are written before the next one is sent to the tasks.

    ``search``: from a block of ``asked`` as an Arrow table to what the tasks need and the hits' plan.
    """
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block) if blocks > 1 else asked
        sent, hits = search(part.toArrow())
        hits = written(hits, "hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def lexical_search(rows: DataFrame, key_col: str, texts: list[str], asked: DataFrame, *, k: int = 20, scoring: str = "bm25", k1: float = 1.2, b: float = 0.75, index: DataFrame | None = None, block_terms: int = 20_000, block: int = 256) -> DataFrame:
    """``question_id, key, score``, the best ``k`` rows for each question of ``asked (question_id, term)``, each term once.

    ``scoring``: ``bm25`` or ``tfidf`` (root of the term frequency, squared inverse document frequency, by the root of
    the length). ``index``: the rows as ``index_rows`` made them, if they are kept; otherwise they are made and written
    once, so that texts are cut into terms a single time. Rows without any term count as rows but can't be hit.

    Counts of rows that hold a term are taken over all rows. The questions reach the tasks in blocks of about ``block``
    with about ``block_terms`` terms; a row is scored where it lies, for all questions of a block in one matrix
    product, and each task hands on its best ``k`` for each question. Nothing but these hits is exchanged.
    """
    spark = rows.sparkSession
    posted = index if index is not None else written(index_rows(rows.select(key_col, *texts), key_col, texts).select("key", "t"), "terms")
    asked = written(asked.select("question_id", "term"), "asked")
    every = posted.agg(F.count("*").alias("rows"), F.sum(F.size("t")).alias("terms")).first()
    usual = (every.terms or 0) / max(1, every.rows)
    held = posted.select(F.explode(F.array_distinct("t")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    held = written(held.groupBy("term").agg(F.count("*").alias("df")), "held")
    known = asked.join(held, "term")
    size = known.agg(F.count("*").alias("terms"), F.countDistinct("question_id").alias("questions")).first()
    source = posted.select("key", "t")

    def search(part: pa.Table):
        ids, terms_ = part["question_id"].unique().to_pylist(), part["term"].unique().to_pylist()
        question, term = ({x: n for n, x in enumerate(xs)} for xs in (ids, terms_))
        weight = np.zeros((len(terms_), len(ids)))
        for q, t, df in zip(*(part[c].to_pylist() for c in ("question_id", "term", "df"))):
            weight[term[t], question[q]] = np.log(1 + (every.rows - df + 0.5) / (df + 0.5)) * (k1 + 1) if scoring == "bm25" else (1 + np.log(every.rows / (df + 1))) ** 2
        sent = spark.sparkContext.broadcast((ids, terms_, weight))
        return sent, source.mapInArrow(_scored(sent, k, scoring, k1, b, usual), HITS)

    blocks = max(1, -(-size.questions // block), -(-size.terms // block_terms))
    return ranked(_in_blocks(known, "question_id", blocks, search), k).drop("rank")


def _scored(sent, k: int, scoring: str, k1: float, b: float, usual: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, weight = sent.value
        if not ids:
            return
        best, wanted, step = Best(ids, k), pa.array(asked, pa.string()), max(16, min(1024, 4_000_000 // len(asked)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                keys, t = batch.column(0).slice(at, step).to_pylist(), batch.column(1).slice(at, step)
                length = t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                listed = t.flatten().dictionary_encode()
                if not len(listed):
                    continue
                place = pc.index_in(listed.dictionary, wanted).fill_null(-1).to_numpy(zero_copy_only=False)[listed.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(len(keys)), length)
                tf = np.bincount(row[place >= 0] * len(asked) + place[place >= 0], minlength=len(keys) * len(asked)).reshape(len(keys), -1).astype(np.float64)
                if scoring == "bm25":
                    tf /= np.maximum(tf + k1 * (1 - b + b * length / usual)[:, None], 1e-300)
                else:
                    tf = np.sqrt(tf) / np.sqrt(np.maximum(length, 1))[:, None]
                score = _rounded((tf @ weight).T)
                some = np.flatnonzero((score > 0).any(0))
                if len(some):
                    best.add([keys[n] for n in some], np.where(score[:, some] > 0, score[:, some], -np.inf))
        yield best.hits()

    return search


# Vectors ------------------------------------------------------------------------------------------------------


def vector_search(rows: DataFrame, key_col: str, vec_col: str, questions: DataFrame, id_col: str, question_vec: str, *, k: int = 20, dim: int, clamp: bool = False, skip_self: bool = False, block_mb: float = 64) -> DataFrame:
    """``question_id, key, score``: the ``k`` rows of highest cosine for each question, exactly.

    Vectors of another length than ``dim``, with nulls, or not finite are no candidates, and as questions find
    nothing; a vector of zeros has cosine 0 with all. ``clamp`` puts 0 for negative cosines; ``skip_self`` leaves out
    the row whose key is the question's. The questions are a stated set; they reach the tasks in blocks of at most
    ``block_mb``, one block after the other, each task keeps its best for each question, and these are ranked together.
    """
    spark = rows.sparkSession
    asked = questions.select(F.col(id_col).cast("string").alias("q"), F.col(question_vec).alias("v")).filter(F.size("v") == dim)
    source = rows.select(F.col(key_col).cast("string").alias("key"), F.col(vec_col).alias("v")).filter(F.size("v") == dim)
    blocks = max(1, -(-asked.count() * dim * 8 // int(block_mb * 2**20 + 1)))

    def search(part: pa.Table):
        sent = spark.sparkContext.broadcast(units(part["q"].to_pylist(), part["v"], dim))
        return sent, source.mapInArrow(_best(sent, k, dim, clamp, skip_self), HITS)

    return ranked(_in_blocks(asked, "q", blocks, search), k).drop("rank")


def units(keys: list, vectors, dim: int) -> tuple[list, np.ndarray]:
    """Keys and vectors of length one of those rows whose values are all finite; zeros stay zeros."""
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1)
    x = x[good]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return [key for key, g in zip(keys, good) if g], x / np.where(norm > 0, norm, 1)


def _best(sent, k: int, dim: int, clamp: bool, skip_self: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, q = sent.value
        best, place = Best(asked, k), {key: n for n, key in enumerate(asked)}
        step = max(64, min(2048, 2_000_000 // max(1, len(asked))))  # bounds the table of scores
        for b in batches:
            keys, x = units(b.column(0).to_pylist(), b.column(1), dim)
            for at in range(0, len(keys), step):
                some = keys[at : at + step]
                score = _rounded(q @ x[at : at + step].T)
                if clamp:
                    score = np.maximum(score, 0)
                if skip_self:
                    for n, key in enumerate(some):
                        if key in place:
                            score[place[key], n] = -np.inf
                best.add(some, score)
        yield best.hits()

    return search


# Fusion -------------------------------------------------------------------------------------------------------


def max_normalized(hits: DataFrame) -> DataFrame:
    """Scores as shares of each question's best; 0 where that is 0."""
    best = F.max("score").over(Window.partitionBy("question_id"))
    return hits.withColumn("score", F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))


def fused(lexical: DataFrame, vector: DataFrame, k: int | None = None, weight: float = 0.5) -> DataFrame:
    """``question_id, key, score, source``: both branches put together; a row that one of them lacks has 0 there.

    ``source`` says where a row came from: ``bm25``, ``vector``, or ``hybrid`` for both.
    """
    both = max_normalized(lexical).select("question_id", "key", (F.col("score") * weight).alias("l"), F.lit(None).cast("double").alias("v")).unionByName(vector.select("question_id", "key", F.lit(None).cast("double").alias("l"), (F.col("score") * (1 - weight)).alias("v")))
    source = F.when(F.max("l").isNotNull() & F.max("v").isNotNull(), "hybrid").when(F.max("l").isNotNull(), "bm25").otherwise("vector")
    sum_ = F.coalesce(F.max("l"), F.lit(0.0)) + F.coalesce(F.max("v"), F.lit(0.0))
    sums = both.groupBy("question_id", "key").agg((F.floor(sum_ * 1e6 + 0.5) / 1e6).alias("score"), source.alias("source"))
    return sums if k is None else ranked(sums, k).drop("rank")


# Funnel and merge ---------------------------------------------------------------------------------------------


def overlap_scores(asked: DataFrame, candidates: DataFrame, key_col: str, text: Column) -> DataFrame:
    """``question_id, key, score``: which share of a candidate's distinct terms the question holds. It stands in for a model that judges relevance."""
    each = candidates.select(F.col(key_col).cast("string").alias("key"), F.array_distinct(terms(text)).alias("t")).withColumn("n", F.size("t"))
    hit = each.select("key", "n", F.explode("t").alias("term")).join(asked, "term").groupBy("question_id", "key", "n").agg(F.count("*").alias("shared"))
    return hit.select("question_id", "key", F.round(F.col("shared") / F.col("n"), 6).alias("score"))


def held_scores(asked: DataFrame, candidates: DataFrame, key_col: str, text: Column, *, least: float = 0.5, block: int = 4096) -> DataFrame:
    """``question_id, key, score`` of at least ``least``: which share of a question's distinct terms a candidate holds, for texts longer than a question.

    ``asked``: ``question_id, term``, each once. The questions reach the tasks in blocks of about ``block``; a
    candidate's terms are counted in its own row, so that nothing is exchanged. Rows without a shared term never count.
    """
    spark = candidates.sparkSession
    rows = candidates.select(F.col(key_col).cast("string").alias("key"), F.array_distinct(terms(text)).alias("t"))
    asked = asked.select("question_id", "term")

    def search(part: pa.Table):
        by_term, ids = {}, {}
        for question, term in zip(*(c.to_pylist() for c in part.columns)):
            by_term.setdefault(term, []).append(ids.setdefault(question, len(ids)))
        by_term = {term: np.array(at) for term, at in by_term.items()}
        size = np.bincount(np.concatenate([*by_term.values(), np.zeros(0, np.int64)]).astype(np.int64), minlength=len(ids))
        sent = spark.sparkContext.broadcast((list(ids), by_term, size))
        return sent, rows.mapInArrow(_held(sent, least), HITS)

    return _in_blocks(asked, "question_id", max(1, -(-asked.select("question_id").distinct().count() // block)), search)


def _held(sent, least: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_term, size = sent.value
        for b in batches:
            out = [[], [], []]
            for key, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at := [by_term[w] for w in words if w in by_term]:
                    share = _rounded(np.bincount(np.concatenate(at), minlength=len(ids)) / size)
                    good = np.flatnonzero((share >= least) & (share > 0))
                    out[0] += [ids[q] for q in good]
                    out[1] += [key] * len(good)
                    out[2] += share[good].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.float64()))], ["question_id", "key", "score"])

    return score


def relevant(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Scores of at least ``least``."""
    return scores.filter(F.col("score") >= least)


def routed_tags(asked: DataFrame, tags: DataFrame, topics: DataFrame, *, least: float = 0.5, most_topics: int = 3, threshold: int = 200) -> DataFrame:
    """``question_id, key, score``: the tags that each question is about.

    With fewer than ``threshold`` of ``tags (name, topic_id)`` all are judged; else a question's ``most_topics`` most
    relevant topics are taken first (``id, name``), and only the tags that point to one of them are judged.
    """
    judged = relevant(overlap_scores(asked, tags.select("name").distinct(), "name", F.col("name")), least)
    if tags.select("name").distinct().count() < threshold:
        return judged
    chosen = ranked(relevant(overlap_scores(asked, topics, "id", F.col("name")), least), most_topics).select("question_id", F.col("key").alias("topic_id"))
    open_to = chosen.join(tags.select("topic_id", F.col("name").alias("key")).distinct(), "topic_id").select("question_id", "key").distinct()
    return judged.join(open_to, ["question_id", "key"], "left_semi")


def hot_funnel(tag_scores: DataFrame, documents: DataFrame, document_scores: DataFrame, chapters: DataFrame, chapter_scores: DataFrame, *, least: float = 0.5, k: int | None = 50) -> DataFrame:
    """``question_id, document_id, path, title, content, score, status, query_count`` of the chapters that a question reaches through relevant tags and documents.

    ``tag_scores``, ``document_scores`` and ``chapter_scores`` are ``question_id, key, score`` with a tag's name, a
    document's id and a chapter's id as key. Only hot and warming documents take part, and chapters with a summary or
    content, the first of which that isn't blank is the hit's content; of repeated paths the best score counts, of equal
    ones the smaller chapter id.
    """
    live = documents.filter(F.col("status").isin("hot", "warming"))
    tagged = live.select(F.col("id").alias("document_id"), F.explode(F.array_distinct("tags")).alias("tag"))
    reached = relevant(tag_scores, least).select("question_id", F.col("key").alias("tag")).join(tagged, "tag").select("question_id", "document_id").distinct()
    wanted = reached.join(relevant(document_scores, least).select("question_id", F.col("key").alias("document_id")), ["question_id", "document_id"], "left_semi")
    body = F.coalesce(F.when(F.trim("summary") != "", F.col("summary")), F.col("content"), F.lit(""))
    told = chapters.filter(F.trim(body) != "").select(F.col("id").alias("key"), "document_id", "path", F.coalesce("title", F.lit("")).alias("title"), F.trim(body).alias("content"))
    hits = relevant(chapter_scores, least).join(told, "key").join(wanted, ["question_id", "document_id"], "left_semi")
    first = F.struct((-F.col("score")).alias("away"), "key")
    best = hits.groupBy("question_id", "document_id", "path").agg(F.max("score").alias("score"), F.min_by(F.struct("title", "content"), first).alias("told"))
    best = best.join(live.select(F.col("id").alias("document_id"), "status", "query_count"), "document_id", "left")
    out = best.select("question_id", "document_id", "path", "told.title", "told.content", "score", "status", "query_count", F.concat_ws("/", "document_id", "path").alias("key"))
    return (out if k is None else ranked(out, k).drop("rank")).drop("key")


def best_per_key(hits: DataFrame) -> DataFrame:
    """The best hit for each question, document and path; of equal ones the hot."""
    order = F.struct("score", (F.col("source") == "hot_progressive").alias("hot"))
    return hits.groupBy("question_id", "document_id", "path").agg(F.max_by(F.struct("score", "source"), order).alias("h")).select("question_id", "document_id", "path", "h.score", "h.source")


def merged_hits(hot: DataFrame, cold: DataFrame, k: int = 15) -> DataFrame:
    """Up to ``k`` hits for each question: the best half of each branch, one for each document and path."""
    half = max(1, k // 2)
    key = F.concat_ws("/", "document_id", "path")
    parts = [ranked(x.withColumn("key", key), half).select("question_id", "document_id", "path", "score", F.lit(name).alias("source")) for x, name in ((hot, "hot_progressive"), (cold, "cold_index"))]
    return ranked(best_per_key(parts[0].unionByName(parts[1])).withColumn("key", key), k).drop("rank", "key")


def accesses(hits: DataFrame) -> DataFrame:
    """``document_id, queries``: in how many questions' hits each document stands."""
    return hits.select("question_id", "document_id").distinct().groupBy("document_id").agg(F.count("*").alias("queries"))
