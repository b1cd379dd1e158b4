"""Complete rankings of documents by their best part, without a row for each pair of a question and a part.

A document is kept as one row with all its parts.  A task scores the parts for a block of questions at once, as products of
matrices, and writes one row for each document: its best part for every question and that part's score, as whole numbers (scores times a
million).  Ranks are counted from these rows (`topk.exact_places`), so no ranking is sorted and no pair is shuffled.  The work stays
questions times parts; what is written is questions times documents, eight bytes each (the score and the part), for one block of questions at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import removed, staged
from . import topk

#: Questions that are scored at once, and parts that a product of matrices has.
MOST_QUESTIONS = 256
SLICE = 256
SCALE = 10**topk.DIGITS


class Asked:
    """The terms of a block of questions.  Those that many questions have are columns of a matrix; of others the questions are listed."""

    #: From how many questions on a term is a column, and how many columns there are at most.
    MANY, COLUMNS = 8, 8192

    def __init__(self, keys: list, table: pa.Table):
        names = table.column("term").combine_chunks().dictionary_encode()
        term = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place = {key: i for i, key in enumerate(keys)}
        order = np.argsort(term, kind="stable")
        self.n, self.terms = len(keys), names.dictionary.cast(pa.string())
        self.question = np.array([place[k] for k in table.column(0).to_pylist()], np.int64)[order]
        self.q, term = table.column("_q").to_numpy()[order], term[order]
        self.first = np.searchsorted(term, np.arange(len(self.terms) + 1))
        sizes = np.diff(self.first)
        often = np.argsort(-sizes, kind="stable")[: self.COLUMNS]
        often = often[sizes[often] >= self.MANY]
        self.column = np.full(len(self.terms), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n))
        there = self.column[term] >= 0
        self.matrix[self.column[term[there]], self.question[there]] = self.q[there]

    def scores(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The scores of n parts for every question, from (part, term, weight)."""
        column = self.column[term]
        on = column >= 0
        dense = np.zeros((n, len(self.matrix)))
        dense[row[on], column[on]] = weight[on]
        row, term, weight = row[~on], term[~on], weight[~on]
        sizes = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        rest = np.bincount(np.repeat(row, sizes) * self.n + self.question[at], weights=np.repeat(weight, sizes) * self.q[at], minlength=n * self.n)
        return dense @ self.matrix + rest.reshape(n, self.n)


class Greatest:
    """The greatest score of each document's parts for every question, and the first part that has it."""

    def __init__(self, docs: int, questions: int):
        self.scores = np.full((docs, questions), np.iinfo(np.int32).min, np.int32)
        self.parts = np.zeros((docs, questions), np.int32)

    def add(self, doc: np.ndarray, part: np.ndarray, scores: np.ndarray) -> None:
        """Scores of parts, in the order of documents and parts."""
        found = np.rint(scores * SCALE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        # the greatest of (score, -part) in one number
        best = np.maximum.reduceat((found << 32) - part[:, None], starts, axis=0)
        own, part = doc[starts], (-best) & 0xFFFFFFFF
        score = (best + part) >> 32
        more = score > self.scores[own]
        self.scores[own] = np.where(more, score, self.scores[own])
        self.parts[own] = np.where(more, part, self.parts[own])

    def rows(self, keys: pa.Array) -> pa.RecordBatch:
        self.scores[self.scores == np.iinfo(np.int32).min] = 0  # documents without a part
        lists = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (self.scores.astype("<i4"), self.parts.astype(">i4"))]
        return pa.RecordBatch.from_arrays([keys, *lists], ["_key", "scores", "parts"])


def _sliced(doc: np.ndarray, part: np.ndarray):
    for at in range(0, len(doc), SLICE):
        yield slice(at, at + SLICE), doc[at : at + SLICE], part[at : at + SLICE]


def _few_words(lists: pa.Array, most: int = 50_000) -> Iterator[slice]:
    """Lists in stretches of at most 1,024 that have about `most` elements, or one list where that has more."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        end = min(at + 1024, max(at + 1, int(np.searchsorted(total, before + most, side="right"))))
        yield slice(at, end)
        at = end


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of the elements of lists: in which list they are, and at which place."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Scored:
    """A complete ranking for a block of questions, as topk.fused_top takes it: asked has the questions' keys, counted the documents."""

    asked: DataFrame
    counted: DataFrame
    keys: list
    rows: DataFrame

    @cached_property
    def prepared(self) -> tuple[DataFrame, Callable]:
        place, n = {key: i for i, key in enumerate(self.keys)}, len(self.keys)

        def blocks(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, topk.BLOCK):
                    own = batch.slice(at, topk.BLOCK)
                    scores = np.frombuffer(b"".join(own.column(1).to_pylist()), "<i4").reshape(own.num_rows, n).T.copy()
                    yield own.column(0).to_numpy(), lambda key, scores=scores: scores[place[key]] / SCALE

        return self.rows.select("_key", "scores"), blocks

    def first_again(self, k: int) -> DataFrame:
        rows, blocks = self.prepared
        query_key, kind = self.asked.dtypes[0]
        keys, type_of = self.keys, self.asked.limit(0).toArrow().schema.field(0).type

        def find(batches):
            best = topk.Best(len(keys), k)
            for own, scores in blocks(batches):
                for i, name in enumerate(keys):
                    best.add(i, own, scores(name))
            yield topk._found(best, keys, type_of, query_key)

        found = rows.mapInArrow(find, f"`{query_key}` {kind}, _key long, score double")
        return topk.search.top(found.withColumnRenamed("_key", self.counted.columns[0]), query_key, self.counted.columns[0], k)

    def best_parts(self, pairs: DataFrame) -> DataFrame:
        """pairs of a question and a document with `part`, the place of the document's best part (the first of equal ones)."""
        query_key, key = self.asked.columns[0], self.counted.columns[0]
        places = self.asked.sparkSession.createDataFrame(list(zip(self.keys, range(len(self.keys)))), f"`{query_key}` {self.asked.dtypes[0][1]}, _place int")
        wanted = F.broadcast(pairs.join(F.broadcast(places), query_key))  # a few of each question
        rows = self.rows.select(F.col("_key").alias(key), "parts")
        return rows.join(wanted, key).withColumn("part", F.conv(F.hex(F.substring("parts", 4 * F.col("_place") + 1, F.lit(4))), 16, 10).cast("int")).drop("parts", "_place")


def scored_texts(asked: DataFrame, terms_asked: DataFrame, words: DataFrame, terms: DataFrame, sublinear: bool = False, grams: tuple[int, int] | None = None) -> Scored:
    """By the cosines of terms.  asked has the keys of a block of questions, terms_asked is of topk.question_terms, words has a document's
    key (a whole number) and the words of its parts, terms is of topk.vocabulary over the parts; all are written tables."""
    query_key, key = asked.columns[0], words.columns[0]
    keys = asked.toArrow().column(0).to_pylist()
    questions = words.sparkSession.sparkContext.broadcast(Asked(keys, terms_asked.join(asked, query_key, "left_semi").select(query_key, "term", "_q").toArrow()))
    own = words.select(F.col(key).alias("_doc"), F.posexplode("words").alias("_part", "words"))
    sent, rare = topk._sent(own.select(F.struct("_doc", "_part").alias("_key"), "words"), terms, sublinear, grams)
    docs = words.select(F.col(key).alias("_key"), "words")
    if rare is None:
        docs = docs.withColumn("rest", F.lit(None).cast("array<struct<part:int,rest:double>>"))
    else:
        rest = rare.groupBy("_key").agg(F.sum(F.col("w") * F.col("w")).alias("rest"))
        docs = docs.join(rest.groupBy(F.col("_key._doc").alias("_key")).agg(F.collect_list(F.struct(F.col("_key._part").alias("part"), "rest")).alias("rest")), "_key", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = questions.value
        weigher = sent.value.weigher(asked, asked.terms, grams)
        for batch in topk._cut(batches, 1024):
            greatest = Greatest(batch.num_rows, asked.n)
            doc, part = _places(batch.column(1))
            lists = pc.list_flatten(batch.column(1))
            more, at = pc.list_flatten(batch.column(2)), _places(batch.column(2))[0]
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            rest = np.zeros(len(doc))
            if len(more):
                rest[first[at] + more.field("part").to_numpy()] = more.field("rest").to_numpy()
            for here in _few_words(lists):  # a document may have many more parts
                row, term, tf, idf = weigher.of(lists[here])
                weight = np.log(tf) + 1.0 if sublinear else tf.astype(np.float64)
                norm = np.sqrt(np.bincount(row, weights=(weight * idf) ** 2, minlength=len(doc[here])) + rest[here])
                kept = term >= 0
                row, term, weight = row[kept], term[kept], weight[kept]
                weight = weight / norm[row]
                for s, d, p in _sliced(doc[here], part[here]):
                    a, b = np.searchsorted(row, (s.start, s.start + len(d)))
                    greatest.add(d, p, asked.scores(len(d), row[a:b] - s.start, term[a:b], weight[a:b]))
            yield greatest.rows(batch.column(0))

    return Scored(asked, words.select(key), keys, staged(docs.mapInArrow(score, "_key long, scores binary, parts binary"), "scored"))


def scored_vectors(asked: DataFrame, vectors: DataFrame) -> Scored:
    """By the products of vectors of unit length.  asked has the keys and vectors of a block of questions, vectors a document's key and the vectors
    of its parts in their order; one that is missing or of another length has the score 0."""
    key, column = vectors.columns
    table = asked.toArrow()
    keys, own = table.column(0).to_pylist(), [np.array([] if v is None else v, np.float64) for v in table.column(1).to_pylist()]
    by_length = {n: ([i for i, v in enumerate(own) if len(v) == n], np.stack([v for v in own if len(v) == n], 1)) for n in {len(v) for v in own} if n}
    questions, n_questions = vectors.sparkSession.sparkContext.broadcast(by_length), len(keys)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in topk._cut(batches, 16 * SLICE):
            greatest = Greatest(batch.num_rows, n_questions)
            doc, part = _places(batch.column(1))
            lists = pc.list_flatten(batch.column(1))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for s, d, p in _sliced(doc, part):
                scores = np.zeros((len(d), n_questions))
                for n, (places, matrix) in questions.value.items():
                    on = np.flatnonzero(sizes[s] == n)
                    if len(on):
                        flat = pc.list_flatten(lists[s].take(pa.array(on))).to_numpy(zero_copy_only=False)
                        scores[np.ix_(on, places)] = np.nan_to_num(flat.reshape(len(on), n) @ matrix)
                greatest.add(d, p, scores)
            yield greatest.rows(batch.column(0))

    docs = vectors.select(F.col(key).alias("_key"), F.col(column).cast("array<array<double>>").alias("vectors"))
    return Scored(asked.select(asked.columns[0]), vectors.select(key), keys, staged(docs.mapInArrow(score, "_key long, scores binary, parts binary"), "scored"))


def fused_top(word: Scored, vector: Scored | None, char: Scored | None, n_parts: int, k: int) -> DataFrame:
    """The k best documents of each question by fusion of complete rankings, as topk.fused_top has them, and `part`, the best part of a document
    by vectors (by words where there are none).  The k first by words have at least 1 / (damping + k), so this depth is enough."""
    depth = int(2.5 * (topk.search.DAMPING + k)) + 1
    best = topk._fused_top(word, vector, char, n_parts, k, depth, complete=True)
    found = staged((vector or word).best_parts(best), "best")
    removed(*(x.rows for x in (word, vector, char) if x is not None))
    return found
