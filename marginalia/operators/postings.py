"""TF-IDF as tables: term statistics, and weighted postings with unit length for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, padded_words, substrings
from ..shared import few, staged


def term_counts(docs: DataFrame, key: str, terms: Column, placed: bool = False) -> DataFrame:
    """key, term, tf.  Counted in the task that explodes them before anything is shuffled; with placed the
    texts are put in place by their key first, once, and then no count moves: that is less where a text has
    many more terms than letters, as with n-grams."""
    rows = docs.repartition(key) if placed else docs
    return rows.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def gram_counts(docs: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """term_counts of the character n-grams inside words.  The words of a text are counted first, and each
    distinct one is cut once."""
    words = term_counts(docs.select(key, text), key, padded_words(F.col(text)), placed=True)
    grams = words.select(key, "tf", F.explode(F.concat(*(substrings(F.col("term"), n) for n in range(low, high + 1)))).alias("gram"))
    return grams.groupBy(key, F.col("gram").alias("term")).agg(F.sum("tf").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """term, df, cf (occurrences)."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """term, df and idf = ln((1 + n) / (1 + df)) + 1 of the terms in at least min_df documents; of these
    the max_features most frequent ones, ties by the term."""
    df = document_frequency(counts).where(F.col("df") >= min_df)
    if max_features is not None:
        df = df.orderBy(F.desc("cf"), "term").limit(max_features)
    return df.select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _raw(counts: DataFrame, terms: DataFrame, sublinear: bool) -> DataFrame:
    """counts with idf and w, tf (or 1 + ln tf) times idf; terms outside the vocabulary are left out.  A
    vocabulary of few terms is broadcast, a larger one is joined by the term."""
    tf = F.log(F.col("tf")) + 1.0 if sublinear else F.col("tf").cast("double")
    small = terms.select("term", "idf")
    return counts.join(F.broadcast(small) if few(small) else small, "term").withColumn("w", tf * F.col("idf"))


def norms(counts: DataFrame, terms: DataFrame, key: str, sublinear: bool = False) -> DataFrame:
    """key and norm, the length of each document: partial sums, no sort."""
    return _raw(counts, terms, sublinear).groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def weighted(counts: DataFrame, terms: DataFrame, key: str, sublinear: bool = False) -> DataFrame:
    """key, term, weight: tf (or 1 + ln tf) times idf, divided by the document's length.  counts and terms are
    read twice each, so they should be written tables."""
    raw = _raw(counts, terms, sublinear).select(key, "term", "w")
    return raw.join(norms(counts, terms, key, sublinear), key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def scores(queries: DataFrame, postings: DataFrame, query_key: str, key: str, digits: int = 6) -> DataFrame:
    """query_key, key, score of all pairs that share a term.  An equi-join on the term; scores are rounded
    so that the order of a sum doesn't decide a rank."""
    q = queries.select(query_key, "term", F.col("weight").alias("_q"))
    pairs = q.join(postings, "term").groupBy(query_key, key).agg(F.sum(F.col("_q") * F.col("weight")).alias("score"))
    return pairs.withColumn("score", F.round("score", digits))


def matched(asked: DataFrame, counts: DataFrame, terms: DataFrame, query_key: str, key: str, sublinear: bool = False, digits: int = 6) -> DataFrame:
    """query_key, key, score of all pairs that share a term, from term counts of the questions and of the
    documents.

    Only counts of terms that a question has are weighted and joined, with the question's weights: these are
    broadcast if they are few, so a term that all documents have isn't a key of a shuffle.  Sums are divided
    by the length of a document at the end."""
    asked = staged(asked, "asked")
    q = staged(weighted(asked, terms, query_key, sublinear).join(terms.select("term", "idf"), "term"), "question-terms")
    tf = F.log(F.col("tf")) + 1.0 if sublinear else F.col("tf").cast("double")
    q = q.select(query_key, "term", (F.col("weight") * F.col("idf")).alias("_q"))
    met = counts.join(F.broadcast(q) if few(q) else q, "term")
    sums = met.groupBy(query_key, key).agg(F.sum(F.col("_q") * tf).alias("_sum"))
    return sums.join(norms(counts, terms, key, sublinear), key).select(query_key, key, F.round(F.col("_sum") / F.col("norm"), digits).alias("score"))


def query_blocks(queries: DataFrame, query_key: str, most: int) -> list[DataFrame]:
    """A stated set of queries in blocks of about `most` rows, each small enough to be broadcast."""
    blocks = max(1, -(-queries.count() // most))
    if blocks == 1:
        return [queries]
    place = F.pmod(F.xxhash64(query_key), F.lit(blocks))
    return [queries.where(place == b) for b in range(blocks)]


def vector_scores(queries: DataFrame, vectors: DataFrame, query_key: str, key: str, digits: int = 6, most_queries: int = 4096) -> DataFrame:
    """Cosines of every query with every vector, from columns `vector` of unit length.

    A stated set of queries against all rows: the queries are broadcast in blocks of bounded size, one
    pass over the vectors for each block."""
    found = None
    for block in query_blocks(queries, query_key, most_queries):
        q = block.select(query_key, F.col("vector").alias("_q"))
        v = vectors.select(key, "vector")
        one = F.broadcast(q).join(v, F.size("_q") == F.size("vector")).select(query_key, key, F.round(dot(F.col("_q"), F.col("vector")), digits).alias("score"))
        found = one if found is None else found.unionByName(one)
    return found
