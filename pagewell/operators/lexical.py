"""BM25: statistics and reranking of given candidates; `postings` has the search over all chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagewell.functions import text as tx
from pagewell.operators.blockscan import round_scores
from pagewell.operators.embedding import idf, list_rows

# The BM25 constants.
K1 = 1.2
B = 0.75


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and number of tokens in them."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).alias("n_terms"),
    )


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(token, n_chunks, max_tf, min_len) of `postings`, counted map-side first.

    In how many chunks a token occurs, how often at most in one, and in how short a chunk: no
    chunk can score more for the token than one that has it as often and is as short.
    """
    return postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("tf").alias("max_tf"), F.min("length").alias("min_len")
    )


def list_frequencies(lists: DataFrame) -> DataFrame:
    """`term_frequencies` of postings as they are stored (`postings.lists`)."""
    return lists.groupBy("token").agg(
        F.sum(F.size("tfs").cast("long")).alias("n_chunks"),
        F.max(F.array_max("tfs")).alias("max_tf"),
        F.min(F.array_min("lengths")).alias("min_len"),
    )


def question_terms(questions: DataFrame, terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(query_id, terms, idfs, avg_len, bounds, counts): each question's distinct tokens the corpus knows.

    ``bounds`` is what a token can add to a score at most, ``counts`` in how many chunks it is.
    ``terms`` may hold several counts per token; they are added up for the asked
    tokens only. Distinct tokens are looked up, each once, so a token asked by a
    third of all questions is still one row in the lookup.
    """
    asked = questions.select(
        "query_id", F.explode(F.array_distinct(tx.tokens(F.col("query_text")))).alias("token")
    )
    n = totals.select(F.col("n_chunks").cast("double")).scalar()
    avg = totals.select(F.try_divide(F.col("n_terms").cast("double"), F.col("n_chunks"))).scalar()
    known = (
        terms.join(asked.select("token").distinct(), "token")
        .groupBy("token")
        .agg(
            F.sum("n_chunks").cast("double").alias("n"),
            F.max("max_tf").alias("max_tf"),
            F.min("min_len").alias("min_len"),
        )
        .filter("n > 0")  # withdrawn chunks are counted with a minus
        .withColumn("idf", idf(n, F.col("n")))
        .withColumn("bound", F.col("idf") * saturation(F.col("max_tf"), F.col("min_len"), avg))
    )
    return (
        asked.join(known, "token")
        .groupBy("query_id")
        .agg(
            F.collect_list("token").alias("terms"),
            F.collect_list("idf").alias("idfs"),
            F.collect_list("bound").alias("bounds"),
            F.collect_list("n").alias("counts"),
        )
        .select("query_id", "terms", "idfs", avg.alias("avg_len"), "bounds", "counts")
    )


def saturation(tf, length, avg):
    """The weight of a token's count in a chunk, of arrays or of columns."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg))


def asked_counts(tokens: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row * vocabulary size + term number, count) of the vocabulary's terms, sorted."""
    values, row = list_rows(tokens)
    found = pc.index_in(values, value_set=vocabulary).fill_null(-1).to_numpy()
    known = found >= 0
    return np.unique(row[known] * len(vocabulary) + found[known], return_counts=True)


def list_lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(column.value_lengths().fill_null(0))


@F.arrow_udf(DoubleType())
def bm25_score(tokens: pa.Array, terms: pa.Array, idfs: pa.Array, avg_len: pa.Array) -> pa.Array:
    """BM25 of one question and one chunk per row; NULL if they share no token."""
    asked, row = list_rows(terms)
    weight, _ = list_rows(idfs)
    vocabulary = pc.unique(asked)
    seen, tf = asked_counts(tokens, vocabulary)
    wanted = row * len(vocabulary) + pc.index_in(asked, value_set=vocabulary).to_numpy()
    at = np.searchsorted(seen, wanted)
    hit = at < len(seen)
    hit[hit] = seen[at[hit]] == wanted[hit]
    row, length, avg = row[hit], list_lengths(tokens), np.asarray(avg_len)
    part = np.asarray(weight)[hit] * saturation(tf[at[hit]], length[row], avg[row])
    total = np.bincount(row, part, minlength=len(tokens))
    return pa.array(round_scores(total), mask=total == 0)


def bm25_rerank(pairs: DataFrame, terms_of_questions: DataFrame, top_n: int = 3) -> DataFrame:
    """Score candidates that carry their ``tokens``; statistics are those of all chunks.

    One row per candidate, scored inside the row; only the best rows of each
    question leave their task.
    """
    asked = pairs.join(terms_of_questions, "query_id")
    scored = asked.withColumn("score", bm25_score("tokens", "terms", "idfs", "avg_len"))
    return keep_best(scored.drop("tokens", *terms_of_questions.columns[1:]), top_n)


def rerank_with(pairs: DataFrame, questions: DataFrame, scorer, top_n: int = 3) -> DataFrame:
    """Reranker slot: ``scorer`` is a pandas UDF of (question text, chunk text) -> double."""
    texts = pairs.join(questions.select("query_id", "query_text"), "query_id")
    scored = texts.withColumn("score", F.round(scorer("query_text", "chunk_text"), 4))
    return keep_best(scored.drop("tokens", "query_text"), top_n)


def keep_best(scored: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` best scored rows per question; a NULL score ranks last and is no hit.

    It is left out after ranking: a filter before would make the scorer run twice.
    """
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_no")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked.filter((F.col("rank") <= top_n) & F.col("score").isNotNull())
