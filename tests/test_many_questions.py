"""Searches of more questions than one block holds: the same rows, and little that is sent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewell.operators import blockscan, lexical, postings, retrieve
from pagewell.operators.blockscan import Limits
from pagewell.operators.similarity import cosine_top_k


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 3), [f"w{int(t)}" for t in rng.zipf(1.4, 12) % 40]) for i in range(300)]
    rows += rows[:20]  # keys may repeat
    texts = [(d, c, " ".join(t), len(t), t) for d, c, t in rows]
    return spark.createDataFrame(texts, "doc_id long, chunk_no int, chunk_text string, n_tokens int, tokens array<string>").cache()


@pytest.fixture(scope="module")
def terms(spark, chunks):
    asked = spark.createDataFrame([(i, f"w{i % 40} w{(7 * i) % 40} w1") for i in range(60)], "query_id long, query_text string")
    counts = lexical.list_frequencies(postings.lists(chunks))
    return lexical.question_terms(asked, counts, lexical.chunk_totals(chunks)).cache()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_blocks_in_rounds_give_the_rows_of_one_block(spark, chunks, terms, monkeypatch):
    lists, limits = postings.postings(chunks), Limits(plain_pairs=0)
    want = rows(postings.search(lists, terms, 4, limits))
    asked = postings.asked_tokens(terms)
    plain = postings.block_scores(lists, asked, 4).count()
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 60)
    assert rows(postings.search(lists, terms, 4, limits)) == want
    sent = postings.block_scores(lists, asked, 4).count()
    n_blocks = -(-asked.groupBy("token").agg(F.max("n")).agg(F.sum("max(n)")).first()[0] // 60)
    assert n_blocks > 25 and sent < n_blocks * plain / 3  # not the best of every block


def test_rounds_of_questions_give_the_rows_of_one_block(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = lambda n: [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-2, 3, (n, 8)))]
    held = spark.createDataFrame(vectors(400), "vec_id long, embedding array<float>")
    asked = spark.createDataFrame(vectors(90), "query_id long, embedding array<float>")
    want = rows(cosine_top_k(held, asked, 5, 8, ["vec_id"]))
    called, of = [], blockscan.rounds
    monkeypatch.setattr(blockscan, "rounds", lambda *a: called.append(of(*a)) or called[-1])
    monkeypatch.setattr(blockscan, "grid", None)  # no chunk is copied
    assert rows(cosine_top_k(held, asked, 5, 8, ["vec_id"], Limits(block_rows=40, group_rows=10))) == want
    assert called[0][1] == 3


def test_many_hits_are_reranked_without_their_texts(spark, chunks, terms):
    hits = terms.select("query_id").crossJoin(chunks.select("doc_id", "chunk_no").distinct().filter("doc_id % 4 = 0"))
    want = lexical.bm25_rerank(retrieve.look_up(hits, chunks, 10), terms, 3)
    got = retrieve.best_texts(hits, chunks, terms, 60, 10_000_000, 3)
    columns = ["query_id", "doc_id", "chunk_no", "score", "rank", "chunk_text", "n_tokens"]
    assert rows(got.select(columns)) == rows(want.select(columns))
