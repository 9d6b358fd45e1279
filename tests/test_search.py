import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewell.operators import blockscan, chunking, lexical, postings
from pagewell.operators.blockscan import Limits
from pagewell.operators.similarity import approx_top_k, cosine_top_k, with_cell

SMALL = "/root/testdata/sf0.001"

# Bounds so low that every search takes the grid.
GRID = Limits(block_rows=7, group_rows=11)


def vectors(spark, array, key="vec_id"):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(array)]
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def questions(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def brute_cosine(c, q, k):
    c, q = np.float32(c).astype(float), np.float32(q).astype(float)
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    s = np.round(s, 4)
    return {
        (i, j, r + 1): s[i, j]
        for i in range(len(q))
        for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:k])
    }


def found(df, *keys):
    return {
        (r["query_id"], *[r[k] for k in keys], r["rank"]): r["score"] for r in df.collect()
    }


@pytest.mark.parametrize("limits", [Limits(), GRID, Limits(block_values=10)])
def test_cosine_equals_brute_force(spark, limits):
    rng = np.random.default_rng(3)
    c, q = rng.normal(size=(200, 8)), rng.normal(size=(30, 8))
    got = found(cosine_top_k(vectors(spark, c), questions(vectors(spark, q)), 4, 8, ["vec_id"], limits), "vec_id")
    want = brute_cosine(c, q, 4)
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], abs=1e-9) for key in want)


@pytest.mark.parametrize("limits", [Limits(), GRID])
def test_ties_go_to_the_smaller_id_however_many_there_are(spark, limits):
    c = [[1.0, 0.0]] * 60 + [[0.0, 1.0]] * 30
    got = found(cosine_top_k(vectors(spark, c), questions(vectors(spark, [[2.0, 0.0]])), 3, 2, ["vec_id"], limits), "vec_id")
    assert got == {(0, 0, 1): 1.0, (0, 1, 2): 1.0, (0, 2, 3): 1.0}


def test_fewer_chunks_than_k_and_unusable_vectors(spark):
    c = [[1.0, 1.0], [0.0, 0.0], [1.0], [1.0, None], None, [1.0, 0.0]]
    q = [[1.0, 0.0], [0.0, 0.0], [1.0, 2.0, 3.0]]
    got = found(cosine_top_k(vectors(spark, c), questions(vectors(spark, q)), 3, 2, ["vec_id"]), "vec_id")
    assert got == {(0, 5, 1): 1.0, (0, 0, 2): 0.7071}


def test_no_questions_and_no_chunks(spark):
    c = vectors(spark, [[1.0, 0.0]])
    assert cosine_top_k(c, questions(c.limit(0)), 3, 2, ["vec_id"]).count() == 0
    assert cosine_top_k(c.limit(0), questions(c), 3, 2, ["vec_id"]).count() == 0


@pytest.mark.parametrize("limits", [Limits(), GRID])
def test_visiting_all_cells_is_exact(spark, limits):
    rng = np.random.default_rng(5)
    c = vectors(spark, rng.normal(size=(150, 8)))
    exact = found(cosine_top_k(c, questions(c), 4, 8, ["vec_id"]), "vec_id")
    assert found(approx_top_k(c, questions(c), 4, 8, 3, 8, ["vec_id"], limits), "vec_id") == exact


@pytest.mark.parametrize("hot", [False, True])
def test_grid_and_scan_agree_when_visiting_some_cells(spark, hot):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(150, 8))
    if hot:
        c[:100] = np.abs(c[:100]) * 0.01 + 1  # one cell holds most rows
    c = vectors(spark, c)
    scan = found(approx_top_k(c, questions(c), 4, 8, 3, 3, ["vec_id"]), "vec_id")
    assert found(approx_top_k(c, questions(c), 4, 8, 3, 3, ["vec_id"], GRID), "vec_id") == scan
    stored = with_cell(c, 3, 8)
    assert found(approx_top_k(stored, questions(c), 4, 8, 3, 3, ["vec_id"]), "vec_id") == scan


def test_a_grid_copies_a_question_once_for_each_chunk_group(spark):
    """Not once for each cell it visits as well, of which there may be thousands."""
    rows = with_cell(vectors(spark, np.random.default_rng(2).normal(size=(60, 8))), 4, 8)
    ask = questions(rows).withColumn("probes", F.sequence(F.lit(0), F.lit(15)))
    seen = blockscan.grid(rows, ask, Limits(block_rows=7, group_rows=30), ("cell", "probes"), ["vec_id"], 8).applyInArrow(
        lambda left, right: pa.table({"chunks": [left.num_rows], "asked": [right.num_rows]}), "chunks long, asked long"
    ).collect()
    n_qg, n_cg = 2, max(2, -(-spark.sparkContext.defaultParallelism // 2))
    assert sum(r["asked"] for r in seen) == 60 * n_cg and sum(r["chunks"] for r in seen) == 60 * n_qg


def recall(df, k, dim, bits, probes):
    pairs = lambda hits: {(r["query_id"], r["vec_id"]) for r in hits.collect()}
    exact = pairs(cosine_top_k(df, questions(df), k, dim, ["vec_id"]))
    return len(exact & pairs(approx_top_k(df, questions(df), k, dim, bits, probes, ["vec_id"]))) / len(exact)


def test_recall_on_the_given_vectors(spark):
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    assert recall(given, 10, 64, 8, 192) >= 0.9


def test_few_cells_are_enough_where_neighbours_are_near(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    near = vectors(spark, np.repeat(centres, 10, axis=0) + 0.1 * rng.normal(size=(400, 32)))
    assert recall(near, 10, 32, 8, 16) >= 0.9


def corpus(spark, n=120):
    rng = random.Random(11)
    texts = [
        " ".join(["the"] + [f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randrange(0, 25))])
        for _ in range(n)
    ]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, chunk_no int, chunk_text string")
    return texts, chunking.add_tokens(df)


def brute_bm25(texts, asked, k):
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for q, question in enumerate(asked):
        scores = {}
        for t in set(re.findall(r"\w+", question.lower())):
            df = sum(t in d for d in docs)
            if not df:
                continue
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for j, d in enumerate(docs):
                if t in d:
                    tf = d.count(t)
                    scores[j] = scores.get(j, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
        best = sorted(scores, key=lambda j: (-round(scores[j], 4), j))[:k]
        out.update({(q, j, 0, r + 1): scores[j] for r, j in enumerate(best)})
    return out


ASKED = ["the w1 w2", "W3, w3 w40?", "nothing here", "the", "w5 w6 w7 w8 w9 w10 the"] * 3


SEARCHES = [Limits(), GRID, Limits(plain_pairs=0), Limits(plain_pairs=0, block_rows=3)]


@pytest.mark.parametrize("limits", SEARCHES)
def test_bm25_equals_brute_force(spark, limits):
    texts, chunks = corpus(spark)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query_text string")
    terms = lexical.question_terms(asked, lexical.term_frequencies(postings.postings(chunks)), lexical.chunk_totals(chunks))
    got = found(postings.search_chunks(chunks, terms, 6, limits), "doc_id", "chunk_no")
    want = brute_bm25(texts, ASKED, 6)
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], abs=1e-4) for key in want)
    # Reranking all chunks must give the same as searching them.
    pairs = asked.select("query_id").join(chunks.drop("chunk_text"), F.lit(True))
    assert found(lexical.bm25_rerank(pairs, terms, 6), "doc_id", "chunk_no") == got


def test_reranker_slot(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def longest(question: pd.Series, chunk: pd.Series) -> pd.Series:
        return chunk.str.len().where(chunk.str.len() > 3).astype(float)

    asked = spark.createDataFrame([(0, "q")], "query_id long, query_text string")
    rows = [(0, i, 0, t, []) for i, t in enumerate(["ab", "abcd", "abcdef", "abcde", "x"])]
    pairs = spark.createDataFrame(
        rows, "query_id long, doc_id long, chunk_no int, chunk_text string, tokens array<string>"
    )
    got = found(lexical.rerank_with(pairs, asked, longest, 4), "doc_id")
    assert got == {(0, 2, 1): 6.0, (0, 3, 2): 5.0, (0, 1, 3): 4.0}


def random_questions(spark, n):
    rng = random.Random(2)
    asked = [" ".join(["the"] + [f"w{min(int(rng.paretovariate(0.5)), 60)}" for _ in range(9)]) for _ in range(n)]
    return asked, spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")


@pytest.mark.parametrize("block_rows", [20_000, 3])
def test_floors_leave_out_common_tokens_and_lose_nothing(spark, monkeypatch, block_rows):
    monkeypatch.setattr(postings, "PROBE_CHUNKS", 30)  # both are read on the driver
    monkeypatch.setattr(postings, "PROBE_KEPT", 6)
    texts, chunks = corpus(spark, 400)
    asked, questions_ = random_questions(spark, 25)
    listed = postings.postings(chunks)
    terms = lexical.question_terms(questions_, lexical.term_frequencies(listed), lexical.chunk_totals(chunks))
    limits = Limits(plain_pairs=0, block_rows=block_rows)
    tokens = postings.asked_tokens(terms)
    of = postings.Asked(listed, True, limits)
    left = postings.with_floors(of, tokens, 3).filter("not needed")
    assert left.filter("token = 'the'").count() > 10
    got = found(postings.search(listed, terms, 3, limits), "doc_id", "chunk_no")
    want = brute_bm25(texts, asked, 3)
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], abs=1e-4) for key in want)


def test_a_search_reads_the_slots_and_tokens_that_are_asked(spark, store):
    from pagewell.plans.answering import build_index
    from pagewell.sources import tables

    index = build_index(tables.documents(spark, SMALL), store, "c")
    asked = spark.createDataFrame([(0, "the of")], "query_id long, query_text string")
    own = postings.reading(index.postings, postings.asked_tokens(index.terms_of(asked)))
    plan = own._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*slot#\d+ (IN|INSET)", plan)
    assert re.search(r"PushedFilters: \[[^]]*In\(token, \[(of,the|the,of)\]\)", plan)
    assert len(own.inputFiles()) < len(index.postings.inputFiles())
    assert {r[0] for r in own.select("token").distinct().collect()} <= {"the", "of"}


def test_intermediate_tables_of_a_search_are_removed(spark, monkeypatch):
    import os

    from pagewell import session

    place = session.work_dir(spark, "own-folder")
    os.makedirs(place)
    monkeypatch.setattr(session, "work_dir", lambda spark, label: f"{place}/{label}-{random.random()}")
    _, chunks = corpus(spark)
    _, questions_ = random_questions(spark, 4)
    listed = postings.postings(chunks)
    terms = lexical.question_terms(questions_, lexical.term_frequencies(listed), lexical.chunk_totals(chunks))
    with session.scratch():
        assert postings.search(listed, terms, 3, Limits(plain_pairs=0)).count() == 12
        assert [name.split("-")[0] for name in os.listdir(place)] == ["hits"]
    assert os.listdir(place) == []


def test_posting_lists_hold_every_chunk_once(spark):
    rows = [(i, c, ["a"] * (i % 3) + ["b", f"t{i % 4}"] if i % 5 else None if i % 2 else [], i % 2) for i in range(40) for c in range(2)]
    rows.append((None, None, ["a", "a", "b"], 0))
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, tokens array<string>, part int").repartition(3)
    want = sorted(
        repr((t, d, c, tokens.count(t), len(tokens), part)) for d, c, tokens, part in rows for t in set(tokens or [])
    )
    packed = postings.lists(chunks, "part")
    got = postings.unpacked(packed).select("token", "doc_id", "chunk_no", "tf", "length", "part").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert packed.count() < len(want) / 3  # a token of many chunks is one row of a batch
    counted = lexical.list_frequencies(postings.lists(chunks))
    assert sorted(counted.collect()) == sorted(lexical.term_frequencies(postings.postings(chunks)).collect())


def test_blocks_of_chunks_give_the_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_POSTINGS", 50)  # read on the driver: many blocks
    texts, chunks = corpus(spark)
    chunks = chunks.unionByName(chunks.filter("doc_id % 7 = 0")).unionByName(
        chunks.filter("doc_id % 9 = 1").withColumn("doc_id", F.lit(None).cast("long"))
    )  # keys that repeat or are null
    _, asked = random_questions(spark, 30)
    asked = asked.unionByName(asked.filter("query_id < 3")).unionByName(asked.limit(1).withColumn("query_id", F.lit(None).cast("long")))
    listed = postings.postings(chunks)
    terms = lexical.question_terms(asked, lexical.term_frequencies(listed), lexical.chunk_totals(chunks))
    for k in (1, 5):
        plain = postings.search(listed, terms, k).collect()
        blocks = postings.search(listed, terms, k, Limits(plain_pairs=0)).collect()
        shape = lambda rows: sorted((str(r["query_id"]), r["rank"], str(r["doc_id"]), r["chunk_no"], r["score"]) for r in rows)
        assert shape(plain) == shape(blocks) and len(blocks) > 20
