import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewell.functions import vectors as vx
from pagewell.operators import chunking, embedding, lexical, postings

TEXTS = ["red fox red", "the fox", "the the dog", "", "Fox! dog?"]


def chunks(spark, texts=TEXTS):
    df = spark.createDataFrame(
        [(i, 0, t) for i, t in enumerate(texts)], "doc_id long, chunk_no int, chunk_text string"
    )
    return chunking.add_tokens(df)


def brute_vectors(texts, dim):
    tokens = [re.findall(r"\w+", t.lower()) for t in texts]
    h = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:7], 16)
    df, n = {}, len(texts)
    for ts in tokens:
        for t in set(ts):
            df[h(t) % embedding.SLOTS] = df.get(h(t) % embedding.SLOTS, 0) + 1
    weight = {s: round(math.log(1 + (n - d + 0.5) / (d + 0.5)) * 10000) for s, d in df.items()}
    out = np.zeros((n, dim))
    for i, ts in enumerate(tokens):
        for t in ts:
            out[i, h(t) % dim] += weight[h(t) % embedding.SLOTS]
    return (out / 10000).astype(np.float32)


def hashed(spark, dim=32):
    c = chunks(spark)
    weights = embedding.collect_weights(
        embedding.slot_weights(lexical.term_frequencies(postings.postings(c)), lexical.chunk_totals(c))
    )
    return embedding.hashed_embedding(c, weights, dim)


def test_hashed_vectors_equal_brute_force(spark):
    rows = hashed(spark).orderBy("doc_id").collect()
    want = brute_vectors(TEXTS, 32)
    np.testing.assert_array_equal(np.array([r["embedding"] for r in rows], np.float32), want)
    np.testing.assert_allclose([r["norm"] for r in rows], np.linalg.norm(want, axis=1), rtol=1e-6)


def test_the_same_hash_in_both_places(spark):
    words = ["a", "été", "2024"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r[0] for r in df.select(embedding.token_hash(F.col("t"))).collect()]
    assert got == [embedding.hash_of(w) for w in words]


def test_encoder_runs_in_batches_and_loads_once_per_task(spark):
    def load():
        seen = {"loads": 1, "calls": 0}

        def encode(texts):
            seen["calls"] += 1
            assert len(texts) <= 2
            return np.array([[len(t), seen["loads"], seen["calls"]] for t in texts])

        return encode

    df = chunks(spark, [*TEXTS, None]).coalesce(1)
    rows = embedding.embed_with(df, load, batch_rows=2).orderBy("doc_id").collect()
    assert [r["embedding"] and r["embedding"][0] for r in rows] == [11, 7, 11, 0, 9, None]
    assert max(r["embedding"][2] for r in rows[:5]) > 1


def vectors(spark, values):
    rows = list(enumerate(values))
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_bad_vectors_are_quarantined(spark):
    values = [[1.0, 2.0, 3.0], [1.0, 2.0], [1.0, None, 3.0], None, [1.0, float("nan"), 0.0], [0.0, 0.0, 0.0]]
    valid, bad = embedding.split_valid(vectors(spark, values), 3)
    assert sorted(r["vec_id"] for r in valid.collect()) == [0, 5]
    assert sorted(r["vec_id"] for r in bad.collect()) == [1, 2, 3, 4]


def test_strict_mode_fails_the_job(spark):
    ok, _ = embedding.split_valid(vectors(spark, [[1.0, 2.0, 3.0]]), 3, strict=True)
    assert ok.count() == 1
    broken, _ = embedding.split_valid(vectors(spark, [[1.0, 2.0]]), 3, strict=True)
    with pytest.raises(Exception, match="does not have 3 elements"):
        broken.collect()


def test_unit_vectors(spark):
    df = embedding.with_norm(vectors(spark, [[3.0, 4.0], [0.0, 0.0]]))
    rows = df.select("norm", vx.unit(F.col("embedding"), F.col("norm")).alias("u")).collect()
    assert rows[0]["norm"] == 5.0 and rows[0]["u"] == [0.6, 0.8]
    assert rows[1]["norm"] == 0.0 and rows[1]["u"] is None


def test_the_model_runs_once_although_its_result_is_filtered(spark):
    plan = embedding.split_valid(hashed(spark), 32)[0]._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython") == 1
