"""Changed and withdrawn documents: the collection is what a fresh build of the last state gives."""

import random

import pytest
from pyspark.sql import functions as F

from pagewell.operators import postings
from pagewell.plans import answering
from pagewell.plans.answering import Index, IndexSettings, build_index
from pagewell.session import settings, work_dir
from pagewell.sources.collections import Collections
from pagewell.streaming.ingest import change_stream, ingest_changes

SETTINGS = IndexSettings(parts=4, chunk_size=6, overlap=2)


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice("fox whale frog hill sea sings runs deep".split()) for _ in range(rng.randrange(1, 20))) for _ in range(n)]


def docs(spark, state):
    return spark.createDataFrame(sorted(state.items()), "doc_id long, text string")


def changes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, sequence long, withdrawn boolean")


def contents(index):
    """Chunks, postings and statistics."""
    chunks = index.chunks.select("doc_id", "chunk_no", "chunk_text").collect()
    listed = index.postings.select("token", "doc_id", "chunk_no", "tf", "length").collect()
    terms = index.store.companion(index.name, "terms").groupBy("token").agg(F.sum("n_chunks").alias("n"))
    totals = index.store.totals(index.name).first()
    return sorted(map(tuple, chunks)), sorted(map(tuple, listed)), sorted(map(tuple, terms.filter("n <> 0").collect())), tuple(totals)


def test_upserts_equal_a_fresh_build(spark, store):
    state = dict(enumerate(texts(1, 20)))
    index = build_index(docs(spark, state), store, "c", SETTINGS)
    first = [(3, "a new frog", 1, False), (3, "an older frog", 0, False), (50, "quite new", 1, None), (4, None, 1, True),
             (5, "", 1, False), (77, None, 1, True), (None, "no id", 1, False), (9, "no sequence", None, False)]
    index.upsert(changes(spark, first))
    state |= {3: "a new frog", 50: "quite new"}
    del state[4], state[5]
    want = contents(build_index(docs(spark, state), store, "d", SETTINGS))
    assert contents(index) == want
    assert index.store.companion(index.name, "rejected").count() == 2
    index.upsert(changes(spark, first[:6]))  # a replay
    index.upsert(changes(spark, [(3, "late", 0, False), (4, "late", 1, False)]))  # older changes
    assert contents(index) == want
    index.upsert(changes(spark, [(4, "back again", 2, False), (3, None, 2, True)]))
    state[4] = "back again"
    del state[3]
    assert contents(index) == contents(build_index(docs(spark, state), store, "d", SETTINGS))


def test_all_documents_of_a_part_can_go(spark, store):
    index = build_index(docs(spark, {1: "fox", 2: "whale", 3: "frog"}), store, "c", SETTINGS)
    index.upsert(changes(spark, [(i, None, 1, True) for i in (1, 2, 3)]))
    assert contents(index) == ([], [], [], (0, 0))


def test_only_the_parts_of_changed_documents_are_written(spark, store):
    index = build_index(docs(spark, dict(enumerate(texts(2, 40)))), store, "c", SETTINGS)
    part = spark.range(1).select(index.part_of(F.lit(7).cast("long"))).first()[0]
    files = lambda rows: {f for f in rows.inputFiles() if f"part={part}/" not in f}
    before = files(index.chunks) | files(index.postings)
    index.upsert(changes(spark, [(7, "changed", 1, False)]))
    assert files(index.chunks) | files(index.postings) == before and before


def test_a_cut_off_upsert_is_made_good(spark, store, monkeypatch):
    state = dict(enumerate(texts(3, 12)))
    index = build_index(docs(spark, state), store, "c", SETTINGS)
    change = changes(spark, [(2, "whale whale sea", 1, False), (5, None, 1, True)])

    def cut(*args):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(Index, "count_statistics", cut)
        with pytest.raises(RuntimeError):
            index.upsert(change)
    Index(Collections(spark, store.database), "c").upsert(change)
    state[2] = "whale whale sea"
    del state[5]
    assert contents(index) == contents(build_index(docs(spark, state), store, "d", SETTINGS))


def test_streamed_changes_in_any_order(spark, store):
    state = dict(enumerate(texts(4, 10)))
    index = build_index(docs(spark, state), store, "c", SETTINGS)
    feed = work_dir(spark, "feed")
    batches = [[(1, None, 3, True), (2, "second", 2, False)], [(1, "first", 2, False), (2, "first", 1, False)], [(11, "new", 1, False)]]
    for rows in batches:
        changes(spark, rows).coalesce(1).write.mode("append").parquet(feed)
    for _ in range(2):
        ingest_changes(change_stream(spark, feed, files_per_batch=1), index, work_dir(spark, "log")).awaitTermination()
    state |= {2: "second", 11: "new"}
    del state[1]
    assert contents(index) == contents(build_index(docs(spark, state), store, "d", SETTINGS))
    found = postings.search(index.postings, index.terms_of(spark.createDataFrame([(0, "second")], "query_id long, query_text string")), 3)
    assert [r["doc_id"] for r in found.collect()] == [2]


def test_changes_need_parts(spark, store):
    index = build_index(docs(spark, {1: "fox"}), store, "c")
    with pytest.raises(ValueError, match="parts"):
        index.upsert(changes(spark, [(1, "x", 1, False)]))
    with pytest.raises(ValueError):
        store.begin("x", 3, buckets=2, parted=True)


def test_the_collection_is_not_shuffled_to_find_changed_documents(spark, store, monkeypatch):
    """However large the changes are: their ids travel, and only rows that stay are stored on the way."""
    state = dict(enumerate(texts(5, 30)))
    index = build_index(docs(spark, state), store, "c", SETTINGS)
    plans, rows, write = {}, {}, answering.stored

    def seen(df, label, *args, **kwargs):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        out = write(df, label, *args, **kwargs)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(answering, "stored", seen)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        index.upsert(changes(spark, [(i, "changed whale", 1, False) for i in range(20)]))
    kept = index.chunks.filter("doc_id >= 20").count()
    for label in ("removed", "kept"):
        assert "BroadcastHashJoin" in plans[label] and "Exchange hashpartitioning" not in plans[label]
    assert rows["kept"] == kept and "rewritten" not in rows and "embedding" not in plans["removed"]
    state |= {i: "changed whale" for i in range(20)}
    assert contents(index) == contents(build_index(docs(spark, state), store, "d", SETTINGS))
