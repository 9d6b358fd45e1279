import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewell.operators import retrieve
from pagewell.operators.blockscan import Limits
from pagewell.plans.answering import Index, IndexSettings, build_index, build_status
from pagewell.sources.collections import Collections, as_json

TEXTS = [
    "The red fox runs over the hill. It is fast.",
    "Blue whales sing in the deep sea.",
    "A fox sleeps. The hill is quiet.",
    "Quantum fields are studied by people.",
]


def docs(spark, texts=TEXTS, start=0):
    return spark.createDataFrame(
        [(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string"
    )


def rows(spark, keys, dim=3):
    data = [(k, 0, "t", 1, ["t"], [float(k)] * dim, 1.0) for k in keys]
    return spark.createDataFrame(
        data,
        "doc_id long, chunk_no int, chunk_text string, n_tokens int, tokens array<string>, "
        "embedding array<float>, norm double",
    )


def test_create_keeps_recreate_loses_drop_removes_one(store, spark):
    assert not store.exists("a")
    store.create_if_missing("a", 3)
    store.create_if_missing("b", 3)
    store.append("a", rows(spark, [1, 2]))
    store.create_if_missing("a", 3)
    assert store.open("a").count() == 2
    assert sorted(r["name"] for r in store.names().collect()) == ["a", "b"]
    store.recreate("a", 3)
    assert store.exists("a") and store.open("a").count() == 0
    store.drop("a")
    assert not store.exists("a") and store.exists("b")


def test_info_and_json(store, spark):
    store.create_if_missing("a", 3)
    store.append("a", rows(spark, [1, 2]))
    info = json.loads(as_json(store.info("a")).first()["json"])
    assert info == {"name": "a", "points": 2, "min_dim": 3, "max_dim": 3, "distance": "cosine"}
    assert store.properties("a")["dim"] == "3"


@pytest.mark.parametrize("buckets", [None, 3])
def test_append_is_repeatable(store, spark, buckets):
    store.create_if_missing("a", 3, buckets=buckets)
    new = rows(spark, [1, 2, 2, 3])
    for _ in range(2):
        store.append("a", store.new_rows("a", new))
    assert sorted(r["doc_id"] for r in store.open("a").collect()) == [1, 2, 3]


def test_append_leaves_out_vectors_of_another_dimension(store, spark):
    store.create_if_missing("a", 3)
    store.append("a", store.valid_rows("a", rows(spark, [1], dim=3).union(rows(spark, [2], dim=2))))
    assert [r["doc_id"] for r in store.open("a").collect()] == [1]


def test_a_bucketed_collection_is_not_shuffled_by_an_append(store, spark):
    store.create_if_missing("a", 3, buckets=3)
    store.append("a", rows(spark, range(50)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        new = store.new_rows("a", rows(spark, range(40, 60)))
        plan = new._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in new.collect()) == list(range(50, 60))
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Bucketed: true" in physical
    assert physical.count("Exchange") == 1  # the new rows


def test_build_then_add_documents(store, spark):
    index = build_index(docs(spark), store, "c")
    status = build_status(index).first()
    assert (status["status"], status["points"], status["documents"]) == ("success", 4, 4)
    more = docs(spark, ["A new fox appears."], start=10)
    for _ in range(2):
        index.add_documents(more.union(docs(spark)))
    assert index.chunks.count() == 5
    assert store.totals("c").first()["n_chunks"] == 5
    fox = store.companion("c", "terms").filter("token = 'fox'").agg(F.sum("n_chunks")).first()[0]
    assert fox == 3


def test_statistics_are_repaired_after_a_cut_off_append(store, spark):
    index = build_index(docs(spark), store, "c")
    before = store.companion("c", "terms").groupBy("token").agg(F.sum("n_chunks")).collect()
    store.append("c", index.rows_for(docs(spark, ["lost statistics fox"], start=50)))
    index.add_documents(docs(spark))
    assert store.totals("c").first()["n_chunks"] == 5
    after = store.companion("c", "terms").groupBy("token").agg(F.sum("n_chunks")).collect()
    assert len(after) == len(before) + 2


def test_opened_again_from_the_catalog(store, spark):
    settings = IndexSettings(chunk_size=20, overlap=5, sentences=True, dim=64)
    build_index(docs(spark), store, "c", settings)
    again = Index(Collections(spark, store.database), "c")
    assert again.settings == settings and again.dim == 64
    asked = spark.createDataFrame([(0, "Who sings in the sea?")], "query_id long, query_text string")
    assert retrieve.retrieve(asked, again, top_n=1).first()["doc_id"] == 1


@pytest.mark.parametrize("cell_bits,buckets", [(0, 0), (2, 0), (0, 3)])
def test_attached_from_the_folder_of_an_earlier_session(spark, store, cell_bits, buckets):
    settings = IndexSettings(cell_bits=cell_bits, buckets=buckets)
    index = build_index(docs(spark), store, "c", settings)
    folder = spark.catalog.getDatabase(store.database).locationUri
    later = Collections(spark, f"{store.database}_later")
    later.attach("c", folder, settings.dim, buckets or None, bool(cell_bits))
    again = Index(later, "c", settings)
    key = ["doc_id", "chunk_no", "chunk_text"]
    assert again.chunks.select(*key).exceptAll(index.chunks.select(*key)).count() == 0
    assert again.chunks.count() == 4 and (again.weights == index.weights).all()
    later.drop("c")
    assert index.chunks.count() == 4


def test_encoder_slot_and_cells(store, spark):
    def load_counter():
        return lambda texts: np.array([[t.count(c) + 0.5 for c in "aefhoswx"] for t in texts])

    settings = IndexSettings(dim=8, load_encoder=load_counter, cell_bits=2)
    index = build_index(docs(spark), store, "c", settings)
    assert "cell" in index.chunks.columns
    assert store.totals("c").first()["n_chunks"] == 4
    asked = spark.createDataFrame([(0, TEXTS[1])], "query_id long, query_text string")
    options = dict(search="approx", bits=2, probes=4)
    exact = retrieve.candidates(asked, index, 2).collect()
    assert retrieve.candidates(asked, index, 2, **options).collect() == exact
    assert exact[0]["doc_id"] == 1


def test_union_with_the_default_reranker_is_the_search_it_is_replaced_by(store, spark):
    index = build_index(docs(spark), store, "c")
    asked = spark.createDataFrame(
        [(0, "Where does the fox run?"), (1, "whales in the sea"), (2, "zzz")],
        "query_id long, query_text string",
    )
    from pagewell.operators import lexical

    found = retrieve.candidates(asked, index, 4, "union")
    pairs = retrieve.look_up(found, index.chunks, 100)
    slow = lexical.bm25_rerank(pairs, index.terms_of(asked), 3)
    fast = retrieve.retrieve(asked, index, 4, 3, "union")
    key = lambda r: (r["query_id"], r["rank"], r["doc_id"], round(r["score"], 3))
    assert sorted(map(key, slow.collect())) == sorted(map(key, fast.collect()))
    # Beyond the bound the collection is joined by key.
    wide = retrieve.look_up(found, index.chunks, 10**9)
    assert wide.count() == pairs.count()
    small = Limits(block_rows=1, group_rows=2)
    grid = retrieve.retrieve(asked, index, 4, 3, "union", limits=small)
    assert sorted(map(key, grid.collect())) == sorted(map(key, fast.collect()))
