"""A collection is replaced whole or not at all, and learned cells live with it."""

import pytest
from pyspark.sql import functions as F

from pagewell.operators import retrieve
from pagewell.plans.answering import Index, IndexSettings, build_index
from pagewell.sources.collections import Collections

OLD = ["The red fox runs over the hill.", "Blue whales sing in the deep sea.", "A fox sleeps."]
NEW = ["Green frogs jump.", "The sea is deep and blue whales live there."]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark):
    return spark.createDataFrame([(0, "Who sings in the sea?")], "query_id long, query_text string")


def best(spark, index):
    return retrieve.retrieve(asked(spark), index, 5, 1, "union").first()["chunk_text"]


def tables(store):
    return {r["tableName"] for r in store.spark.sql(f"SHOW TABLES IN {store.database}").collect()}


def test_a_failed_build_leaves_the_old_index_answering(spark, store):
    index = build_index(docs(spark, OLD), store, "c")
    before = tables(store)

    def load_broken():
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    with pytest.raises(Exception, match="no model"):
        build_index(docs(spark, NEW), store, "c", IndexSettings(load_encoder=load_broken))
    assert tables(store) == before  # nothing half-built is left
    assert best(spark, Index(store, "c")) == best(spark, index) == OLD[1]


def test_a_build_is_not_seen_before_it_is_complete(spark, store, monkeypatch):
    build_index(docs(spark, OLD), store, "c")
    seen = []
    switch = Collections.switch

    def late(self, name, staged):
        seen.append((Index(self, "c").chunks.count(), self.open(staged).count()))
        switch(self, name, staged)

    monkeypatch.setattr(Collections, "switch", late)
    build_index(docs(spark, NEW), store, "c")
    assert seen == [(3, 2)] and Index(store, "c").chunks.count() == 2


def test_an_open_index_outlives_one_rebuild(spark, store):
    first = build_index(docs(spark, OLD), store, "c")
    second = build_index(docs(spark, NEW), store, "c")
    assert best(spark, first) == OLD[1] and best(spark, second) == NEW[1]
    assert [r["name"] for r in store.names().collect()] == ["c"]
    build_index(docs(spark, OLD + NEW), store, "c")
    assert Index(store, "c").chunks.count() == 5 and second.chunks.count() == 2
    assert len(store._versions("c")) == 2  # the first is gone
    store.drop("c")
    assert tables(store) == set()


def test_the_last_version_is_attached(spark, store):
    build_index(docs(spark, OLD), store, "c")
    build_index(docs(spark, NEW), store, "c")
    folder = spark.catalog.getDatabase(store.database).locationUri
    later = Collections(spark, f"{store.database}_later")
    later.attach("c", folder, 384)
    assert best(spark, Index(later, "c")) == NEW[1]


def test_learned_cells_of_a_collection(spark, store):
    texts = [f"{w} number {i} {w}" for w in ("fox", "whale", "frog", "hill") for i in range(12)]
    index = build_index(docs(spark, texts), store, "c", IndexSettings(learned_cells=4))
    index.add_documents(spark.createDataFrame([(99, "a new whale whale")], "doc_id long, text string"))
    again = Index(store, "c")
    assert again.settings.learned_cells == 4 and again.cells.sizes.sum() == 49
    counted = {r["cell"]: r["n"] for r in again.chunks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert counted == {i: n for i, n in enumerate(again.cells.sizes) if n}
    key = ["query_id", "doc_id"]
    exact = retrieve.candidates(asked(spark), again, 5).select(*key).collect()
    assert retrieve.candidates(asked(spark), again, 5, search="learned", share=1.0).select(*key).collect() == exact
    part = retrieve.candidates(asked(spark), again, 5, search="learned", share=0.3).count()
    assert 0 < part <= 5
    with pytest.raises(TypeError):
        retrieve.candidates(asked(spark), again, 5, search="learned", bits=3)
