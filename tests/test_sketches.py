"""Bloom filters of keys: no known key is missed, few new ones are looked up, and the rest is not read."""

from pyspark.sql import functions as F

from pagewell.operators import sketches
from pagewell.plans.answering import IndexSettings, build_index
from pagewell.session import scratch

KEYS = ["doc_id", "chunk_no"]


def keyed(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(7)).cast("int").alias("chunk_no"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_no_key_is_missed_and_few_are_mistaken(spark):
    one, two = sketches.sketch(keyed(spark, 0, 3000), KEYS), sketches.sketch(keyed(spark, 3000, 5000), KEYS)
    both = one.union(two)
    assert sketches.maybe_known(keyed(spark, 0, 5000), both, KEYS).count() == 5000
    assert sketches.maybe_known(keyed(spark, 10_000, 20_000), both, KEYS).count() < 10
    assert sketches.maybe_known(keyed(spark, 0, 50), both.limit(0), KEYS).count() == 0


def test_an_append_of_new_documents_reads_nothing_of_the_collection(spark, store, monkeypatch):
    index = build_index(docs(spark, [(i, f"fox {i}") for i in range(30)]), store, "c")
    read = []
    open_ = type(store).open
    monkeypatch.setattr(type(store), "open", lambda self, name: read.append(name) or open_(self, name))
    with scratch():
        new = index.settings.chunk(docs(spark, [(100, "new"), (101, "new"), (100, "new")]))
        assert store.unseen_rows(index.name, new).count() == 2
        assert not read
        some = index.settings.chunk(docs(spark, [(3, "fox 3"), (102, "new")]))
        assert [r["doc_id"] for r in store.unseen_rows(index.name, some).collect()] == [102]
        assert read


def test_only_the_parts_of_possible_duplicates_are_read(spark, store):
    index = build_index(docs(spark, [(i, f"fox {i}") for i in range(40)]), store, "c", IndexSettings(parts=4))
    with scratch():
        some = index.settings.chunk(docs(spark, [(3, "fox 3"), (200, "new")]))
        assert [r["doc_id"] for r in store.unseen_rows(index.name, some).collect()] == [200]
    for _ in range(2):
        index.add_documents(docs(spark, [(i, f"fox {i}") for i in range(35, 50)]))
    assert sorted(r["doc_id"] for r in index.chunks.collect()) == list(range(50))
    assert store.totals(index.name).first()["n_chunks"] == 50


def test_rows_appended_by_the_store_are_sketched(spark, store):
    index = build_index(docs(spark, [(1, "fox")]), store, "c")
    store.append("c", index.rows_for(docs(spark, [(2, "whale")])))
    index.add_documents(docs(spark, [(2, "whale"), (3, "frog")]))
    assert sorted(r["doc_id"] for r in index.chunks.collect()) == [1, 2, 3]
