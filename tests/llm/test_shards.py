"""Sharding delivers the records themselves, and does so again by the next version of the map."""

from pagewell.llm import sharding


def rows(spark, long=300_000):
    texts = ["a", "", None, "b" * 40, "é" * 9, "x " * long] + ["copy"] * 60
    data = [(i if i != 3 else None, t, i, "clash") for i, t in enumerate(texts)] + [(7, "copy", 7, "clash")] * 5
    return spark.createDataFrame(data, "doc_id long, text string, shard int, slot string")


def records(df):
    return sorted(map(repr, (tuple(r["doc"]) for r in df.collect())))


def test_records_are_stored_by_shard(spark):
    docs = rows(spark)
    stored, slot_map = sharding.sharded(docs, 5, slots=64)
    want = sorted(map(repr, map(tuple, docs.collect())))
    assert records(stored) == want  # whole, with all columns, whatever their names
    assert any("shard=" in f for f in stored.inputFiles())
    after, new_map = sharding.resharded(stored, slot_map, 6)
    assert records(after) == want
    assert {r["version"] for r in new_map.collect()} == {2}
    for df, m in ((stored, slot_map), (after, new_map)):
        shard = {r["vslot"]: r["shard"] for r in m.collect()}
        places = {}
        for r in df.collect():
            assert r["shard"] == shard[r["vslot"]]
            places.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_empty_table(spark):
    stored, slot_map = sharding.sharded(rows(spark).limit(0), 5)
    assert stored.count() == 0 and sharding.resharded(stored, slot_map, 6)[0].count() == 0
