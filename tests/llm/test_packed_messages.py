"""What blocks send and get: the same values in fewer bytes."""

import zlib

import numpy as np

from pagewell.llm import blocks


def test_arrays_come_back_as_they_were():
    arrays = [[0, 255], [0, 256], [70_000], [2**32], [2**63 - 1, 0], [-1, 5], []]
    for values in [np.array(a, np.int64) for a in arrays]:
        assert blocks.joined([[blocks.packed(values)]], 0, np.int64).tolist() == values.tolist()
    for n in range(18):
        truths = np.arange(n) % 3 == 0
        assert blocks.joined([[blocks.packed(truths)], [blocks.packed(truths)]], 0, "?").tolist() == truths.tolist() * 2
    parts = np.array([0.1, -np.inf, 3.0])
    assert blocks.unpacked(blocks.packed(parts)).tolist() == parts.tolist()
    assert blocks.joined([], 0, float).tolist() == []


def test_keys_come_back_as_they_were():
    for keys in ([], [0], [2**64 - 1], [0, 1, 2**63, 2**64 - 1]):
        got = blocks.unpacked_keys(blocks.packed_keys(np.array(keys, np.uint64)))
        assert got.tolist() == keys and got.dtype == np.uint64


def test_few_bytes_are_sent(frame):
    """A count takes a byte, a truth a bit, and the steps between keys compress."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 50_000, dtype=np.uint64))
    counts, truths = rng.integers(0, 200, len(keys)), rng.random(len(keys)) < 0.5
    docs = blocks.blocked(frame([(1, "a")]), "doc_id")
    sent = blocks.asked(docs, lambda row: (keys, [counts, truths]), 1).first()
    assert len(sent["values"][0]) < len(keys) + 2 and len(sent["values"][1]) < len(keys) // 8 + 4
    assert len(zlib.compress(sent["keys"], 1)) < 0.85 * 8 * len(keys)
    got = blocks.answered(blocks.asked(docs, lambda row: (keys, [counts, truths]), 7), "l?", lambda k, v: v, "a").first()["a"]
    assert blocks.joined(got, 0, np.int64).tolist() == counts.tolist()
    assert blocks.joined(got, 1, "?").tolist() == truths.tolist()


def test_few_blocks_are_in_a_row_group(frame):
    """A scan holds the rows of a row group at once, so large rows stand in small groups."""
    from urllib.parse import urlsplit

    import pyarrow.dataset as ds

    docs = frame([(i, "word " * 20) for i in range(90)]).coalesce(1)
    table = blocks.blocked(docs, "doc_id", limit=1)
    answers = blocks.answered(blocks.asked(table, lambda row: (np.arange(9, dtype=np.uint64), []), 3), "", lambda k, v: [k], "a")
    for place, least in ((table.place, 90), (blocks.written(answers, "answers", group_rows=4).place, 90)):
        rows = [g.num_rows for f in ds.dataset(urlsplit(place).path).get_fragments() for g in f.row_groups]
        assert sum(rows) == least and max(rows) <= 4
