"""Pieces are placed by fitted patterns, and ids are those of the vocabulary on every given document."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewell.llm import packing
from pagewell.llm.tokens import encoder

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def texts():
    return [t or "" for (t,) in duckdb.sql(f"SELECT text FROM '{DOCUMENTS}'").fetchall()]


def test_ids_of_all_given_documents(texts):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = reference.encode_batch(texts, add_special_tokens=False)
    for text, ids in zip(texts, wanted, strict=True):
        assert np.frombuffer(encoder().encode(text), "<u4").tolist() == ids.ids


def test_most_pieces_come_from_patterns(texts):
    sizes = np.array([len(encoder().encode(t)) // 4 + 1 for t in texts]) % 2048
    histogram = np.bincount(sizes[sizes > 0], minlength=2049)
    patterns = packing.candidate_patterns(np.flatnonzero(histogram), 2048)
    weights = packing.fitted(patterns, histogram.astype(float))
    chosen, left = packing.rounded(patterns, weights, histogram, packing.SHARES[0])
    used = np.zeros(2049, np.int64)
    for p in chosen:
        assert sum(p.lengths) == 2048 and p.repeats > 0
        np.add.at(used, list(p.lengths), p.repeats)
    assert (used + left == histogram).all()
    assert used.sum() >= 0.85 * histogram.sum()
    least = -(-int((histogram * np.arange(2049)).sum()) // 2048)
    assert sum(p.repeats for p in packing.plan(histogram)) <= least + 1


def test_rounding_keeps_the_sum():
    """Weights of a third each: by plain rounding none would be used."""
    patterns = [np.array([[1500, 548], [1400, 648], [1300, 748]]), np.zeros((0, 3), int)]
    histogram = np.zeros(2049, np.int64)
    histogram[[1500, 548, 1400, 648, 1300, 748]] = 1
    chosen, left = packing.rounded(patterns, [np.full(3, 1 / 3), np.zeros(0)], histogram, 1.0)
    assert sum(p.repeats for p in chosen) == 1 and left.sum() == 4


def test_a_very_long_text(frame):
    rows = packing.packed(frame([(1, "word " * 200_000), (2, "short")])).collect()
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 1)
    assert sum(size for *_, size in long) >= 200_000 and all(size == 2048 for *_, size in long[1:])
    assert [start for _, start, _ in long] == [0, *np.cumsum([size for *_, size in long])[:-1].tolist()]
