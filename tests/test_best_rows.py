"""Searches of many questions at once: the same best rows, without sorting, rounding or visiting what cannot be among them."""

import numpy as np
import pyarrow as pa
import pytest

from pagewell.operators import blockscan, postings


def plainly(q, s, keys, k):
    order = np.lexsort((*reversed(keys), -s, q))
    place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return np.sort(order[place < k]), order[place == k - 1]


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_best_rows(n):
    rng = np.random.default_rng(n)
    for k in (1, 2, 5, 50):
        q, s = rng.integers(0, 4, n), rng.choice([0.0, -0.0, -0.5, 0.5, 1.0, 1 + 1e-9, 123.4567], n)
        keys = [rng.integers(-2, 2, n), np.arange(n)]
        keep, floored, floors = blockscan.best_rows(q, s, keys, k)
        want, last = plainly(q, s, keys, k)
        assert np.flatnonzero(keep).tolist() == want.tolist()
        assert sorted(zip(floored, floors)) == sorted(zip(q[last], s[last]))


def test_only_level_rows_are_sorted_by_their_keys(monkeypatch):
    rng, seen, lexsort = np.random.default_rng(1), [], np.lexsort
    best = blockscan.RunningBest(5, 10, 1)
    scores = blockscan.round_scores(rng.random((5, 4000)))
    best.offer([np.arange(4000)], np.arange(4000), np.arange(5), scores)
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(len(keys[0])) or lexsort(keys))
    best.settle()
    assert sum(seen) < 50
    for q in range(5):
        want = lexsort((np.arange(4000), -scores[q]))[:10]
        assert sorted(best.kept[0][best.q == q]) == sorted(want) and best.floor[q] == scores[q][want[-1]]


def block(rng, n_chunks, n_terms, n_questions):
    """Postings and questions of a few common and many rare terms."""
    has = rng.random((n_chunks, n_terms)) < np.where(np.arange(n_terms) < 5, 0.8, 0.03)
    asks = rng.random((n_questions, n_terms)) < np.where(np.arange(n_terms) < 5, 0.8, 0.05)
    chunk, term = np.nonzero(has)
    table = pa.table({"term": term, "doc_id": chunk // 3, "chunk_no": (chunk % 3).astype(np.int32),
                      "tf": rng.integers(1, 4, len(term)).astype(np.int32), "length": (5 + chunk % 7).astype(np.int32)})
    question, asked = np.nonzero(asks)
    tokens = pa.array([f"t{t}" for t in asked])
    block = postings.AskedBlock(pa.table({"query_id": question, "token": tokens, "idf": 1 + asked % 5 / 3, "avg_len": np.full(len(asked), 7.0)}))
    number = {t: i for i, t in enumerate(block.vocabulary.to_pylist())}
    terms = [number.get(f"t{t}", -1) for t in table["term"].to_pylist()]
    known = np.array(terms) >= 0
    return table.set_column(0, "term", pa.array(terms, pa.int64())).filter(pa.array(known)), block


@pytest.mark.parametrize("cells", [2_000_000, 900])
def test_a_block_is_scored_as_by_sums(monkeypatch, cells):
    """Common terms as a matrix, the others by their postings, in pieces; only scores that can be wanted are rounded."""
    table, asked = block(np.random.default_rng(2), 300, 60, 40)
    rounded, plain = [], blockscan.round_scores
    monkeypatch.setattr(postings, "MATRIX_CELLS", cells)
    monkeypatch.setattr(postings, "round_scores", lambda x: rounded.append(x.size) or plain(x))
    got = postings.best_of_block(table, asked, 7)
    scores, avg = {}, asked.avg
    for q, t, idf in zip(asked.question, asked.term, asked.idf):
        for row in table.filter(pa.compute.equal(table["term"], int(t))).to_pylist():
            key = int(asked.query_ids[q].as_py()), row["doc_id"], row["chunk_no"]
            scores[key] = scores.get(key, 0) + idf * postings.saturation(row["tf"], row["length"], avg)
    want = []
    for q in {key[0] for key in scores}:
        own = sorted((-float(plain(np.array([s]))[0]), key) for key, s in scores.items() if key[0] == q)
        want += [(*key, -s) for s, key in own[:7]]
    found = sorted(zip(*[got[c].to_pylist() for c in ("query_id", "doc_id", "chunk_no", "score")]))
    assert [r[:3] for r in found] == [r[:3] for r in sorted(want)]
    assert np.allclose([r[3] for r in found], [r[3] for r in sorted(want)], atol=1e-9)
    assert sum(rounded) < 2 * 7 * 40


def test_rounding_takes_whole_numbers_and_nothing():
    assert blockscan.round_scores(np.bincount([], [], minlength=2)).tolist() == [0, 0]
    assert blockscan.round_scores(np.array([])).tolist() == []
    assert blockscan.round_scores(np.array([0.00005, -0.00005, 1.23456])).tolist() == [0.0001, -0.0001, 1.2346]
