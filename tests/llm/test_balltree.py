"""Ranking against plain loops over all documents; bounds and pruning on small trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagewell.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(docs, items, k=10):
    bags = [Counter(plain_terms(d[1])) for d in docs]
    sizes = [sum(b.values()) for b in bags]
    n_docs, all_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, *_), bag, n in zip(docs, bags, sizes):
            score = 0
            for t in plain_terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * n * n_docs) // all_terms
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(frame, docs, items):
    got = balltree.ranked(frame(docs), frame(items, "item_id long, text string, rank int"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "W" + str(int(rng.paretovariate(0.6)) % 300)
    return [(i, " ".join(word() for _ in range(rng.randrange(40))), "en") for i in range(n)]


ODD = [(None, None), (None, "w1 w2"), (7, ""), (8, " -- \t"), (9, "naïve_Ünïcode nbsp"), (9, "naïve_Ünïcode nbsp"),
       (5, "w1 " * 300_000), (4, "W1_w1-w1.w2"), (3, "w1_w1-w1.w2")]
ITEMS = [(1, "w1 w2 W3 w3"), (1, "ünïcode Ünïcode NAïVE"), (None, "w5, w6; w7"), (2, None), (3, "..."), (4, "unseen"), (5, "W1")]


def test_ranking(frame):
    docs = ODD + corpus(2, 500)
    items = ITEMS + [(100 + i, t) for i, t, _ in corpus(4, 30)]
    assert found(frame, docs, items) == expected(docs, items)


@pytest.mark.parametrize("docs", [[], ODD[:1], ODD[1:2]])
@pytest.mark.parametrize("items", [[], ITEMS])
def test_small_tables(frame, docs, items):
    assert found(frame, docs, items) == expected(docs, items)


def test_items_in_several_blocks(frame, monkeypatch):
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 20)  # read on the driver
    docs, items = corpus(6, 60), [(i, t) for i, t, _ in corpus(7, 12)]
    assert found(frame, docs, items) == expected(docs, items)


@pytest.mark.parametrize("groups", [1, 7, 64])
def test_bounds_hold_and_prune(groups):
    rng = np.random.default_rng(groups)
    width, n = 64, 700
    rows = [np.sort(rng.choice(width, rng.integers(0, 9) if i % 5 else 0, replace=False)) for i in range(n)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    term = np.concatenate(rows).astype(np.int64)
    value = rng.integers(1, 10**10, len(term))
    tree = balltree.Tree(term, value, first, width, groups)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), np.diff(first)), term] = value
    assert sorted(tree.order.tolist()) == list(range(n))
    visited = 0
    for _ in range(20):
        ids = rng.choice(width, 6, replace=False)
        counts = rng.integers(1, 4, 6)
        scores = dense[:, ids] @ counts
        bounds = tree.bounds(ids, counts)
        for leaf in range(tree.first_leaf):
            mine = tree.order[tree.leaf_ends[leaf] : tree.leaf_ends[leaf + 1]]
            node = leaf + tree.first_leaf
            while node:
                assert bounds[node] >= scores[mine].max()
                node //= 2
        kth = np.sort(scores)[-10]
        got = []
        for found_rows, exact in tree.search(ids, counts, lambda: kth):
            visited += 1
            assert (exact == scores[found_rows]).all()
            got += exact[exact >= kth].tolist()
        assert sorted(got) == sorted(scores[scores >= kth].tolist())
    if groups == 64:
        assert visited < 0.75 * 20 * tree.first_leaf  # random rows without clusters
