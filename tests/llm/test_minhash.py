"""Near-duplicates against all pairs, on made-up groups that touch at the threshold."""

import random
import re

import numpy as np

from pagewell.llm import minhash
from pagewell.llm.components import components


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def expected(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(doc_id, smallest.get(find(i), doc_id))
    return sorted(
        (doc_id is None, doc_id or 0, len(sets[i]), smallest.get(find(i))) for i, (doc_id, _) in enumerate(rows)
    )


def found(groups):
    rows = groups.select("doc.doc_id", "n_shingles", "component_id").collect()
    return sorted((r[0] is None, r[0] or 0, r[1], r[2]) for r in rows)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    texts = []
    for size in (8, 30, 60, 200):
        base = [word() for _ in range(size)]
        for _ in range(60):  # chains of edits around the threshold
            copy = list(base)
            for _ in range(rng.randrange(1 + size // 25 + 2)):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    passage = " ".join(word() for _ in range(40))  # a passage that many share
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(5, 80))) for _ in range(80)]
    texts += [texts[0]] * 20 + [texts[0].upper(), "", None, " \n\t", "a", "A", "a b", "a b c d", "é è", "É è"]
    return [(i, t) for i, t in enumerate(texts)]


def test_all_links(frame):
    rows = corpus()
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, "only one"), (7, "another text of the id seven")]
    assert found(minhash.grouped(frame(rows), "doc_id")) == expected(rows)


def test_one_of_each(frame):
    rows = corpus(6) + [(None, "no id at all")]
    docs = frame(rows)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = expected(rows)
    assert kept.count() == len({c for _, _, n, c in want if n and c is not None}) + sum(
        n == 0 for _, _, n, _ in want
    ) + 1


def test_empty_table(frame):
    assert minhash.grouped(frame([]), "doc_id").count() == 0


def test_long_text(frame):
    long = " ".join(f"w{i}" for i in range(400_000))
    got = found(minhash.grouped(frame([(1, long), (2, long + " end"), (3, "short")]), "doc_id"))
    assert got == [(False, 1, 399_996, 1), (False, 2, 399_997, 1), (False, 3, 1, 3)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    true = 2400 / 3400
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.12
    assert (minhash.signature(a) == minhash.signature(a[::-1])).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(200, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {n: n for link in links for n in link}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: find(n) for n in parent if any(n in link and link[0] != link[1] for link in links)}
