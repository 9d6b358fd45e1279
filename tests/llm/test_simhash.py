"""Fingerprints against plain loops, links against all pairs."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pagewell.llm import simhash


def plain_print(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    """The smallest index of each entry's component, by all pairs of distinct values."""
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    return [find(p) for p in prints]


def expected(rows):
    prints = [plain_print(r[1]) for r in rows]
    roots, least = components_of(prints), {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    return sorted([(r[0], f"{p:016x}", least.get(root)) for r, p, root in zip(rows, prints, roots)], key=repr)


def found(docs):
    got = simhash.grouped(docs, "doc_id").select("doc.doc_id", simhash.as_hex(F.col("print")), "component_id")
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        flips = sum(1 << b for b in bits)
        assert any(not mask & flips for mask in masks)


def test_shingle_hash_is_sparks(spark):
    for text in ("a b c", "é ü 漢字", "x" * 200):
        want = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()[0]
        assert want % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    out = []
    for _ in range(6):
        base = [word() for _ in range(400)]
        for _ in range(25):  # one word changed: fingerprints that differ in few bits
            copy = list(base)
            copy[rng.randrange(400)] = word().upper()
            out.append(" ".join(copy))
    return out + [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(40)]


ODD = [(None, None), (7, ""), (3, " \t\n"), (9, None), (None, "no id at all"), (8, "Two words"), (6, "two\x0bWORDS"),
       (8, "Two words"), (12, "nbsp is no separator"), (13, "long " * 300_000)]


def test_texts(frame):
    rows = ODD + [(100 + i, t, "en", "web", 1, 2, 3) for i, t in enumerate(texts(3))]
    assert found(frame(rows)) == expected(rows)
    assert len({c for _, _, c in expected(rows)}) < len({p for _, p, _ in expected(rows)})


@pytest.mark.parametrize("rows", [[], [(1, "one")], [(None, "x y z")]])
def test_small_tables(frame, rows):
    assert found(frame(rows)) == expected(rows)


@pytest.mark.parametrize("small", [2, 64])
def test_links_of_crowded_buckets(spark, small):
    """Values in clusters around the radius, most of them in long and cut buckets."""
    rng = random.Random(small)
    prints = set()
    for _ in range(12):
        base, walk = rng.getrandbits(64), rng.sample(range(64), 40)
        for _ in range(60):
            p = base
            for b in rng.sample(walk, rng.randrange(5)):
                p ^= 1 << b
            prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 1, 2**63}
    prints = sorted(prints)
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    got = simhash.links(rows, small).collect()
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in got:
        parent[find(a % 2**64)] = find(b % 2**64)
    same = lambda labels: {frozenset(p for p, x in zip(prints, labels) if x == y) for y in set(labels)}
    assert same([find(p) for p in prints]) == same(components_of(prints))
