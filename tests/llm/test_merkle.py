"""The manifest against a tree built plainly in Python, for every number of levels a stored row may span."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewell.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = None if n_chars is None else n_chars + more
    values = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return found


def path(tree, at):
    for nodes in tree[:-1]:
        other = at ^ 1
        yield (nodes[other] if other < len(nodes) else None), other < at
        at //= 2


def expected(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {lang: levels([leaf(r) for r in by_lang[lang]]) for lang in langs}
    top = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, row in enumerate(by_lang[lang]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded, proof = leaf(row, int(tampered)), ""
            for sibling, is_left in [*path(trees[lang], at), *path(top, place)]:
                proof += sibling or ""
                folded = h(folded) if sibling is None else h(sibling, folded) if is_left else h(folded, sibling)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[lang][-1][0], root, h(proof), folded, folded == root))
    return sorted(out, key=repr)


def found(docs, span=merkle.SPAN):
    return sorted((tuple(r) for r in merkle.Manifest(docs, span).verified().collect()), key=repr)


ODD = [
    (None, None, None, None, None),
    (None, "no id", None, "web", 3),
    (3, "", "en", "", 0),
    (3, "", "en", "", 0),  # a repeated row
    (3, "same id", "en", "web", 7),
    (5, "é" * 10, "é", "books", None),
    (4, "long " * 400_000, "", "web", 2_000_000),
    *[(100 + i, f"text {i % 7}", ("en", "en", "de", "z")[i % 4], "web", i) for i in range(77)],
]


@pytest.mark.parametrize("span", [1, 3, 8])
def test_odd_rows(frame, span):
    assert found(frame(ODD), span) == expected(ODD)


@pytest.mark.parametrize("rows", [[], ODD[2:3], ODD[2:4], ODD[:1] + ODD[5:6]])
def test_small_tables(frame, rows):
    assert found(frame(rows)) == expected(rows)


def test_only_tampered_rows_fail(frame):
    rows = [(i, "x", "en", "web", None if i % 3 == 0 else i) for i in range(300)]
    for row in found(frame(rows)):
        changed = zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[0] % 3
        assert row[-1] == (not changed)


def test_stored_rows_are_linked(frame):
    manifest = merkle.Manifest(frame(ODD), 2)
    rows = manifest.nodes.select("tree", "stratum", "idx", "up_tree", "up_stratum", "up_idx", F.size("levels")).collect()
    own = {tuple(r[:3]) for r in rows}
    assert len(own) == len(rows)
    for r in rows:  # each parent position lies below a stored row, but for the root
        tree, level, idx = r[3:6]
        assert (tree, level + 1, idx >> 2) in own or (tree, idx) == (merkle.TOP, 0)
        assert 1 <= r[6] <= 2
