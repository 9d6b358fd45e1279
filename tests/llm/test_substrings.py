"""Removed repeats against a count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from pagewell.llm import substrings


def expected(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefg") + str(rng.randrange(60))
    passages = [[word() for _ in range(n)] for n in (20, 34, 35, 36, 70, 200)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [word() for _ in range(rng.randrange(0, 60))]
            parts += rng.choice(passages) if rng.random() < 0.5 else []
        texts.append(rng.choice(" \n").join(parts))
    whole = " ".join(word() for _ in range(50))
    loop = " ".join(["x", "y", "z"] * 30)
    return texts + [whole, whole, "", None, "   ", "one", loop, "the " * 36, "É " * 40 + "end"]


@pytest.mark.parametrize("length, seed", [(35, 16), (12, 5)])
def test_removed_words(frame, length, seed):
    texts = corpus(length)
    got = substrings.deduplicated(frame(list(enumerate(texts))), "doc_id", length=length, seed=seed).collect()
    want = expected(texts, length)
    assert {r["row"]["doc_id"]: tuple(r)[1:4] for r in got} == dict(enumerate(want))
    for r in got:  # the kept text has just the kept words
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert hashlib.sha256(" ".join(words).encode()).hexdigest() == r["kept_sha256"]
        if not r["n_removed"]:
            assert r["text"] == (texts[r["row"]["doc_id"]] or "")


def test_many_blocks(frame, monkeypatch):
    from pagewell.llm import blocks

    monkeypatch.setattr(blocks, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(substrings, "blocked", lambda docs, *keep: blocks.blocked(docs, *keep, limit=700))
    texts = corpus(2)
    got = substrings.deduplicated(frame(list(enumerate(texts))), "doc_id").collect()
    assert {r["row"]["doc_id"]: tuple(r)[1:4] for r in got} == dict(enumerate(expected(texts, 35)))


def test_repeated_rows_and_clashing_names(frame):
    text = " ".join(f"w{i}" for i in range(40))
    docs = frame([(1, text), (1, text), (2, "other words"), (None, None)])
    done = substrings.cleaned(docs)
    assert done.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in done.collect()) == [
        (0, "", 0),
        (1, "", 0),
        (1, "", 0),
        (2, "other words", 11),
    ]


def test_empty_table(frame):
    assert substrings.deduplicated(frame([]), "doc_id").count() == 0


def test_long_text(frame):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = substrings.deduplicated(frame([(1, long), (2, long + " x"), (3, "w5 w6")]), "doc_id", texts=False)
    assert sorted((r[0][0], r[1], r[2]) for r in got.collect()) == [(1, 300_000, 300_000), (2, 300_001, 300_000), (3, 2, 0)]
