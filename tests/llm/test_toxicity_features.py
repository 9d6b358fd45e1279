"""Every dense feature against a version in plain Python, on odd texts."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagewell.llm import toxicity
from pagewell.llm.common import text_slices, word_hash

WORDS = {"vilefool": 3.0, "dreck": 2.5, "you": 1.75}
BEGINNINGS = {"vile": 2.0, "grob": 1.5, "grobi": 4.0, "ünfl": 2.25}
PERSONS = {w.encode() for w in toxicity.SECOND_PERSON}


def lexicon():
    words = sorted((word_hash(w), x) for w, x in WORDS.items())
    starts = sorted(
        ((word_hash(b) + len(b.encode())) % 2**64, x) for b, x in BEGINNINGS.items() if len(b.encode()) in toxicity.BEGINNINGS
    )
    return toxicity.Lexicon(
        np.array([h for h, _ in words], np.uint64),
        np.array([x for _, x in words]),
        np.array([h for h, _ in starts], np.uint64),
        np.array([x for _, x in starts]),
    )


def plain(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    low = [w.lower() for w in words]
    known = {w.encode(): x for w, x in WORDS.items()}
    starts = {b.encode(): x for b, x in BEGINNINGS.items() if len(b.encode()) in toxicity.BEGINNINGS}
    weight = [known.get(w, 0.0) for w in low]
    begin = [max(starts.get(w[:n], 0.0) if len(w) >= n else 0.0 for n in toxicity.BEGINNINGS) for w in low]
    person = [w in PERSONS for w in low]
    near = [
        (x > 0 or y > 0) and any(person[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1])
        for i, (x, y) in enumerate(zip(weight, begin))
    ]
    is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    is_capital = lambda c: 65 <= c <= 90
    is_sign = lambda c: 48 <= c <= 57 or c in b"*@$#+_"
    is_mark = lambda c: 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126
    some = lambda test, w: sum(map(test, w))
    hidden = [
        len(w) >= 3 and some(is_letter, w) > 0 and some(is_sign, w) > 0 and some(is_letter, w) + some(is_sign, w) >= len(w) - 1
        for w in words
    ]
    shouted = [some(is_letter, w) > 1 and some(is_capital, w) == some(is_letter, w) for w in words]
    size, chars = max(len(words), 1), max(len(data), 1)
    return [
        sum(weight) / size,
        sum(x > 0 for x in weight) / size,
        max(weight, default=0.0),
        math.log1p(sum(x > 0 for x in weight)),
        sum(begin) / size,
        max(begin, default=0.0),
        math.log1p(sum(x > 0 for x in begin)),
        sum(near) / size,
        sum(person) / size,
        some(is_capital, data) / max(some(is_letter, data), 1),
        sum(shouted) / size,
        data.count(b"!") / chars,
        data.count(b"?") / chars,
        some(is_mark, data) / chars,
        sum(hidden) / size,
        sum(data[i] == data[i + 1] == data[i + 2] for i in range(len(data) - 2)) / chars,
        math.log1p(len(words)),
    ]


def random_text(rng):
    pool = [*WORDS, *PERSONS, "Vilehead", "GROBIAN", "v1le", "d*eck", "a@b", "ünflat", "漢字", "!!!", "???", "aaaa", "...", "U", "x"]
    pool = [w.decode() if isinstance(w, bytes) else w for w in pool]
    return rng.choice(" \n\t").join(rng.choice(pool) for _ in range(rng.randrange(0, 40)))


ODD = [
    "", None, "   ", "YOU VILEFOOL!!!", "so aa", "aab", "you a b c d vilefool", "you a b c d e vilefool",
    "vilefool", "you", "x you", "É\x0bvile\x0cgrobian", "a" * 5, "word " * 20_000 + "you dreck", "1 2 3", "U r a v1lef00l?",
]


@pytest.mark.parametrize("seed", range(3))
def test_features(seed):
    rng = random.Random(seed)
    texts = ODD + [random_text(rng) for _ in range(150)]
    rng.shuffle(texts)
    table, done = lexicon(), 0
    for at, end, data, offsets in text_slices(pa.array(texts, pa.string())):
        got = toxicity.features_of(data, offsets, table)
        assert got.shape == (end - at, len(toxicity.FEATURES))
        for text, row in zip(texts[at:end], got):
            wanted = dict(zip(toxicity.FEATURES, plain(text)))
            assert dict(zip(toxicity.FEATURES, row)) == pytest.approx(wanted, abs=1e-9), (text or "")[:80]
        done += end - at
    assert done == len(texts)
