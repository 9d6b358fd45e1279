"""Every stage of the pipeline against brute force, on what the stage before it kept."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from test_minhash import expected as components_of
from test_substrings import expected as without_repeats

import corpus_pipeline
from pagewell.llm.quality import COMMON_WORDS
from pagewell.llm.tokens import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(11)
    common = COMMON_WORDS["en"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice("bcdfg") + rng.choice("aeiou") + str(rng.randrange(500))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(45)
    texts = [prose(rng.randrange(20, 260)) for _ in range(60)]
    texts += [prose(30) + " " + passage + "\n" + prose(rng.randrange(30, 90)) for _ in range(12)]
    for i in range(10):  # near copies, and exact ones
        words = texts[i].split()
        words[rng.randrange(len(words))] = "edited"
        texts += [" ".join(words), texts[i]]
    texts += ["again and again and " * 40, prose(150).upper() + "!!", " ".join(f"x%%%{i}###" for i in range(150)), "", None]
    return [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t or ""), None, None) for i, t in enumerate(texts)]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def distance(p, q):
    p, q = np.array(p, float), np.array(q, float)
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))


def clean(rows):
    def measures(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        upper, symbols = sum(c.isupper() for c in text), len(re.findall(r"[#*$%&|<>]", text))
        chars = sum(map(len, words))
        hits = [words.count(c) for c in COMMON_WORDS["en"]]
        return words, [chars - upper - symbols, upper, symbols, len(text) - chars], [*hits, len(words) - sum(hits)]

    every = [measures(r[1] or "") for r in rows]
    classes, common = (np.sum([m[k] for m in every], 0) for k in (1, 2))
    none = np.zeros_like(common)
    none[-1] = 1
    limit = min(0.34, 0.75 * distance(none, common)) if common[:-1].any() else 0.34
    kept = []
    for row, (words, own_classes, own_common) in zip(rows, every):
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = Counter(grams)
        repeated = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        odd = len(row[1] or "") >= 200 and distance(own_classes, classes) > 0.29
        odd = odd or len(words) >= 120 and distance(own_common, common) > limit
        if not failed and not odd:
            kept.append(row)
    return kept


def copies(rows):
    size = defaultdict(float)
    for r in rows:
        size[r[3]] += len(r[1].encode()) + 1
    total, weights = sum(size.values()), {s: math.sqrt(b) for s, b in size.items()}
    out = []
    for r in rows:
        rate = total * weights[r[3]] / sum(weights.values()) / size[r[3]]
        draw = int(hashlib.md5(f"mix-1|{r[0]}".encode()).hexdigest()[:13], 16) / 16**13
        n, below = 0, math.exp(-rate)
        while below <= draw:
            n += 1
            below += math.exp(-rate) * rate**n / math.factorial(n)
        out += [r] * n
    return out


def test_every_stage(spark, frame):
    docs, names = frame(corpus()).select(*COLUMNS), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "repeated passages", "source mixture", "packed sequences"]
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, rows: stages[name](spark, frame([(*r, None, None) for r in rows]).select(*COLUMNS), "")
    before = rows_of(docs)
    kept = clean(before)
    assert 60 < len(kept) < len(before) - 4
    passed = step("quality rules", before)
    assert passed.columns == COLUMNS and sorted(rows_of(passed)) == sorted(kept)
    least = {c for _, _, _, c in components_of([(r[0], r[1]) for r in kept])}
    single = step("near duplicates", kept)
    assert single.columns == COLUMNS and sorted(rows_of(single)) == sorted(r for r in kept if r[0] in least)
    kept = sorted(r for r in kept if r[0] in least)
    cut = step("repeated passages", kept)
    want = without_repeats([r[1] for r in kept], 35)
    got = sorted(rows_of(cut))
    assert cut.columns == COLUMNS and [g[0] for g in got] == [r[0] for r in kept]
    for g, (n, removed, digest), old in zip(got, want, kept):
        words = re.findall(r"[^\x20\x09-\x0D]+", g[1])
        assert len(words) == n - removed and hashlib.sha256(" ".join(words).encode()).hexdigest() == digest
        assert g[4] == len(g[1]) and (removed or g[1] == old[1])
    assert any(removed for _, removed, _ in want)
    mixture = step("source mixture", got)
    assert mixture.columns == COLUMNS and sorted(rows_of(mixture)) == sorted(copies(got))
    rows = step("packed sequences", copies(got)).collect()
    tokens = Counter()
    for r in copies(got):
        tokens[r[0]] += len(encoder().encode(r[1])) // 4 + 1
    packed = Counter()
    ends = defaultdict(list)
    for r in rows:
        packed[r["doc_id"]] += r["length"]
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert packed == tokens
    for parts in ends.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048


def test_empty_table_runs_through(spark, frame):
    docs = frame([]).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
