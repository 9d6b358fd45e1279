"""Quality rules, packing, extraction, sharding, mixing, neighbours and language model on small cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewell.llm import extraction, katz, mixing, neighbours, packing, quality, sharding, toxicity
from pagewell.llm.tokens import encoder

WORDS = "the of and to in a is that for it on was be with as by tree house river seven green under window".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS[:16]) if rng.random() < 0.4 else rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(n))


# ---- quality ---------------------------------------------------------------------------


def test_base_counts(frame):
    texts = ["", None, " \n ", "one", "a b c a b c", "x x x x", "p\nq\n\n \np\np", "Ab #1 $% é <b>|&*", "w " * 70]
    rows = quality.judged(frame([(i, t, "en") for i, t in enumerate(texts)]), quality.QualityRules(), "doc_id").collect()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if twice[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert tuple(r)[1:6] == (
            len(words),
            sum(map(len, words)),
            len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)),
            len(covered),
        )
        assert r["base_failed"] and not r["kept"]


def test_divergent_documents_go(frame):
    rng = random.Random(1)
    good = [prose(rng, rng.randrange(130, 300)) for _ in range(200)]
    symbols = " ".join(f"{w}{rng.randrange(99)}%%%###&&&" for w in prose(rng, 200).split())
    shouted = " ".join(f"{w}{i}".upper() for i, w in enumerate(prose(rng, 200).split()))
    rare = " ".join(f"zq{i}xy" for i in range(200))
    texts = [*good, symbols, shouted, rare]
    docs = frame([(i, t, "en") for i, t in enumerate(texts)])
    assert {r["doc_id"] for r in quality.clean(docs).collect()} == set(range(200))
    assert quality.clean(docs).columns == docs.columns
    other = frame([(i, t, None) for i, t in enumerate(good)])  # a language without common words
    assert quality.clean(other).count() == 200
    assert quality.clean(frame([])).count() == 0


def test_many_repeated_windows(frame):
    text = " ".join(f"a{i % 45} b{i % 45} c{i % 45}" for i in range(90)) + " " + " ".join(f"u{i}" for i in range(30))
    row = quality.judged(frame([(1, text, "en")]), quality.QualityRules(), "doc_id").first()
    assert row["n_repeat_words"] == 270


# ---- packing ---------------------------------------------------------------------------


def test_tokens_of_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [
        "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n", "it's  we'll", "x\t y", "é ü 漢字 😀  z", "a b 　c",
        "<|endoftext|>", "a <|endoftext|> b", "1234 56.78", "don't\n 's", "tail \n", " lead  two", "a" * 5000,
    ]
    for text in texts:
        ids = np.frombuffer(encoder().encode(text), "<u4").tolist()
        assert ids == reference.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 50, 5000, 300_000])
def test_plan_uses_up_the_histogram(n):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(6, 1, n).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    patterns = packing.plan(histogram)
    used = np.zeros(2049, int)
    for p in patterns:
        assert sum(p.lengths) <= 2048
        np.add.at(used, list(p.lengths), p.repeats)
    assert (used == histogram).all()
    least = -(-int(lengths.sum()) // 2048)
    assert sum(p.repeats for p in patterns) <= max(least * 1.01 + 1, sum(p.repeats for p in packing.best_fit(histogram, 2048)) + 1)


def test_packed_round_trip(frame):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(120)] + ["", None, "same", "same", prose(rng, 900)]
    rows = packing.packed(frame(list(enumerate(texts))), length=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r["ids"]) == r["length"] <= 64
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [sum(p["length"] for p in parts[:k]) for k in range(len(parts))]
        assert all(r["length"] == 64 for r in parts[1:])
        whole = [x for r in parts for x in r["ids"]]
        assert whole == np.frombuffer(encoder().encode(text or ""), "<u4").tolist() + [0]
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.packed(frame([])).count() == 0


def test_a_text_is_encoded_in_one_call(monkeypatch):
    """The cost of a text of words never seen before does not depend on how many they are."""
    rng, calls = random.Random(5), []
    text = " ".join("".join(rng.choices("abcdeé\n", k=9)) for _ in range(500)) + "  <|endoftext|> "
    own = encoder()
    whole = own._encoding
    fake = type("Counted", (), {name: lambda _, t, _n=name, **k: calls.append(t) or getattr(whole, _n)(t, **k) for name in ("encode", "encode_to_numpy")})
    monkeypatch.setattr(own, "_encoding", fake())
    assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, allowed_special="all")
    assert calls == [text]


# ---- extraction ------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><div id=main><h2>Title</h2>
<p>First, with commas, and text   that is long&nbsp;enough to count &amp; more &#233;.<p>Second paragraph, also, of some
length, so it scores.<ul><li>one item of a list</li><li>another</ul><script>no()</script><form><p>Mail</p></form></div>
<div class="sidebar"><p>Side text, with commas, long enough to be taken for a paragraph of prose.</p></div>
<div id="comments"><p>I think, you know, that this comment is long, with commas, and more words.</p></div>
<footer>&copy; us</footer></body>"""


def test_main_text():
    assert extraction.main_text(PAGE).split("\n") == [
        "Title",
        "First, with commas, and text that is long enough to count & more é.",
        "Second paragraph, also, of some length, so it scores.",
        "one item of a list",
        "another",
    ]


def test_odd_pages(spark):
    deep = "<div>" * 30_000 + "<p>" + "deep words, " * 20
    rows = [(1, None), (2, ""), (3, "<script>x"), (4, "plain &lt;text"), (5, "<p>open <b>bold"), (6, deep), (6, deep)]
    pages = spark.createDataFrame([(i, "u", h, "clash") for i, h in rows], "page_id long, url string, html string, row string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extraction.extracted(pages).collect()}
    assert got == {
        1: ("", 0),
        2: ("", 0),
        3: ("", 0),
        4: ("plain <text", 11),
        5: ("open bold", 9),
        6: (("deep words, " * 20).strip(), 239),
    }
    assert extraction.extracted(pages.limit(0)).count() == 0


# ---- sharding --------------------------------------------------------------------------


def test_slots_and_rebalancing(frame):
    rng = random.Random(2)
    docs = frame([(i, "x" * rng.randrange(200)) for i in range(3000)] + [(None, None), (None, "t"), (5, "x"), (5, "x")])
    placed, slot_map = sharding.sharded(docs, 7, slots=256)
    rows = placed.collect()
    assert len(rows) == 3004
    loads = Counter()
    places = {}
    for r in rows:
        loads[r["shard"]] += r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    biggest = max(r["bytes"] for r in slot_map.collect())
    assert set(loads) == set(range(7)) and max(loads.values()) - min(loads.values()) <= biggest
    after = sharding.rebalanced(slot_map, 8).collect()
    before = {r["vslot"]: r["shard"] for r in slot_map.collect()}
    assert {r["version"] for r in after} == {2} and {r["vslot"] for r in after} == set(before)
    moved = [r for r in after if r["shard"] != before[r["vslot"]]]
    assert len(moved) < len(before) / 4
    grown = Counter()
    for r in after:
        grown[r["shard"]] += r["bytes"]
    assert set(grown) == set(range(8)) and max(grown.values()) - min(grown.values()) <= 2 * biggest
    assert sharding.sharded(frame([]), 7)[0].count() == 0


# ---- mixing ----------------------------------------------------------------------------


def test_mixture(frame):
    rng = random.Random(3)
    rows = [(i, "y" * 100, "en", "big" if i < 4000 else "small", 100, 9) for i in range(5000)]
    rows += [(None, None, None, None), (1, "y" * 100, "en", "big", 100, 9)]
    docs = frame(rows)
    out = mixing.mixed(docs, {"big": 1.0, "small": 1.0}).select("doc.*", "copies").collect()
    assert set(docs.columns) <= set(out[0].asDict())
    share = Counter(r["source"] for r in out)
    assert share[None] == 0 and abs(share["big"] / 2500 - 1) < 0.1 and abs(share["small"] / 2500 - 1) < 0.1
    counts = Counter(Counter(r["doc_id"] for r in out if r["source"] == "small").values())
    assert all(abs(counts[k] - 1000 * math.exp(-2.5) * 2.5**k / math.factorial(k)) < 60 for k in range(1, 6))
    again = mixing.mixed(docs, {"big": 1.0, "small": 1.0}).select("doc.*").collect()
    assert Counter(r["doc_id"] for r in again) == Counter(r["doc_id"] for r in out)
    assert mixing.mixed(frame([])).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.01, 1.0, 30.0, 1500.0])
def test_poisson_table(spark, rate):
    table = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).first()["t"]
    steps = np.diff([0.0, *table])
    assert abs(table[-1] - 1) < 1e-9
    assert abs((steps * np.arange(len(steps))).sum() - rate) < 1e-6 * max(1, rate)


# ---- neighbours ------------------------------------------------------------------------


def test_hilbert_curve_is_one_path():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def vectors(seed, n, clusters):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    return centres[rng.integers(clusters, size=n)] + 0.1 * rng.normal(size=(n, 16))


def test_nearest(spark):
    x = vectors(1, 1500, 30)
    x[200:900] = x[200]  # a vector that is everywhere
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [1.0, None] * 8), (5300, [float("nan")] * 16), (5400, [1.0] * 3)]
    odd += [(None, rows[0][1]), rows[3]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(1500), gap)) if i != q][:10]
        assert sorted(found) == list(range(1, 11))
        assert all(abs(score - gap[v]) < 1e-9 for v, score in found.values())
        assert list(found.values()) == sorted(found.values(), key=lambda f: (f[1], f[0])) or len(found) == 10
        hits += len({v for v, _ in found.values()} & set(order))
        if 200 <= q < 900:
            assert [found[i + 1][0] for i in range(10)] == order
    assert hits >= 0.9 * 10 * len(got)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], schema)
    rows = neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 1), (2, 2)]
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


# ---- language model --------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_against_recursion(frame, order):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(60)] + ["", None, "The THE the", texts_repeat := "a b " * 30]
    held = lambda i: i % 4 == 1
    docs = frame(list(enumerate(texts))).withColumn("is_held", F.col("doc_id") % 4 == 1)
    rows = katz.Model(docs, "is_held", "doc_id", order=order).scored().collect()
    tokens = {i: re.findall(r"\S+", (t or "").lower()) + ["</s>"] for i, t in enumerate(texts)}
    counts = [None] + [Counter() for _ in range(order)]
    for i, t in tokens.items():
        padded = ["<s>"] * (order - 1) + t
        if not held(i):
            for n in range(1, order + 1):
                counts[n].update(tuple(padded[j - n + 1 : j + 1]) for j in range(order - 1, len(padded)))
    total, distinct = sum(counts[1].values()), len(counts[1])
    factors = [None, None] + [katz.discounts(Counter(counts[n].values())) for n in range(2, order + 1)]

    def p(gram):
        n = len(gram)
        if n == 1:
            return (counts[1][gram] + 0.5) / (total + 0.5 * (distinct + 1))
        after = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        kept = {g: c * factors[n][min(c, katz.K + 1)] for g, c in after.items()}
        whole = sum(after.values())
        whole += whole - sum(kept.values()) < 1e-9 * whole
        if gram in kept:
            return kept[gram] / whole
        return (1 - sum(kept.values()) / whole) / (1 - sum(p(g[1:]) for g in after)) * p(gram[1:])

    for r in rows:
        t = tokens[r["row"]["doc_id"]]
        padded = ["<s>"] * (order - 1) + t
        grams = [tuple(padded[j - order + 1 : j + 1]) for j in range(order - 1, len(padded))]
        assert r["n_tokens"] == len(t) and r["n_known"] == sum(counts[1][(w,)] > 0 for w in t)
        assert math.isclose(r["score"], sum(math.log10(p(g)) for g in grams), rel_tol=1e-9)
        assert math.isclose(r["base_score"], sum(math.log10(p((w,))) for w in t), rel_tol=1e-9)
    if order == 2:  # exactly normalised, the unknown word included
        for context in {g[:1] for g in counts[2]} | {("nowhere",)}:
            mass = sum(p(context + w) for w in counts[1]) + p(context + ("unknown",))
            assert abs(mass - 1) < 1e-9


def test_katz_tallies_come_with_the_counts(frame):
    """Answers and tallies come from one asking: the questions of all blocks are shuffled once."""
    docs = frame([(1, "a b a"), (2, "b a c"), (3, "b a")]).withColumn("held_out", F.lit(False))
    blocks = katz.blocked(docs, "held_out", limit=6)
    messages = katz.asked(blocks, katz._grams_asked(1, 1), 4)
    rows = {r["block"]: r["n"] for r in katz.answered(messages, "l", katz._counts, "n", katz._tallied).collect()}
    assert len(rows) == blocks.count() + 1 > 2
    tallies = sum(np.frombuffer(bucket[0], np.int64) for bucket in rows.pop(katz.SUMMARY))
    # a 4 times, b and the end 3 times, c once
    assert tallies.tolist() == [11, 4, 1, 0, 2, 1, 0, 0]


def test_katz_without_training(frame):
    docs = frame([(1, "a b"), (2, None)]).withColumn("is_held", F.lit(True))
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in katz.Model(docs, "is_held").scored().collect())
    empty = frame([]).withColumn("is_held", F.lit(False))
    assert katz.Model(empty, "is_held").scored().count() == 0


# ---- toxicity --------------------------------------------------------------------------


def test_toxicity_held_out(frame, spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(2400):
        words, toxic = prose(rng, rng.randrange(5, 80)).split(), int(rng.random() < 0.25)
        for _ in range(rng.randrange(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "vilefool", "vilehead", "dreck"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(9000, None), (9001, ""), (None, "vilefool"), (0, rows[0][1])]
    labels += [(None, 1), (9000, None), (77777, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(rows)
    held = F.pmod(toxicity.id_crc(), F.lit(4)) == 2
    model = toxicity.fitted(toxicity.sample_of(docs, labels, ~held))
    scores = toxicity.scored(docs, model, "doc_id").collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    unseen = [r for r in scores if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 9000]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in unseen)
    assert len(unseen) > 400 and right >= 0.97 * len(unseen)
    none = toxicity.fitted(toxicity.sample_of(docs, labels.where("toxic = 0"), ~held))
    assert {r["score"] for r in toxicity.scored(docs, none, "doc_id").collect()} == {0.0}
    assert toxicity.scored(frame([]), none, "doc_id").count() == 0
