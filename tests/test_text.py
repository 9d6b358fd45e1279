import random
import re

import pytest
from pyspark.sql import functions as F

from pagewell.functions import text as tx
from pagewell.operators import chunking


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def chunks_of(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_no").collect():
        out.setdefault(r["doc_id"], []).append((r["chunk_text"], r["n_tokens"]))
    return out


def random_texts(n):
    rng = random.Random(7)
    texts = []
    for _ in range(n):
        words = ["w%d%s" % (rng.randrange(50), rng.choice(["", "", "", ".", "?", ",", ".\n"]))
                 for _ in range(rng.randrange(0, 90))]
        texts.append(rng.choice([" ", "  ", "\n "]).join(words))
    return texts


def test_fixed_windows_at_the_edges(spark):
    size, overlap = 8, 3
    exact = " ".join(f"w{i}" for i in range(size))
    got = chunks_of(
        chunking.fixed_chunks(docs(spark, ["one", exact, exact + " more", "", "  \n ", None]), size, overlap)
    )
    assert got[0] == [("one", 1)]
    assert got[1] == [(exact, size)]
    assert got[2] == [(exact, size), ("w5 w6 w7 more", 4)]
    assert set(got) == {0, 1, 2}


def test_fixed_windows_cover_every_word_and_share_the_overlap(spark):
    size, overlap = 10, 4
    texts = random_texts(60)
    got = chunks_of(chunking.fixed_chunks(docs(spark, texts), size, overlap))
    for i, text in enumerate(texts):
        words = text.split()
        parts = [c.split() for c, _ in got.get(i, [])]
        assert all(len(p) <= size for p in parts)
        for a, b in zip(parts, parts[1:]):
            assert a[-overlap:] == b[:overlap]
        rebuilt = parts[0] + [w for p in parts[1:] for w in p[overlap:]] if parts else []
        assert rebuilt == words


def test_overlap_must_be_below_the_size(spark):
    for bad in (10, 11, -1):
        with pytest.raises(ValueError):
            chunking.fixed_chunks(docs(spark, ["a"]), 10, bad)
        with pytest.raises(ValueError):
            chunking.sentence_chunks(docs(spark, ["a"]), 10, bad)


def expected_sentences(text, size, overlap):
    budget = size - overlap
    pieces = []
    for line in re.sub(r"([.!?])\s+", "\\1\n", text).split("\n"):
        words = line.split()
        pieces += [words[i : i + budget] for i in range(0, len(words), budget)]
    groups = []
    for p in pieces:
        if groups and sum(map(len, groups[-1])) + len(p) <= budget:
            groups[-1].append(p)
        else:
            groups.append([p])
    out = []
    for n, group in enumerate(groups):
        lead = []
        if n:
            for p in reversed(groups[n - 1]):
                if sum(map(len, lead)) + len(p) > overlap:
                    break
                lead.insert(0, p)
        words = [w for p in lead + group for w in p]
        out.append((" ".join(words), len(words)))
    return out


@pytest.mark.parametrize("size,overlap", [(12, 4), (20, 0), (9, 8)])
def test_sentences_are_packed_greedily(spark, size, overlap):
    texts = random_texts(60) + [" ".join(f"w{i}" for i in range(300)), "", " \n ", "A b. C d! E"]
    got = chunks_of(chunking.sentence_chunks(docs(spark, texts), size, overlap))
    for i, text in enumerate(texts):
        want = expected_sentences(text, size, overlap)
        assert got.get(i, []) == want
        assert all(n <= size for _, n in want)


def test_a_long_document_is_packed_in_linear_time(spark):
    text = " ".join(f"s{i} t." for i in range(200_000))
    n = chunking.sentence_chunks(docs(spark, [text]), 100, 20).agg(F.sum("n_tokens")).first()[0]
    assert n > 400_000


def test_paragraphs(spark):
    df = docs(spark, ["a\n\nb", "c"])
    rows = chunking.paragraphs(df).orderBy("doc_id", "para_no").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_tokens_are_lower_case_runs_of_letters_and_digits(spark):
    df = docs(spark, ["Été-2024, naïve_x!", "", None])
    got = [r[0] for r in df.orderBy("doc_id").select(tx.tokens(F.col("text"))).collect()]
    assert got == [["été", "2024", "naïve", "x"], [], None]


def test_page_text(spark):
    html = "<p>a&lt;b</p><SCRIPT x>var t='</p>';</script><!-- no\nno --><style>q{}</style> c&amp;amp;d"
    assert docs(spark, [html]).select(tx.page_text(F.col("text"))).first()[0] == "a<b c&amp;d"
