"""Quality rules: documents that only the word rule rejects."""

import random

from pagewell.llm import quality


def test_only_the_word_rule_rejects(frame):
    rng = random.Random(5)
    common = quality.COMMON_WORDS["en"]
    rare = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 8)))
    prose = lambda n: [rng.choice(common) if rng.random() < 0.18 else rare() for _ in range(n)]
    good = [" ".join(prose(rng.randrange(250, 400))) for _ in range(300)]
    junk = [" ".join(rare() for _ in range(n)) for n in (130, 200, 400)]
    junk.append(" | ".join(" ".join(rare() for _ in range(4)) for _ in range(60)))
    short = " ".join(rare() for _ in range(100))  # below the minimum, no verdict
    docs = frame([(i, t, "en") for i, t in enumerate([*good, *junk, short])])
    rows = {r["doc_id"]: r for r in quality.judged(docs, quality.QualityRules(), "doc_id").collect()}
    for i in range(300, 304):
        assert not rows[i]["base_failed"] and rows[i]["class_distance"] < 0.29 and rows[i]["word_distance"] < 0.34
    assert {i for i, r in rows.items() if not r["kept"]} == {300, 301, 302, 303}
    assert {r["doc_id"] for r in quality.clean(docs).collect()} == {*range(300), 304}
    one_limit = quality.judged(docs, quality.QualityRules(max_word_share=None), "doc_id")
    assert one_limit.where("kept").count() == 305


def test_language_in_which_no_common_word_occurs(frame):
    rng = random.Random(6)
    texts = [" ".join(f"zq{rng.randrange(9999)}" for _ in range(rng.randrange(130, 300))) for _ in range(40)]
    assert quality.clean(frame([(i, t, "de") for i, t in enumerate(texts)])).count() == 40
