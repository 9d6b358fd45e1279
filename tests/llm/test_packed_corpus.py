"""The pipeline's last stage delivers the packed corpus: the ids of every piece of every copy."""

from collections import Counter

import numpy as np
from test_pipeline import COLUMNS, corpus

import corpus_pipeline
from pagewell.llm.packing import LENGTH
from pagewell.llm.tokens import encoder


def expected(texts):
    """Pieces of token ids, an end token each; the short piece comes first."""
    out = Counter()
    for doc_id, text in texts:
        ids = (*np.frombuffer(encoder().encode(text or ""), "<u4").tolist(), 0)
        first = len(ids) % LENGTH or LENGTH
        for k, lo in enumerate([0, *range(first, len(ids), LENGTH)]):
            out[doc_id, k, lo, ids[lo : lo + LENGTH if lo else first]] += 1
    return out


def test_ids_of_the_last_stage(spark, frame):
    rows = corpus()
    long = [(7000, " ".join(f"w{i}" for i in range(3000)), "en", "s0", 1, None, None)]
    rows = rows + rows[:5] + long  # some in two copies
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "packed sequences"
    got = stage(spark, frame(rows).select(*COLUMNS), "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == expected([r[:2] for r in rows])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], {})[r["offset"]] = r["ids"]
    for parts in sequences.values():  # pieces lie end to end
        ends = [0, *np.cumsum([len(parts[at]) for at in sorted(parts)]).tolist()]
        assert sorted(parts) == ends[:-1] and ends[-1] <= LENGTH
