"""Text columns: words, tokens, sentences, windows, page text.

The patterns avoid lookaround and back-references, so the same pattern can be
used by any SQL engine that checks the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D ]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])[\x09-\x0D ]+"

# Character entities replaced in page text, in this order.
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
HIDDEN_BLOCK = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]*>"


def words(text: Column) -> Column:
    """Whitespace words; the unit of chunk sizes and budgets."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; the unit of matching."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def window_structs(word_array: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` words as array<struct<chunk_text, n_tokens>>."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    n = F.size(word_array)
    starts = F.sequence(
        F.lit(0), F.greatest(n - F.lit(1 + overlap), F.lit(0)), F.lit(size - overlap)
    )
    return F.when(
        n > 0,
        F.transform(
            starts,
            lambda i: F.struct(
                F.array_join(F.slice(word_array, i + 1, F.lit(size)), " ").alias("chunk_text"),
                F.least(F.lit(size), n - i).alias("n_tokens"),
            ),
        ),
    )


def sentence_pieces(text: Column, longest: int) -> Column:
    """Sentences as word arrays; one longer than ``longest`` words is cut by words."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\n")
    as_words = F.transform(F.split(marked, r"\n+"), words)
    cut = F.transform(
        as_words,
        lambda ws: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0)), F.lit(longest)),
            lambda i: F.slice(ws, i + 1, F.lit(longest)),
        ),
    )
    return F.filter(F.flatten(cut), lambda p: F.size(p) > 0)


def plain_sentences(text: Column) -> Column:
    """Sentences as strings with single blanks, none empty."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\n")
    joined = F.transform(F.split(marked, r"\n+"), lambda s: F.array_join(words(s), " "))
    return F.filter(joined, lambda s: s != "")


def pack_plan(lengths: np.ndarray, budget: int, overlap: int) -> list[list[int]]:
    """Greedy packing of sentence lengths, linear in the number of sentences.

    Each chunk is ``[lead, end, n]``: sentences ``lead .. end - 1`` holding ``n``
    words. A chunk's own sentences hold at most ``budget`` words; before them
    come the last sentences of the previous chunk, at most ``overlap`` words.
    """
    total = np.concatenate(([0], np.cumsum(lengths)))
    plan, first, previous = [], 0, 0
    while first < len(lengths):
        end = int(np.searchsorted(total, total[first] + budget, side="right")) - 1
        lead = max(int(np.searchsorted(total, total[first] - overlap, side="left")), previous)
        plan.append([lead, end, int(total[end] - total[lead])])
        previous, first = first, end
    return plan


def pack_udf(budget: int, overlap: int):
    """Only the sentence lengths travel to Python; the text stays in the JVM."""

    @F.pandas_udf("array<array<int>>")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lengths in batches:
            yield lengths.map(lambda n: None if n is None else pack_plan(n, budget, overlap))

    return pack


def page_text(html: Column) -> Column:
    """Visible text of a web page: no scripts, styles, comments or tags."""
    text = F.regexp_replace(html, HIDDEN_BLOCK, " ")
    text = F.regexp_replace(text, COMMENT, " ")
    text = F.regexp_replace(text, TAG, " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, SPACE, " "))
