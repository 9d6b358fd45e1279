"""Katz backoff over words: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

A text's tokens are its lower-cased words and one end. The distribution of single tokens is the
base, (c + 0.5) / (N + 0.5 (V + 1)), which leaves a share for one unknown word. For longer
contexts, counts up to ``K`` are discounted by Good and Turing's estimate from the counts of
counts of that order, and the mass set free goes to words unseen after the context, in proportion
to the next shorter context's distribution:

    P(w | h) = d(c(hw)) c(hw) / T(h)     if c(hw) > 0
             = alpha(h) P(w | h')        otherwise, h' being h without its first word
    alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of P(w | h') over the same w)

T(h) is the number of tokens after h, plus one where no count after h is discounted, so
that every context keeps mass for unseen words. Contexts never seen in training pass their words
on to the shorter context. Where the counts of counts give no discount between 0 and 1, (r - 0.5) / r
is used.

The corpus stays in blocks of documents; each block asks for the counts of its own n-grams and
the weights of its own contexts, and scores its texts token by token. The model is stored in tables
partitioned by bucket: n-grams with counts, and contexts with their weights.

Defined results: a null text is empty and has the end as its only token; repeated rows count
as often as they occur; with no training rows only the base's share of unknown words is left; an
empty table gives an empty result; extra columns of any name are carried inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.blocks import (
    BATCH_ROWS,
    SUMMARY,
    answered,
    asked,
    blocked,
    buckets_for,
    joined,
    with_answers,
    opened,
    received,
)
from pagewell.llm.common import Words, discard, mix, sequence_hash, text_slices, written

ORDER = 2
K = 5  # counts beyond K are not discounted
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)


@dataclass
class Totals:
    """What is the same for all blocks: corpus sizes, and the discounts of each order."""

    tokens: int = 0
    distinct: int = 0
    discounts: list[np.ndarray] = field(default_factory=list)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


class Block:
    """The tokens of a block's texts and their n-grams, as distinct sorted keys per order."""

    def __init__(self, block: dict, order: int):
        tokens, texts = [], []
        for at, _, data, offsets in text_slices(block["texts"]):
            words = Words(data, offsets)
            n = len(offsets) - 1
            flat = np.full(len(words.hash) + n, END)
            place = np.arange(len(words.hash)) + words.text  # one end after each earlier text
            flat[place] = words.hash
            tokens.append(flat)
            texts.append(np.repeat(np.arange(at, at + n), np.diff(words.first) + 1))
        empty = np.zeros(0, np.int64)
        self.tokens = np.concatenate(tokens or [empty.astype(np.uint64)])
        self.text = np.concatenate(texts or [empty])
        self.n_texts = len(block["texts"])
        held_out = block["rows"].field("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.held_out = held_out
        self.trains = ~held_out[self.text]
        self.order = order

    def history(self, back: int) -> np.ndarray:
        """The token that stands ``back`` places before each token; START before a text."""
        if not back:
            return self.tokens
        before = np.full(len(self.tokens), START)
        same = np.zeros(len(self.tokens), bool)
        same[back:] = self.text[back:] == self.text[:-back]
        before[same] = self.tokens[:-back][same[back:]]
        return before

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n-gram that ends at each token."""
        if n == 1:
            return self.tokens
        return sequence_hash([self.history(i) for i in reversed(range(n))])

    def contexts(self, n: int) -> np.ndarray:
        """The hash of the ``n - 1`` tokens before each token, apart from that of n-grams."""
        return mix(sequence_hash([self.history(i) for i in reversed(range(1, n))]) + np.uint64(1))


def _grams_asked(order: int, n: int):
    def ask(row: dict):
        block = Block(row, order)
        keys, at = np.unique(block.grams(n), return_inverse=True)
        return keys, [np.bincount(at[block.trains], minlength=len(keys)).astype(np.int64)]

    return ask


def _counts(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """For each asked n-gram its count, and whether this block is the one to account for it."""
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, at, values[0])
    owner = np.zeros(len(keys), bool)
    owner[first] = sums > 0
    return [sums[at], owner]


def _tallied(found: list[np.ndarray]) -> np.ndarray:
    """Of a bucket's n-grams: the sum of their counts, how many there are, and how many have each count 1 .. K + 1."""
    counts, owner = found
    counts = counts[owner]
    few = np.bincount(counts[counts <= K + 1], minlength=K + 2)
    return np.array([counts.sum(), len(counts), *few[1:]], np.int64)


class Scorer:
    """Probabilities of a block's tokens from the answers it got, order by order."""

    def __init__(self, row: dict, order: int, totals: Totals):
        self.block, self.totals, self.row = Block(row, order), totals, row

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token the count of its n-gram, and at one token of each n-gram that is ours whether it is."""
        _, first, at = np.unique(self.block.grams(n), return_index=True, return_inverse=True)
        owner = np.zeros(len(at), bool)
        owner[first] = joined(self.row[f"counts{n}"], 1, "?")
        return joined(self.row[f"counts{n}"], 0, np.int64)[at], owner

    def discounted(self, n: int, counts: np.ndarray) -> np.ndarray:
        return counts * self.totals.discounts[n][np.minimum(counts, K + 1)]

    def probabilities(self, n: int) -> np.ndarray:
        """P of each token after the ``n - 1`` tokens before it."""
        if n == 1:
            return self.totals.base(self.counts(1)[0])
        shorter = self.probabilities(n - 1)
        counts, _ = self.counts(n)
        _, at = np.unique(self.block.contexts(n), return_inverse=True)
        total, alpha = (joined(self.row[f"contexts{n}"], i, float)[at] for i in (0, 1))
        seen = self.discounted(n, counts) / np.maximum(total, 1)
        return np.where(counts > 0, seen, np.where(total > 0, alpha, 1.0) * shorter)

    def sums(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Contexts of the block, and over the n-grams it accounts for: counts, discounted counts, shorter P."""
        counts, owner = self.counts(n)
        keys, at = np.unique(self.block.contexts(n), return_inverse=True)
        at, counts = at[owner], counts[owner]
        shorter = self.probabilities(n - 1)[owner]
        parts = (counts, self.discounted(n, counts), shorter)
        count, *others = (np.bincount(at, p, len(keys)).astype(float) for p in parts)
        return keys, [count.astype(np.int64), *others]


def _weights(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """T(h), 0 if h is unknown, and alpha(h)."""
    distinct, at = np.unique(keys, return_inverse=True)
    count, mass, shorter = (np.bincount(at, v, len(distinct)) for v in values)
    total = count + (count - mass < 1e-9 * np.maximum(count, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = (1 - mass / total) / (1 - shorter)
    total[count == 0] = 0
    return [total.astype(np.int64)[at], np.where(count > 0, alpha, 1.0)[at]]


def discounts(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Factor for each count 0 .. K, and at K + 1 for all larger ones."""
    factors = np.ones(K + 2)
    n = [0.0] + [float(counts_of_counts.get(r, 0)) for r in range(1, K + 2)]
    tail = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (good - tail) / (1 - tail) if tail != 1 else 0.0
        factors[r] = d if 0 < d < 1 else (r - 0.5) / r
    return factors


class Model:
    """Blocks of documents with everything that is known of their n-grams; scores once."""

    def __init__(self, docs: DataFrame, held_out: str, *keep: str, order: int = ORDER):
        self.order, self.totals = order, Totals(discounts=[np.zeros(0)] * 2)
        self.blocks = blocked(docs.withColumn("held_out", F.col(held_out)), "held_out", *keep)
        self.buckets = buckets_for(self.blocks)
        self.answers: list[DataFrame] = []
        self.tables: dict[str, DataFrame] = {}
        for n in range(1, order + 1):
            self._count(n)
            if n > 1:
                self._weigh(n)

    def _known(self) -> DataFrame:
        return with_answers(self.blocks, *self.answers)

    def _store(self, messages: DataFrame, kinds: str, names: list[str], combine, label: str) -> DataFrame:
        """The model's table: a row per bucket, with the sums of its distinct keys as arrays."""

        def table(part: pa.Table) -> pa.Table:
            keys, values = received(part, kinds)
            keys = np.concatenate(keys)
            distinct, first = np.unique(keys, return_index=True)
            found = [x[first] for x in combine(keys, values)]
            used = found[0] > 0
            columns = {"bucket": part["bucket"].slice(0, 1), "keys": pa.array([distinct[used].view(np.int64)])}
            for name, column in zip(names, found):
                columns[name] = pa.array([column[used]], pa.list_(pa.int64() if name == "counts" else pa.float64()))
            return pa.table(columns)

        fields = ", ".join(f"{n} array<{'bigint' if n == 'counts' else 'double'}>" for n in names)
        rows = messages.groupBy("bucket").applyInArrow(table, f"bucket int, keys array<bigint>, {fields}")
        return written(rows, label, "bucket", batch_rows=BATCH_ROWS)

    def _count(self, n: int) -> None:
        # Asked anew for the table rather than kept: the questions are large. Answers and tallies come from
        # one asking, as each shuffles all of them.
        messages = asked(self.blocks, _grams_asked(self.order, n), self.buckets)
        answers = answered(messages, "l", _counts, f"counts{n}", _tallied)
        answers = written(answers, f"counts-{n}", batch_rows=BATCH_ROWS)
        self.answers.append(answers)
        # One row of K + 3 numbers for each bucket.
        rows = answers.filter(F.col("block") == SUMMARY).first()
        found = sum((np.frombuffer(a[0], np.int64) for a in rows[1]), np.zeros(K + 3, np.int64)) if rows else np.zeros(K + 3)
        tokens, distinct, *few = map(int, found)
        if n == 1:
            self.totals.distinct, self.totals.tokens = distinct, tokens
        else:
            self.totals.discounts.append(discounts(dict(enumerate(few, 1))))

    def store_counts(self) -> None:
        """The tables of n-grams; written last, as nothing here reads them."""
        for n in range(1, self.order + 1):
            messages = asked(self.blocks, _grams_asked(self.order, n), self.buckets)
            self.tables[f"grams{n}"] = self._store(messages, "l", ["counts"], _counts, f"model-grams-{n}")

    def _weigh(self, n: int) -> None:
        order, totals = self.order, self.totals
        messages = asked(self._known(), lambda row: Scorer(row, order, totals).sums(n), self.buckets)
        messages = written(messages, f"contexts-{n}", batch_rows=BATCH_ROWS)
        self.answers.append(written(answered(messages, "ldd", _weights, f"contexts{n}"), f"weights-{n}"))
        self.tables[f"contexts{n}"] = self._store(
            messages, "ldd", ["totals", "alphas"], _weights, f"model-contexts-{n}"
        )
        discard(messages)

    def scored(self) -> DataFrame:
        """Struct ``row`` (held_out and the kept columns) with the scores of every text."""
        order, totals = self.order, self.totals
        row = self.blocks.schema["rows"].dataType.elementType
        schema = self.blocks.select().schema.add("row", row)
        for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
            schema = schema.add(name, kind)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = opened(batch, i)
                    scorer = Scorer(row, order, totals)
                    text, n = scorer.block.text, scorer.block.n_texts
                    counts, _ = scorer.counts(1)
                    columns = [
                        row["rows"],
                        pa.array(np.bincount(text, minlength=n), pa.int64()),
                        pa.array(np.bincount(text, counts > 0, n).astype(np.int64)),
                        pa.array(np.bincount(text, np.log10(totals.base(counts)), n)),
                        pa.array(np.bincount(text, np.log10(scorer.probabilities(order)), n)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        done = written(self._known().mapInArrow(score, schema), "scores", batch_rows=BATCH_ROWS)
        discard(*self.answers)
        self.store_counts()
        discard(self.blocks)
        return done
