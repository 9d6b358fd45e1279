"""Substring deduplication: seed, extend, keep maximal repeats.

Every window of ``LENGTH`` words has an anchor: the run of ``SEED`` words in it with the smallest
hash (winnowing). Equal windows have equal anchors, so only windows whose anchor occurs elsewhere
can be repeats. Those are extended: the words to both sides of the anchor, up to the window's ends,
are compared by a hash of the whole window, for every window that contains the anchor. Windows found
again elsewhere overlap or touch where a repeat goes on; their union is the set of maximal
repeats of at least ``LENGTH`` words. Comparison is by 64-bit hashes of words and windows.

All occurrences of a repeat are removed. Defined results: null, empty and shorter texts keep all
their words; a text that occurs twice loses all its words if it has ``LENGTH`` of them; repeats inside
one document count, overlapping ones too; repeated rows are documents of their own; an empty table
gives an empty result; extra columns of any name are carried inside a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.blocks import (
    BATCH_ROWS,
    answered,
    asked,
    blocked,
    buckets_for,
    joined,
    opened,
    with_answers,
)
from pagewell.llm.common import Words, discard, mix, rolling_hash, text_slices, written

LENGTH = 35
SEED = 16


def _starts(words: Words, length: int) -> np.ndarray:
    """Word positions where a window of ``length`` words of one text begins."""
    n = len(words.hash) - length + 1
    return np.flatnonzero(words.text[:n] == words.text[length - 1 :]) if n > 0 else np.zeros(0, np.int64)


def _anchors(words: Words, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    """For each window the hash of its anchor."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(rolling_hash(words.hash, seed), length - seed + 1)
    return np.concatenate([views[s].min(1) for s in np.array_split(starts, len(starts) // 65536 + 1)])


def _counted(found: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of a block and whether each occurs twice in it."""
    keys, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
    return keys, [counts > 1]


def _elsewhere(keys: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Whether a key was sent by several blocks or occurs twice in one."""
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[at[values[0]]] = True
    return [twice[at]]


class Repeats:
    """Windows of a block, slice by slice, as the passes need them."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed = length, seed

    def slices(self, block: dict) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
        for at, _, data, offsets in text_slices(block["texts"]):
            words = Words(data, offsets, lower=False)
            starts = _starts(words, self.length)
            yield at, words, starts, _anchors(words, starts, self.length, self.seed)

    def anchors(self, block: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct anchors; twice if two anchors at different places have this hash.

        An anchor is the smallest of several hashes; mixed anew, it is as likely in every bucket.
        """
        found = []
        for _, words, starts, anchors in self.slices(block):
            runs = rolling_hash(words.hash, self.seed)
            # Neighbouring windows share an anchor; it counts once for each place it has.
            here = np.zeros(len(runs), bool)
            if len(starts):
                marks = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(marks, starts, 1)
                np.add.at(marks, np.minimum(starts + self.length - self.seed + 1, len(words.hash)), -1)
                inside = np.cumsum(marks)[: len(runs)] > 0
                here = inside & np.isin(runs, anchors)
            found.append(mix(runs[here]))
        return _counted(found)

    def candidates(self, block: dict) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
        """Starts and hashes of the windows whose anchor occurs elsewhere."""
        asked_keys, _ = self.anchors(block)
        repeated = asked_keys[joined(block["anchors"], 0, "?")]
        for at, words, starts, anchors in self.slices(block):
            starts = starts[np.isin(mix(anchors), repeated)]
            yield at, words, starts, rolling_hash(words.hash, self.length)[starts] if len(starts) else starts.astype(
                np.uint64
            )

    def windows(self, block: dict) -> tuple[np.ndarray, list[np.ndarray]]:
        return _counted([hashes for *_, hashes in self.candidates(block)])

    def covered(self, block: dict) -> Iterator[tuple[int, Words, np.ndarray]]:
        """First text, words and whether each word lies in a repeat."""
        found = list(self.candidates(block))
        keys, _ = _counted([hashes for *_, hashes in found])
        repeated = keys[joined(block["windows"], 0, "?")]
        for at, words, starts, hashes in found:
            marks = np.zeros(len(words.hash) + 1, np.int64)
            hit = starts[np.isin(hashes, repeated)]
            marks[hit] += 1
            marks[hit + self.length] -= 1
            yield at, words, np.cumsum(marks[:-1]) > 0


def _kept_text(words: Words, gone: np.ndarray, text: int) -> str:
    """The text without the removed words and the space that follows each."""
    lo, hi = words.first[text], words.first[text + 1]
    begin, end = words.offsets[text], words.offsets[text + 1]
    edges = np.concatenate([words.start[lo:hi], [end]])
    parts = [words.data[begin : edges[0]].tobytes()]
    turns = np.flatnonzero(np.diff(gone[lo:hi].astype(np.int8), prepend=1, append=1))
    for a, b in zip(turns[::2], turns[1::2]):
        parts.append(words.data[edges[a] : edges[b]].tobytes())
    return b"".join(parts).decode()


def deduplicated(
    docs: DataFrame, *keep: str, length: int = LENGTH, seed: int = SEED, texts: bool = True
) -> DataFrame:
    """Struct ``row`` of the ``keep`` columns, n_words, n_removed, kept_sha256 and, if asked, the kept text."""
    repeats = Repeats(length, seed)
    blocks = blocked(docs, *keep)
    buckets = buckets_for(blocks)
    anchors = answered(asked(blocks, repeats.anchors, buckets), "?", _elsewhere, "anchors")
    anchors = written(anchors, "anchor-answers", batch_rows=BATCH_ROWS, group_rows=BATCH_ROWS)
    messages = asked(with_answers(blocks, anchors), repeats.windows, buckets)
    # A block sends a message to each bucket.
    messages = written(messages, "window-questions", batch_rows=BATCH_ROWS, group_rows=BATCH_ROWS * buckets)
    windows = written(answered(messages, "?", _elsewhere, "windows"), "window-answers", group_rows=BATCH_ROWS)
    discard(messages)
    row = blocks.schema["rows"].dataType.elementType
    schema = blocks.select().schema.add("row", row).add("n_words", "long").add("n_removed", "long")
    schema = schema.add("kept_sha256", "string")
    if texts:
        schema = schema.add("text", "string")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = opened(batch, i)
                for at, words, gone in repeats.covered(block):
                    n = len(words.first) - 1
                    sums = np.concatenate([[0], np.cumsum(gone)])
                    removed = sums[words.first[1:]] - sums[words.first[:-1]]
                    digests, kept = [], []
                    raw = words.data.tobytes()
                    for t in range(n):
                        text = raw[words.offsets[t] : words.offsets[t + 1]]
                        left: Iterator[bytes] = iter(text.split())
                        if removed[t]:
                            left = compress(left, ~gone[words.first[t] : words.first[t + 1]])
                        digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                        if texts:
                            kept.append(_kept_text(words, gone, t) if removed[t] else text.decode())
                    columns = [
                        block["rows"].slice(at, n),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(digests, pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns + ([pa.array(kept, pa.string())] if texts else []), names=schema.names
                    )

    final = with_answers(blocks, anchors, windows).mapInArrow(remove, schema)
    done = written(final, "without-repeats", batch_rows=BATCH_ROWS)
    discard(blocks, anchors, windows)
    return done


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their own columns, their texts (and ``n_chars``) without repeats."""
    done = deduplicated(docs, *[c for c in docs.columns if c != "text"], length=length)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
