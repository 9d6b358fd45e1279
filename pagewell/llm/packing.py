"""Packing by patterns: few-document length patterns fitted to the histogram of lengths.

Documents become token sequences, an end token each, and only those longer than a sequence
are cut. All patterns of two pieces and a spread of those of three that fill a sequence
exactly are weighted by non-negative least squares against the histogram, rounded to whole
repeats by largest remainder, and what is left is packed best-fit, again by lengths and counts. Histogram,
patterns and plan are bounded by the sequence length, whatever the corpus; the pieces
stay in Spark. A piece's place follows from its rank among the pieces of its length.

Defined results: a null or empty text is the end token alone; every row is packed, so
repeated rows take a place each and a null id is carried as it is; a text of any length is
cut into pieces; among pieces of one length the order is free; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewell.llm.common import written
from pagewell.llm.tokens import encoder

LENGTH = 2048
END = 0
TRIPLES = 24  # partners tried for the longest piece of a three-piece pattern
STEPS = 600
SHARES = (1.0, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5)  # of the fitted repeats, tried for the rounding
GROUP_ROWS = 2_000  # pieces of one length that are numbered together


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, the ids of every piece."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, number, start, size, crc, values = [], [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    data = encode(text.as_py() or "") + end
                    n = len(data) // 4
                    lo, hi = 0, n % length or length
                    k = 0
                    while lo < n:
                        hi = min(hi, n)
                        piece = data[4 * lo : 4 * hi]
                        row.append(i)
                        number.append(k)
                        start.append(lo)
                        size.append(hi - lo)
                        crc.append(zlib.crc32(piece))
                        if ids:
                            values.append(piece)
                        lo, hi, k = hi, hi + length, k + 1
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(row, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if ids:
                    flat = np.frombuffer(b"".join(values), "<i4")
                    ends = np.cumsum([0, *size], dtype=np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_pydict(columns)

    text = F.col("text").cast("string").alias("text")
    return docs.select("doc_id", text).mapInArrow(cut, schema + (", ids array<int>" if ids else ""))


# ---- the plan: patterns and how often each is used, from the histogram alone -------------


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    repeats: int


def candidate_patterns(lengths: np.ndarray, total: int) -> list[np.ndarray]:
    """Patterns of two and of three of these lengths that add up to ``total``, as (n, k) arrays.

    Of three pieces, the longest is tried with ``TRIPLES`` evenly spread middle ones.
    """
    present = np.zeros(total + 1, bool)
    present[lengths] = True
    pairs = lengths[(lengths * 2 >= total) & (lengths < total)]
    pairs = pairs[present[total - pairs]]
    found = [np.stack([pairs, total - pairs], 1)]
    triples = []
    for a in lengths[(lengths * 3 >= total) & (lengths < total - 1)]:
        b = np.arange(-(-(total - a) // 2), min(a, total - a - 1) + 1)
        b = b[present[b] & present[total - a - b]]
        if len(b) > TRIPLES:
            b = b[np.linspace(0, len(b) - 1, TRIPLES).astype(int)]
        triples.append(np.stack([np.full(len(b), a), b, total - a - b], 1))
    found.append(np.concatenate(triples) if triples else np.zeros((0, 3), int))
    return found


def fitted(patterns: list[np.ndarray], histogram: np.ndarray) -> list[np.ndarray]:
    """Repeat counts, not negative, whose lengths come closest to the histogram (squared error).

    Accelerated projected gradient; a fixed number of steps over a bounded set.
    """
    members = np.concatenate([p.ravel() for p in patterns])
    owner = np.concatenate(
        [np.repeat(np.arange(len(p)) + before, p.shape[1]) for p, before in zip(patterns, (0, len(patterns[0])))]
    )
    n = sum(map(len, patterns))
    if not n:
        return [np.zeros(0) for _ in patterns]
    # Each length's error counts relative to how many pieces have it.
    weight = 1 / np.sqrt(np.maximum(histogram, 1))
    uses = np.bincount(members, minlength=len(histogram))
    step = 1 / max(1e-9, 3 * float((uses * weight**2).max()))
    x = y = np.zeros(n)
    momentum = 1.0
    for _ in range(STEPS):
        error = (np.bincount(members, y[owner], len(histogram)) - histogram) * weight**2
        after = np.maximum(0, y - step * np.bincount(owner, error[members], n))
        faster = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        y = after + (momentum - 1) / faster * (after - x)
        x, momentum = after, faster
    return [x[: len(patterns[0])], x[len(patterns[0]) :]]


def best_fit(histogram: np.ndarray, total: int) -> list[Pattern]:
    """Best-fit decreasing on lengths with counts: equal bins are one entry with a number."""
    left = histogram.copy()
    spaces: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(total + 1)]
    open_spaces = np.zeros(total + 1, bool)
    for size in range(total, 0, -1):
        n = int(left[size])
        while n:
            fits = np.flatnonzero(open_spaces[size:])
            if len(fits):
                space = size + int(fits[0])
                lengths, count = spaces[space].pop()
                open_spaces[space] = bool(spaces[space])
            else:
                space, lengths, count = total, (), n
            each = min(space // size, n)
            used = min(count, n // each)
            if lengths and used < count:
                spaces[space].append((lengths, count - used))
                open_spaces[space] = True
            rest = space - each * size
            spaces[rest].append((lengths + (size,) * each, used))
            open_spaces[rest] = True
            n -= used * each
    return [Pattern(lengths, count) for group in spaces for lengths, count in group]


def plan(histogram: np.ndarray, total: int = LENGTH) -> list[Pattern]:
    """Patterns whose repeats use up the histogram exactly (index: length).

    The last patterns to be rounded up may leave lengths that go badly together, so rounding
    is also stopped earlier; of the plans with the fewest sequences the one with the most repeats
    of fitted patterns is taken.
    """
    left = histogram.astype(np.int64).copy()
    whole = [Pattern((total,), int(left[total]))] if left[total] else []
    left[total] = 0
    patterns = candidate_patterns(np.flatnonzero(left), total)
    repeats = fitted(patterns, left.astype(float))
    best: list[Pattern] | None = None
    for share in SHARES:
        chosen, residual = rounded(patterns, repeats, left, share)
        found = chosen + best_fit(residual, total)
        if best is None or sum(p.repeats for p in found) < sum(p.repeats for p in best):
            best = found
    return whole + best


def rounded(
    patterns: list[np.ndarray], weights: list[np.ndarray], histogram: np.ndarray, share: float
) -> tuple[list[Pattern], np.ndarray]:
    """Whole repeats by largest remainder, up to ``share`` of the fitted sum, and the lengths left over."""
    left, chosen = histogram.copy(), []
    members = [row for group in patterns for row in group]
    weight = np.concatenate(weights)
    whole = np.floor(weight).astype(np.int64)
    goal, used = int(share * weight.sum()), 0

    def take(at: int, wanted: int) -> int:
        needs = np.bincount(members[at], minlength=1)
        lengths = np.flatnonzero(needs)
        n = min(wanted, int((left[lengths] // needs[lengths]).min()))
        if n > 0:
            left[lengths] -= n * needs[lengths]
            chosen.append(Pattern(tuple(int(v) for v in members[at]), n))
        return n

    for at in np.argsort(-weight, kind="stable"):
        if not whole[at]:
            break
        used += take(at, int(whole[at]))
    for at in np.argsort(whole - weight, kind="stable"):
        if used >= goal:
            break
        used += take(at, 1)
    return chosen, left


def places(patterns: list[Pattern]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From (length, rank among the pieces of that length) to (sequence_id, offset)."""
    rows, base = [], 0
    for p in patterns:
        offset = 0
        for size in p.lengths:
            rows.append((size, base, offset, p.repeats))
            offset += size
        base += p.repeats
    size, first, offset, repeats = np.array(rows, np.int64).reshape(-1, 4).T
    order = np.argsort(size, kind="stable")
    size, first, offset, repeats = size[order], first[order], offset[order], repeats[order]
    ends = np.cumsum(repeats)
    starts = ends - repeats
    begin = np.zeros(size.max(initial=0) + 2, np.int64)  # rank 0 of each length on the common line
    np.add.at(begin, size + 1, repeats)
    begin = np.cumsum(begin)

    def look_up(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        on_line = begin[length] + rank
        at = np.searchsorted(ends, on_line, side="right")
        return first[at] + on_line - starts[at], offset[at]

    return look_up


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ids: bool = True) -> DataFrame:
    """Every piece with its sequence and its place in it."""
    cut = written(pieces(docs, length, vocabulary, ids), "pieces")
    # At most ``length`` rows reach the driver.
    counts = cut.groupBy("length").count().collect()
    histogram = np.zeros(length + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["count"]
    look_up = places(plan(histogram, length))
    # Ranks: numbered inside groups of bounded size, moved by the sizes of the groups before. A frequent
    # length has more groups, so there are at most ``length`` groups more than pieces need.
    groups = np.maximum(1, -(-histogram[1:] // GROUP_ROWS))
    own = F.element_at(F.lit(groups.tolist()), F.col("length").cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), own).cast("int"))
    sizes = cut.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("n", F.row_number().over(inside) - 1).join(firsts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("n")).drop("first", "n", "part")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = look_up(
                batch.column("length").to_numpy(zero_copy_only=False),
                batch.column("rank").to_numpy(zero_copy_only=False),
            )
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(placed, schema).select(*cut.drop("part").columns, "sequence_id", "offset")
