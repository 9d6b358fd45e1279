"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint bit is 1 where over half of a text's 3-word shingles, repeats included, have it in
their XXH64. Fingerprints with at most two differing bits are linked. Seven bit masks cover the 64
bits: each bit is given a non-zero vector of three bits, and mask v keeps the bits whose vector has
an odd product with v. The vectors of two differing bits never span the whole space, so some mask
keeps neither of them, and the pair is equal under that mask: no link is missed.

Distinct fingerprints are dealt by (mask, kept bits, fingerprint) into sorted ranges, so that a bucket
may lie in many tasks and none of them holds a hot one. A bucket of up to ``SMALL`` members that
lies inside one range is compared in place, and a spanning forest of its links is passed on. The
members of a longer or cut bucket name their centres instead: their own value and those
with one free bit flipped. Two fingerprints with a common centre differ in at most two bits, and
any two that differ in at most two have one; a centre has at most 65 members. So long
buckets are exact as well, without pairs.

Defined results: null, empty and wordless texts have the fingerprint zero and are linked like any
other; texts of one or two words have one shingle of them all; repeated rows have equal fingerprints;
null ids are never a component's smallest id unless there is no other; an empty table gives an
empty result; texts are read whole; extra columns of any name are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.llm.common import discard, signed, written
from pagewell.llm.components import components

SHINGLE = 3
BITS = 64
RADIUS = 2
SEED = 42
# Members of a bucket that are compared with each other in place.
SMALL = 64
# A key of more than one in this many rows is hot: there are fewer such keys than this.
HOT_SHARE = 1000
_CHUNK = 1 << 15


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any ``radius`` bits are all left out of at least one."""
    size = 2 ** (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    width = min(SHINGLE, len(words))
    starts, ends = (end - size)[: len(words) - width + 1], end[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = slice(at, at + _CHUNK)
        hashes = np.array(
            [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())],
            "<u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, *keep: str) -> DataFrame:
    """Struct ``doc`` of the ``keep`` columns, and ``print`` (the fingerprint's 64 bits as a long)."""
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"), F.col("text").cast("string").alias("text")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(signed(prints))], names=["doc", "print"])

    return source.mapInArrow(measure, f"doc {source.schema['doc'].dataType.simpleString()}, print bigint")


def as_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a few fingerprints: (member, root) of every other member."""
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= RADIUS
    label = np.arange(len(prints))
    while True:
        lower = np.where(close, label[None, :], len(prints)).min(1)
        if (lower == label).all():
            break
        label = lower
    other = label != np.arange(len(prints))
    return prints[other], prints[label[other]]


def _from_range(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Links (member, root) and centre rows (centre, member) from one sorted range of bucket rows.

    The range's first and last bucket may go on in its neighbours, so they name centres.
    """
    free = [np.array([0] + [1 << i for i in range(BITS) if not mask >> i & 1], np.uint64) for mask in covering_masks()]

    def out(kind: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind)), pa.array(signed(a)), pa.array(signed(b))], names=["is_link", "a", "b"]
        )

    def centres(mask: int, prints: np.ndarray) -> pa.RecordBatch:
        flips = free[mask]
        return out(False, (prints[:, None] ^ flips).ravel(), np.repeat(prints, len(flips)))

    key, held, cut = None, np.zeros(0, np.uint64), True  # ``cut``: the bucket held has named centres or must
    for batch in batches:
        if not batch.num_rows:
            continue
        mask = batch.column("mask").to_numpy()
        value = batch.column("value").to_numpy()
        prints = batch.column("print").to_numpy().view(np.uint64)
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(mask)]])
        long_enough = ends - starts > 1
        long_enough[[0, -1]] = True  # these may belong with rows of other batches
        for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist()):
            if (mask[a], value[a]) != key:
                if key is not None:
                    if cut:
                        yield centres(key[0], held)
                    elif len(held) > 1:
                        yield out(True, *_forest(held))
                    cut = False
                key, held = (mask[a], value[a]), held[:0]
            held = np.concatenate([held, prints[a:b]])
            if len(held) > small:
                cut = True
            while cut and len(held) > small:
                yield centres(key[0], held[:_CHUNK])
                held = held[_CHUNK:]
    if key is not None:
        yield centres(key[0], held)


def links(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) with the same components as all pairs of distinct ``print`` of at most two differing bits."""
    tables = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(int(np.uint64(mask).view(np.int64))).alias("value"))
            for i, mask in enumerate(covering_masks())
        ]
    )
    rows = prints.select("print", F.explode(tables).alias("t")).select("t.mask", "t.value", "print")
    by = ["mask", "value", "print"]
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    found = written(ranges.mapInArrow(lambda rows: _from_range(rows, small), "is_link boolean, a bigint, b bigint"), "simhash-buckets")
    around = found.where("not is_link").groupBy("a").agg(F.collect_set("b").alias("members")).where("size(members) > 1")
    stars = around.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    table = written(found.where("is_link").select("a", "b").union(stars.where("a <> b")).distinct(), "simhash-links")
    discard(found)
    return table


def by_key(rows: DataFrame, side: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``side``, which has every key once and the number ``n`` of its rows.

    Hot keys, of which there are fewer than ``HOT_SHARE``, are broadcast; the others meet in a shuffle.
    """
    is_hot = F.col("n") * HOT_SHARE > total
    hot, rest = side.where(is_hot).drop("n"), side.where(~is_hot).drop("n")
    few = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return few.unionByName(others)


def grouped(docs: DataFrame, *keep: str, doc_id: str = "doc_id") -> DataFrame:
    """Struct ``doc`` of the ``keep`` columns (``doc_id`` among them), ``print`` and component_id."""
    rows = written(fingerprinted(docs, *keep), "fingerprints")
    own_id = F.col("doc").getField(doc_id)
    least = F.struct(own_id.isNull().alias("none"), own_id.alias("id"))
    prints = written(rows.groupBy("print").agg(F.min(least).alias("least"), F.count("*").alias("n")), "prints")
    found = links(prints.select("print"))
    labels = components(found).select(F.col("node").alias("print"), "label")
    # Only fingerprints in a link need a look at the others of their component.
    named = written(prints.join(labels, "print"), "labelled")
    groups = named.groupBy("label").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    linked = by_key(named.select("print", "label"), groups, "label", named.count()).select("print", "first")
    ids = prints.join(linked, "print", "left").select("print", F.coalesce("first", "least")["id"].alias("component_id"), "n")
    ids = written(ids, "print-ids")
    discard(prints, found, named)
    return by_key(rows, ids, "print", rows.count())
