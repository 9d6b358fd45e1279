"""Blocks of documents that ask for corpus-wide facts about their keys.

A block is a row that holds some megabytes of documents. To learn how often something occurs in
the whole corpus, every block sends each of its distinct keys once, with what it knows about
it, to the bucket of the key's range; a bucket joins what it got and answers every block in the order
in which that block asked. So a key that is everywhere is sent once per block, however
many documents have it, and answers need no keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from pagewell.llm.common import written

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20  # text per bucket of keys
BATCH_ROWS = 4
SUMMARY = -1  # the block that summaries of buckets are answers to


def block_schema(row: StructType) -> StructType:
    return StructType().add("block", "long").add("bytes", "long").add("rows", ArrayType(row)).add(
        "texts", ArrayType(StringType())
    )


def blocked(docs: DataFrame, *keep: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the documents: their ``keep`` columns as ``rows`` and whole ``texts``, null as empty.

    A block ends when it has ``limit`` bytes; one longer text makes a block of its own.
    """
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ends = pa.array([0, len(table)], pa.int32())
            columns = [
                pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in ("row", "text")
            ]
            head = [pa.array([task << 32 | number], pa.int64()), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(head + columns, names=["block", "bytes", "rows", "texts"])

        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            total = np.cumsum(lengths)
            at = 0
            while at < batch.num_rows:
                done = total[at - 1] if at else 0
                end = int(np.searchsorted(total, done + max(limit - size, 0), side="right"))
                end = max(end, at + (not held))
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(total[end - 1] - done)
                if end < batch.num_rows:
                    yield block()
                    number, held, size = number + 1, [], 0
                at = end
        if held:
            yield block()

    return written(
        source.mapInArrow(pack, block_schema(source.schema["row"].dataType)), "blocks", group_rows=BATCH_ROWS
    )


def buckets_for(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    return max(4, -(-total // BUCKET_BYTES))


def _edges(buckets: int) -> np.ndarray:
    return np.array([b * 2**64 // buckets for b in range(1, buckets)], np.uint64)


# ---- keys and arrays as bytes, in as few as hold them: most of what is shuffled and stored ----

NARROW = [np.dtype(t) for t in (np.uint8, np.uint16, np.uint32)]


def packed(values: np.ndarray) -> bytes:
    """An array for `unpacked`: whole numbers in the narrowest type that holds all of them, truths as bits."""
    if values.dtype == bool:
        return np.packbits(values).tobytes() + bytes([-len(values) % 8]) + b"?"
    if values.dtype.kind == "i" and len(values) and values.min() >= 0:
        top = values.max()
        values = values.astype(next((t for t in NARROW if top <= np.iinfo(t).max), values.dtype), copy=False)
    return values.tobytes() + values.dtype.char.encode()


def unpacked(data: bytes) -> np.ndarray:
    kind = np.dtype(chr(data[-1]))
    if kind == bool:
        bits = np.frombuffer(data, np.uint8, len(data) - 2)
        return np.unpackbits(bits, count=8 * len(bits) - data[-2]).view(bool)
    return np.frombuffer(data, kind, (len(data) - 1) // kind.itemsize)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, first all lowest bytes, then all next ones.

    The highest bytes of the steps between many keys are zeros, which compression takes away.
    """
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def received(messages: pa.Table, kinds: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The keys of each message, and the arrays of these ``kinds`` along all of them."""
    keys = [unpacked_keys(k) for k in messages["keys"].to_pylist()]
    sent = messages["values"].to_pylist()
    return keys, [np.concatenate([unpacked(row[j]) for row in sent], dtype=kind) for j, kind in enumerate(kinds)]


Asked = tuple[np.ndarray, Sequence[np.ndarray]]  # distinct sorted keys, and arrays along them


def asked(blocks: DataFrame, ask: Callable[[dict], Asked], buckets: int) -> DataFrame:
    """Every block's keys, cut into one message for each bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(buckets)
        for batch in batches:
            for i in range(batch.num_rows):
                row = opened(batch, i)
                keys, values = ask(row)
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array(np.full(len(full), row["block"]), pa.int64()),
                        pa.array([packed_keys(keys[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()),
                        pa.array(
                            [[packed(v[cuts[b] : cuts[b + 1]]) for v in values] for b in full],
                            pa.list_(pa.binary()),
                        ),
                    ],
                    names=["bucket", "block", "keys", "values"],
                )

    return blocks.mapInArrow(send, "bucket int, block bigint, keys binary, values array<binary>")


def answered(
    messages: DataFrame,
    kinds: Sequence[str],
    answer: Callable[[np.ndarray, list[np.ndarray]], Sequence[np.ndarray]],
    label: str,
    summary: Callable[[Sequence[np.ndarray]], np.ndarray] | None = None,
) -> DataFrame:
    """block and ``label``: for each bucket it asked, in order, the arrays that ``answer`` gives.

    ``answer`` gets a bucket's keys, block after block, and the arrays sent along them; it
    returns arrays of the same length. ``summary`` gets these and returns one small array for the whole
    bucket; such arrays are the answers of a further block ``SUMMARY``.
    """

    def reply(table: pa.Table) -> pa.Table:
        keys, values = received(table, kinds)
        cuts = np.cumsum([0, *map(len, keys)])
        found = answer(np.concatenate(keys), values)
        blocks, buckets = table["block"].to_pylist(), table["bucket"].to_pylist()
        arrays = [[packed(f[a:b]) for f in found] for a, b in zip(cuts, cuts[1:])]
        if summary:
            blocks, buckets = [*blocks, SUMMARY], [*buckets, buckets[0]]
            arrays.append([summary(found).tobytes()])
        return pa.table(
            {
                "block": pa.array(blocks, pa.int64()),
                "bucket": pa.array(buckets, pa.int32()),
                "arrays": pa.array(arrays, pa.list_(pa.binary())),
            }
        )

    replies = messages.groupBy("bucket").applyInArrow(reply, "block bigint, bucket int, arrays array<binary>")
    # A block's answers are as bounded as the block.
    return replies.groupBy("block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "arrays"))), lambda x: x["arrays"]).alias(label)
    )


def with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    for a in answers:
        blocks = blocks.join(a.hint("shuffle_hash"), "block", "left")
    return blocks


def opened(batch: pa.RecordBatch, i: int) -> dict:
    """A block: its number, rows and texts as Arrow arrays, and its answers as lists of bytes."""
    row: dict = {"block": batch.column("block")[i].as_py()}
    for name in batch.schema.names:
        if name in ("rows", "texts"):
            row[name] = batch.column(name)[i].values
        elif name not in ("block", "bytes"):
            row[name] = batch.column(name)[i].as_py() or []
    return row


def joined(answers: list[list[bytes]], at: int, kind: str) -> np.ndarray:
    """One of the arrays of all buckets' answers, along the keys that were asked."""
    return np.concatenate([np.zeros(0, kind), *[unpacked(a[at]) for a in answers]], dtype=kind)
