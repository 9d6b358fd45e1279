"""Helpers shared by the operators: stored intermediates, words and hashes of whole Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+``; the separators are single bytes in UTF-8, so
words can be found in the bytes of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.session import ship_package, work_dir

# The word separators, as a Java class and as characters.
SPACE_CLASS = r"[ \t-\r]"
SPACES = " \t\n\x0b\f\r"
# Shuffle files of a query that ends in a table are not needed after it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
GROUP_ROWS = "parquet.block.row.count.limit"


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(
    df: DataFrame, label: str, *partitions: str, batch_rows: int | None = None, group_rows: int | None = None
) -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage, survives lost executors.

    ``batch_rows`` bounds the rows of an Arrow batch, for tables of large rows. ``group_rows`` bounds those of
    a row group: a scan holds up to 4,096 rows of one at once, and the writer looks at their size only after 100.
    """
    spark = df.sparkSession
    ship_package(spark)
    place = work_dir(spark, label)
    settings = {CLEANUP: "true"} | ({ARROW_ROWS: str(batch_rows)} if batch_rows else {})
    groups = {GROUP_ROWS: str(group_rows)} if group_rows else {}
    with _set(spark, **settings):
        df.write.options(compression="zstd", **groups).partitionBy(*partitions).parquet(place)
    table = spark.read.schema(df.schema).parquet(place)
    table.place = place
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing unfinished reads any more."""
    for table in tables:
        if place := getattr(table, "place", None):
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---- words and hashes of an Arrow batch -------------------------------------------------

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SLICE_BYTES = 1 << 20

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES * 2)
        tables = []
        for base in (BASE, BASE_INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of several texts: byte ranges, text numbers and 64-bit hashes.

    ``first[i] : first[i + 1]`` are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = IS_SPACE[data]
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = space[:-1]
            before[offsets[:-1][offsets[:-1] < n]] = True
        self.start = np.flatnonzero(~space & before)
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = space[1:]
            inner = offsets[1:-1]
            after[inner[(inner > 0) & (inner < n)] - 1] = True
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        powers, inverses = _power_tables(n + 1)
        codes = BYTE_CODE[LOWER[data]] if lower else BYTE_CODE[data]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers[:n], out=total[1:])
        self._total, self._inverses = total, inverses
        self.hash = self.range_hash(self.start, self.end)

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; those of whole words are ``hash``."""
        return mix((self._total[end] - self._total[start]) * self._inverses[start])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where ``size`` words of one text follow each other, and the hash of each."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return at, sequence_hash([self.hash[at + i] for i in range(size)])


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the words in their order, whatever their number."""
    total = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        total = mix(total * BASE + part)
    return total


def rolling_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` entries, for long runs; as a polynomial, in one pass."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverses[: n - size + 1])


def word_hash(word: str) -> int:
    """The hash that ``Words`` gives a lower-cased word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of a batch, at most ``limit`` bytes together or one longer text.

    Gives first row, end row, the bytes and the offsets of the texts in them. Nulls
    count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        lo = offsets[at]
        yield at, end, data[lo : offsets[end]], offsets[at : end + 1] - lo
        at = end


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists from flat values; ``ends`` has the start 0 and every end."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
