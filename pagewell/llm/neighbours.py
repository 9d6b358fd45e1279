"""Nearest neighbours by shifted space-filling curves.

Every distinct vector is projected and shifted differently for each of several curves and
gets its Hilbert key there. Spark range-partitions and sorts each curve; a vector's place on a curve
is its rank. A query meets the vectors in a window around its place on every curve; what the windows
find is merged and ranked by exact distances. The half-width of the window is measured: it is the
rank distance within which, on the best curve, the wanted share of the true neighbours of a bounded
sample of queries lies (found by brute force over all vectors). So the index adapts to the data: well
separated data need a narrow window, data without structure a wide one.

Windows are cut into chunks of bounded size, and equal vectors are one entry with its smallest ids, so
no task depends on how often a vector occurs.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; a null id takes no part; repeated rows of one id and vector are
one; equal distances are ordered by the smaller id; with fewer candidates than asked all are
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewell.llm.common import written

CURVES = 16
DIMENSIONS = 8
BITS = 6
RECALL = 0.96  # share of the sample's true neighbours the window must reach
SAMPLE = 100  # queries of the sample
CHUNK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (n, dimensions).

    From the highest bit down, every set bit of a coordinate reflects the lower bits of the first,
    every clear one swaps them with its own; a Gray code then orders the cells.
    """
    axes = [column.copy() for column in cells.astype(np.int64).T]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for axis in axes:
            reflect = (axis & bit) != 0
            swap = np.where(reflect, 0, (axes[0] ^ axis) & low)
            if axis is axes[0]:
                axis ^= np.where(reflect, low, 0)
            else:
                axes[0] ^= np.where(reflect, low, swap)
                axis ^= swap
        bit >>= 1
    for previous, axis in zip(axes, axes[1:]):
        axis ^= previous
    turn = np.zeros(len(cells), np.int64)
    for place in range(1, bits):
        turn ^= np.where(axes[-1] & (1 << place), (1 << place) - 1, 0)
    keys = np.zeros(len(cells), np.int64)
    for place in reversed(range(bits)):
        for axis in axes:
            keys = (keys << 1) | (((axis ^ turn) >> place) & 1)
    return keys


@dataclass
class Curves:
    """Projections, shifts and scales of all curves; of fixed size for a given vector length."""

    centre: np.ndarray
    spread: np.ndarray
    seed: int = 11

    def keys(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        size = vectors.shape[1]
        m = min(DIMENSIONS, size)
        for curve in range(CURVES):
            axes = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :m]
            shift = rng.uniform(0, 1, m)
            scale = np.sqrt((self.spread[:, None] ** 2 * axes**2).sum(0)) + 1e-300
            z = np.clip(((vectors - self.centre) @ axes) / scale / 8 + 0.5, 0, 1)
            cells = np.minimum(((z + shift) / 2 * (1 << BITS)).astype(int), (1 << BITS) - 1)
            yield curve, hilbert_keys(cells, BITS)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 0))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    lengths = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def entries(good: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: entry (its smallest id), vector and its ``k + 1`` smallest ids.

    Ranks are limited per task before the shuffle, so a vector that is everywhere stays small.
    """
    one = Window.partitionBy("h1", "h2").orderBy("vec_id")
    hashed = good.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(1))})
    hashed = hashed.withColumn("n", F.dense_rank().over(one)).where(F.col("n") <= k + 1)
    return hashed.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("entry"),
        F.min_by("vector", "vec_id").alias("vector"),
        F.sort_array(F.collect_set("vec_id")).alias("ids"),  # at most k + 1
    )


def fitted_curves(table: DataFrame) -> Curves:
    """Centre and spread of all vectors, summed per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                yield pa.RecordBatch.from_pydict(
                    {
                        "i": pa.array(np.arange(x.shape[1]), pa.int32()),
                        "n": pa.array(np.full(x.shape[1], len(x)), pa.int64()),
                        "s": pa.array(x.sum(0)),
                        "q": pa.array((x**2).sum(0)),
                    }
                )

    rows = (
        table.select("vector")
        .mapInArrow(sums, "i int, n bigint, s double, q double")
        .groupBy("i")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        .orderBy("i")
        .collect()  # one row per component
    )
    n = np.array([r["n"] for r in rows], float)
    mean = np.array([r["s"] for r in rows], float) / n
    return Curves(mean, np.sqrt(np.maximum(np.array([r["q"] for r in rows]) / n - mean**2, 0)))


def ranked(table: DataFrame, curves: Curves) -> DataFrame:
    """curve, entry, vector and rank on the curve, for every entry and curve."""
    vector = table.schema["vector"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                for curve, keys in curves.keys(_matrix(part.column("vector"))):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), curve), pa.int32()),
                            pa.array(keys),
                            part.column("entry"),
                            part.column("vector"),
                        ],
                        names=["curve", "key", "entry", "vector"],
                    )

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(CURVES, np.int64)
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            first = np.searchsorted(curve, np.arange(CURVES))  # sorted by curve
            place = np.arange(len(curve)) - first[curve] + seen[curve]
            seen += np.bincount(curve, minlength=CURVES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("curve"),
                    batch.column("entry"),
                    batch.column("vector"),
                    pa.array(np.full(len(curve), task), pa.int32()),
                    pa.array(place),
                ],
                names=["curve", "entry", "vector", "task", "place"],
            )

    sorted_rows = (
        table.select("entry", "vector")
        .mapInArrow(keyed, f"curve int, key bigint, entry bigint, vector {vector}")
        .repartitionByRange("curve", "key", "entry")
        .sortWithinPartitions("curve", "key", "entry")
    )
    rows = written(
        sorted_rows.mapInArrow(
            numbered, f"curve int, entry bigint, vector {vector}, task int, place bigint"
        ),
        "curves",
    )
    before = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("curve", "task").count()
    firsts = sizes.select("curve", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return rows.join(firsts, ["curve", "task"]).select(
        "curve", "entry", "vector", (F.col("first") + F.col("place")).alias("rank")
    )


def _closest(entry: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    if len(entry) > 4 * k:
        near = np.flatnonzero(distance <= np.partition(distance, k)[k])
    else:
        near = np.arange(len(entry))
    return near[np.lexsort((entry[near], distance[near]))][:k]


def _best(queries: np.ndarray, vectors: np.ndarray, entry: np.ndarray, query: np.ndarray, k: int) -> dict:
    """The ``k`` closest entries of each query among these, by exact distances."""
    found = {"query": [], "entry": [], "distance": []}
    for q, vector in zip(query, queries):
        gap = vectors - vector
        distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        near = _closest(entry, distance, k)
        found["query"].append(np.full(len(near), q))
        found["entry"].append(entry[near])
        found["distance"].append(distance[near])
    return {name: pa.array(np.concatenate(parts)) for name, parts in found.items()}


FOUND = "query bigint, entry bigint, distance double"


def brute_force(table: DataFrame, sample: list, k: int) -> DataFrame:
    """The ``k`` closest entries of a bounded list of (entry, vector) among all."""
    query = np.array([r["entry"] for r in sample], np.int64)
    queries = np.array([r["vector"] for r in sample], float)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("vector"))
                entry = batch.column("entry").to_numpy()
                yield pa.RecordBatch.from_pydict(_best(queries, vectors, entry, query, k))

    return _merged(table.select("entry", "vector").mapInArrow(search, FOUND), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "entry")
    one = found.groupBy("query", "entry").agg(F.min("distance").alias("distance"))
    return one.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def half_window(places: DataFrame, table: DataFrame, asked: DataFrame, k: int, recall: float) -> int:
    """Rank distance that reaches ``recall`` of the sample's true neighbours on their best curve."""
    sample = asked.join(table, "entry").orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE)
    sample = sample.select("entry", "vector").collect()
    if not sample:
        return 1
    # At most SAMPLE * k rows and SAMPLE rows.
    true = written(brute_force(table, sample, k), "true-neighbours").where("query <> entry")
    pairs = F.broadcast(true.select("query", "entry"))
    theirs = places.join(pairs, "entry").select("curve", "query", "entry", F.col("rank").alias("its"))
    own = places.join(F.broadcast(true.select(F.col("query").alias("entry")).distinct()), "entry")
    own = own.select("curve", F.col("entry").alias("query"), F.col("rank").alias("own"))
    gaps = theirs.join(own, ["curve", "query"]).groupBy("query", "entry")
    gaps = gaps.agg(F.min(F.abs(F.col("its") - F.col("own"))).alias("gap"))
    width = gaps.agg(F.percentile("gap", F.lit(recall)).alias("w")).first()["w"]
    return max(1, int(np.ceil(width or 1)))


def nearest(
    rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row that is a query."""
    good = written(usable(rows, vector), "vectors")
    classes = written(entries(good, k), "entries")
    table = classes.select("entry", "vector")
    empty = classes.isEmpty()
    hashes = {"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(1))}
    queries = good.where(is_query).withColumns(hashes).select("vec_id", "h1", "h2").distinct()
    queries = written(queries.join(classes.select("h1", "h2", "entry"), ["h1", "h2"]), "query-entries")
    asked = queries.select("entry").distinct()
    if empty:
        return queries.select(
            F.col("vec_id").alias("query_id"),
            F.lit(1).alias("rank"),
            "vec_id",
            F.lit(0.0).alias("score"),
        ).where("false")
    # The entry itself is among its k + 1 closest.
    near = k + 1
    places = written(ranked(table, fitted_curves(table)), "places")
    width = half_window(places, table, asked, near, recall)
    chunk = max(64, min(CHUNK, width))
    reach = -(-width // chunk)
    chunked = places.withColumn("chunk", F.floor(F.col("rank") / chunk))
    dealt = chunked.join(asked, "entry").select(
        F.col("curve").alias("on_curve"),
        F.col("entry").alias("query"),
        F.col("vector").alias("asked"),
        F.explode(F.sequence(F.col("chunk") - reach, F.col("chunk") + reach)).alias("in_chunk"),
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query", pa.int64()), ("entry", pa.int64()), ("distance", pa.float64()))})
        return pa.table(
            _best(
                _matrix(left["asked"]),
                _matrix(right["vector"]),
                right["entry"].to_numpy(),
                left["query"].to_numpy(),
                near,
            )
        )

    found = (
        dealt.groupBy("on_curve", "in_chunk")
        .cogroup(chunked.select("curve", "chunk", "entry", "vector").groupBy("curve", "chunk"))
        .applyInArrow(search, FOUND)
    )
    # Lists of at most k + 1 ids for each of at most k + 1 entries.
    best = written(_merged(found, near), "found").join(classes.select("entry", "ids"), "entry")
    lists = best.groupBy("query").agg(
        F.slice(
            F.sort_array(
                F.flatten(
                    F.collect_list(
                        F.transform("ids", lambda i: F.struct(F.col("distance").alias("score"), i.alias("vec_id")))
                    )
                )
            ),
            1,
            near,
        ).alias("near")
    )
    answers = queries.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(lists, "query")
    own = F.col("query_id")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != own), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("n", "x")).select(
        "query_id",
        (F.col("n") + 1).cast("int").alias("rank"),
        F.col("x.vec_id").alias("vec_id"),
        F.col("x.score").alias("score"),
    )
