"""Approximate vector search in learned cells: a coarse quantiser, and the cells nearest to a question.

The centres are fitted with k-means on a bounded sample, every row is assigned to its nearest
centre, and a question visits its nearest cells until they hold a given share of all rows. So the
share of the vectors that is read is a setting, and recall is what follows from it; the number of
cells may be large, since only centres and cell sizes are held by a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.functions import vectors as vx
from pagewell.operators.blockscan import Limits
from pagewell.operators.similarity import celled_top_k, matrix

# The centres are fitted on at most this many rows, chosen by a hash of their keys.
SAMPLE_ROWS = 20_000
# More cells are no gain in what a task holds: at 384 dimensions this is 12 MB of centres.
MAX_CELLS = 4096
ROWS_PER_CELL = 4
ITERATIONS = 8
SHARE = 0.25


@dataclass(frozen=True)
class Cells:
    """Unit centres and the number of rows in each cell."""

    centres: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> Cells:
        """From stored rows (cell, centre, n); several counts of a cell are added up. At most ``MAX_CELLS`` rows."""
        rows = table.groupBy("cell").agg(F.max("centre").alias("centre"), F.sum("n").alias("n")).orderBy("cell").collect()
        return cls(np.array([r["centre"] for r in rows]), np.array([r["n"] for r in rows]))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(1)

    def visited(self, x: np.ndarray, share: float) -> list[np.ndarray]:
        """The nearest cells of each vector that together hold at most ``share`` of the rows; one at least."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        count = np.maximum((held <= share * self.sizes.sum()).sum(1), 1)
        return [cells[:n] for cells, n in zip(order, count)]


def fitted_centres(rows: DataFrame, keys: list[str], dim: int, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centres fitted on a sample of the usable vectors; fewer than ``cells`` if there are fewer different ones."""
    usable = rows.filter(vx.is_valid(F.col("embedding"), dim)).select(*keys, "embedding")
    usable = usable.filter(F.exists("embedding", lambda x: x != 0))
    sample = usable.orderBy(F.xxhash64(*keys), *keys).limit(SAMPLE_ROWS)
    data = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).cache()
    n = data.count()
    cells = min(cells or max(n // ROWS_PER_CELL, 1), MAX_CELLS, max(n // 2, 1))
    if n < 2 or cells < 2:
        data.unpersist()
        return np.eye(1, dim)
    model = KMeans(k=cells, seed=seed, initMode="random", maxIter=ITERATIONS, distanceMeasure="cosine").fit(data)
    centres = np.array(model.clusterCenters())
    data.unpersist()
    length = np.linalg.norm(centres, axis=1)
    return centres[length > 0] / length[length > 0, None]


def with_learned_cell(rows: DataFrame, centres: np.ndarray, name: str = "cell") -> DataFrame:
    """Add the cell of each vector; NULL for an unusable one."""
    cells, dim = Cells(centres, np.ones(len(centres))), centres.shape[1]

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        rows, x = matrix(column, dim)
        out, known = np.zeros(len(column), np.int32), np.zeros(len(column), bool)
        out[rows], known[rows] = cells.nearest(x), True
        return pa.array(out, mask=~known)

    return rows.withColumn(name, cell("embedding"))


def cell_table(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, centre, n): the centres and how many of ``rows``, which have a ``cell``, are in each."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    sizes = rows.filter("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return every.join(sizes, "cell", "left").select("cell", "centre", F.coalesce("n", F.lit(0)).alias("n"))


def with_visited_cells(questions: DataFrame, cells: Cells, share: float) -> DataFrame:
    """Add ``probes``, the cells a question visits; none for an unusable vector."""
    dim = cells.centres.shape[1]

    @F.arrow_udf("array<int>")
    def visit(column: pa.Array) -> pa.Array:
        rows, x = matrix(column, dim)
        out = [[] for _ in range(len(column))]
        for row, visited in zip(rows, cells.visited(x, share)):
            out[row] = visited.tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return questions.withColumn("probes", visit("embedding"))


def learned_top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    cells: Cells,
    share: float = SHARE,
    keys: list[str] | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Cosine top-k among the chunks of each question's nearest cells, at most ``share`` of all but for one cell.

    ``chunks`` carry their ``cell``; of a collection stored by it only the visited cells are read.
    """
    if not 0 < share <= 1:
        raise ValueError("share is above 0 and at most 1")
    dim = cells.centres.shape[1]
    usable = questions.filter(vx.is_valid(F.col("embedding"), dim)).select("query_id", "embedding")
    return celled_top_k(chunks, with_visited_cells(usable, cells, share), k, dim, keys, limits)
