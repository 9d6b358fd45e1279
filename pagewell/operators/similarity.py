"""Vector search: exact cosine top-k, and a faster search that visits part of the cells."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.functions import vectors as vx
from pagewell.operators.blockscan import MATRIX_CELLS, Limits, Scored, round_scores, top_k
from pagewell.operators.embedding import DIM, list_rows


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable vectors of a list column.

    A vector of another length, with a NULL element, or of length zero is left
    out: it can be no hit. `split_valid` is where such rows are reported.
    """
    values, row = list_rows(column)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    usable = lengths == dim
    if values.null_count:
        usable[np.unique(row[np.asarray(values.is_null())])] = False
    x = flat[usable[row]].reshape(-1, dim)
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.flatnonzero(usable)[length > 0], x[length > 0] / length[length > 0, None]


def blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, MATRIX_CELLS // max(width, 1))
    return (slice(i, i + step) for i in range(0, n, step))


def cosine_scorer(dim: int):
    def prepare(block: pa.Table):
        questions, q = matrix(block.column("embedding").combine_chunks(), dim)

        def score(batch: pa.RecordBatch) -> Iterator[Scored]:
            rows, x = matrix(batch.column("embedding"), dim)
            for part in blocks(len(rows), len(questions)):
                yield rows[part], questions, round_scores(q @ x[part].T)

        return score

    return prepare


def cosine_top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    dim: int = DIM,
    keys: list[str] | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Exact: every usable chunk vector is compared with every question vector."""
    keys = keys or ["doc_id", "chunk_no"]
    return top_k(
        chunks.select(*keys, "embedding"),
        questions.filter(vx.is_valid(F.col("embedding"), dim)).select("query_id", "embedding"),
        k,
        cosine_scorer(dim),
        keys,
        F.size("embedding"),
        limits,
        dim=dim,
    )


def planes(bits: int, dim: int) -> np.ndarray:
    """``bits`` directions of +1 and -1, fixed by md5 so that any engine can repeat them."""
    sign = lambda b, i: 1.0 if int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:7], 16) % 2 else -1.0
    return np.array([[sign(b, i) for i in range(dim)] for b in range(bits)])


def cell_numbers(projected: np.ndarray) -> np.ndarray:
    return (projected > 0) @ (1 << np.arange(projected.shape[1]))


def probe_cells(projected: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` most promising cells per question, own cell first.

    Changing side of a plane costs the distance to it, so a cell costs the sum
    over the planes on whose other side it lies.
    """
    bits = projected.shape[1]
    flips = np.array(list(itertools.product([0, 1], repeat=bits)))[:, ::-1]
    cost = np.round(np.abs(projected) @ flips.T, 9)
    mask = flips @ (1 << np.arange(bits))
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return cell_numbers(projected)[:, None] ^ mask[order]


def with_cell(df: DataFrame, bits: int, dim: int, name: str = "cell") -> DataFrame:
    """Add the cell a vector lies in; NULL for an unusable vector. A collection may store it."""
    directions = planes(bits, dim)

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        rows, x = matrix(column, dim)
        out = np.zeros(len(column), np.int32)
        out[rows] = cell_numbers(x @ directions.T)
        known = np.zeros(len(column), bool)
        known[rows] = True
        return pa.array(out, mask=~known)

    return df.withColumn(name, cell("embedding"))


def with_probes(df: DataFrame, bits: int, dim: int, probes: int) -> DataFrame:
    """Add the array of cells a question visits; empty for an unusable vector."""
    directions = planes(bits, dim)

    @F.arrow_udf("array<int>")
    def visit(column: pa.Array) -> pa.Array:
        rows, x = matrix(column, dim)
        out = [[] for _ in range(len(column))]
        for row, cells in zip(rows, probe_cells(x @ directions.T, probes)):
            out[row] = cells.tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return df.withColumn("probes", visit("embedding"))


def celled_scorer(dim: int):
    """Cosine, but each question meets only the chunks of the cells it visits."""

    def prepare(block: pa.Table):
        questions, q = matrix(block.column("embedding").combine_chunks(), dim)
        probes, owner = list_rows(block.column("probes").combine_chunks())
        probes = np.asarray(probes)
        position = np.full(block.num_rows, -1)
        position[questions] = np.arange(len(questions))
        by_cell = np.argsort(probes, kind="stable")
        visited, firsts = np.unique(probes[by_cell], return_index=True)
        visitors = dict(zip(visited, np.split(position[owner[by_cell]], firsts[1:])))

        def score(batch: pa.RecordBatch) -> Iterator[Scored]:
            rows, x = matrix(batch.column("embedding"), dim)
            cells = np.asarray(batch.column("cell").take(pa.array(rows)))
            for cell in np.unique(cells):
                who = visitors.get(cell)
                if who is None:
                    continue
                inside = np.flatnonzero(cells == cell)
                for part in blocks(len(inside), len(who)):
                    pick = inside[part]
                    yield rows[pick], questions[who], round_scores(q[who] @ x[pick].T)

        return score

    return prepare


def approx_top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    dim: int = DIM,
    bits: int = 8,
    probes: int = 32,
    keys: list[str] | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Cosine top-k among the chunks in the ``probes`` likeliest of ``2 ** bits`` cells.

    Cells are the sides of ``bits`` fixed planes; nothing is replicated on the
    chunk side. With ``probes = 2 ** bits`` the result is the exact one; how many
    are enough depends on how near the nearest chunks are. If the chunks already carry ``cell`` (a collection partitioned by it), only the
    visited cells are read.
    """
    if not 1 <= probes <= 2**bits or bits > 12:
        raise ValueError("need 1 <= probes <= 2 ** bits and bits <= 12")
    ask = with_probes(
        questions.filter(vx.is_valid(F.col("embedding"), dim)).select("query_id", "embedding"),
        bits, dim, probes,
    )
    if "cell" not in chunks.columns:
        chunks = with_cell(chunks, bits, dim)
        return celled_top_k(chunks, ask, k, dim, keys, limits, prune=False)
    return celled_top_k(chunks, ask, k, dim, keys, limits)


def celled_top_k(
    chunks: DataFrame, ask: DataFrame, k: int, dim: int, keys: list[str] | None, limits: Limits, prune: bool = True
) -> DataFrame:
    """Cosine top-k of questions with ``probes`` among the chunks whose ``cell`` they visit.

    ``prune`` filters the chunks by the visited cells, whose number is bounded by that of all cells.
    """
    keys = keys or ["doc_id", "chunk_no"]
    if prune:
        visited = [r[0] for r in ask.select(F.explode("probes")).distinct().collect()]
        chunks = chunks.filter(F.col("cell").isin(visited))
    return top_k(
        chunks.select(*keys, "embedding", "cell"),
        ask,
        k,
        celled_scorer(dim),
        keys,
        F.size("embedding") + F.size("probes"),
        limits,
        cells=("cell", "probes"),
        dim=dim,
    )
