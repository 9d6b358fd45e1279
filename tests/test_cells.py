"""Search in learned cells: exact when all are visited, little read and high recall where neighbours are near."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewell.operators import cells
from pagewell.operators.blockscan import Limits
from pagewell.operators.similarity import cosine_top_k


def vectors(spark, array):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(array)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def questions(df):
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def learned(rows, dim, n=None):
    centres = cells.fitted_centres(rows, ["vec_id"], dim, n)
    celled = cells.with_learned_cell(rows, centres)
    return celled, cells.Cells.of(cells.cell_table(celled, centres))


def clustered(n_centres=40, each=10, dim=32, seed=9):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.normal(size=(n_centres, dim)), each, axis=0) + 0.1 * rng.normal(size=(n_centres * each, dim))


def hits(df):
    return {(r["query_id"], r["vec_id"], r["rank"]): r["score"] for r in df.collect()}


@pytest.mark.parametrize("limits", [Limits(), Limits(block_rows=7, group_rows=11)])
def test_visiting_all_cells_is_exact(spark, limits):
    rows = vectors(spark, [*np.random.default_rng(1).normal(size=(90, 8)), None, np.zeros(8)])
    celled, found = learned(rows, 8, 9)
    assert celled.filter("cell IS NULL").count() == 2
    got = hits(cells.learned_top_k(celled, questions(rows), 4, found, 1.0, ["vec_id"], limits))
    assert got == hits(cosine_top_k(rows, questions(rows), 4, 8, ["vec_id"]))


def test_a_tenth_is_enough_where_neighbours_are_near(spark):
    rows = vectors(spark, clustered())
    celled, found = learned(rows, 32, 40)
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    exact = pairs(cosine_top_k(rows, questions(rows), 10, 32, ["vec_id"]))
    near = pairs(cells.learned_top_k(celled, questions(rows), 10, found, 0.1, ["vec_id"]))
    assert len(exact & near) >= 0.9 * len(exact)
    visited = cells.with_visited_cells(questions(rows), found, 0.1).collect()
    assert all(len(v["probes"]) == 1 or found.sizes[v["probes"]].sum() <= 40 for v in visited)


def test_few_or_no_vectors(spark):
    for array in ([], [[1.0, 0.0]], [[0.0, 0.0]], [[1.0, 0.0]] * 5):
        rows = vectors(spark, array)
        celled, found = learned(rows, 2)
        got = cells.learned_top_k(celled, questions(rows), 3, found, 1.0, ["vec_id"])
        assert hits(got) == hits(cosine_top_k(rows, questions(rows), 3, 2, ["vec_id"]))


def test_arguments(spark):
    rows = vectors(spark, clustered(4, 4))
    celled, found = learned(rows, 32)
    with pytest.raises(ValueError):
        cells.learned_top_k(celled, questions(rows), 3, found, 0.0, ["vec_id"])
