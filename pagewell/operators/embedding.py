"""Chunks and questions to vectors.

Any model fits the encoder slot (`embed_with`). The default needs no model: each
token adds its inverse document frequency to one of ``dim`` places chosen by a
hash. Weights belong to hash slots, not to tokens, so their table has at most
``SLOTS`` rows however large the corpus grows, and sending it to every task is
safe by construction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.functions import vectors as vx

DIM = 384
SLOTS = 1 << 18
WEIGHT_SCALE = 10_000
UNSEEN = -1  # the row of the slots that no chunk had


def token_hash(token: Column) -> Column:
    """28 bits of md5: every SQL engine has it, and it never leaves the bigint range."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int")


def hash_of(token: str) -> int:
    """The same as `token_hash`, for the distinct tokens of a batch."""
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16)


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, always positive."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def slot_weights(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(slot, weight): idf in whole ten-thousandths, so that sums do not depend on order.

    A slot occurs as often as its tokens together, at most in every chunk.
    ``terms`` is (token, n_chunks), so the corpus is not read for this. One more row
    has the weight of all other slots.
    """
    n = totals.select(F.col("n_chunks").cast("double")).scalar()
    slots = terms.groupBy((token_hash(F.col("token")) % SLOTS).alias("slot")).agg(
        F.sum("n_chunks").cast("double").alias("df")
    )
    scaled = F.round(idf(n, F.least(F.col("df"), n)) * WEIGHT_SCALE)
    known = slots.select("slot", scaled.cast("int").alias("weight"))
    rest = totals.select(
        F.lit(UNSEEN).cast("int").alias("slot"),
        F.round(idf(F.col("n_chunks").cast("double"), F.lit(0.0)) * WEIGHT_SCALE).cast("int").alias("weight"),
    )
    return known.withColumn("slot", F.col("slot").cast("int")).unionByName(rest)


def collect_weights(weights: DataFrame) -> np.ndarray:
    """The weights as one array of ``SLOTS`` integers; slots that no chunk had weigh most."""
    table = weights.toArrow()
    slot, weight = table["slot"].to_numpy(), table["weight"].to_numpy()
    unseen = weight[slot == UNSEEN]
    out = np.full(SLOTS, unseen[0] if len(unseen) else 0, dtype=np.int64)
    out[slot[slot != UNSEEN]] = weight[slot != UNSEEN]
    return out


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column; a NULL list has no values."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten(), np.repeat(np.arange(len(column)), lengths)


def hashed_vectors(tokens: pa.Array, weights: np.ndarray, dim: int) -> np.ndarray:
    """One vector per list of tokens; each distinct token of the batch is hashed once."""
    values, row = list_rows(tokens)
    coded = values.dictionary_encode()
    h = np.array([hash_of(t) for t in coded.dictionary.to_pylist()], dtype=np.int64)
    code = coded.indices.to_numpy()
    summed = np.bincount(
        row * dim + (h % dim)[code], weights[h % SLOTS][code], minlength=len(tokens) * dim
    )
    return (summed / WEIGHT_SCALE).astype(np.float32).reshape(len(tokens), dim)


def as_list_array(matrix: np.ndarray) -> pa.Array:
    rows, dim = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(matrix.ravel(), pa.float32())
    )


def once(udf):
    """Keep the optimizer from copying an expensive function below a filter on its result."""
    return udf.asNondeterministic()


def hashed_embedding(df: DataFrame, weights: np.ndarray, dim: int = DIM) -> DataFrame:
    """Default embedder: adds ``embedding`` and ``norm`` to rows that have ``tokens``."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("embedding array<float>, norm double")
    def encode(tokens: pa.Array) -> pa.Array:
        vectors = hashed_vectors(tokens, shared.value, dim)
        exact = vectors.astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        return pa.StructArray.from_arrays(
            [as_list_array(vectors), pa.array(norms)], names=["embedding", "norm"]
        )

    coded = df.withColumn("v", once(encode)("tokens"))
    return coded.select(*df.columns, "v.embedding", "v.norm")


def embed_with(
    df: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "chunk_text",
    batch_rows: int = 256,
) -> DataFrame:
    """Encoder slot: ``load_encoder`` runs once per task, then encodes batches of texts.

    A NULL text gets a NULL vector. The vectors are not trusted: `split_valid`
    checks them against the collection's dimension.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            present = np.flatnonzero(texts.notna())
            for i in range(0, len(present), batch_rows):
                rows = present[i : i + batch_rows]
                for row, vector in zip(rows, encoder(texts.iloc[rows].tolist())):
                    out.iat[row] = np.asarray(vector, dtype=np.float32)
            yield out

    return with_norm(df.withColumn("embedding", once(encode)(F.col(text))))


def with_norm(df: DataFrame) -> DataFrame:
    """Store each vector's length once, so that searches need one dot product per pair."""
    return df.withColumn("norm", vx.norm(F.col("embedding")))


def split_valid(df: DataFrame, dim: int, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) by the collection's vector schema.

    In strict mode the first bad vector fails the job instead.
    """
    ok = vx.is_valid(F.col("embedding"), dim)
    if strict:
        problem = F.lit(f"vector does not have {dim} elements that are not NULL")
        return df.filter(F.when(ok, True).otherwise(F.raise_error(problem).cast("boolean"))), df.limit(0)
    return df.filter(ok), df.filter(~ok)
