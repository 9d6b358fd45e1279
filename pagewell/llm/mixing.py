"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of times its documents are repeated on average so that its
share of the mixture's bytes is its target weight. Each document draws a number from a hash of
its key and the seed, and inverts the Poisson distribution with its source's rate; so a
document's count depends on nothing but its key, its source's rate and the seed. The document is
repeated that often, and all copies are dealt anew by a hash of key and copy number.

Defined results: a null source is a source of its own, a null id is replaced by the text's hash
in the draw; repeated rows draw the same count; an empty text weighs one byte; rows of a source
with target weight 0 all go; an empty table gives an empty result; extra columns of any name
are carried, those named ``copy`` and ``copies`` only inside the document's struct.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.llm.common import written

SEED = "mix-1"
DIGITS = 13  # hex digits of the draw: 52 bits


def source_of(column: str = "source") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def size_of() -> Column:
    return (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long")


def key_of() -> Column:
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), text))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, bytes and rate. Without weights the target is the square root of a source's bytes.

    Sources without a weight, when weights are given, have weight 0. One row per source.
    """
    sizes = docs.select(source_of().alias("source"), size_of().alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("bytes"))
    if weights is None:
        weight = F.sqrt("bytes")
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = written(sizes.withColumn("weight", weight), "source-sizes")
    total = sizes.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    return sizes.crossJoin(F.broadcast(total)).select(  # one row of totals
        "source",
        "bytes",
        F.when(
            F.col("all_weight") > 0,
            F.lit(float(epochs)) * F.col("all_bytes") * F.col("weight") / F.col("all_weight") / F.col("bytes"),
        )
        .otherwise(0.0)
        .alias("rate"),
    )


def poisson_table(rate: Column) -> Column:
    """Cumulated probabilities of 0, 1, 2, ... until nothing is left; terms in logarithms."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(
        (-rate).alias("term"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("table")
    )

    def step(s: Column, k: Column) -> Column:
        term = s["term"] + F.log(rate / k)
        total = s["sum"] + F.exp(term)
        return F.struct(
            term.alias("term"), total.alias("sum"), F.concat(s["table"], F.array(total)).alias("table")
        )

    table = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["table"])
    return F.when(rate > 0, table).otherwise(F.array(F.lit(1.0)))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def mixed(
    docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: str = SEED
) -> DataFrame:
    """Struct ``doc`` of all columns, ``copies`` and ``copy`` (from 1), in an order without meaning.

    Draws happen before anything is shuffled; the one shuffle deals the copies.
    """
    tables = rates(docs, weights, epochs).select("source", poisson_table(F.col("rate")).alias("table"))
    # A row per source; small by its file's size, so the planner may broadcast it.
    tables = written(tables, "poisson-tables").withColumnRenamed("source", "_source")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        source_of().alias("_source"),
        key_of().alias("key"),
    ).withColumn("draw", uniform(seed, F.col("key")))
    drawn = rows.join(tables, "_source").withColumn(
        "copies", F.size(F.filter("table", lambda c: c <= F.col("draw")))
    )
    repeated = drawn.where(F.col("copies") > 0).select(
        "doc", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "key"
    )
    dealt = repeated.withColumn("deal", F.md5(F.concat_ws("|", F.lit(seed), "key", "copy")))
    return dealt.repartition("deal").sortWithinPartitions("deal").select("doc", "copies", "copy")
