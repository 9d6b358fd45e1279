"""Bloom filters of keys as rows: (shard, word, bits), 64 bits of a shard's filter in each.

Rows of several appends are combined with a bitwise or, so an append writes only its own bits.
A key whose bits are not all set is certainly new; the others have to be looked up. A filter that is
too small for its keys only sends more of them to the lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = "shard int, word int, bits bigint"
# 64 filters of 2 ** 20 bits: 8 MB if all are set, under 2 % wrong hits at 8 million keys.
SHARDS = 64
BITS = 1 << 20
HASHES = 5


def places(keys: list[str]) -> Column:
    """The shard, word and bit of each hash of a key."""
    own = F.xxhash64(*keys)
    shard = F.pmod(F.xxhash64(F.lit("shard"), *keys), F.lit(SHARDS)).cast("int")
    step = F.xxhash64(F.lit("step"), *keys).bitwiseOR(F.lit(1))
    found = []
    for i in range(HASHES):
        place = F.pmod(F.xxhash64(own, step, F.lit(i)), F.lit(BITS))
        word, bit = F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
        found.append(F.struct(shard.alias("shard"), word.alias("word"), bit.alias("bit")))
    return F.array(*found)


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The filter of the rows' keys, combined map-side first; at most ``SHARDS * BITS / 64`` rows."""
    bits = rows.select(F.explode(places(keys)).alias("p")).select("p.*")
    return bits.groupBy("shard", "word").agg(F.bit_or("bit").alias("bits"))


def maybe_known(rows: DataFrame, sketched: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of ``rows`` that may be among those sketched; all others are certainly not."""
    own = rows.select(*keys).distinct().withColumn("p", F.explode(places(keys)))
    own = own.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], "p.*")
    filters = sketched.groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    met = own.join(filters, ["shard", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    names = [f"key_{i}" for i in range(len(keys))]
    # Two hashes of a key may name the same bit; each counts.
    hits = met.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES)
    return hits.select(*[F.col(n).alias(k) for n, k in zip(names, keys)])
