"""Schemas of the tables passed between operators."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

CONVERSATIONS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

COLLECTION = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("chunk_text", T.StringType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("norm", T.DoubleType()),
    ]
)

CHUNK_KEYS = ["doc_id", "chunk_no"]

# A document as it is from ``sequence`` on; a withdrawn one has no text.
CHANGES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("withdrawn", T.BooleanType()),
    ]
)
