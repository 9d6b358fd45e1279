"""Documents to chunks. Every form is one projection: no shuffle, one pass over the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.functions import text as tx


def fixed_chunks(docs: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """Windows of ``size`` words that share ``overlap`` words with their neighbour."""
    split = docs.select("doc_id", tx.words(F.col("text")).alias("w"))
    windows = split.select(
        "doc_id", F.posexplode(tx.window_structs(F.col("w"), size, overlap)).alias("chunk_no", "c")
    )
    return windows.select("doc_id", "chunk_no", "c.chunk_text", "c.n_tokens")


def sentence_chunks(docs: DataFrame, size: int = 1024, overlap: int = 200) -> DataFrame:
    """Whole sentences packed greedily, each chunk led by the end of the one before it.

    New sentences take at most ``size - overlap`` words and the lead at most
    ``overlap``, so no chunk is longer than ``size``. ``overlap=0`` packs only.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    budget = size - overlap
    pieces = docs.select("doc_id", tx.sentence_pieces(F.col("text"), budget).alias("p"))
    planned = pieces.select(
        "doc_id",
        F.transform("p", lambda p: F.array_join(p, " ")).alias("s"),
        tx.pack_udf(budget, overlap)(F.transform("p", F.size)).alias("plan"),
    )
    chunks = planned.select(
        "doc_id",
        F.posexplode(
            F.transform(
                "plan",
                lambda c: F.struct(
                    F.array_join(F.slice("s", c[0] + 1, c[1] - c[0]), " ").alias("chunk_text"),
                    c[2].alias("n_tokens"),
                ),
            )
        ).alias("chunk_no", "c"),
    )
    return chunks.select("doc_id", "chunk_no", "c.chunk_text", "c.n_tokens")


def paragraphs(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Text between separators (a regular expression), numbered within the document."""
    return docs.select(
        "doc_id", F.posexplode(F.split("text", separator)).alias("para_no", "para_text")
    )


def add_tokens(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Add the matching tokens of a text column."""
    return chunks.withColumn("tokens", tx.tokens(F.col(text)))
