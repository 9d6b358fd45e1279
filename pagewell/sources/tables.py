"""Documents and questions kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewell.session import is_folder, spread


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "doc_id"
    )


def arriving(
    spark: SparkSession, schema: StructType, folder: str, glob: str, files_per_batch: int | None = None
) -> DataFrame:
    """The rows of Parquet files in a folder as they appear, of those files whose names match ``glob``.

    A table may be one file or a folder of files: if ``glob`` names a folder below, its files arrive.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, f"{folder}/{glob}"):
        return reader.parquet(f"{folder}/{glob}")
    return reader.option("pathGlobFilter", glob).parquet(folder)


def list_texts(docs: DataFrame) -> DataFrame:
    return docs.select("text")


def count_documents(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_documents"))


def questions(df: DataFrame, query_id, text: str = "text") -> DataFrame:
    """Any table as questions: one row per question."""
    return df.select(query_id.cast("long").alias("query_id"), F.col(text).alias("query_text"))


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark.read.parquet(f"{folder}/benchmark.parquet"), F.col("item_id"))


def turn_id(back: int = 0) -> Column:
    """One id per conversation turn (the one ``back`` turns before): pairs counted along diagonals.

    Negative, so that it is no id of another source of questions.
    """
    turn = F.col("turn") - back
    both = F.col("conv_id") + turn
    return -1 - (F.shiftright(both * (both + 1), 1) + turn)


def user_questions(turns: DataFrame) -> DataFrame:
    """The user's turns. Works on a stream of turns as well."""
    return questions(turns.filter(F.col("role") == "user"), turn_id())
