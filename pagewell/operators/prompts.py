"""Ranked chunks to prompts within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewell.functions import text as tx

# The system message, the parts of the question template, and the
# sizes of the model's context and output.
SYSTEM_MESSAGE = (
    "You are a helpful AI assistant that answers questions based on the provided context. \n"
    "If you don't know the answer or can't find it in the context, simply say \"I don't know!\"."
)
PROMPT_HEAD = (
    "You are a helpful AI assistant. Use the following context to answer the question. \n"
    "If you cannot find the answer in the context, say "
    "\"I cannot find the answer in the provided context.\"\n"
    "\n"
    "Context:\n"
)
PROMPT_MIDDLE = "\n\nQuestion: "
PROMPT_TAIL = "\n\nAnswer: "
NUM_CTX = 1024
NUM_PREDICT = 128


def render(context: Column | str, question: Column) -> Column:
    """The template with both texts copied as they are, whatever characters they hold."""
    if isinstance(context, str):
        context = F.lit(context)
    return F.concat(
        F.lit(PROMPT_HEAD), context, F.lit(PROMPT_MIDDLE), question, F.lit(PROMPT_TAIL)
    )


def with_questions(hits: DataFrame, questions: DataFrame) -> DataFrame:
    return hits.join(questions.select("query_id", "query_text"), "query_id")


def within_budget(
    hits: DataFrame, num_ctx: int = NUM_CTX, num_predict: int = NUM_PREDICT
) -> DataFrame:
    """Keep the best chunks of each question that fit beside the prompt and the answer.

    The first chunk that does not fit is cut to the words that are left.
    """
    prompt_size = F.size(tx.words(render("", F.col("query_text"))))
    budget = F.lit(num_ctx - num_predict) - prompt_size
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    left = (budget - F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).cast("int")
    cut = F.array_join(F.slice(tx.words(F.col("chunk_text")), 1, F.col("left")), " ")
    return (
        hits.withColumn("left", left)
        .filter(F.col("left") > 0)
        .withColumn("chunk_text", F.when(F.col("n_tokens") > F.col("left"), cut).otherwise(F.col("chunk_text")))
        .withColumn("n_tokens", F.least("n_tokens", "left"))
        .drop("left")
    )


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context): a question's chunk texts in rank order, at most top_n of them."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_text")))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ranked, lambda h: h["chunk_text"]), "\n\n").alias("context")
    )


def prompts(questions: DataFrame, context_of: DataFrame) -> DataFrame:
    """(query_id, prompt, n_tokens) for every question; without a hit the context is empty."""
    joined = questions.join(context_of, "query_id", "left")
    text = render(F.coalesce("context", F.lit("")), F.col("query_text"))
    return joined.select("query_id", text.alias("prompt")).withColumn(
        "n_tokens", F.size(tx.words(F.col("prompt")))
    )


def messages(prompt_rows: DataFrame) -> DataFrame:
    """(query_id, messages): the system message and the prompt as a chat."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return prompt_rows.select(
        "query_id",
        F.array(
            message("system", F.lit(SYSTEM_MESSAGE)), message("user", F.col("prompt"))
        ).alias("messages"),
    )
