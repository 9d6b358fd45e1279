import pytest
from pyspark.sql import functions as F

from pagewell.operators import answers as an
from pagewell.operators import prompts
from pagewell.plans.answering import AnswerSettings, answer, build_index

STRANGE = "50% off {context_str} {} $1 \\1 %s {query_str}"

# Fixed value: the whole prompt for one question.
WANT = (
    "You are a helpful AI assistant. Use the following context to answer the question. \n"
    'If you cannot find the answer in the context, say "I cannot find the answer in the provided context."\n'
    "\nContext:\n%s\n\nQuestion: %s\n\nAnswer: "
)


def questions(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def hits(spark, rows):
    return spark.createDataFrame(
        rows, "query_id long, rank int, chunk_text string, n_tokens int, query_text string"
    )


def test_the_template_copies_texts_unchanged(spark):
    asked = questions(spark, [STRANGE, "plain"])
    context = prompts.contexts(
        hits(spark, [(0, 2, "second", 1, STRANGE), (0, 1, STRANGE, 8, STRANGE)])
    )
    got = {r["query_id"]: r for r in prompts.prompts(asked, context).collect()}
    first, second = (f"{STRANGE}\n\nsecond", STRANGE), ("", "plain")
    assert got[0]["prompt"] == WANT.replace("%s", "\0") .replace("\0", first[0], 1).replace("\0", first[1], 1)
    assert got[1]["prompt"] == WANT % second
    assert got[1]["n_tokens"] == len((WANT % second).split())


def test_messages(spark):
    rows = prompts.messages(spark.createDataFrame([(0, "ask")], "query_id long, prompt string"))
    system, user = rows.first()["messages"]
    assert (system["role"], system["content"]) == ("system", prompts.SYSTEM_MESSAGE)
    assert (user["role"], user["content"]) == ("user", "ask")


def test_budget_keeps_the_best_that_fit(spark):
    frame = len((WANT % ("", "q")).split())
    rows = hits(spark, [(0, 1, "a", 10, "q"), (0, 2, "b", 10, "q"), (0, 3, "c", 1, "q"), (1, 1, "d", 21, "q")])
    kept = prompts.within_budget(rows, num_ctx=frame + 5 + 20, num_predict=5).collect()
    # The chunk of 21 words is cut to the 20 that are left.
    assert sorted((r["query_id"], r["rank"], r["n_tokens"]) for r in kept) == [(0, 1, 10), (0, 2, 10), (1, 1, 20)]


def test_best_sentence_and_its_ties(spark):
    rows = hits(
        spark,
        [
            (0, 2, "Red fox here. Red fox there.", 6, "where is the red fox"),
            (0, 1, "Nothing. Fox red now!  Fox red later.", 7, "where is the red fox"),
            (1, 1, "No match at all", 4, "zebra"),
        ],
    )
    got = {r["query_id"]: (r["answer"], r["overlap"]) for r in an.best_sentences(rows).collect()}
    assert got == {0: ("Fox red now!", 2), 1: ("No match at all", 0)}


def test_refusal_cap_and_questions_without_hits(spark):
    asked = questions(spark, ["red fox", "zebra", "absent"])
    rows = hits(spark, [(0, 1, "The red fox ran far away", 6, "red fox"), (1, 1, "Not this", 2, "zebra")])
    got = {r["query_id"]: r["answer"] for r in an.extractive_answers(asked, rows, num_predict=3).collect()}
    refusal = "I cannot find the answer in the provided context."
    assert got == {0: "The red fox", 1: refusal, 2: refusal}
    strict = an.extractive_answers(asked, rows, min_overlap=3).collect()
    assert {r["answer"] for r in strict} == {refusal}


@pytest.fixture
def index(store, spark):
    docs = spark.createDataFrame([(0, "The red fox runs. It is fast."), (1, "Whales sing.")], "doc_id long, text string")
    return build_index(docs, store, "c")


def test_errors_are_values_and_other_rows_are_undisturbed(index, spark):
    asked = questions(spark, ["red fox?", None, " \n ", "zebra", "whales"])
    got = {r["query_id"]: r for r in answer(asked, index).collect()}
    assert got[0]["answer"] == "The red fox runs." and got[0]["error"] is None
    for i in (1, 2):
        assert got[i]["answer"] == "Error processing query: " + an.EMPTY_QUESTION
        assert got[i]["error"] == an.EMPTY_QUESTION
    assert got[3]["answer"] == an.REFUSAL
    assert got[4]["answer"] == "Whales sing."


def test_generator_slot(index, spark):
    def load_picky():
        def generate(prompt):
            if "zebra" in prompt:
                raise ValueError("no zebras")
            return " ".join(["word"] * 200)

        return generate

    asked = questions(spark, ["red fox?", None, "zebra"])
    settings = AnswerSettings(load_generator=load_picky, num_predict=5)
    got = {r["query_id"]: r for r in answer(asked, index, settings).collect()}
    assert got[0]["answer"] == "word word word word word" and got[0]["error"] is None
    assert got[1]["answer"].startswith("Error processing query: ")
    assert got[2]["answer"] == "Error processing query: no zebras"
    assert got[2]["error"] == "no zebras"


def test_modes_with_a_custom_reranker(index, spark):
    import pandas as pd

    @F.pandas_udf("double")
    def shortest(question: pd.Series, chunk: pd.Series) -> pd.Series:
        return -chunk.str.len().astype(float)

    asked = questions(spark, ["red fox and whales"])
    for mode in ("vector", "bm25", "union"):
        settings = AnswerSettings(mode=mode, reranker=shortest, top_n=1)
        assert answer(asked, index, settings).first()["answer"] == "Whales sing."


def test_a_missing_collection_is_an_error_of_the_job(store):
    from pagewell.plans.answering import Index

    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        Index(store, "absent")
