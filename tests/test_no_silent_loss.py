"""Cases that once lost rows, changed results or passed without an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewell.operators import retrieve
from pagewell.plans.answering import AnswerSettings, Index, IndexSettings, answer, build_index, build_status
from pagewell.sources import files
from pagewell.operators.blockscan import Limits


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def asked(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "query_id long, query_text string")


TEXTS = ["red apples grow here", "blue birds fly south", "green stones lie still"]


def test_both_stages_in_the_plan(spark, store):
    index = build_index(docs(spark, TEXTS), store, "c")
    hits = retrieve.retrieve(asked(spark, ["red apples"]), index, mode="union")
    assert hits.first()["doc_id"] == 0


@pytest.mark.parametrize("options, error", [({"mode": "vectr"}, ValueError), ({"search": "nonsense"}, ValueError), ({"bogus": 1}, TypeError)])
def test_wrong_arguments_are_refused(spark, store, options, error):
    index = build_index(docs(spark, TEXTS), store, "c")
    with pytest.raises(error):
        retrieve.retrieve(asked(spark, ["red"]), index, **{"mode": "union", **options})


def three_numbers():
    """An encoder of three places, made here so that it travels by value."""

    def load():
        return lambda texts: np.ones((len(texts), 3), np.float32)

    return load


def test_rejected_vectors_are_kept_and_reported(spark, store):
    settings = IndexSettings(load_encoder=three_numbers())
    index = build_index(docs(spark, TEXTS), store, "bad", settings)
    status = build_status(index).first()
    assert (status["status"], status["points"], status["message"]) == ("failed", 0, "3 chunks rejected")
    assert {r["reason"] for r in store.companion("bad", "rejected").collect()} == {"3 elements, not 384"}
    with pytest.raises(Exception, match="elements"):
        build_index(docs(spark, TEXTS), store, "strict", settings, strict=True)


def test_encoder_is_remembered(spark, store):
    build_index(docs(spark, TEXTS), store, "enc", IndexSettings(dim=3, load_encoder=three_numbers()))
    assert build_status(Index(store, "enc", IndexSettings(dim=3, load_encoder=three_numbers()))).first()["status"] == "success"
    with pytest.raises(ValueError, match="encoder"):
        Index(store, "enc")


def test_other_dimension_is_an_error(spark, store):
    store.create_if_missing("c", 3)
    store.create_if_missing("c", 3)
    with pytest.raises(ValueError, match="exists"):
        store.create_if_missing("c", 384)


def test_words_appended_later_are_found(spark, store):
    index = build_index(docs(spark, []), store, "grow")
    index.add_documents(docs(spark, TEXTS))
    hits = retrieve.retrieve(asked(spark, ["blue birds"]), index, mode="vector", top_n=1).collect()
    assert [r["doc_id"] for r in hits] == [1]
    assert index.chunks.where("norm > 0").count() == 3
    before = index.chunks.select("doc_id", "norm").collect()
    index.reweigh()
    again = build_index(docs(spark, TEXTS), store, "whole")
    norm = lambda i: {r["doc_id"]: round(r["norm"], 4) for r in i.chunks.collect()}
    assert norm(index) == norm(again) and len(before) == 3


def test_one_answer_for_every_question(spark, store):
    index = build_index(docs(spark, TEXTS), store, "c")
    questions = asked(spark, ["red apples", "blue birds", "green stones", None], [7, 7, None, None])
    rows = answer(questions, index).collect()
    assert len(rows) == 4
    assert sorted(r["answer"] for r in rows)[:3] == ["Error processing query: the question is empty", *TEXTS[1:2], TEXTS[2]]


def test_long_chunk_is_cut_to_the_budget(spark, store):
    long = " ".join(["needle answer"] + [f"w{i}" for i in range(2000)])
    settings = IndexSettings(chunk_size=1024, overlap=200)
    index = build_index(docs(spark, [long]), store, "long", settings)
    row = answer(asked(spark, ["needle answer"]), index, AnswerSettings()).first()
    assert row["answer"].startswith("needle answer")


def test_collection_with_a_companions_name(spark, store):
    store.create_if_missing("x__terms", 3)
    store.create_if_missing("y", 3)
    assert {r["name"] for r in store.names().collect()} == {"x__terms", "y"}


def test_files_of_other_suffixes_are_read(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.md", "two"), ("c.HTML", "<p>three</p>"), ("d.tar.gz", "four")):
        (tmp_path / name).write_text(text)
    upper = lambda f: files.decode_text(f).withColumn("text", F.upper("text"))
    routed = files.extract(files.scan_folder(spark, str(tmp_path)), {".html": upper, ".gz": files.decode_text, ".tar.gz": upper})
    assert sorted(r["text"] for r in routed.collect()) == ["<P>THREE</P>", "FOUR", "one", "two"]
    assert files.extract(files.scan_folder(spark, str(tmp_path)), {".html": upper}, rest=None).count() == 1


def test_small_question_blocks_give_the_same(spark, store):
    index = build_index(docs(spark, TEXTS * 5), store, "c")
    questions = asked(spark, ["red apples", "blue birds"])
    few = Limits(block_rows=1, block_values=10, group_rows=3)
    key = lambda rows: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in rows)
    whole = retrieve.retrieve(questions, index, mode="union").collect()
    assert key(retrieve.retrieve(questions, index, mode="union", limits=few).collect()) == key(whole)
