"""The slots called from SQL give the rows of the DataFrame form."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from pagewell.functions import sql
from pagewell.functions import text as tx
from pagewell.operators import chunking, embedding
from pagewell.plans.queries import length_encoder

TEXTS = [
    "One two. Three four five! Six?  Seven eight nine ten eleven.",
    "no end of sentence here at all it goes on and on without a stop",
    "", None, "   ", "A.", "it's a 'quoted' \\ text.\n\nNext line. " * 40, "word " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    sql.register(spark, load_encoder=length_encoder)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "a row without an id.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.createOrReplaceTempView("sql_docs")
    return df


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size,overlap", [(7, 0), (7, 3), (1024, 200)])
@pytest.mark.parametrize("name", ["fixed_chunks", "sentence_chunks"])
def test_chunks(spark, docs, name, size, overlap):
    got = spark.sql(f"SELECT d.doc_id, c.* FROM sql_docs d, LATERAL {name}(d.text, {size}, {overlap}) c")
    assert got.columns == ["doc_id", "chunk_no", "chunk_text", "n_tokens"]
    assert rows_of(got) == rows_of(getattr(chunking, name)(docs, size, overlap))


def test_fixed_chunks_and_page_text_stay_in_the_jvm(spark, docs):
    plan = spark.sql(
        "SELECT page_text(c.chunk_text) AS t FROM sql_docs d, LATERAL fixed_chunks(d.text, 8, 2) c"
    )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_page_text(spark):
    pages = ["<p>a &lt;b&gt; &amp;</p><!-- x\ny --><script>var a = '\\n'</script> it&#39;s &quot;c&quot;", None, ""]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    sql.register(spark)
    df.createOrReplaceTempView("sql_pages")
    assert rows_of(spark.sql("SELECT page_text(html) AS t FROM sql_pages")) == rows_of(df.select(tx.page_text(df.html)))


def test_vectors_of_partitions(spark, docs):
    chunks = chunking.fixed_chunks(docs, 8, 2).unionByName(
        spark.createDataFrame([(99, 0, None, 0)], "doc_id long, chunk_no int, chunk_text string, n_tokens int")
    )
    chunks.createOrReplaceTempView("sql_chunks")
    got = spark.sql(
        """SELECT * FROM embed_chunks(TABLE(
             SELECT doc_id, chunk_no, chunk_text, pmod(xxhash64(doc_id, chunk_no), 5) AS part FROM sql_chunks)
           PARTITION BY part)"""
    )
    wanted = embedding.embed_with(chunks, length_encoder).select("doc_id", "chunk_no", "embedding", "norm")
    near = lambda rows: [(*r[:3], None if r[3] is None else round(r[3], 6)) for r in rows]
    assert near(rows_of(got)) == near(rows_of(wanted))


def test_batches_are_bounded():
    seen = []

    def load():
        def encode(texts):
            seen.append(len(texts))
            return np.ones((len(texts), 2), np.float32)

        return encode

    table = sql.chunk_encoder(load, batch_rows=4)()
    out = [r for i in range(10) for r in table.eval({"doc_id": i, "chunk_no": 0, "chunk_text": "x"}) or ()]
    out += list(table.terminate())
    assert [r[0] for r in out] == list(range(10)) and seen == [4, 4, 2]


def test_reranker(spark):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def shared_letters(question, chunk):
        return (question.str.len() + chunk.str.len()).astype(float)

    sql.register(spark, reranker=shared_letters)
    assert spark.sql("SELECT rerank('ab', 'c') AS s").first()["s"] == 3.0


def test_wrong_arguments(spark, docs):
    with pytest.raises(PySparkException):
        spark.sql("SELECT c.* FROM sql_docs d, LATERAL sentence_chunks(d.text, 5, 5) c").collect()
