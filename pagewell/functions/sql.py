"""The slots as functions of Spark SQL.

    register(spark, load_encoder=load_my_model, reranker=my_pandas_udf)

    SELECT d.doc_id, c.* FROM documents d, LATERAL fixed_chunks(d.text, 1024, 200) c
    SELECT d.doc_id, c.* FROM documents d, LATERAL sentence_chunks(d.text, 1024, 200) c
    SELECT * FROM embed_chunks(TABLE(chunks) PARTITION BY part)
    SELECT page_text(html) FROM pages
    SELECT rerank(query_text, chunk_text) FROM candidates

`fixed_chunks` and `page_text` are written in SQL and stay in the JVM. `sentence_chunks` and
`embed_chunks` run in Python. `embed_chunks` takes rows with doc_id, chunk_no and chunk_text,
holds ``BATCH_ROWS`` of them at a time and loads the encoder once per worker; each value of the
partitioning column goes to one task, so it should be a spread number, not a key that may be frequent.
Spark takes no call of one SQL function as an argument of another; put the inner one in a subquery.

Defined results: a NULL or empty text has no chunks; a NULL chunk text has a NULL vector and norm.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewell.functions import text as tx

BATCH_ROWS = 256

CHUNK = "chunk_no int, chunk_text string, n_tokens int"
VECTOR = "doc_id bigint, chunk_no int, embedding array<float>, norm double"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed_chunks_sql() -> str:
    """Windows of words, as in `functions.text.window_structs`; the text is split once."""
    words = f"filter(split(body, {_quoted(tx.SPACE)}), x -> x <> '')"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION fixed_chunks(body STRING, size INT, overlap INT)
RETURNS TABLE (chunk_no INT, chunk_text STRING, n_tokens INT)
RETURN SELECT c.chunk_no, c.chunk.chunk_text, c.chunk.n_tokens
  FROM posexplode(flatten(transform(
    filter(array({words}), w -> size(w) > 0),
    w -> transform(
      sequence(0, greatest(size(w) - 1 - overlap, 0), size - overlap),
      i -> struct(array_join(slice(w, i + 1, size), ' ') AS chunk_text, least(size, size(w) - i) AS n_tokens))
  ))) c(chunk_no, chunk)"""


def page_text_sql() -> str:
    """The replacements of `functions.text.page_text`, in the same order."""
    body = "html"
    for pattern in (tx.HIDDEN_BLOCK, tx.COMMENT, tx.TAG):
        body = f"regexp_replace({body}, {_quoted(pattern)}, ' ')"
    for entity, char in tx.ENTITIES:
        body = f"replace({body}, {_quoted(entity)}, {_quoted(char)})"
    body = f"trim(regexp_replace({body}, {_quoted(tx.SPACE)}, ' '))"
    return f"CREATE OR REPLACE TEMPORARY FUNCTION page_text(html STRING) RETURNS STRING RETURN {body}"


class SentenceChunks:
    """Sentences packed greedily, as `operators.chunking.sentence_chunks` does for a column."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int]]:
        if not 0 <= overlap < size:
            raise ValueError("need 0 <= overlap < size")
        budget = size - overlap
        sentences = []
        for sentence in re.split(r"\n+", re.sub(tx.SENTENCE_END, "\\1\n", text or "")):
            words = [w for w in re.split(tx.SPACE, sentence) if w]
            sentences += [words[i : i + budget] for i in range(0, len(words), budget)]
        lengths = np.array([len(s) for s in sentences], np.int64)
        joined = [" ".join(s) for s in sentences]
        for number, (lead, end, n) in enumerate(tx.pack_plan(lengths, budget, overlap)):
            yield number, " ".join(joined[lead:end]), n


_encoders: dict[Callable, Callable] = {}


def _encoder(load: Callable[[], Callable]) -> Callable:
    if load not in _encoders:
        _encoders[load] = load()
    return _encoders[load]


def chunk_encoder(load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch_rows: int = BATCH_ROWS) -> type:
    """The class of a table function that encodes the chunks of its partition batch by batch."""

    class EmbedChunks:
        def __init__(self):
            self.rows: list[tuple] = []

        def eval(self, row):
            self.rows.append((row["doc_id"], row["chunk_no"], row["chunk_text"]))
            if len(self.rows) >= batch_rows:
                yield from self.terminate()

        def terminate(self):
            rows, self.rows = self.rows, []
            texts = [text for *_, text in rows if text is not None]
            vectors = iter(_encoder(load_encoder)(texts) if texts else [])
            for doc_id, chunk_no, text in rows:
                if text is None:
                    yield doc_id, chunk_no, None, None
                else:
                    vector = np.asarray(next(vectors), np.float32)
                    exact = vector.astype(np.float64)
                    yield doc_id, chunk_no, vector.tolist(), float(np.sqrt(exact @ exact))

    return EmbedChunks


def register(
    spark: SparkSession,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
    reranker: Callable | None = None,
) -> None:
    """Make the functions known to the session; those of models only if the models are given."""
    spark.sql(fixed_chunks_sql())
    spark.sql(page_text_sql())
    spark.udtf.register("sentence_chunks", F.udtf(SentenceChunks, returnType=CHUNK))
    if load_encoder is not None:
        spark.udtf.register("embed_chunks", F.udtf(chunk_encoder(load_encoder), returnType=VECTOR))
    if reranker is not None:
        spark.udf.register("rerank", reranker)
