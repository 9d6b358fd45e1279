"""Two-stage retrieval: many cheap candidates, then a few reranked chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.functions import text as tx
from pagewell.operators import lexical, postings
from pagewell.operators.blockscan import Limits
from pagewell.operators.cells import learned_top_k
from pagewell.operators.similarity import approx_top_k, cosine_top_k
from pagewell.session import stored

PAIR = ["query_id", "doc_id", "chunk_no"]
CANDIDATE_K = 100

# Fixed value: how many chunks the reranker keeps.
TOP_N = 3

SEARCH_OPTIONS = {"exact": set(), "approx": {"bits", "probes"}, "learned": {"share"}}

# At most this many (query, chunk) keys are broadcast, below 100 bytes each.
LOOKUP_ROWS = 1_000_000


def embed_questions(questions: DataFrame, index) -> DataFrame:
    """Questions in the vector space of the index."""
    return index.embed(questions.withColumn("tokens", tx.tokens(F.col("query_text"))), "query_text")


# The asked terms of at most this many questions are broadcast, some hundred bytes each.
TERMS_ROWS = 200_000
COLUMNS = ("chunk_text", "n_tokens", "tokens")


def look_up(hits: DataFrame, chunks: DataFrame, at_most: int, wanted: tuple = COLUMNS) -> DataFrame:
    """Add the stored columns of the hits' chunks, or those that are ``wanted``.

    ``at_most`` is the proven number of hits (questions times hits per question).
    Within the bound the hits travel to the collection, which is scanned in place
    and not shuffled; beyond it both sides are joined by key, which a bucketed
    collection does without being shuffled either.
    """
    side = F.broadcast(hits) if at_most <= LOOKUP_ROWS else hits
    return chunks.select("doc_id", "chunk_no", *wanted).join(side, ["doc_id", "chunk_no"])


def best_texts(found: DataFrame, chunks: DataFrame, terms: DataFrame, n_questions: int, at_most: int, top_n: int) -> DataFrame:
    """The reranked best of very many hits: texts are read for the best alone, and terms travel to the tokens.

    Chunks that share a key are told apart by a hash of their texts.
    """
    mark = F.xxhash64("chunk_text").alias("mark")
    pairs = look_up(found, chunks, at_most, ("tokens", mark))
    few = terms.select("query_id", "terms", "idfs", "avg_len")
    few = F.broadcast(few) if n_questions <= TERMS_ROWS else few
    best = stored(lexical.bm25_rerank(pairs, few, top_n), "best")
    texts = look_up(best.drop("mark").distinct(), chunks, n_questions * top_n, ("chunk_text", "n_tokens", mark))
    return best.join(texts.select("query_id", "rank", "mark", "chunk_text", "n_tokens").distinct(), ["query_id", "rank", "mark"])


def check_arguments(mode: str, search: str = "exact", options: dict | None = None) -> None:
    """Refuse what no search knows, before anything is read."""
    if mode not in ("vector", "bm25", "union") or search not in SEARCH_OPTIONS:
        raise ValueError("mode is vector, bm25 or union; search is exact, approx or learned")
    if unknown := set(options or {}) - SEARCH_OPTIONS[search]:
        raise TypeError(f"{search} search has no option {', '.join(sorted(unknown))}")


def candidates(
    questions: DataFrame,
    index,
    k: int = CANDIDATE_K,
    mode: str = "vector",
    terms: DataFrame | None = None,
    limits: Limits = Limits(),
    search: str = "exact",
    **search_options,
) -> DataFrame:
    """(query_id, doc_id, chunk_no) by vectors, by BM25, or by both."""
    check_arguments(mode, search, search_options)
    found = []
    if mode != "bm25":
        asked = embed_questions(questions, index)
        if search == "learned":
            found.append(learned_top_k(index.chunks, asked, k, index.cells, limits=limits, **search_options))
        else:
            by_vector = cosine_top_k if search == "exact" else approx_top_k
            found.append(by_vector(index.chunks, asked, k, index.dim, limits=limits, **search_options))
    if mode != "vector":
        terms = index.terms_of(questions) if terms is None else terms
        found.append(postings.search(index.postings, terms, k, limits))
    if len(found) == 1:
        return found[0].select(*PAIR)
    return found[0].select(*PAIR).unionByName(found[1].select(*PAIR)).distinct()


def retrieve(
    questions: DataFrame,
    index,
    candidate_k: int = CANDIDATE_K,
    top_n: int = TOP_N,
    mode: str = "vector",
    reranker=None,
    limits: Limits = Limits(),
    **search_options,
) -> DataFrame:
    """The reranked best chunks of each question, with their text but without an answer.

    Columns: query_id, doc_id, chunk_no, score, rank, chunk_text, n_tokens.
    ``reranker`` is a pandas UDF of (question, chunk) -> double; the default is
    BM25. Both stages run in every mode.
    """
    check_arguments(mode, search_options.get("search", "exact"), {k: v for k, v in search_options.items() if k != "search"})
    columns = [*PAIR, "score", "rank", "chunk_text", "n_tokens"]
    n_questions = questions.count()
    terms = index.terms_of(questions)
    if mode != "vector":
        terms = stored(terms, "question-terms")
    found = candidates(questions, index, candidate_k, mode, terms, limits, **search_options)
    at_most = n_questions * candidate_k * (2 if mode == "union" else 1)
    if reranker is None and at_most > LOOKUP_ROWS:
        return best_texts(found, index.chunks, terms, n_questions, at_most, top_n).select(*columns)
    pairs = look_up(found, index.chunks, at_most)
    if reranker is not None:
        return lexical.rerank_with(pairs, questions, reranker, top_n).select(*columns)
    return lexical.bm25_rerank(pairs, terms, top_n).select(*columns)
