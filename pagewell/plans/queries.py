"""The registered queries: every operator over the whole given tables.

Each function takes a session and the folder of the tables. Queries about
retrieval and answers share one stored index per session and folder, as a user
builds an index once and asks many questions; `K4_build_index` builds its own.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.functions import sql
from pagewell.functions import text as tx
from pagewell.functions import vectors as vx
from pagewell.operators import answers as an
from pagewell.operators import cells, chunking, embedding, evaluation, lexical, postings, prompts, retrieve
from pagewell.operators.similarity import approx_top_k, cosine_top_k
from pagewell.plans.answering import (
    AnswerSettings,
    Index,
    IndexSettings,
    answer,
    build_index,
    build_status,
    ranked_context,
    render_prompts,
)
from pagewell.session import ship_package, spread, stored, work_dir
from pagewell.sources import files, tables
from pagewell.sources.collections import Collections, as_json, collection_info
from pagewell.streaming.ingest import (
    change_stream,
    document_stream,
    ingest_changes,
    ingest_files,
    ingest_to_collection,
    ingest_to_folder,
)
from pagewell.streaming.questions import answer_stream, turn_stream

VECTOR_DIM = 64
RANKED = [*retrieve.PAIR, "score", "rank"]
SENTENCE_SIZE, SENTENCE_OVERLAP = 1024, 200

REGISTRY: dict = {}
_indexes: dict = {}


def query(name):
    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return function(spark, folder.rstrip("/"))

        REGISTRY[name] = run
        return function

    return register


def fresh_store(spark: SparkSession, label: str) -> Collections:
    place = work_dir(spark, label)
    return Collections(spark, os.path.basename(place).replace("-", "_"), place)


def shared_index(spark: SparkSession, folder: str) -> Index:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _indexes:
        store = fresh_store(spark, "index")
        _indexes[key] = build_index(tables.documents(spark, folder), store, "documents")
    return _indexes[key]


def embedding_rows(spark, folder) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id").select(
        "vec_id", "embedding"
    )


def vector_questions(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


def turns(spark, folder) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def exported_folder(spark, folder) -> str:
    """The documents as text files, one file each, in one folder per language."""
    out = work_dir(spark, "folder")
    files.write_each(spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text"), out, by="lang")
    return out


def by_file(texts: DataFrame) -> DataFrame:
    """One row per file: its folder's language and a hash of its text, without the writer's last newline."""
    lang = F.regexp_extract("path", "lang=([a-z]+)", 1)
    texts = texts.withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    return texts.select(lang.alias("lang"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


# Sources


@query("S1_recursive_folder_scan")
def recursive_scan(spark, folder):
    root = exported_folder(spark, folder)
    return by_file(files.decode_text(files.scan_folder(spark, root, recursive=True)))


@query("S2_flat_folder_scan")
def flat_scan(spark, folder):
    root = exported_folder(spark, folder)
    # Below the English folder lies another one, which a flat scan must not enter.
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter(F.col("lang") != "en")
    docs.select("text").write.option("compression", "none").text(f"{root}/lang=en/below")
    return by_file(files.decode_text(files.scan_folder(spark, f"{root}/lang=en", recursive=False)))


@query("S3_suffix_routing")
def suffix_routing(spark, folder):
    root = exported_folder(spark, folder)
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("html")
    files.write_each(pages, f"{root}/pages", packed=True)
    scanned = files.scan_folder(spark, root)
    return by_file(files.extract(scanned, {".txt.gz": files.decode_packed_page}))


@query("S1_folder_stream")
def folder_stream(spark, folder):
    """The exported folder as a stream into a collection, in two runs; files of the second run arrive between them."""
    index = build_index(
        spark.createDataFrame([], "doc_id long, text string"), fresh_store(spark, "folder"), "files", IndexSettings(parts=8)
    )
    root, log = exported_folder(spark, folder), work_dir(spark, "folder-log")
    for late in (False, True):
        if late:
            pages = spark.read.parquet(f"{folder}/pages.parquet").select("html")
            files.write_each(pages, f"{root}/pages", packed=True)
        arriving = files.folder_stream(spark, root)
        ingest_files(arriving, index, log, {".txt.gz": files.decode_packed_page}).awaitTermination()
    read = index.store.companion(index.name, "applied").agg(F.count(F.lit(1)).alias("n_files"))
    return index.chunks.select("chunk_no", "n_tokens", F.md5("chunk_text").alias("text_md5")).crossJoin(read)


@query("S4_filename_as_id")
def filename_as_id(spark, folder):
    root = exported_folder(spark, folder)
    docs = files.as_documents(files.decode_text(files.scan_folder(spark, root)))
    return docs.agg(
        (F.count_distinct("doc_id") == F.count(F.lit(1))).alias("ids_unique"),
        F.bool_and(F.col("path").endswith(F.col("file_name"))).alias("names_match"),
        F.count_distinct("path").alias("n_files"),
    )


@query("S5_missing_folder")
def missing_folder(spark, folder):
    """One row per folder that is probed: its files, or the error as a value."""
    root = exported_folder(spark, folder)
    out = None
    for name in ("lang=en", "lang=fr", "absent"):
        try:
            found = files.scan_folder(spark, f"{root}/{name}").agg(F.count(F.lit(1)).alias("n_files"))
            row = found.select(F.lit(name).alias("folder"), "n_files", F.lit("").alias("error"))
        except files.MissingFolder as e:
            error = str(e).replace(root, "")
            row = spark.range(1).select(
                F.lit(name).alias("folder"), F.lit(0).cast("long").alias("n_files"), F.lit(error).alias("error")
            )
        out = row if out is None else out.unionByName(row)
    return out


@query("S6_page_text")
def page_text(spark, folder):
    pages = spread(spark.read.parquet(f"{folder}/pages.parquet"), "page_id")
    return pages.select("page_id", "url", tx.page_text(F.col("html")).alias("text"))


@query("S7_list_documents")
def list_documents(spark, folder):
    return tables.list_texts(spark.read.parquet(f"{folder}/documents.parquet"))


@query("S8_count_documents")
def count_documents(spark, folder):
    return tables.count_documents(spark.read.parquet(f"{folder}/documents.parquet"))


@query("S9_questions")
def question_source(spark, folder):
    return tables.benchmark_questions(spark, folder).unionByName(
        tables.user_questions(turns(spark, folder))
    )


@query("S10_open_collection")
def open_collection(spark, folder):
    index = shared_index(spark, folder)
    return index.store.open("documents").select("doc_id", "chunk_no", "chunk_text")


# Collections


@query("K1_list_collections")
def list_collections(spark, folder):
    store = shared_index(spark, folder).store
    points = None
    for row in store.names().collect():  # the collections of one database
        own = store.open(row["name"]).agg(F.count(F.lit(1)).alias("points"))
        own = own.select(F.lit(row["name"]).alias("name"), "points")
        points = own if points is None else points.unionByName(own)
    return store.names().join(points, "name").select(
        "name",
        "points",
        F.lit(store.exists("documents")).alias("documents_exists"),
        F.lit(store.exists("absent")).alias("absent_exists"),
    )


def stored_vectors(spark, folder) -> DataFrame:
    """The given vectors in the shape of collection rows."""
    vectors = embedding_rows(spark, folder).select(
        F.col("vec_id").alias("doc_id"),
        F.lit(0).alias("chunk_no"),
        F.lit("").alias("chunk_text"),
        F.lit(0).alias("n_tokens"),
        F.array().cast("array<string>").alias("tokens"),
        "embedding",
    )
    return embedding.with_norm(vectors)


@query("K2_create_if_missing")
def create_if_missing(spark, folder):
    store = fresh_store(spark, "create")
    store.create_if_missing("vectors", VECTOR_DIM)
    store.append("vectors", stored_vectors(spark, folder))
    store.create_if_missing("vectors", VECTOR_DIM)
    return store.info("vectors")


@query("K3_recreate")
def recreate(spark, folder):
    store = fresh_store(spark, "recreate")
    rows = stored_vectors(spark, folder)
    store.create_if_missing("vectors", VECTOR_DIM)
    store.append("vectors", rows)
    store.recreate("vectors", VECTOR_DIM)
    store.append("vectors", rows)
    return store.info("vectors")


@query("K4_build_index")
def index_build(spark, folder):
    index = build_index(tables.documents(spark, folder), fresh_store(spark, "build"), "documents")
    return index.chunks.select(
        "doc_id", "chunk_no", "n_tokens", F.size("tokens").alias("n_terms"), F.round("norm", 3).alias("norm")
    )


@query("K5_append")
def append_twice(spark, folder):
    store = fresh_store(spark, "append")
    rows = stored_vectors(spark, folder)
    store.create_if_missing("vectors", VECTOR_DIM, buckets=8)
    for _ in range(2):
        store.append("vectors", store.valid_rows("vectors", store.new_rows("vectors", rows)))
    return store.open("vectors").select("doc_id", F.round("norm", 4).alias("norm"))


@query("K6_collection_info")
def info(spark, folder):
    return collection_info(spark.read.parquet(f"{folder}/embeddings.parquet"), "embeddings")


@query("K7_drop_collection")
def drop_collection(spark, folder):
    store = fresh_store(spark, "drop")
    for name in ("kept", "dropped"):
        store.create_if_missing(name, VECTOR_DIM)
        store.append(name, stored_vectors(spark, folder))
    store.drop("dropped")
    points = store.open("kept").agg(F.count(F.lit(1)).alias("points"))
    return points.select(
        "points",
        F.lit(store.exists("kept")).alias("kept_exists"),
        F.lit(store.exists("dropped")).alias("dropped_exists"),
    )


@query("K8_vector_schema")
def vector_schema(spark, folder):
    rows = embedding_rows(spark, folder)
    pieces = []
    for dim in (VECTOR_DIM, embedding.DIM):
        valid, bad = embedding.split_valid(rows, dim)
        for df, ok in ((valid, True), (bad, False)):
            pieces.append(df.select(F.lit(dim).alias("dim"), F.lit(ok).alias("valid"), "vec_id"))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


@query("K9_json")
def json_rows(spark, folder):
    return as_json(info(spark, folder))


@query("K10_build_status")
def status(spark, folder):
    return build_status(shared_index(spark, folder))


# Text to chunks to vectors


@query("T1_fixed_chunks")
def fixed(spark, folder):
    return chunking.fixed_chunks(tables.documents(spark, folder))


@query("T2_sentence_packing")
def packing(spark, folder):
    docs = tables.documents(spark, folder)
    return chunking.sentence_chunks(docs, SENTENCE_SIZE - SENTENCE_OVERLAP, 0)


@query("T3_sentence_overlap")
def sentence_overlap(spark, folder):
    return chunking.sentence_chunks(tables.documents(spark, folder), SENTENCE_SIZE, SENTENCE_OVERLAP)


@query("T4_paragraphs")
def paragraph_split(spark, folder):
    return chunking.paragraphs(tables.documents(spark, folder), "\n")


def components(rows: DataFrame, *keys: str) -> DataFrame:
    """Non-zero vector components as rows; exact, since they are whole ten-thousandths."""
    return rows.select(*keys, F.posexplode("embedding").alias("place", "x")).select(
        *keys, "place", F.round(F.col("x").cast("double"), 2).alias("x")
    ).filter(F.col("x") > 0)


@query("T5_embed_chunks")
def embed_chunks(spark, folder):
    """The documents are embedded here; only the weights are taken from the index."""
    rows = shared_index(spark, folder).rows_for(tables.documents(spark, folder))
    return components(rows, "doc_id", "chunk_no")


def length_encoder():
    """A stand-in model for the encoder slot: letters, digits and words of a text."""
    import numpy as np

    def encode(texts):
        return np.array([[len(t), t.count(" ") + 1, t.count(".")] for t in texts], dtype=np.float32)

    return encode


@query("T6_encoder_slot")
def encoder_slot(spark, folder):
    chunks = chunking.fixed_chunks(tables.documents(spark, folder))
    rows = embedding.embed_with(chunks, length_encoder)
    return rows.select(
        "doc_id",
        "chunk_no",
        *[F.col("embedding")[i].cast("int").alias(n) for i, n in enumerate(["chars", "blanks", "stops"])],
        F.round("norm", 3).alias("norm"),
    )


@query("T3_T6_sql_functions")
def sql_functions(spark, folder):
    """Documents cut into sentences and embedded by functions of SQL alone."""
    sql.register(spark, load_encoder=length_encoder)
    return spark.sql(
        """
        SELECT doc_id, chunk_no, CAST(embedding[0] AS INT) AS chars, CAST(embedding[1] AS INT) AS blanks,
               CAST(embedding[2] AS INT) AS stops, round(norm, 3) AS norm
        FROM embed_chunks(TABLE(
          SELECT d.doc_id, c.chunk_no, c.chunk_text,
                 pmod(xxhash64(d.doc_id, c.chunk_no), 4096) AS part
          FROM {docs} d, LATERAL sentence_chunks(d.text, {size}, {overlap}) c) PARTITION BY part)
        """,
        docs=tables.documents(spark, folder),
        size=SENTENCE_SIZE,
        overlap=SENTENCE_OVERLAP,
    )


@query("T1_S6_sql_functions")
def native_sql_functions(spark, folder):
    """The text of all pages, cut into windows: functions written in SQL, without Python."""
    sql.register(spark)
    return spark.sql(
        """
        SELECT p.page_id, c.chunk_no, c.n_tokens, md5(c.chunk_text) AS text_md5
        FROM (SELECT page_id, page_text(html) AS body FROM {pages}) p, LATERAL fixed_chunks(p.body, 128, 28) c
        """,
        pages=spread(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id"),
    )


@query("T7_unit_vectors")
def unit_vectors(spark, folder):
    rows = embedding.with_norm(embedding_rows(spark, folder))
    units = rows.select("vec_id", "norm", vx.unit(F.col("embedding"), F.col("norm")).alias("u"))
    return units.select(
        "vec_id", F.round("norm", 4).alias("norm"), F.posexplode("u").alias("place", "x")
    ).withColumn("x", F.round("x", 4) + F.lit(0.0))


@query("T8_tokens")
def token_counts(spark, folder):
    docs = tables.documents(spark, folder)
    return docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy(
        "doc_id", "token"
    ).agg(F.count(F.lit(1)).alias("n"))


# Retrieval


@query("R1_cosine_top_k")
def cosine(spark, folder):
    rows = embedding_rows(spark, folder)
    return cosine_top_k(rows, vector_questions(rows), 5, VECTOR_DIM, ["vec_id"])


@query("R2_approximate_top_k")
def approximate(spark, folder):
    """The given vectors have no near neighbours, so many cells are needed for a recall of 0.9."""
    rows = embedding_rows(spark, folder)
    return approx_top_k(rows, vector_questions(rows), 5, VECTOR_DIM, 8, 192, ["vec_id"])


@query("R2_learned_cells")
def learned_cells(spark, folder):
    """Every vector asked about all, in learned cells that hold a quarter of them: recall and share read, measured."""
    rows = embedding_rows(spark, folder)
    centres = cells.fitted_centres(rows, ["vec_id"], VECTOR_DIM)
    celled = stored(cells.with_learned_cell(rows, centres), "celled")
    learned = cells.Cells.of(cells.cell_table(celled, centres))
    asked = vector_questions(rows)
    near = cells.learned_top_k(celled, asked, 5, learned, 0.25, ["vec_id"]).select("query_id", "vec_id")
    exact = cosine_top_k(rows, asked, 5, VECTOR_DIM, ["vec_id"]).select("query_id", "vec_id")
    visited = cells.with_visited_cells(asked, learned, 0.25).select(F.explode("probes").alias("cell"))
    visited = visited.groupBy("cell").agg(F.count(F.lit(1)).alias("visits"))  # a row per cell is shuffled, not one per visit
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    read = visited.join(sizes, "cell").agg(F.sum(F.col("n") * F.col("visits")).alias("read"))
    both = near.withColumn("hit", F.lit(1)).join(exact, ["query_id", "vec_id"], "right")
    recall = both.agg(F.count_distinct("query_id").alias("questions"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return recall.crossJoin(read).select(  # one row each
        "questions",
        (F.col("recall") >= 0.9).alias("recall_reached"),
        (F.col("read") <= 0.25 * F.col("questions") * F.col("questions")).alias("at_most_a_quarter_read"),
    )


@query("R3_embed_questions")
def question_vectors(spark, folder):
    index = shared_index(spark, folder)
    asked = retrieve.embed_questions(tables.benchmark_questions(spark, folder), index)
    return components(asked, "query_id")


@query("R4_rerank")
def rerank(spark, folder):
    index = shared_index(spark, folder)
    asked = tables.benchmark_questions(spark, folder)
    found = retrieve.candidates(asked, index, 50, "vector")
    n = asked.count()
    pairs = retrieve.look_up(found, index.chunks, n * 50)
    return lexical.bm25_rerank(pairs, index.terms_of(asked), retrieve.TOP_N).select(*RANKED)


@query("R4_bm25_search")
def bm25_search(spark, folder):
    index = shared_index(spark, folder)
    asked = tables.benchmark_questions(spark, folder)
    terms = stored(index.terms_of(asked), "question-terms")
    return postings.search(index.postings, terms, retrieve.TOP_N)


def length_reranker():
    """A stand-in model for the reranker slot: the closer two texts are in length, the better."""

    @F.pandas_udf("double")
    def score(question: pd.Series, chunk: pd.Series) -> pd.Series:
        return -(question.str.len() - chunk.str.len()).abs().astype(float)

    return score


@query("R4_reranker_slot")
def reranker_slot(spark, folder):
    asked = tables.benchmark_questions(spark, folder)
    hits = retrieve.retrieve(asked, shared_index(spark, folder), mode="vector", reranker=length_reranker())
    return hits.select(*RANKED)


@query("R5_two_stage")
def two_stage(spark, folder):
    asked = tables.benchmark_questions(spark, folder)
    hits = retrieve.retrieve(asked, shared_index(spark, folder), mode="vector")
    return hits.select(*RANKED)


@query("R6_retrieval_only")
def retrieval_only(spark, folder):
    asked = tables.benchmark_questions(spark, folder)
    return retrieve.retrieve(asked, shared_index(spark, folder), mode="union").select(
        "query_id", "doc_id", "chunk_no", "rank"
    )


@query("R7_configurable_k")
def other_k(spark, folder):
    asked = tables.benchmark_questions(spark, folder)
    return retrieve.retrieve(
        asked, shared_index(spark, folder), candidate_k=20, top_n=5, mode="vector"
    ).select(*RANKED)


# Prompts and answers


def two_stage_context(spark, folder, settings=AnswerSettings()):
    asked = tables.benchmark_questions(spark, folder)
    return asked, ranked_context(asked, shared_index(spark, folder), settings)


@query("P1_context")
def context(spark, folder):
    asked = tables.benchmark_questions(spark, folder)
    return prompts.contexts(retrieve.retrieve(asked, shared_index(spark, folder), mode="union"))


@query("P2_prompt")
def prompt(spark, folder):
    return render_prompts(tables.benchmark_questions(spark, folder), shared_index(spark, folder))


@query("P3_system_message")
def system_message(spark, folder):
    chat = prompts.messages(prompt(spark, folder))
    return chat.select("query_id", F.posexplode("messages").alias("pos", "m")).select(
        "query_id", "pos", "m.role", "m.content"
    )


@query("P4_context_budget")
def budget(spark, folder):
    _, kept = two_stage_context(spark, folder, AnswerSettings(top_n=10, num_ctx=640))
    return kept.select("query_id", "rank", "doc_id", "chunk_no", "n_tokens")


@query("P5_extractive_answer")
def extractive(spark, folder):
    _, hits = two_stage_context(spark, folder)
    return an.best_sentences(hits)


def counting_generator():
    """A stand-in model for the generator slot: tells the length of its prompt."""
    return lambda prompt: f"a prompt of {len(prompt)} characters"


@query("P5_generator_slot")
def generator_slot(spark, folder):
    asked = tables.benchmark_questions(spark, folder)
    return answer(asked, shared_index(spark, folder), AnswerSettings(load_generator=counting_generator))


@query("P4_cut_chunk")
def cut_chunk(spark, folder):
    """Chunks of 1024 words beside a prompt in a context of 1024: the first is cut to what is left."""
    settings = IndexSettings(chunk_size=1024, overlap=200)
    index = build_index(tables.documents(spark, folder), fresh_store(spark, "large"), "documents", settings)
    kept = ranked_context(tables.benchmark_questions(spark, folder), index)
    return kept.select(
        "query_id", "rank", "doc_id", "chunk_no", "n_tokens", F.md5("chunk_text").alias("text_md5")
    )


@query("P6_length_cap")
def length_cap(spark, folder):
    _, hits = two_stage_context(spark, folder)
    return an.cap_words(an.best_sentences(hits), 8)


@query("P7_refusal")
def refusal(spark, folder):
    asked, hits = two_stage_context(spark, folder)
    return an.extractive_answers(asked, hits, min_overlap=12)


@query("P8_answer")
def answers(spark, folder):
    """The whole way: vector candidates, BM25 rerank, prompt budget, answer."""
    asked = tables.benchmark_questions(spark, folder)
    return answer(asked, shared_index(spark, folder), AnswerSettings(mode="vector"))


@query("P8_answer_union")
def answers_union(spark, folder):
    return answer(tables.benchmark_questions(spark, folder), shared_index(spark, folder))


@query("P9_errors_as_values")
def errors(spark, folder):
    """All turns are asked; the text of turns that are not the user's is withheld."""
    said = F.when(F.col("role") == "user", F.col("text"))
    asked = turns(spark, folder).select(tables.turn_id().alias("query_id"), said.alias("query_text"))
    return answer(asked, shared_index(spark, folder))


@query("P10_response")
def response(spark, folder):
    return an.response_text(answers(spark, folder))


# Streams


@query("ST1_stream_ingest")
def stream_ingest(spark, folder):
    index = shared_index(spark, folder)
    out, log = work_dir(spark, "ingested"), work_dir(spark, "ingest-log")
    arriving = document_stream(spark, folder, "documents.parquet")
    ingest_to_folder(arriving, index, out, log).awaitTermination()
    return spark.read.parquet(out).select(
        "doc_id", "chunk_no", "n_tokens", F.size("tokens").alias("n_terms"), F.round("norm", 3).alias("norm")
    )


@query("ST1_stream_append")
def stream_append(spark, folder):
    """An index of the English documents; then all documents arrive, twice."""
    store = fresh_store(spark, "arrive")
    known = spread(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    index = build_index(known.filter(F.col("lang") == "en"), store, "documents")
    for _ in range(2):
        arriving = document_stream(spark, folder, "documents.parquet")
        ingest_to_collection(arriving, index, work_dir(spark, "arrive-log")).awaitTermination()
    rows = index.chunks.select(
        "doc_id", "chunk_no", F.size("tokens").alias("n_terms"), F.round("norm", 3).alias("norm")
    )
    return rows


@query("ST1_stream_changes")
def stream_changes(spark, folder):
    """An index of the English documents; then all documents arrive, some change, some are withdrawn, twice over."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    index = build_index(
        spread(docs.filter(F.col("lang") == "en"), "doc_id"), fresh_store(spark, "change"), "documents", IndexSettings(parts=8)
    )
    rows = lambda at, text, gone: docs.select("doc_id", text.alias("text"), F.lit(at).cast("long").alias("sequence"), F.lit(gone).alias("withdrawn"))
    changed = rows(2, F.concat(F.lit("changed "), "text"), False).filter("doc_id % 3 = 0")
    withdrawn = rows(3, F.lit(None).cast("string"), True).filter("doc_id % 5 = 0")
    feed = work_dir(spark, "feed")
    for part in (rows(1, F.col("text"), False), changed, withdrawn):
        part.coalesce(1).write.mode("append").parquet(feed)
    for files in (1, None):  # the second run, from a checkpoint of its own, replays everything
        arriving = change_stream(spark, feed, files_per_batch=files)
        ingest_changes(arriving, index, work_dir(spark, "change-log")).awaitTermination()
    points = index.store.totals(index.name).select(F.col("n_chunks").alias("points"))
    return index.chunks.select("doc_id", "chunk_no", "n_tokens", F.md5("chunk_text").alias("text_md5")).crossJoin(points)


@query("ST2_stream_questions")
def stream_questions(spark, folder):
    out, log = work_dir(spark, "answered"), work_dir(spark, "answer-log")
    asked = tables.user_questions(turn_stream(spark, folder, "conversations.parquet"))
    answer_stream(asked, shared_index(spark, folder), out, log).awaitTermination()
    return spark.read.parquet(out).select("query_id", "answer")


# Monitoring and evaluation


@query("M1_stage_metrics")
def stage_metrics(spark, folder):
    docs = tables.documents(spark, folder)
    seen, loaded = evaluation.observed(docs, "documents", F.size(tx.words(F.col("text"))) == 0)
    chunks, cut = evaluation.observed(
        chunking.fixed_chunks(seen), "chunks", F.col("n_tokens") < 1024
    )
    chunks.write.format("noop").mode("overwrite").save()
    return evaluation.metrics(spark, [("documents", loaded), ("chunks", cut)])


@query("M1_stream_metrics")
def stream_metrics(spark, folder):
    """Rows and rows without words of each micro-batch; the seconds are left out here."""
    index, out, log = shared_index(spark, folder), work_dir(spark, "watched"), work_dir(spark, "watched-log")
    arriving = document_stream(spark, folder, "documents.parquet")
    watched = evaluation.observed_stream(arriving, "documents", F.size(tx.words(F.col("text"))) == 0)
    run = ingest_to_folder(watched, index, out, log)
    run.awaitTermination()
    return evaluation.batch_metrics(run).filter("stage <> 'batch'")


@query("M2_result_quality")
def result_quality(spark, folder):
    index = shared_index(spark, folder)
    asked = tables.benchmark_questions(spark, folder)
    truth = stored(evaluation.quotes(tables.documents(spark, folder), asked), "truth")
    vector = cosine_top_k(index.chunks, retrieve.embed_questions(asked, index), 100, index.dim)
    terms = stored(index.terms_of(asked), "question-terms")
    bm25 = postings.search(index.postings, terms, 100)
    both = retrieve.retrieve(asked, index, mode="union")
    out = None
    for mode, hits in (("vector", vector), ("bm25", bm25), ("two_stage", both)):
        row = evaluation.quality(hits, truth).select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("M3_answer_cache")
def answer_cache(spark, folder):
    said = turns(spark, folder)
    asked = tables.user_questions(said)
    replies = said.filter(F.col("role") == "assistant").select(
        tables.turn_id(1).alias("query_id"), F.col("text").alias("answer")
    )
    cache = evaluation.cache_rows(asked, replies)
    every = asked.unionByName(tables.benchmark_questions(spark, folder))
    hits = evaluation.cache_hits(every, cache).withColumn("hit", F.lit(True))
    misses = evaluation.cache_misses(every, cache).select(
        "query_id", F.lit(None).cast("string").alias("answer"), F.lit(False).alias("hit")
    )
    return hits.unionByName(misses)
