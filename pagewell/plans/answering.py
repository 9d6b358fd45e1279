"""From documents to a stored index, and from questions to answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.operators import answers as an
from pagewell import schemas
from pagewell.operators import cells, chunking, embedding, lexical, postings, prompts, retrieve, similarity
from pagewell.operators.blockscan import Limits
from pagewell.session import scratch, stored
from pagewell.sources.collections import Collections

Chunker = Callable[[DataFrame], DataFrame]

# At most the ids of this many changed documents are broadcast, 8 bytes each.
CHANGED_IDS = 4_000_000

# Fixed value: the message of a build without losses.
BUILT = "Index created successfully"


@dataclass(frozen=True)
class IndexSettings:
    """How documents become chunks and vectors.

    Chunks are small enough that several fit into one prompt. ``load_encoder``
    fills the encoder slot; without it the hashed vectors are used.
    ``cell_bits`` stores the collection by search cells cut by fixed planes, ``learned_cells``
    by that many cells fitted to the vectors. ``parts`` stores it by that many parts of documents,
    so that `Index.upsert` replaces the parts of changed documents alone.
    """

    dim: int = embedding.DIM
    chunk_size: int = 128
    overlap: int = 28
    sentences: bool = False
    load_encoder: Callable | None = None
    cell_bits: int = 0
    buckets: int = 0
    learned_cells: int = 0
    parts: int = 0

    def kept(self) -> dict[str, int]:
        """What a collection remembers of its settings: the whole numbers."""
        names = ("chunk_size", "overlap", "sentences", "cell_bits", "buckets", "learned_cells", "parts")
        return {name: int(getattr(self, name)) for name in names}

    @classmethod
    def of(cls, properties: dict[str, str]) -> IndexSettings:
        kept = {name: int(properties[name]) for name in cls().kept() if name in properties}
        return cls(dim=int(properties["dim"]), **kept)

    def chunk(self, docs: DataFrame) -> DataFrame:
        form = chunking.sentence_chunks if self.sentences else chunking.fixed_chunks
        return chunking.add_tokens(form(docs, self.chunk_size, self.overlap))


class Index:
    """A stored collection together with what questions need to be compared with it.

    Opened by name, it has the settings it was built with. An encoder cannot be
    kept in a table: pass ``settings`` again for a collection built with one.
    """

    def __init__(self, store: Collections, name: str, settings: IndexSettings | None = None):
        name = store.pinned(name)  # a rebuild does not change what an open index reads
        properties = store.properties(name)
        self.store, self.name = store, name
        self.settings = settings or IndexSettings.of(properties)
        if properties.get("encoder") == "1" and self.settings.load_encoder is None:
            raise ValueError(f"collection {name.split('@')[0]} was built with an encoder; pass its settings to open it")
        self.dim = int(properties["dim"])

    @property
    def chunks(self) -> DataFrame:
        return self.store.open(self.name)

    @cached_property
    def weights(self) -> np.ndarray:
        return embedding.collect_weights(self.store.companion(self.name, "weights"))

    @property
    def cells(self) -> cells.Cells:
        return cells.Cells.of(self.store.companion(self.name, "cells"))

    def fit_cells(self, chunks: DataFrame) -> None:
        """Learn the search cells from vectors of the given chunks; their rows are counted as they are stored."""
        vectors = self.embed(chunks, "chunk_text")
        centres = cells.fitted_centres(vectors, schemas.CHUNK_KEYS, self.dim, self.settings.learned_cells)
        empty = cells.cell_table(vectors.select(F.lit(None).cast("int").alias("cell")).limit(0), centres)
        self.store.append_companion(self.name, "cells", empty, overwrite=True)

    def count_cells(self, rows: DataFrame) -> None:
        sizes = rows.filter("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.withColumn("centre", F.lit(None).cast("array<double>"))
        self.store.append_companion(self.name, "cells", sizes)

    def embed(self, df: DataFrame, text: str) -> DataFrame:
        """Vectors for rows that have ``tokens`` and a text column."""
        if self.settings.load_encoder is not None:
            return embedding.embed_with(df, self.settings.load_encoder, text)
        return embedding.hashed_embedding(df, self.weights, self.dim)

    def rows_for(self, docs: DataFrame) -> DataFrame:
        """Collection rows of documents. Works on a stream as well."""
        return self.with_vectors(self.settings.chunk(docs))

    def with_vectors(self, chunks: DataFrame) -> DataFrame:
        rows = self.embed(chunks, "chunk_text")
        if self.settings.parts:
            return rows.withColumn("part", self.part_of(F.col("doc_id")))
        if self.settings.learned_cells:
            return cells.with_learned_cell(rows, self.cells.centres)
        if self.settings.cell_bits:
            rows = similarity.with_cell(rows, self.settings.cell_bits, self.dim)
        return rows

    @property
    def posting_lists(self) -> DataFrame:
        return self.store.companion(self.name, "postings")

    @property
    def postings(self) -> DataFrame:
        return postings.unpacked(self.posting_lists)

    def part_of(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.settings.parts)).cast("int")

    def terms_of(self, questions: DataFrame) -> DataFrame:
        return lexical.question_terms(
            questions, self.store.companion(self.name, "terms"), self.store.totals(self.name)
        )

    def add_documents(self, docs: DataFrame, strict: bool = False) -> None:
        """Append documents; chunks the collection already holds are left as they are.

        Only new chunks are embedded. They are written once to the shared folder
        first, so that chunks and statistics are taken from the same rows.
        """
        self.repair_statistics()
        with scratch():
            chunks = stored(self.settings.chunk(docs), "chunks", self.store.spark)
            new = self.store.unseen_rows(self.name, chunks)
            every = stored(self.with_vectors(new), "new-rows", self.store.spark)
            rows = self.store.valid_rows(self.name, every, strict)
            self.store.append(self.name, rows)
            self.store.reject(self.name, every)
            if self.settings.learned_cells:
                self.count_cells(rows)
            self.write_statistics(rows)

    def upsert(self, changes: DataFrame, strict: bool = False) -> None:
        """Apply changes (doc_id, text, sequence, withdrawn): new, changed and withdrawn documents.

        Of several changes of a document the one with the highest sequence counts, and only if it is
        higher than the last one applied, so a replay or a late older change does nothing. Chunks,
        postings and the last changes are rewritten for the parts that hold such documents; the
        statistics get the difference, and are counted again if an earlier upsert was cut off.
        A change without an id or a sequence is kept among the rejected rows.
        """
        if not self.settings.parts:
            raise ValueError("only a collection stored by parts takes changes; set IndexSettings.parts")
        store, name, key = self.store, self.name, ["doc_id"]
        with scratch():
            arrived = stored(changes.select("doc_id", "text", "sequence", "withdrawn"), "changes", store.spark)
            usable = F.col("doc_id").isNotNull() & F.col("sequence").isNotNull()
            bad = arrived.filter(~usable).select(
                "doc_id", F.lit(None).cast("int").alias("chunk_no"), F.lit("a change without id or sequence").alias("reason")
            )
            store.append_companion(name, "rejected", bad)
            gone = F.coalesce("withdrawn", F.lit(False)).alias("withdrawn")
            last = F.max(F.struct("sequence", gone, "text")).alias("last")
            latest = arrived.filter(usable).groupBy("doc_id").agg(last).select("doc_id", "last.*")
            latest = latest.withColumn("part", self.part_of(F.col("doc_id")))
            done = store.companion(name, "applied").select("doc_id", "part", F.col("sequence").alias("before"))
            news = latest.join(done, ["doc_id", "part"], "left").filter("before IS NULL OR sequence > before")
            news = stored(news.drop("before"), "news")
            parts = [r[0] for r in news.select("part").distinct().collect()]  # at most settings.parts
            if not parts:
                return
            self.repair_statistics()
            store.remember(name, unfinished=1)
            here = F.col("part").isin(parts)
            every = stored(self.rows_for(news.filter("NOT withdrawn").select("doc_id", "text")), "new-rows")
            new = store.valid_rows(name, every, strict)
            old = self.chunks.filter(here)
            # The ids travel to the collection, whose rows would else be shuffled with all their vectors, twice.
            ids = news.select(*key)
            ids = F.broadcast(ids) if news.count() <= CHANGED_IDS else ids
            removed = stored(old.select(*schemas.CHUNK_KEYS, "tokens").join(ids, key, "left_semi"), "removed")
            kept = stored(old.join(ids, key, "left_anti").select(*old.columns), "kept")
            rows = kept.unionByName(new.select(*old.columns))
            applied = store.companion(name, "applied").filter(here).join(ids, key, "left_anti")
            applied = stored(applied.unionByName(news.select(*applied.columns)), "applied")
            store.sketch(name, new)
            store.overwrite_parts(name, None, rows, parts)
            store.overwrite_parts(name, "postings", self.listed(rows).sortWithinPartitions("token"), parts)
            store.reject(name, every)
            for more, sign in ((new, 1), (removed, -1)):
                self.count_statistics(self.listed(more), more, sign)
            store.overwrite_parts(name, "applied", applied, parts)
            store.remember(name, unfinished=0)

    def listed(self, rows: DataFrame) -> DataFrame:
        """The postings of rows of the collection, as they are stored."""
        if self.settings.parts:
            return postings.lists(rows.withColumn("part", self.part_of(F.col("doc_id"))), "part")
        return postings.lists(rows)

    def count_statistics(self, listed: DataFrame, rows: DataFrame, sign: int = 1, overwrite: bool = False) -> None:
        """Counts and totals as increments; with sign -1 those of removed rows. Totals come last."""
        terms, totals = lexical.list_frequencies(listed), lexical.chunk_totals(rows)
        if sign < 0:
            none = F.lit(None).cast("int")
            terms = terms.select("token", (-F.col("n_chunks")).alias("n_chunks"), none.alias("max_tf"), none.alias("min_len"))
            totals = totals.select((-F.col("n_chunks")).alias("n_chunks"), (-F.col("n_terms")).alias("n_terms"))
        self.store.append_companion(self.name, "terms", terms, overwrite)
        self.store.append_companion(self.name, "totals", totals, overwrite)

    def reweigh(self) -> None:
        """Weights from the present statistics, and all vectors anew from the stored tokens.

        For a collection that has grown beyond the corpus its weights were counted on.
        """
        rows = stored(self.chunks.drop("embedding", "norm", "cell"), "reweighed", self.store.spark)
        self.count_weights()
        self.store.append(self.name, self.with_vectors(rows), overwrite=True, sketched=True)

    def count_weights(self) -> None:
        totals = self.store.totals(self.name)
        weights = embedding.slot_weights(self.store.companion(self.name, "terms"), totals)
        self.store.append_companion(self.name, "weights", weights, overwrite=True)
        self.__dict__.pop("weights", None)

    def write_statistics(self, rows: DataFrame, overwrite: bool = False) -> None:
        """Postings, counts and totals of ``rows``; of all chunks with ``overwrite``."""
        listed = self.listed(rows)
        ordered = postings.in_slots(listed, "part" if self.settings.parts else "slot")
        self.store.append_companion(self.name, "postings", ordered, overwrite)
        self.count_statistics(self.posting_lists if overwrite else listed, rows, 1, overwrite)

    def repair_statistics(self) -> None:
        """Count again if an earlier append or upsert was cut off between chunks and statistics.

        Seen by comparing the row count, which Parquet keeps, with the totals,
        which are written last, and by the mark that an upsert leaves until its end.
        """
        whole = self.store.properties(self.name).get("unfinished", "0") == "0"
        if not whole or self.store.totals(self.name).first()["n_chunks"] != self.chunks.count():
            self.write_statistics(self.chunks, overwrite=True)


def build_index(
    docs: DataFrame,
    store: Collections,
    name: str,
    settings: IndexSettings = IndexSettings(),
    strict: bool = False,
) -> Index:
    """Chunk, embed and store documents as a new collection, replacing one of that name.

    The new one is built beside the old one, which is read until the new one is complete; a build
    that fails leaves it as it was. The documents are split and tokenised once, into a table in the shared
    folder; statistics, weights and vectors are computed from that table.
    """
    celled = bool(settings.cell_bits or settings.learned_cells)
    staged = store.begin(name, settings.dim, settings.buckets or None, celled, bool(settings.parts))
    try:
        store.remember(staged, **settings.kept(), encoder=int(settings.load_encoder is not None))
        index = Index(store, staged, settings)
        with scratch():
            fill(index, stored(settings.chunk(docs), "chunks"), strict)
    except BaseException:
        store.abandon(staged)
        raise
    store.switch(name, staged)
    return index


def fill(index: Index, chunks: DataFrame, strict: bool) -> None:
    """The tables of an empty version, from tokenised chunks."""
    store, name, settings = index.store, index.name, index.settings
    index.write_statistics(chunks, overwrite=True)
    store.sketch(name, chunks)
    if settings.load_encoder is None:
        index.count_weights()
    if settings.learned_cells:
        index.fit_cells(chunks)
    if settings.load_encoder is None:
        store.append(name, store.valid_rows(name, index.with_vectors(chunks), strict), sketched=True)
    else:  # an encoder's vectors are not trusted, and not computed twice
        every = stored(index.with_vectors(chunks), "encoded")
        store.append(name, store.valid_rows(name, every, strict), sketched=True)
        store.reject(name, every)
        index.repair_statistics()
    if settings.learned_cells:
        index.count_cells(index.chunks)


def build_status(index: Index) -> DataFrame:
    """(status, message, points, documents) of a finished build, from what is stored and rejected."""
    rejected = index.store.companion(index.name, "rejected").agg(F.count(F.lit(1)).alias("rejected"))
    counts = index.chunks.agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("doc_id").alias("documents")
    ).crossJoin(rejected)  # one row each
    lost = F.col("rejected") > 0
    status = F.when(lost & (F.col("points") == 0), "failed").when(lost, "partial").otherwise("success")
    return counts.select(
        status.alias("status"),
        F.when(lost, F.concat(F.col("rejected").cast("string"), F.lit(" chunks rejected")))
        .otherwise(BUILT)
        .alias("message"),
        "points",
        "documents",
    )


@dataclass(frozen=True)
class AnswerSettings:
    candidate_k: int = retrieve.CANDIDATE_K
    top_n: int = retrieve.TOP_N
    mode: str = "union"
    num_ctx: int = prompts.NUM_CTX
    num_predict: int = prompts.NUM_PREDICT
    min_overlap: int = 1
    reranker: object = None
    load_generator: Callable | None = None
    limits: Limits = Limits()


def ranked_context(
    questions: DataFrame, index: Index, s: AnswerSettings = AnswerSettings()
) -> DataFrame:
    """The reranked chunks of each question with their texts, cut to the budget."""
    hits = retrieve.retrieve(
        questions, index, s.candidate_k, s.top_n, s.mode, s.reranker, s.limits
    )
    return prompts.within_budget(
        prompts.with_questions(hits, questions), s.num_ctx, s.num_predict
    )


def render_prompts(
    questions: DataFrame, index: Index, s: AnswerSettings = AnswerSettings()
) -> DataFrame:
    return prompts.prompts(questions, prompts.contexts(ranked_context(questions, index, s)))


def answer(
    questions: DataFrame, index: Index, s: AnswerSettings = AnswerSettings()
) -> DataFrame:
    """(query_id, answer, error), one row for every question.

    A question that cannot be asked, or whose generation fails, has its error as
    a value and does not disturb the others. Questions are numbered and stored
    first, so an id that is NULL or used twice does no harm.
    """
    numbered = an.check_questions(questions).withColumn("number", F.monotonically_increasing_id())
    checked = stored(numbered, "questions", index.store.spark)
    good = checked.filter(F.col("error").isNull())
    good = good.select(F.col("number").alias("query_id"), "query_text")
    if s.load_generator is not None:
        done = an.generate_with(render_prompts(good, index, s), s.load_generator)
        done = done.withColumnRenamed("error", "failure")
        done = an.cap_words(done, s.num_predict)
    else:
        done = an.extractive_answers(
            good, ranked_context(good, index, s), s.num_predict, s.min_overlap
        ).withColumn("failure", F.lit(None).cast("string"))
    done = done.withColumnRenamed("query_id", "number")
    joined = checked.select("query_id", "number", "error").join(done, "number", "left")
    return an.errors_as_answers(
        joined.select(
            "query_id", "answer", F.coalesce("error", "failure").alias("error")
        )
    )
