"""BM25 search over a stored table of postings: (token, chunk, count, length), by slots of tokens.

Stored are lists, one row for a token of many chunks (`lists`); a search reads them as one row for each chunk.

A search reads the slots of the tokens that are asked, and of them the asked tokens. It is exact
without scoring every chunk that has a common token, by the upper bounds kept for each token:

1. the chunks best by a question's most valuable tokens are scored whole; the k-th best of them is a
   floor that no chunk of the result lies below;
2. the least valuable tokens that together cannot reach the floor make no candidate;
3. chunks with any other token are candidates, unless even all left-out tokens could not lift
   them to the floor; the left-out tokens are then looked up for the candidates alone.

That is for asked tokens beyond the bound of a task. Within it the asked postings meet by blocks of chunks, where
all questions are scored at once (`block_scores`): a chunk's postings are in one block, so its sums are whole.

Else everything is a join, a sum by (question, chunk) and a ranking, so Spark spreads it: no task holds
a token's list or a question's chunks. Asked tokens are broadcast while their number is within a
bound; beyond it both sides meet by token and a salt of the chunk, so a token of most chunks is many keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewell.operators.blockscan import DECIMALS, MATRIX_CELLS, Limits, merge_best, round_scores
from pagewell.operators.embedding import list_rows
from pagewell.operators.lexical import saturation
from pagewell.session import scratch, stored

# Parts a stored table of postings is cut into, by a hash of the token.
SLOTS = 32
COLUMNS = "token string, doc_ids array<bigint>, chunk_nos array<int>, tfs array<int>, lengths array<int>, slot int"
LISTED = {"doc_ids": "doc_id", "chunk_nos": "chunk_no", "tfs": "tf", "lengths": "length"}
KEYS = ["doc_id", "chunk_no"]

# Chunks of a question's most valuable tokens that are looked at for its floor (its first token always
# is), and how many of the best of them are scored whole, at least and for each wanted hit.
PROBE_CHUNKS = 2_000
PROBE_KEPT, PROBE_PER_HIT = 20, 2
# Left-out tokens reach at most this share of the floor, so that a chunk needs the others to be a candidate.
LEFT_SHARE = 0.5
# Scores are compared after rounding to four decimals, so a floor is lowered by more than that.
MARGIN = 2 * 10.0**-DECIMALS
# With at most this many asked tokens their names are part of the scan's filter.
LITERALS = 1_000
SALTS = 16
# Postings of a block of chunks that is scored at once, and numbers that an asked token takes in a task.
BLOCK_POSTINGS = 500_000
ASKED_VALUES = 4
# A term that adds to at least one of so many scores of a block is summed as part of a matrix product.
COMMON = 500
# Blocks are scored in rounds, each of so many times the blocks of all before it, which give the floors for it.
ROUND_GROWTH = 4


def slot_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def gather(batches: Iterator[pa.RecordBatch], by: str | None = None) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of a batch of chunks, each with the chunks that have it and how often."""
    for batch in batches:
        values, row = list_rows(batch.column("tokens"))
        coded = pc.dictionary_encode(values)
        width = max(len(coded.dictionary), 1)
        code, tf = np.unique(row * width + coded.indices.to_numpy(), return_counts=True)
        row, code = code // width, code % width
        part = batch.column(by).to_numpy(zero_copy_only=False)[row] if by else np.zeros(len(row), np.int32)
        order = np.lexsort((row, code, part))
        row, code, tf, part = row[order], code[order], tf[order], part[order]
        firsts = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(part, prepend=-1))
        ends, at = pa.array(np.append(firsts, len(row)), pa.int32()), pa.array(row)
        columns = {
            "token": coded.dictionary.take(pa.array(code[firsts])),
            "doc_ids": pa.ListArray.from_arrays(ends, batch.column("doc_id").take(at)),
            "chunk_nos": pa.ListArray.from_arrays(ends, batch.column("chunk_no").take(at)),
            "tfs": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
            "lengths": pa.ListArray.from_arrays(ends, batch.column("length").take(at)),
        }
        if by:
            columns[by] = pa.array(part[firsts], pa.int32())
        yield pa.RecordBatch.from_pydict(columns)


def lists(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Postings as they are stored: a row for each token of a batch of chunks (with equal ``by``). Nothing is shuffled.

    So a token is moved, sorted and stored once for many chunks.
    """
    schema = ", ".join(c for c in COLUMNS.split(", ") if c != "slot int") + (f", {by} int" if by else "")
    own = chunks.select(*KEYS, "tokens", F.size("tokens").alias("length"), *([by] if by else []))
    rows = own.mapInArrow(lambda batches: gather(batches, by), schema)
    return rows.withColumn("slot", slot_of(F.col("token")))


def unpacked(lists: DataFrame) -> DataFrame:
    """One row for every token and chunk of `lists`."""
    others = [c for c in lists.columns if c not in LISTED]
    hit = F.explode(F.arrays_zip(*LISTED)).alias("hit")
    return lists.select(*others, hit).select(*others, *[F.col(f"hit.{c}").alias(LISTED[c]) for c in LISTED])


def postings(chunks: DataFrame) -> DataFrame:
    """One row for every distinct token of a chunk. A projection: nothing is shuffled."""
    return unpacked(lists(chunks))


def in_slots(rows: DataFrame, by: str = "slot") -> DataFrame:
    """Postings as they are stored: few files per slot, each sorted by token, so that a scan skips the rest."""
    return rows.hint("rebalance", by).sortWithinPartitions(by, "token")


def asked_tokens(terms_of_questions: DataFrame) -> DataFrame:
    """(query_id, token, idf, bound, n, avg_len), one row for each token of a question."""
    zipped = F.explode(F.arrays_zip("terms", "idfs", "bounds", "counts")).alias("t")
    return terms_of_questions.select("query_id", "avg_len", zipped).select(
        "query_id",
        F.col("t.terms").alias("token"),
        F.col("t.idfs").alias("idf"),
        F.col("t.bounds").alias("bound"),
        F.col("t.counts").alias("n"),
        "avg_len",
    )


def reading(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The postings of the asked tokens: if these are few, their slots are pruned and their names pushed down."""
    own = rows.select("slot", "token", *KEYS, "tf", "length")
    named = asked.select("token", slot_of(F.col("token"))).distinct().limit(LITERALS + 1).collect()
    if len(named) > LITERALS:
        return own
    return own.filter(F.col("slot").isin(list({r[1] for r in named})) & F.col("token").isin([r[0] for r in named]))


@dataclass(frozen=True)
class Asked:
    """The postings to read and the asked tokens, measured once; ``few`` tokens may be broadcast."""

    own: DataFrame
    few: bool
    limits: Limits

    def partial_scores(self, tokens: DataFrame, *carried: str) -> DataFrame:
        """(query_id, keys, score, carried): what the ``tokens`` add to the chunks that have them."""
        if self.few:
            met = self.own.join(F.broadcast(tokens), "token")
        else:
            salt = F.pmod(F.xxhash64(*KEYS), F.lit(SALTS))
            salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
            met = self.own.withColumn("salt", salt).join(tokens.withColumn("salt", salts), ["token", "salt"])
        return met.groupBy("query_id", *KEYS).agg(F.sum(part_score()).alias("score"), *[F.first(c).alias(c) for c in carried])

    def others(self, tokens: DataFrame, found: DataFrame) -> DataFrame:
        """(query_id, keys, score): what the ``tokens`` add to the ``found`` chunks, one row for each of them."""
        weights = tokens.groupBy("query_id").agg(
            F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("idfs"), F.first("avg_len").alias("avg_len")
        )
        candidates = found.select("query_id", *KEYS)
        if self.few:
            weights = F.broadcast(weights)
        if found.count() <= self.limits.block_rows * SALTS:
            candidates = F.broadcast(candidates)
        met = self.own.join(candidates, KEYS).join(weights, "query_id")
        met = met.withColumn("idf", F.try_element_at("idfs", F.col("token"))).filter("idf IS NOT NULL")
        return met.select("query_id", *KEYS, part_score().alias("score"))


def part_score() -> Column:
    return F.col("idf") * saturation(F.col("tf"), F.col("length"), F.col("avg_len"))


def with_floors(of: Asked, asked: DataFrame, k: int) -> DataFrame:
    """Adds to the asked tokens ``floor``, ``needed`` (makes candidates) and ``rest`` (bound of all others together)."""
    by_question = W.partitionBy("query_id")
    first = by_question.orderBy(F.desc("bound"), "token")
    marked = asked.withColumn("place", F.row_number().over(first)).withColumn("seen", F.sum("n").over(first))
    marked = stored(marked.withColumn("probe", (F.col("place") == 1) | (F.col("seen") <= PROBE_CHUNKS)), "probes")
    ranked = of.partial_scores(marked.filter("probe")).withColumn(
        "r", F.row_number().over(by_question.orderBy(F.desc("score"), *KEYS))
    )
    found = stored(ranked.filter(F.col("r") <= max(PROBE_KEPT, PROBE_PER_HIT * k)).drop("r"), "probed")
    whole = found.unionByName(of.others(marked.filter("not probe"), found))
    whole = whole.groupBy("query_id", *KEYS).agg(F.sum("score").alias("score"))
    floors = whole.withColumn("r", F.row_number().over(by_question.orderBy(F.desc("score")))).filter(F.col("r") == k)
    last = by_question.orderBy("bound", F.desc("token"))
    return (
        asked.join(floors.select("query_id", (F.col("score") - MARGIN).alias("floor")), "query_id", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .withColumn("needed", F.sum("bound").over(last) >= LEFT_SHARE * F.col("floor"))
        .withColumn("rest", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))).over(by_question), F.lit(0.0)))
    )


class AskedBlock:
    """The asked tokens as arrays: ``vocabulary``, and the questions that ask each term, by question and term."""

    def __init__(self, asked: pa.Table):
        token = pc.dictionary_encode(asked["token"].combine_chunks())
        query = pc.dictionary_encode(asked["query_id"].combine_chunks(), null_encoding="encode")
        self.vocabulary, self.query_ids = token.dictionary, query.dictionary
        width = max(len(self.vocabulary), 1)
        pair = query.indices.to_numpy() * np.int64(width) + token.indices.to_numpy()
        pair, at = np.unique(pair, return_inverse=True)  # a question asked under one id twice counts twice
        self.idf = np.bincount(at, asked["idf"].to_numpy(), minlength=len(pair))
        self.question, self.term = pair // width, pair % width
        self.avg = asked["avg_len"][0].as_py() if len(asked) else 1.0


def common_terms(sums: np.ndarray, cells: int, at_most: int) -> np.ndarray:
    """The terms that add to many scores of a block, so that they are cheaper as rows of a matrix; the most common first."""
    order = np.argsort(-sums, kind="stable")[:at_most]
    return order[sums[order] * COMMON >= cells]


def add_postings(scores: np.ndarray, question, idf, start, held, chunk: np.ndarray, weight: np.ndarray) -> None:
    """To each question's scores what its terms add, a bounded number of postings at a time."""
    ends = np.cumsum(held)
    at = 0
    while at < len(held):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + MATRIX_CELLS, side="right")))
        n = held[at:end]
        # Of every pair of a question and a term all the term's postings, one after the other.
        posting = np.arange(ends[end - 1] - done) + np.repeat(start[at:end] - (ends[at:end] - n - done), n)
        cell = np.repeat(question[at:end] * scores.shape[1], n) + chunk[posting]
        np.add.at(scores.reshape(-1), cell, np.repeat(idf[at:end], n) * weight[posting])
        at = end


def best_of_block(table: pa.Table, asked: AskedBlock, k: int, floors: np.ndarray | None = None) -> pa.Table:
    """The k best chunks of every question among the chunks of one block, whose asked postings are the ``table``.

    A chunk below the ``floors`` of its question is in no result and is left out.
    """
    keys = [table[key].combine_chunks() for key in KEYS]
    order_by = [x for key in reversed(keys) for x in (key.fill_null(0).to_numpy(), np.asarray(key.is_valid()))]
    order = np.lexsort(order_by)
    changed = np.any([np.diff(x[order], prepend=x[order][:1]) != 0 for x in order_by], axis=0)
    chunk = np.empty(len(order), np.int64)
    chunk[order] = np.cumsum(changed)  # numbered as ties are broken
    n_chunks, named = int(chunk.max()) + 1, np.empty(int(chunk.max()) + 1, np.int64)
    named[chunk] = np.arange(len(chunk))
    term = table["term"].to_numpy()
    weight = saturation(table["tf"].to_numpy(), table["length"].to_numpy(), asked.avg)
    pair, at = np.unique(term * np.int64(n_chunks) + chunk, return_inverse=True)
    weight = np.bincount(at, weight, minlength=len(pair))
    term, chunk = pair // n_chunks, pair % n_chunks
    firsts = np.searchsorted(term, np.arange(len(asked.vocabulary) + 1))
    rows: list[tuple] = []
    step = max(1, MATRIX_CELLS // n_chunks)
    held, n_asking = np.diff(firsts), np.bincount(asked.term, minlength=len(asked.vocabulary))
    common = common_terms(held * n_asking, n_chunks * len(asked.query_ids), min(MATRIX_CELLS // step, 4 * MATRIX_CELLS // n_chunks))
    weights = np.zeros((len(common), n_chunks))
    for i, t in enumerate(common):
        weights[i, chunk[firsts[t] : firsts[t + 1]]] = weight[firsts[t] : firsts[t + 1]]
    place = np.full(len(asked.vocabulary), -1)
    place[common] = np.arange(len(common))
    for low in range(0, len(asked.query_ids), step):
        mine = slice(*np.searchsorted(asked.question, [low, low + step]))
        question, term, idf = asked.question[mine] - low, asked.term[mine], asked.idf[mine]
        is_common = place[term] >= 0
        idfs = np.zeros((min(step, len(asked.query_ids) - low), len(common)))
        idfs[question[is_common], place[term[is_common]]] = idf[is_common]
        scores = idfs @ weights
        rare = np.flatnonzero(~is_common & (held[term] > 0))
        add_postings(scores, question[rare], idf[rare], firsts[term[rare]], held[term[rare]], chunk, weight)
        for q, own in enumerate(scores):
            floor = -np.inf if floors is None else floors[low + q] - MARGIN  # rounding may lift those just below
            found = np.flatnonzero(own >= floor if floor > 0 else own > 0)
            if len(found) > k:
                found = found[own[found] >= np.partition(own[found], -k)[-k] - MARGIN]
            score = round_scores(own[found])
            best = np.lexsort((found, -score))[:k]
            rows.append((np.full(len(best), low + q), found[best], score[best]))
    q, found, score = map(np.concatenate, zip(*rows)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    columns = [asked.query_ids.take(pa.array(q)), *[key.take(pa.array(named[found])) for key in keys], pa.array(score)]
    return pa.Table.from_arrays(columns, names=["query_id", *KEYS, "score"])


def block_scores(own: DataFrame, asked: DataFrame, k: int, merge_ways: int = Limits().merge_ways) -> DataFrame:
    """(query_id, keys, score): of each block of chunks the k best of every question, so all that can be in a result.

    Each posting of an asked token is moved once, however many questions ask it; pairs of questions and chunks
    exist only as sums in the task that has the chunks. A block is bounded in postings, the sums in cells.
    Many blocks are scored in a few rounds: the k-th best of a question so far is its floor in the next one, so
    what blocks send grows with the number of rounds, not with that of blocks.
    """
    read = asked.groupBy("token").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = max(1, int(-(-read // BLOCK_POSTINGS)))
    block = AskedBlock(asked.select("query_id", "token", "idf", "avg_len").toArrow())
    spark = own.sparkSession
    numbers = pa.array(np.arange(len(block.vocabulary)), pa.int64())
    terms = spark.createDataFrame(pa.table({"token": block.vocabulary, "term": numbers}))
    shared = spark.sparkContext.broadcast(block)
    met = own.join(F.broadcast(terms), "token").select("term", *KEYS, "tf", "length")
    met = met.withColumn("block", F.pmod(F.xxhash64(*KEYS), F.lit(n_blocks)))

    def best(part: DataFrame, floors) -> DataFrame:
        return part.groupBy("block").applyInArrow(
            lambda table: best_of_block(table, shared.value, k, floors and floors.value),
            "query_id bigint, doc_id bigint, chunk_no int, score double",
        )

    ends = [1]
    while ends[-1] * (1 + ROUND_GROWTH) < n_blocks:
        ends.append(ends[-1] * (1 + ROUND_GROWTH))
    if n_blocks <= 1 + ROUND_GROWTH:
        return best(met, None)
    number = sum((F.col("block") >= end).cast("int") for end in ends)
    met = stored(met.withColumn("round", number), "asked-postings", by=("round",))
    found, floors = best(met.filter("round = 0"), None), None
    for i in range(1, len(ends) + 1):
        ranked = stored(merge_best(found, k, KEYS, merge_ways), "best-so-far")
        lowest = ranked.filter(F.col("rank") == k).select("query_id", "score").toArrow()  # a number for each question
        at = pc.index_in(lowest["query_id"], value_set=block.query_ids).to_numpy()
        values = np.full(len(block.query_ids), -np.inf)
        values[at] = lowest["score"].to_numpy()
        floors = spark.sparkContext.broadcast(values)
        found = ranked.drop("rank").unionByName(best(met.filter(F.col("round") == i), floors))
    return found


def search(rows: DataFrame, terms_of_questions: DataFrame, k: int, limits: Limits = Limits()) -> DataFrame:
    """(query_id, doc_id, chunk_no, score, rank) with rank 1..k per question, over postings ``rows``.

    Exact; ties go to the smaller keys. Intermediate tables are removed, the result is a stored table.
    """
    with scratch() as lasting:
        asked = stored(asked_tokens(terms_of_questions), "asked")
        tokens, pairs = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        of = Asked(reading(rows, asked), tokens <= limits.block_rows, limits)
        if pairs <= limits.plain_pairs:
            total = of.partial_scores(asked)
        elif ASKED_VALUES * tokens <= limits.block_values:
            total = block_scores(of.own, asked, k, limits.merge_ways)
        else:
            asked = stored(with_floors(of, asked, k), "asked-floors")
            found = of.partial_scores(asked.filter("needed"), "floor", "rest")
            found = stored(found.filter(F.col("score") + F.col("rest") >= F.col("floor")), "found")
            total = found.select("query_id", *KEYS, "score").unionByName(of.others(asked.filter("not needed"), found))
            total = total.groupBy("query_id", *KEYS).agg(F.sum("score").alias("score"))
        ranked = merge_best(total.withColumn("score", F.round("score", DECIMALS)), k, KEYS, limits.merge_ways)
        return lasting(ranked.select("query_id", *KEYS, "score", "rank"), "hits")


def search_chunks(chunks: DataFrame, terms_of_questions: DataFrame, k: int, limits: Limits = Limits()) -> DataFrame:
    """The same over chunks without a stored table."""
    return search(postings(chunks), terms_of_questions, k, limits)
