"""Best k chunks for many questions at once, without forming question-chunk pairs.

A scorer turns a batch of chunks and a block of questions into a score matrix
inside the task; only each question's running best k leaves the task. The
question block reaches the chunks in one of two ways:

* ``small block``: its size is measured first, and below the bound it is
  broadcast. The chunks are scanned in place, nothing but the best lists is
  shuffled.
* ``rounds``: above the bound, blocks of questions are broadcast one after the other, each for a scan of its
  own, if that moves much less than a grid.
* ``grid``: else, chunks and questions are cut into groups of bounded
  size by a hash of their ids, and each (chunk group, question group) pair is
  scored by one cogrouped task call, a block of questions at a time. Nothing passes
  through the driver. A row is copied once for each group of the other side.

Both are exact for the chunks and questions that share a search cell (see `similarity`
for searches that give chunks cells): a question travels with the cells it visits, never once for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pagewell.session import stored

# A scorer is prepared once per question block. It yields (rows, questions,
# scores): index arrays into the batch and the block, and a (questions x rows)
# score matrix with minus infinity where there is no hit.
Scored = tuple[np.ndarray, np.ndarray, np.ndarray]
Scorer = Callable[[pa.RecordBatch], Iterator[Scored]]
Prepare = Callable[[pa.Table], Scorer]

MATRIX_CELLS = 2_000_000
SCAN_ROWS = 8192  # chunks that a grid task scores at once
DECIMALS = 4
# Bytes of a row of a best list, and how many times less rounds must move than a grid, as each reads the chunks again.
LIST_BYTES, MUCH_LESS = 28, 4


@dataclass(frozen=True)
class Limits:
    """Bounds on what one task holds and on how many lists are merged.

    ``block_rows`` and ``block_values`` bound a question block, ``group_rows`` and ``group_values`` the
    chunks and the questions of a grid task. A scan uses at most ``scan_waves`` tasks per core, since
    every task sends its own best k, and they are merged ``merge_ways`` at a time.
    Up to ``plain_pairs`` (question, posting) pairs are summed without looking for floors first.
    """

    block_rows: int = 20_000
    block_values: int = 8_000_000
    group_rows: int = 250_000
    group_values: int = 16_000_000
    merge_ways: int = 16
    plain_pairs: int = 2_000_000


class RunningBest:
    """Best k rows per question seen so far; a row below the k-th score is never kept."""

    def __init__(self, n_questions: int, k: int, n_keys: int):
        self.k = k
        self.floor = np.full(n_questions, -np.inf)
        self.kept = [np.empty(0, np.int64) for _ in range(n_keys)]
        self.q, self.s = np.empty(0, np.int64), np.empty(0)
        self.pending: list[tuple] = []
        self.n_pending = 0

    def offer(self, keys: list[np.ndarray], rows, questions, scores) -> None:
        """Take a (questions x rows) block of scores."""
        wanted = scores >= self.floor[questions, None]
        if scores.shape[1] > self.k and np.count_nonzero(wanted) > 2 * self.k * len(questions):
            # k rows of this block alone reach its k-th score: a floor for each question.
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            self.floor[questions] = np.maximum(self.floor[questions], kth)
            wanted = scores >= self.floor[questions, None]
        c, r = np.nonzero(wanted & (scores > -np.inf))
        if len(r):
            self.pending.append((questions[c], scores[c, r], [key[rows[r]] for key in keys]))
            self.n_pending += len(r)
            if self.n_pending > max(MATRIX_CELLS // 2, 2 * len(self.q)):
                self.settle()

    def settle(self) -> None:
        q = np.concatenate([self.q] + [p[0] for p in self.pending])
        s = np.concatenate([self.s] + [p[1] for p in self.pending])
        keys = [
            np.concatenate([kept] + [p[2][i] for p in self.pending])
            for i, kept in enumerate(self.kept)
        ]
        self.pending, self.n_pending = [], 0
        keep, floored, floors = best_rows(q, s, keys, self.k)
        self.floor[floored] = np.maximum(self.floor[floored], floors)
        self.q, self.s, self.kept = q[keep], s[keep], [key[keep] for key in keys]


def best_rows(q: np.ndarray, s: np.ndarray, keys: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are among the k best of their question, the questions with k or more rows, and their k-th scores.

    All rows are sorted by one number, of the question and the rounded score; by the whole score and the
    keys only those that are level with the k-th.
    """
    bits = (0.0 - s).astype(np.float32).view(np.uint32)  # no minus zero
    ascending = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    mixed = q.astype(np.uint64) << np.uint64(32) | ascending
    ordered = np.sort(mixed)
    asked = ordered >> np.uint64(32)
    first = np.flatnonzero(np.diff(asked, prepend=~asked[:1]))
    floored = np.diff(first, append=len(ordered)) >= k
    last = np.full(int(asked[-1]) + 1 if len(asked) else 0, ~np.uint64(0))
    last[asked[first[floored]]] = ordered[first[floored] + k - 1]
    keep = mixed < last[q]
    level = np.flatnonzero(mixed == last[q])
    level = level[np.lexsort((*[key[level] for key in reversed(keys)], -s[level], q[level]))]
    own = q[level]
    free = k - np.bincount(q[keep], minlength=len(last))[own]
    place = np.arange(len(own)) - np.searchsorted(own, own, side="left")
    keep[level[place < free]] = True
    ends = level[place == free - 1]
    return keep, q[ends], s[ends]


def best_of(batches, block: pa.Table, prepare: Prepare, k: int, keys: list[str], schema):
    """One task's best lists as a record batch."""
    best = RunningBest(block.num_rows, k, len(keys))
    score = None
    for batch in batches:
        if batch.num_rows == 0 or block.num_rows == 0:
            continue
        score = score or prepare(block)
        ids = [batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64) for key in keys]
        for rows, questions, scores in score(batch):
            best.offer(ids, rows, questions, scores)
    best.settle()
    query_ids = block.column("query_id").to_numpy().astype(np.int64)
    columns = [query_ids[best.q], *best.kept, best.s]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def round_scores(scores: np.ndarray) -> np.ndarray:
    """Half away from zero, as SQL rounds; scores are rounded before they are ranked."""
    scale = 10.0**DECIMALS
    out = np.abs(scores) * scale  # whole numbers, as bincount gives of nothing, become floats
    out += 0.5
    np.floor(out, out=out)
    out /= scale
    return np.copysign(out, scores, out=out)


def small_block(questions: DataFrame, size_of, limits: Limits) -> pa.Table | None:
    """The question table if it is within the bounds, else None. Measured before it is moved."""
    rows, values = questions.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(size_of).cast("long"), F.lit(0))
    ).first()
    if rows > limits.block_rows or values > limits.block_values:
        return None
    return questions.toArrow().combine_chunks()


def top_k(
    chunks: DataFrame,
    questions: DataFrame,
    k: int,
    prepare: Prepare,
    keys: list[str],
    size_of,
    limits: Limits = Limits(),
    cells: tuple | None = None,
    dim: int = 1,
) -> DataFrame:
    """(query_id, keys..., score, rank) with rank 1..k per question.

    ``chunks`` holds the integer key columns and what the scorer reads;
    ``questions`` holds ``query_id`` and what the scorer's preparation reads.
    ``size_of`` measures one question, a vector has ``dim`` numbers. Ties go to the smaller keys.
    """
    schema = pa.schema(
        [("query_id", pa.int64()), *[(key, pa.int64()) for key in keys], ("score", pa.float64())]
    )
    ddl = "query_id bigint, " + ", ".join(f"{key} bigint" for key in keys) + ", score double"
    block, ways = small_block(questions, size_of, limits), limits.merge_ways
    if block is None and not cells and (split := rounds(chunks, questions, k, limits, dim)):
        asked, n_rounds = split
        few = chunks.coalesce(chunks.sparkSession.sparkContext.defaultParallelism)
        wide = Limits(**vars(limits) | {"block_rows": 2 * limits.block_rows, "block_values": 2 * limits.block_values})
        out = None
        for i in range(n_rounds):
            part = asked.filter(F.col("round") == i).drop("round")
            part = stored(top_k(few, part, k, prepare, keys, size_of, wide, None, dim), "round-hits")
            out = part if out is None else out.unionByName(part)
        return out
    if block is not None:
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def scan(batches):
            yield best_of(batches, shared.value, prepare, k, keys, schema)

        # Every split sends its own best k; with more splits the first merge has more ways.
        ways = max(limits.merge_ways, int(chunks.rdd.getNumPartitions() ** 0.5))
        lists = chunks.mapInArrow(scan, ddl)
    else:
        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            # Rows of a search cell stand together, so that its visitors are looked up once for many rows.
            left = left.sort_by("cell") if cells else left.combine_chunks()
            found = [
                best_of(left.to_batches(max_chunksize=SCAN_ROWS), part, prepare, k, keys, schema)
                for part in question_blocks(right.combine_chunks(), limits, cells, dim)
            ]
            return pa.Table.from_batches(found, schema)

        lists = grid(chunks, questions, limits, cells, keys, dim).applyInArrow(meet, ddl)
    typed = lists.select(
        "query_id", *[F.col(key).cast(chunks.schema[key].dataType) for key in keys], "score"
    )
    return merge_best(typed, k, keys, ways)


def rounds(chunks: DataFrame, questions: DataFrame, k: int, limits: Limits, dim: int) -> tuple[DataFrame, int] | None:
    """The questions with a ``round`` that each is asked in, and the number of rounds; None if a grid suits them better."""
    n_chunks, n_questions = chunks.count(), questions.count()
    rows = max(1, min(limits.group_rows, limits.group_values // dim))
    n_qg = max(1, -(-n_questions // rows))
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    n_cg = max(1, -(-n_chunks // rows), -(-cores // n_qg))
    lists = n_questions * k * LIST_BYTES
    moved = 4 * dim * (n_chunks * n_qg + n_questions * n_cg) + n_cg * lists
    if moved < MUCH_LESS * cores * lists:
        return None
    n_rounds = -(-n_questions // max(1, min(limits.block_rows, limits.block_values // dim)))
    number = F.pmod(F.xxhash64("query_id"), F.lit(n_rounds)).cast("int")
    asked = stored(questions.withColumn("round", number), "round-questions", by=("round",))
    most = asked.groupBy("round").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # Questions of one id stay together; if they are too many for a block, a grid cuts them by chunks alone.
    return (asked, n_rounds) if most * dim <= 2 * limits.block_values and most <= 2 * limits.block_rows else None


@F.arrow_udf(BinaryType())
def packed_cells(column: pa.Array) -> pa.Array:
    """The numbers of the visited cells as bits."""
    out = []
    for visited in column.to_pylist():
        bits = np.zeros(max(visited, default=-1) + 1, np.uint8)
        bits[visited] = 1
        out.append(np.packbits(bits).tobytes())
    return pa.array(out, pa.binary())


def question_blocks(questions: pa.Table, limits: Limits, cells, dim: int) -> Iterator[pa.Table]:
    """The questions of a grid task in blocks within the bounds, with the cells they visit as a list again."""
    at, n = 0, questions.num_rows
    while at < n:
        part, width = questions.slice(at, limits.block_rows), dim
        if cells:
            bits = part.column(cells[1]).to_pylist()
            width += max(1, sum(int.from_bytes(b).bit_count() for b in bits) // len(bits))
        part = part.slice(0, max(1, limits.block_values // width))
        at += part.num_rows
        if cells:
            visited = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) for b in bits[: part.num_rows]]
            ends = np.cumsum([0, *map(len, visited)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(visited), pa.int32()))
            part = part.set_column(part.schema.get_field_index(cells[1]), cells[1], lists)
        yield part.combine_chunks()


def grid(chunks: DataFrame, questions: DataFrame, limits: Limits, cells, keys: list[str], dim: int):
    """Cogroup chunk groups with question groups of bounded size.

    ``cells`` optionally names (a cell column of the chunks, an array column of
    cells to visit of the questions). Groups are cut by ids alone, so a cell that holds a third of the
    rows is no larger task than others; there are at least as many pairs of groups as cores.
    """
    rows = max(1, min(limits.group_rows, limits.group_values // dim))
    n_qg = max(1, -(-questions.count() // rows))
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    n_cg = max(1, -(-chunks.count() // rows), -(-cores // n_qg))
    pick = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = chunks.withColumnRenamed(cells[0], "cell") if cells else chunks
    c = c.withColumn("cg", pick(n_cg, *keys)).withColumn("qg", every(n_qg))
    q = questions.withColumn(cells[1], packed_cells(cells[1])) if cells else questions
    q = q.withColumn("qg", pick(n_qg, "query_id")).withColumn("cg", every(n_cg))
    # New columns, since chunks may be asked about each other.
    q = q.select(*[F.col(name).alias(name) for name in q.columns])
    return c.groupBy("cg", "qg").cogroup(q.groupBy("cg", "qg"))


def merge_best(lists: DataFrame, k: int, keys: list[str], ways: int) -> DataFrame:
    """Merge the tasks' lists in two steps, so that no task receives all lists of a question."""
    order = [F.desc("score"), *[F.asc(key) for key in keys]]
    part = lists.withColumn("way", F.pmod(F.xxhash64(*keys), F.lit(ways)))
    first = W.partitionBy("query_id", "way").orderBy(*order)
    cut = part.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    final = W.partitionBy("query_id").orderBy(*order)
    return (
        cut.drop("r", "way")
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
    )
