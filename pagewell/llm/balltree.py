"""Ranked lexical search as exact inner-product search in ball trees of sparse vectors.

A document is a sparse vector of whole numbers over the terms that any item asks for: the term's
weight times its saturated frequency. An item is the vector of its term counts, so the score is the
inner product. Each task cuts its documents into blocks and builds a binary tree over each, halving
the documents of a node along the line between two far ones. A node keeps its centroid and a
radius for each group of terms; by the Cauchy-Schwarz inequality, group by group, no document below it scores
more than item . centroid + sum of |item in the group| * radius in the group. These floating-point
bounds are widened by far more than rounding can cost. For each item the nodes are visited best
bound first until the best one left lies below the k-th score found so far in the task; the
documents of a leaf are scored in whole numbers. Only each task's best k leave it, and they are merged in
two steps.

Items reach the tasks in blocks of bounded size, each of which reads the documents once. Document
counts (with terms, of terms, per term) are taken over all documents.

Defined results: documents without terms and null texts count for nothing and are never found; items
without terms, or null, have no rows; null ids lose ties; repeated rows are ranked each by itself;
repeated or null item ids are ranked each by themselves; empty tables give an empty result; texts
are read whole; other columns take no part.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.common import discard, written
from pagewell.operators.blockscan import merge_best

# Fixed values of the score: saturation and length scales of the contract.
WEIGHT_SCALE, TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_PERCENT = 1000, 1_000_000_000, 1000, 8, 75

TOP_K = 10
# Documents of a leaf and of a tree, groups of terms with a radius each, and terms of items in a block.
LEAF, TREE, GROUPS = 16, 2048, 4096
BLOCK_TERMS = 1_000_000
# Sums of fewer than 2 ** 22 products are off by less than one in 2 ** 30; bounds are widened by more.
SAFE, CANCELLED = 1 + 1e-8, 1e-11

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Items:
    """A block of items: their numbers, and the term numbers and counts of each."""

    numbers: list[int]
    vocabulary: dict[bytes, int]
    asked: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows) -> Items:
        vocabulary: dict[bytes, int] = {}
        numbers, asked = [], []
        for number, text in rows:
            counts = Counter(terms((text or "").encode()))
            if counts:
                ids = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts])
                numbers.append(number)
                asked.append((ids, np.array(list(counts.values()), np.int64)))
        return cls(numbers, vocabulary, asked)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str) -> DataFrame:
    """doc_id, n (terms in the text), ids and tfs of the terms that items ask for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                found = terms(text.as_py() or b"")
                tally = Counter(map(vocabulary.get, found))
                tally.pop(None, None)
                sizes.append(len(found))
                ids.append(list(tally))
                tfs.append(list(tally.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "ids", "tfs"],
            )

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(count, "doc_id bigint, n bigint, ids array<int>, tfs array<bigint>")


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The saturated frequency of a term that occurs ``tf`` times among ``n`` terms."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // all_terms
    return (TF_SCALE * tf) // (TF_UNIT * tf + LENGTH_UNIT * m)


class Tree:
    """A ball tree over sparse rows: ``term`` and ``value`` of row i are those from first[i] to first[i + 1].

    Node 1 is the root, nodes 2 i and 2 i + 1 the halves of node i; leaves are the nodes of the last
    level. ``order`` gives the given number of each row, leaf by leaf.
    """

    def __init__(self, term: np.ndarray, value: np.ndarray, first: np.ndarray, width: int, groups: int = GROUPS):
        n = len(first) - 1
        self.groups = min(groups, max(width, 1))
        depth = max(0, (n // LEAF).bit_length() - 1) if n >= LEAF else 0
        x, row = value.astype(np.float64), np.repeat(np.arange(n), np.diff(first))
        # The groups that a row has entries in; its distance in any other group is the centroid's length there.
        cells, cell = np.unique(row * self.groups + term % self.groups, return_inverse=True)
        cell_row, cell_group = np.divmod(cells, self.groups)
        cell_squares = np.bincount(cell, x * x, len(cells))
        squares = np.bincount(row, x * x, n)
        group_of = np.arange(width) % self.groups
        node = np.zeros(n, np.int64)  # within the level
        centroids, radii = [np.zeros((1, width))], [np.zeros((1, self.groups))]
        for level in range(depth + 1):
            here = 2**level
            size = np.bincount(node, minlength=here)
            place = node[row] * width + term
            centroid = np.bincount(place, x, here * width).reshape(here, width) / np.maximum(size, 1)[:, None]
            own_cell = (np.arange(here)[:, None] * self.groups + group_of).ravel()
            own = np.bincount(own_cell, (centroid * centroid).ravel(), here * self.groups)
            product = x * centroid.ravel()[place]
            at = node[cell_row] * self.groups + cell_group
            more = cell_squares - 2 * np.bincount(cell, product, len(cells))
            # What cancels in the difference can be off by a share of what it is taken from.
            more += CANCELLED * (cell_squares + own[at])
            radius = np.zeros(here * self.groups)
            np.maximum.at(radius, at, more)
            centroids.append(centroid)
            radii.append(np.sqrt(own * (1 + CANCELLED) + radius).reshape(here, -1))
            if level < depth:
                far = squares - 2 * np.bincount(row, product, n) + own.reshape(here, -1).sum(1)[node]
                node = self._halves(node, far, squares, row, term, x, here, width)
        self.centroid, self.radius = np.concatenate(centroids), np.concatenate(radii)
        self.order = np.argsort(node, kind="stable")
        self.leaf_ends = np.searchsorted(node[self.order], np.arange(2**depth + 1))
        self.first_leaf = 2**depth
        counts = np.diff(first)[self.order]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(first[:-1][self.order] - self.first[:-1], counts) + np.arange(len(term))
        self.term, self.value = term[at], value[at]

    @staticmethod
    def _halves(node, far, squares, row, term, x, here, width) -> np.ndarray:
        """The nodes of the next level: each node's rows cut at the middle between two far ones."""

        def farthest(distance):
            best = np.lexsort((distance, node))
            return best[np.searchsorted(node[best], np.arange(here), side="right") - 1]

        def products(pivots):
            chosen = np.full(len(node), -1)
            chosen[pivots] = np.arange(here)
            mine = chosen[row] >= 0
            dense = np.zeros((here, width))
            dense[chosen[row[mine]], term[mine]] = x[mine]
            return np.bincount(row, x * dense[node[row], term], len(node))

        one = products(farthest(far))
        two = products(farthest(squares - 2 * one))
        along = np.lexsort((one - two, node))
        start = np.searchsorted(node[along], np.arange(here))
        size = np.bincount(node, minlength=here)
        inside = np.arange(len(node)) - start[node[along]]
        halves = np.empty_like(node)
        halves[along] = 2 * node[along] + (inside >= (size[node[along]] + 1) // 2)
        return halves

    def bounds(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """No row below a node scores more than the node's bound."""
        group, at = np.unique(ids % self.groups, return_inverse=True)
        norm = np.sqrt(np.bincount(at, counts.astype(np.float64) ** 2))
        return (self.centroid[:, ids] @ counts + self.radius[:, group] @ norm) * SAFE + 1

    def scores(self, leaf: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The given numbers of a leaf's rows and their exact scores."""
        lo, hi = self.leaf_ends[leaf : leaf + 2]
        a, z = self.first[lo], self.first[hi]
        total = np.concatenate([[0], np.cumsum(dense[self.term[a:z]] * self.value[a:z])])
        return self.order[lo:hi], np.diff(total[self.first[lo : hi + 1] - a])

    def search(self, ids: np.ndarray, counts: np.ndarray, floor) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves best bound first while the best one left reaches ``floor()``; a subtree below it is skipped."""
        bound = self.bounds(ids, counts)
        dense = np.zeros(self.centroid.shape[1], np.int64)
        dense[ids] = counts
        waiting = [(-bound[1], 1)]
        while waiting and -waiting[0][0] >= floor():
            _, node = heapq.heappop(waiting)
            if node >= self.first_leaf:
                yield self.scores(node - self.first_leaf, dense)
            else:
                for child in (2 * node, 2 * node + 1):
                    heapq.heappush(waiting, (-bound[child], child))


def _best_of_task(batches, items: Items, weights: np.ndarray, n_docs: int, all_terms: int, k: int):
    """(item, none, doc_id, row, score) of the best k rows of a task for every item."""
    best: list[list[tuple]] = [[] for _ in items.numbers]
    for batch in batches:
        for at in range(0, batch.num_rows, TREE):
            part = batch.slice(at, TREE)
            ids, tfs = part.column("ids"), part.column("tfs")
            count = np.asarray(ids.value_lengths())
            term = ids.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), count)
            size = part.column("n").to_numpy()
            value = weights[term] * impacts(tfs.flatten().to_numpy(), size[row], n_docs, all_terms)
            tree = Tree(term, value, np.concatenate([[0], np.cumsum(count)]), len(weights))
            docs, row_number = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
            for found, (asked, counts) in zip(best, items.asked):
                floor = lambda: -found[-1][0] if len(found) == k else 1
                for rows, scores in tree.search(asked, counts, floor):
                    for i in np.flatnonzero(scores >= floor()):
                        doc = docs[rows[i]]
                        insort(found, (-int(scores[i]), doc is None, doc or 0, row_number[rows[i]]))
                        del found[k:]
    rows = [(n, none, doc, row, -score) for n, found in zip(items.numbers, best) for score, none, doc, row in found]
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["query_id", "none", "doc_id", "row", "score"]
    )


def _of_block(docs: DataFrame, items: Items, k: int, doc_id: str) -> DataFrame:
    """query_id, rank, none, doc_id, score of the best documents for one block of items."""
    counted = written(vectors(docs, items.vocabulary, doc_id), "term-vectors")
    totals = counted.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, all_terms = totals["docs"], totals["terms"] or 0
    # One row per term of the items.
    frequency = counted.select(F.explode("ids").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(items.vocabulary), np.int64)
    for term, count in frequency:
        df[term] = count
    weights = term_weights(df, n_docs)
    rows = counted.where(F.size("ids") > 0).withColumn("row", F.monotonically_increasing_id())
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))
    lists = rows.mapInArrow(
        lambda batches: _best_of_task(batches, *shared.value, n_docs, all_terms, k),
        "query_id bigint, none boolean, doc_id bigint, row bigint, score bigint",
    )
    ways = max(16, int(rows.rdd.getNumPartitions() ** 0.5))
    ranked = written(merge_best(lists, k, ["none", "doc_id", "row"], ways).drop("row"), "ranked")
    discard(counted)
    shared.unpersist()
    return ranked


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP_K, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id and score of the best ``k`` documents with a score for every item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = written(asked.withColumn("query_id", F.monotonically_increasing_id()), "items")
    # A term has at least one byte and a separator.
    size = asked.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_TERMS))
    done = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = _of_block(docs, Items.of(mine.select("query_id", "text").toLocalIterator()), k, doc_id)
        done = part if done is None else done.unionByName(part)
    found = done.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id")))
    return found.join(asked.select("query_id", "item_id"), "query_id").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )
