"""A Merkle manifest of a table, and a recursive query that climbs it from every leaf.

Leaves are SHA-256 digests of rows. The leaves of one language, ascending by id, are the bottom of a
tree: every two consecutive nodes become the digest of their hex texts, a last single one the
digest of its own. The roots of the languages (null first, then by bytes) are the bottom of one
more tree, whose root is that of the table.

Built levels are stored as node rows that name their parent row. A row holds the ``SPAN`` levels
below its node, so a tree of n leaves has n / 2 ** SPAN rows at its lowest stored level, and a
leaf reaches the root over 20 levels in three or four steps of the recursive query, not 20.
Each step appends the siblings on its levels and folds the leaf's digest, tampered or not, with them.

Nothing is ordered in one task: rows are range-partitioned by language, id and digest, and places
within a language come from the counts of the partitions. A group of nodes has at most 2 ** SPAN.

Defined results: a null in a leaf column is hashed as ``-``; null ids come first in their language,
repeated rows have equal digests and places of their own; rows without language are a tree; a
null id is never tampered with, a null ``n_chars`` stays null; an empty table gives an empty
result; texts are hashed whole; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewell.llm.common import _set, discard, written

# The columns of a leaf, and how a null is written.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NULL = "-"

# Levels below a stored node.
SPAN = 8
# The tree above the languages; a language's tree is named NULL or "=" and the language.
TOP = ""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def leaf_digest(changed: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the leaf columns, each ``-`` or its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for name in LEAF_COLUMNS:
        value = (changed or {}).get(name, F.col(name)).cast("string")
        written_out = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(written_out, F.lit(NULL)))
    return F.sha2(F.concat(*parts), 256)


def is_tampered() -> Column:
    """True where 7 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with ``row`` (unique), ``part``, ``idx`` (place in their tree from 0) and ``n`` (rows of the tree).

    One range shuffle; the counts joined back have one row per partition and tree.
    """
    ordered = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    ordered = written(
        ordered.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "ordered"
    )
    counts = ordered.groupBy(tree, "part").agg(F.min("row").alias("first"), F.count("*").alias("here"))
    trees = W.partitionBy(tree)
    starts = counts.select(
        tree,
        "part",
        "first",
        (F.sum("here").over(trees.orderBy("part")) - F.col("here")).alias("before"),
        F.sum("here").over(trees).alias("n"),
    )
    done = ordered.join(starts, [tree, "part"]).select(
        *rows.columns, "row", "part", (F.col("row") - F.col("first") + F.col("before")).alias("idx"), "n"
    )
    table = written(done, "placed")
    discard(ordered)
    return table


def with_tree(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """The columns of ``trees`` (one row per tree) for every row, joined by tree and part: no key is hot."""
    parts = rows.select("tree", "part").distinct().join(trees, "tree")
    return rows.join(parts, ["tree", "part"])


# The levels of one group of nodes, bottom first; ``steps`` is their number above the bottom.
_UP = (
    "transform(sequence(0, (size(a) + 1) div 2 - 1), i -> "
    "unhex(sha2(concat(lower(hex(a[2 * i])), coalesce(lower(hex(get(a, 2 * i + 1))), '')), 256)))"
)
_LEVELS = (
    "aggregate(sequence(1, steps), array(bottom), "
    f"(built, step) -> concat(built, transform(slice(built, -1, 1), a -> {_UP})))"
)


def stratum(nodes: DataFrame, number: int, span: int) -> DataFrame:
    """The stored rows above ``nodes`` (tree, idx, n, rank, digest), one for each 2 ** span of them.

    tree, stratum, idx: the row's own node; steps, levels: what lies below it; up_tree,
    up_stratum, up_idx: its parent row; digest, and n and rank for the next stratum.
    """
    groups = (
        nodes.where("n > 1")
        .groupBy("tree", F.shiftright("idx", span).alias("idx"), "n", "rank")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("members"))
        .withColumn("steps", F.least(F.lit(span), F.length(F.bin(F.col("n") - 1))))
        .withColumn("bottom", F.col("members.digest"))
        .withColumn("levels", F.expr(_LEVELS))
    )
    above = F.shiftright(F.col("n") + (2**span - 1), span)
    is_root = above == 1
    return groups.select(
        "tree",
        F.lit(number + 1).alias("stratum"),
        "idx",
        "steps",
        F.expr("slice(levels, 1, steps)").alias("levels"),
        F.when(is_root, TOP).otherwise(F.col("tree")).alias("up_tree"),
        F.when(is_root, 0).otherwise(number + 1).alias("up_stratum"),
        F.when(is_root, F.col("rank")).otherwise(F.col("idx")).alias("up_idx"),
        F.expr("levels[steps][0]").alias("digest"),
        above.alias("n"),
        "rank",
    )


def built(bottom: DataFrame, span: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored rows of all strata above ``bottom`` (tree, idx, n, rank, digest), and tree, rank and root."""
    most = bottom.agg(F.max("n")).first()[0] or 0
    strata, nodes = [], bottom
    roots = nodes.where("n = 1").select("tree", "rank", "digest")
    while most > 1:
        nodes = written(stratum(nodes, len(strata), span), "nodes")
        strata.append(nodes)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "rank", "digest"))
        most = (most + 2**span - 1) >> span
    return strata, roots


_CLIMB = """
WITH RECURSIVE climb (row, step, tree, stratum, idx, folded, siblings) AS (
  SELECT row, 0, tree, stratum, idx, folded, CAST('' AS BINARY) FROM {start}
  UNION ALL
  SELECT row, step + 1, up_tree, up_stratum, up_idx,
    aggregate(path, folded, (a, s) -> sha2(CASE WHEN s.digest IS NULL THEN a
      WHEN s.place % 2 = 0 THEN concat(lower(hex(s.digest)), a) ELSE concat(a, lower(hex(s.digest))) END, 256)),
    aggregate(path, CAST('' AS BINARY), (a, s) -> concat(a, coalesce(s.digest, CAST('' AS BINARY))))
  FROM (
    SELECT c.row, c.step, c.folded, n.up_tree, n.up_stratum, n.up_idx,
      transform(sequence(0, n.steps - 1), l -> struct(
        shiftright(c.idx - shiftleft(n.idx, {span}), l) ^ 1 AS place,
        get(n.levels[l], CAST(shiftright(c.idx - shiftleft(n.idx, {span}), l) ^ 1 AS INT)) AS digest)) AS path
    FROM climb c JOIN {nodes} n
      ON n.tree = c.tree AND n.stratum = c.stratum + 1 AND n.idx = shiftright(c.idx, {span})
  )
) SELECT row, step, folded, siblings FROM climb
"""


def climbed(start: DataFrame, nodes: DataFrame, span: int) -> DataFrame:
    """row, proof and folded: every leaf of ``start`` (row, tree, stratum, idx, folded) taken to the root.

    A step's row carries its own siblings alone; they are put together per leaf at the end.
    """
    spark = start.sparkSession
    steps = F.sort_array(F.collect_list(F.struct("step", "siblings", "folded")))
    with _set(spark, **{ROW_LIMIT: "-1"}):  # the recursion ends at the root, whatever the number of rows
        climb = spark.sql(_CLIMB, start=start, nodes=nodes, span=span)  # leaves no view behind
        ends = climb.groupBy("row").agg(steps.alias("steps"))
        siblings = F.expr("aggregate(steps, CAST('' AS BINARY), (a, s) -> concat(a, s.siblings))")
        return written(
            ends.select(
                "row",
                F.sha2(F.lower(F.hex(siblings)), 256).alias("proof_sha256"),
                F.element_at("steps", -1)["folded"].alias("folded_root"),
            ),
            "climbed",
        )


class Manifest:
    """The stored tree of a table of documents.

    ``leaves``: doc_id, leaf and tampered digest, tree, row, idx, n, rank. ``nodes``: the stored levels.
    ``roots``: tree and subroot of each language; ``root``: hex, None for an empty table.
    """

    def __init__(self, docs: DataFrame, span: int = SPAN):
        self.span = span
        changed = F.col("n_chars") + 1
        hashed = docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(NULL)).alias("tree"),
            leaf_digest().alias("leaf"),
            F.when(is_tampered(), leaf_digest({"n_chars": changed})).alias("tampered"),
        )
        hashed = written(hashed, "leaves")
        rows = placed(hashed, "tree", "doc_id", "leaf")
        discard(hashed)
        trees = rows.groupBy("tree").agg(F.max("n").alias("size")).withColumn("all", F.lit(TOP))
        ranks = placed(trees, "all", "tree").select("tree", F.col("idx").alias("rank"))
        self.leaves = written(with_tree(rows, ranks), "manifest-leaves")
        discard(rows)
        bottom = self.leaves.select("tree", "idx", "n", "rank", F.unhex("leaf").alias("digest"))
        strata, subroots = built(bottom, span)
        self.roots = written(subroots, "subroots")
        top = self.roots.withColumnsRenamed({"tree": "lang_tree"}).select(
            F.lit(TOP).alias("tree"),
            F.col("rank").alias("idx"),
            F.lit(self.roots.count()).cast("long").alias("n"),
            F.lit(0).cast("long").alias("rank"),
            "digest",
        )
        upper, roots = built(top, span)
        root = roots.first()
        self.root = root["digest"].hex() if root else None
        # The root has no parent row: a stratum of that number does not exist.
        upper = [t.withColumn("up_stratum", F.col("stratum")).withColumn("up_tree", F.col("tree")) for t in upper]
        self._strata = strata + upper
        columns = ["tree", "stratum", "idx", "steps", "levels", "up_tree", "up_stratum", "up_idx"]
        empty = docs.sparkSession.createDataFrame(
            [],
            "tree string, stratum int, idx bigint, steps int, levels array<array<binary>>, "
            "up_tree string, up_stratum int, up_idx bigint",
        )
        self.nodes = empty
        for table in self._strata:
            self.nodes = self.nodes.union(table.select(*columns))

    def proofs(self) -> DataFrame:
        """row, proof_sha256 and folded_root of every leaf, its tampered digest folded where there is one."""
        alone = F.col("n") == 1
        start = self.leaves.select(
            "row",
            F.when(alone, TOP).otherwise(F.col("tree")).alias("tree"),
            F.lit(0).alias("stratum"),
            F.when(alone, F.col("rank")).otherwise(F.col("idx")).alias("idx"),
            F.coalesce("tampered", "leaf").alias("folded"),
        )
        return climbed(start, self.nodes, self.span)

    def verified(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
        subroots = self.roots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
        return (
            with_tree(self.leaves.select("row", "tree", "part", "doc_id", "leaf"), subroots)
            .join(self.proofs(), "row")
            .select(
                "doc_id",
                "leaf",
                "subroot",
                F.lit(self.root).alias("root"),
                "proof_sha256",
                "folded_root",
                F.coalesce(F.col("folded_root") == F.lit(self.root), F.lit(False)).alias("verified"),
            )
        )

    def discard(self) -> None:
        """Remove the stored tables, when no result is read from them any more."""
        discard(self.leaves, self.roots, *self._strata)
