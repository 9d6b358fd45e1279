"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's set holds the hashes of its distinct 5-word shingles (one of all words if there are
fewer). One permutation scatters the set over 32 bits; a second one, circularly shifted by
0, 1, 2, ..., gives the coordinates of the signature. Sets that agree in a band of four coordinates
are compared; of 32 bands a pair at a similarity of 0.75 misses all with a chance of five
in a million. A link is confirmed on the full sets.

No group is compared pair by pair as a whole. Equal sets are one class. Then, in rounds:
every class of a bucket against one hub, the links found are contracted to components, and buckets
whose members are all in one component are done; a second round takes another hub for each
remaining bucket; the last one compares what is left of a bucket, members outside its largest
component against all others, in blocks of bounded size, by signatures first and at once by the sets,
so that only links leave a block. So no link between classes of different components stays untested.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing;
repeated rows are equal sets; a null id never is a component's smallest id unless there is no
other, and then is not kept; an empty table gives an empty result; extra columns of any name
are carried inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.llm.common import Words, discard, lists, mix, sequence_hash, signed, text_slices, written
from pagewell.llm.components import components

SHINGLE = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
# Pairs whose signatures agree in fewer coordinates are not verified. At a similarity of 0.75 the
# mean is 96 with a deviation of 4.9, so a pair is lost with a chance of about one in ten million.
MIN_EQUAL = 70
# Blocks of the last round: rows while signatures are compared, shingles while sets are.
QUERIES, MEMBERS = 2048, 8192
QUERY_SIZE, MEMBER_SIZE = 1 << 19, 1 << 21

_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)


def scattered(shingles: np.ndarray) -> np.ndarray:
    """The first permutation, on 32 bits of the hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    return x * np.uint32(0x7FEB352D)


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit values, in place."""
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x9E3779B1)
    return x


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest values of the second permutation under each circular shift."""
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    places = scattered(shingles)
    for at in range(0, len(places), 512):
        values = _second(places[at : at + 512, None] + _SHIFTS)
        np.minimum(best, values.min(0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return sequence_hash([np.arange(BANDS, dtype=np.uint64), *rows.T])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(data, offsets)
    _, hashes = words.windows(SHINGLE)
    counts = np.diff(words.first)
    ends = np.cumsum(np.concatenate([[0], np.maximum(counts - SHINGLE + 1, 0)]))
    found = []
    for i, n in enumerate(counts):
        if n >= SHINGLE:
            found.append(np.unique(hashes[ends[i] : ends[i + 1]]))
        elif n:
            found.append(sequence_hash([words.hash[j : j + 1] for j in range(words.first[i], words.first[i + 1])]))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def prepared(docs: DataFrame, *keep: str) -> DataFrame:
    """row, the ``keep`` columns, text, n_shingles, two hashes of the set, signature and band keys.

    ``row`` numbers the rows of the written table; equal sets have equal hashes.
    """
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("text")):
                sizes, one, two, sigs, keys = [], [], [], [], []
                for shingles in shingle_sets(data, offsets):
                    sizes.append(len(shingles))
                    one.append(np.bitwise_xor.reduce(shingles, initial=np.uint64(0)))
                    two.append(mix(shingles).sum(dtype=np.uint64))
                    if len(shingles):
                        sig = signature(shingles)
                        sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
                        keys.append(band_keys(sig))
                    else:
                        sigs.append(None)
                        keys.append(np.zeros(0, np.uint64))
                n = end - at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)),
                        batch.column("doc").slice(at, n),
                        batch.column("text").slice(at, n),
                        pa.array(sizes, pa.int64()),
                        pa.array(signed(np.array(one, np.uint64))),
                        pa.array(signed(np.array(two, np.uint64))),
                        pa.array(sigs, pa.binary()),
                        lists(signed(np.concatenate(keys)), np.cumsum([0, *map(len, keys)]), pa.int64()),
                    ],
                    names=["row", "doc", "text", "n_shingles", "set1", "set2", "sig", "bands"],
                )
                number += n

    doc = source.schema["doc"].dataType.simpleString()
    schema = f"row bigint, doc {doc}, text string, n_shingles bigint, set1 bigint, set2 bigint, sig binary, bands array<bigint>"
    return written(source.mapInArrow(measure, schema), "shingled")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked: signatures first, then the full sets."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES)
                for c in ("sig_a", "sig_b")
            )
            good = (a == b).sum(1) >= MIN_EQUAL
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def sets(column: pa.Array, ids: np.ndarray) -> list[np.ndarray]:
            for i, key in enumerate(ids):
                if key not in known:
                    if len(known) > 64:
                        known.clear()
                    data = np.frombuffer(column[i].as_py().encode(), np.uint8)
                    known[key] = shingle_sets(data, np.array([0, len(data)]))[0]
                yield known[key]

        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(sets(batch.column("text_a"), a), sets(batch.column("text_b"), b))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= THRESHOLD * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def side(name: str, table: DataFrame, *columns: str) -> DataFrame:
        return table.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    near = (
        pairs.join(side("a", classes, "sig", "n_shingles"), "a")
        .join(side("b", classes, "sig", "n_shingles"), "b")
        .where(
            100 * F.least("n_shingles_a", "n_shingles_b") >= THRESHOLD * F.greatest("n_shingles_a", "n_shingles_b")
        )
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(alike, "a bigint, b bigint")
    )
    near = written(near, "candidates")
    ends = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    needed = written(texts.join(ends, "class"), "candidate-texts")
    full = near.join(side("b", needed, "text"), "b").join(side("a", needed, "text"), "a")
    links = written(full.select("a", "b", "text_a", "text_b").mapInArrow(linked, "a bigint, b bigint"), "links")
    discard(near, needed)
    return links


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, class and label of the members of buckets that span several components."""
    found = components(links)
    labels = found.withColumnRenamed("node", "class")
    rows = members.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_keys = (
        rows.groupBy("key")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high")
        .select("key")
    )
    rows = written(rows.join(open_keys, "key").select("key", "class", "label"), "open-buckets")
    discard(found)
    return rows


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Each member with its bucket's hub, the member that a hash of bucket and class puts first."""
    order = F.struct(F.xxhash64("key", "class").alias("h"), "class", "label")
    hubs = rows.groupBy("key").agg(F.min(order).alias("hub"))
    pairs = rows.join(hubs, "key").where(F.col("label") != F.col("hub.label"))
    return pairs.select(
        F.greatest("class", F.col("hub.class")).alias("b"), F.least("class", F.col("hub.class")).alias("a")
    ).distinct()


def _block_by_block(rows: DataFrame, size: Column, query_size: int, member_size: int, compare, schema: str) -> DataFrame:
    """``compare`` on every block of queries and block of members of each bucket.

    Queries are the members outside a bucket's largest label. ``rows`` has key, class, label and
    what ``compare`` needs of each; the columns of queries begin with ``q_``.
    """
    sizes = rows.withColumn("size", size).groupBy("key", "label").agg(F.sum("size").alias("size"))
    largest = sizes.groupBy("key").agg(
        F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("all_size")
    )
    dealt = rows.join(largest, "key").select(
        *rows.columns,
        (F.col("label") != F.col("most.label")).alias("asks"),
        F.ceil((F.col("all_size") - F.col("most.size")) / query_size).cast("int").alias("query_blocks"),
        F.ceil(F.col("all_size") / member_size).cast("int").alias("member_blocks"),
        F.xxhash64("class").alias("deal"),
    )
    # The keys of both sides need equal types to meet.
    queries = dealt.where("asks").select(
        *[F.col(c).alias(f"q_{c}") for c in rows.columns],
        F.pmod("deal", "query_blocks").cast("int").alias("q_block"),
        F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("q_member"),
    )
    members = dealt.select(
        *rows.columns,
        F.pmod("deal", "member_blocks").cast("int").alias("member"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("block"),
    )
    met = queries.groupBy("q_key", "q_block", "q_member").cogroup(members.groupBy("key", "block", "member"))
    return met.applyInArrow(compare, schema)


class _Forest:
    """Groups of nodes that grow together, and the links that joined two of them."""

    def __init__(self, *nodes: np.ndarray):
        self.nodes = np.unique(np.concatenate(nodes))
        self.group = np.arange(len(self.nodes))
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def join(self, node: int, others: np.ndarray) -> None:
        own = self.group[np.searchsorted(self.nodes, node)]
        groups, first = np.unique(self.group[np.searchsorted(self.nodes, others)], return_index=True)
        new = groups != own
        if new.any():
            found = others[first[new]]
            self.a.append(np.minimum(found, node))
            self.b.append(np.maximum(found, node))
            self.group[np.isin(self.group, groups[new])] = own

    def links(self) -> pa.Table:
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(self.a or none)), "b": pa.array(np.concatenate(self.b or none))})


def _near(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each query its number and those of the members that may be linked with it."""
    q_sig, sig = (
        np.frombuffer(b"".join(t[c].to_pylist()), np.uint8).reshape(-1, COORDINATES)
        for t, c in ((left, "q_sig"), (right, "sig"))
    )
    label, size = right["label"].to_numpy(), right["n_shingles"].to_numpy()
    for i, (q_label, n) in enumerate(zip(left["q_label"].to_numpy(), left["q_n_shingles"].to_numpy())):
        fits = (label != q_label) & (100 * np.minimum(size, n) >= THRESHOLD * np.maximum(size, n))
        at = np.flatnonzero(fits)
        yield i, at[(sig[at] == q_sig[i]).sum(1) >= MIN_EQUAL]


def _rest_links(rows: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (of labels) that join all classes of different labels in an open bucket that are linked.

    Blocks of buckets compare signatures. What is similar grows into groups that need not end at a bucket,
    so a class has one group and brings its set along once; blocks of the groups compare the sets.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("text")):
                found = [x.tobytes() for x in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class").slice(at, end - at), pa.array(found, pa.binary())], names=["class", "set"]
                )

    def similar(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, members = left["q_class"].to_numpy(), right["class"].to_numpy()
        forest = _Forest(asked, members)
        if left.num_rows and right.num_rows:
            for i, near in _near(left, right):
                if len(near):
                    forest.join(asked[i], members[near])
        return forest.links()

    def linked(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, label = left["q_label"].to_numpy(), right["label"].to_numpy()
        forest = _Forest(asked, label)
        if left.num_rows and right.num_rows:
            own = [np.frombuffer(x, np.uint64) for x in left["q_set"].to_pylist()]
            theirs = [np.frombuffer(x, np.uint64) for x in right["set"].to_pylist()]
            size = np.array([len(x) for x in theirs])
            known, ids = np.unique(np.concatenate(theirs), return_inverse=True)
            bags = np.split(ids, np.cumsum(size)[:-1])
            for i, near in _near(left, right):
                if len(near):
                    bag = own[i]
                    at = np.minimum(np.searchsorted(known, bag), len(known) - 1)
                    mark = np.zeros(len(known), bool)
                    mark[at[known[at] == bag]] = True
                    hits = mark[np.concatenate([bags[j] for j in near])]
                    both = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(size[near])[:-1]]), dtype=np.int64)
                    good = near[100 * both >= THRESHOLD * (size[near] + len(bag) - both)]
                    if len(good):
                        forest.join(asked[i], label[good])
        return forest.links()

    rows = written(rows.join(classes.select("class", "sig", "n_shingles"), "class"), "open-signatures")
    close = written(_block_by_block(rows, F.lit(1), QUERIES, MEMBERS, similar, "a bigint, b bigint"), "similar")
    groups = components(close)
    own = rows.select("class", "label", "sig", "n_shingles").dropDuplicates(["class"])
    members = written(groups.select(F.col("node").alias("class"), F.col("label").alias("key")).join(own, "class"), "groups")
    discard(rows, close, groups)
    open_texts = texts.join(members.select("class"), "class").select("class", "text")
    bags = written(open_texts.mapInArrow(sets, "class bigint, set binary"), "open-sets")
    links = _block_by_block(
        members.join(bags, "class"), F.col("n_shingles"), QUERY_SIZE, MEMBER_SIZE, linked, "a bigint, b bigint"
    )
    links = written(links.distinct(), "links")
    discard(members, bags)
    return links


def class_labels(shingled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of equal sets (class: their first row), and (class, label) of those in a link."""
    classes = shingled.where("n_shingles > 0").groupBy("set1", "set2", "n_shingles").agg(F.min("row").alias("class"))
    classes = written(classes, "classes")
    own = shingled.join(classes.select(F.col("class").alias("row")), "row")
    measures = written(own.select(F.col("row").alias("class"), "n_shingles", "sig", "bands"), "signatures")
    texts = shingled.select(F.col("row").alias("class"), "text")
    keys = measures.select("class", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("class").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared.drop("n"), "key"), "buckets")
    first = members.where(F.col("class") != F.col("hub"))
    first = written(first.select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    links = one = _verified(first, measures, texts)
    rows = _labelled(members.select("key", "class"), links)
    discard(members)
    second = written(_hub_pairs(rows).join(first, ["a", "b"], "left_anti"), "pairs")
    two = _verified(second, measures, texts)
    discard(first, second)
    wider, rows = rows, _labelled(rows.select("key", "class"), one.union(two))
    discard(wider)
    three = _rest_links(rows, measures, texts)
    labels = components(one.union(two).union(three))
    discard(rows, measures, one, two, three)
    return classes, labels.withColumnRenamed("node", "class")


def _members(shingled: DataFrame, doc_id: str) -> DataFrame:
    """row, doc, n_shingles, component_id and ``keeper`` of every row."""
    classes, labels = class_labels(shingled)
    classes = classes.join(labels, "class", "left")
    classes = classes.select("set1", "set2", "n_shingles", F.coalesce("label", "class").alias("label"))
    rows = shingled.drop("text", "sig", "bands").join(classes, ["set1", "set2", "n_shingles"], "left")
    # Rows without words are components of their own.
    rows = written(rows.withColumn("label", F.coalesce("label", "row")), "labelled")
    own_id = F.col("doc").getField(doc_id)
    smallest = rows.groupBy("label").agg(
        F.min(F.struct(own_id.isNull().alias("none"), own_id.alias("id"), "row")).alias("least")
    )
    return rows.join(smallest, "label").select(
        "row",
        "doc",
        "n_shingles",
        F.col("least.id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("keeper"),
    )


def grouped(docs: DataFrame, *keep: str, doc_id: str = "doc_id") -> DataFrame:
    """Struct ``doc`` of the ``keep`` columns (``doc_id`` among them), n_shingles, component_id and
    ``keeper``: true for one row of each component, one with the smallest id."""
    return _members(prepared(docs, *keep), doc_id).drop("row")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents, one of each component, with all their columns."""
    shingled = prepared(docs, *[c for c in docs.columns if c != "text"])
    keepers = _members(shingled, doc_id).where("keeper").select("row")
    kept = shingled.select("row", "doc", "text").join(keepers, "row", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
