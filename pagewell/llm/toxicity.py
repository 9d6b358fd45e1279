"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a whole text: densities and strongest entries of a lexicon of words and of one
of word beginnings, lexicon words near the second person, capitals, punctuation and
obfuscated words. Three disjoint parts of a bounded sample of labelled rows teach the lexicons
(words that labelled texts tell apart), the trees, and the calibration. Nothing but the text
enters a score.

Defined results: a null text is an empty one and is scored as such; a null label does not
count as one, a row labelled twice is toxic if either label says so; a null id can be scored
but not learned from; without labels of both kinds every score is the share of label 1 (0 if
there are none); repeated rows get equal scores; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pagewell.llm.common import Words, lists, signed, text_slices, word_hash, written

# The bound of the sample: labelled rows that are learned from, chosen by a hash of the id.
SAMPLE = 20_000
LEXICON = 4096
MIN_DOCS = 4
MIN_WEIGHT = 1.5
BEGINNINGS = (4, 5)  # bytes
NEAR = 5
THRESHOLD = 0.3
# Second-person words.
SECOND_PERSON = (
    "you your yours yourself u ur you're du dich dir dein deine deiner euch ihr sie tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros su sus"
).split()
FEATURES = (
    "lexicon_density lexicon_share lexicon_strongest lexicon_hits beginning_density beginning_strongest beginning_hits "
    "near_second_person second_person capitals capital_words exclamations questions punctuation obfuscated long_runs words"
).split()


def id_crc(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8"))


@dataclass
class Lexicon:
    """Sorted hashes and their weights, at most ``LEXICON`` each for words and beginnings."""

    words: np.ndarray
    word_weights: np.ndarray
    beginnings: np.ndarray
    beginning_weights: np.ndarray

    @staticmethod
    def look_up(hashes: np.ndarray, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return np.where(table[at] == hashes, weights[at], 0.0)


def _beginnings(words: Words) -> list[np.ndarray]:
    long = words.end - words.start
    return [
        np.where(long >= n, words.range_hash(words.start, np.minimum(words.start + n, words.end)), np.uint64(0))
        + np.uint64(n)
        for n in BEGINNINGS
    ]


_CLASS = np.zeros((5, 256), np.int32)  # letters, capitals, digits and signs, punctuation, exclamation
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, [*range(48, 58), *b"*@$#+_"]] = 1
_CLASS[3, [*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = 1
_CLASS[4, ord("!")] = 1


def features_of(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    words, n = Words(data, offsets), len(offsets) - 1
    size = np.maximum(np.diff(words.first), 1).astype(float)
    chars = np.maximum(np.diff(offsets), 1).astype(float)
    sums = [np.concatenate([[0], np.cumsum(row[data])]) for row in _CLASS]

    def per_text(k: int) -> np.ndarray:
        return (sums[k][offsets[1:]] - sums[k][offsets[:-1]]).astype(float)

    def per_word(k: int) -> np.ndarray:
        return sums[k][words.end] - sums[k][words.start]

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.text[mask], minlength=n).astype(float)

    def strongest(weights: np.ndarray) -> np.ndarray:
        best = np.zeros(n)
        hit = np.flatnonzero(weights)
        np.maximum.at(best, words.text[hit], weights[hit])
        return best

    weight = Lexicon.look_up(words.hash, lexicon.words, lexicon.word_weights)
    begins = np.zeros(len(words.hash))
    for hashes in _beginnings(words):
        found = Lexicon.look_up(hashes, lexicon.beginnings, lexicon.beginning_weights)
        begins = np.maximum(begins, found)
    persons = np.flatnonzero(np.isin(words.hash, np.array([word_hash(w) for w in SECOND_PERSON], np.uint64)))
    hits = np.flatnonzero((weight > 0) | (begins > 0))
    near = np.zeros(len(words.hash), bool)
    if len(persons) and len(hits):
        after = np.minimum(np.searchsorted(persons, hits), len(persons) - 1)
        for at in (persons[after], persons[np.maximum(after - 1, 0)]):
            close = (np.abs(at - hits) <= NEAR) & (words.text[at] == words.text[hits])
            near[hits[close]] = True
    letters, long = per_word(0), words.end - words.start
    obfuscated = (letters > 0) & (per_word(2) > 0) & (letters + per_word(2) >= long - 1) & (long >= 3)
    runs = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        same = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
        for back in (1, 2):  # runs end with their text
            across = np.asarray(offsets[1:-1], np.int64) - back
            same[across[(across >= 0) & (across < len(same))]] = False
        runs[3:] = np.cumsum(same)
    question = np.concatenate([[0], np.cumsum(data == ord("?"))])
    columns = [
        np.bincount(words.text, weight, n) / size,
        count(weight > 0) / size,
        strongest(weight),
        np.log1p(count(weight > 0)),
        np.bincount(words.text, begins, n) / size,
        strongest(begins),
        np.log1p(count(begins > 0)),
        count(near) / size,
        np.bincount(words.text[persons], minlength=n) / size,
        per_text(1) / np.maximum(per_text(0), 1),
        count((per_word(1) == letters) & (letters > 1)) / size,
        per_text(4) / chars,
        (question[offsets[1:]] - question[offsets[:-1]]) / chars,
        per_text(3) / chars,
        count(obfuscated) / size,
        (runs[offsets[1:]] - runs[offsets[:-1]]) / chars,
        np.log1p(np.diff(words.first)),
    ]
    return np.stack(columns, 1)


def with_features(docs: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """Columns ``keep`` and ``features`` of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("_text")):
                rows = features_of(data, offsets, lexicon)
                part = batch.slice(at, end - at)
                ends = np.arange(len(rows) + 1) * rows.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], lists(rows.ravel(), ends, pa.float64())],
                    names=[*keep, "features"],
                )

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(measure, rows.drop("_text").schema.add("features", ArrayType(DoubleType())))


def sample_of(docs: DataFrame, labels: DataFrame, learnable: Column, limit: int = SAMPLE) -> DataFrame:
    """text, label and part (0 to 9) of at most ``limit`` labelled ids."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("label"))
        .withColumn("order", F.xxhash64("doc_id", F.lit("sample")))
        .orderBy("order", "doc_id")
        .limit(limit)
    )
    chosen = chosen.withColumn("part", F.pmod("order", F.lit(10)).cast("int")).drop("order")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ``limit`` rows of an id and two numbers.
    return written(rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample")


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings by the log odds of the texts that hold them."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch.column("text")):
                words = Words(data, offsets)
                label = batch.column("label").to_numpy(zero_copy_only=False)[at:end]
                for kind, hashes in enumerate([words.hash, *_beginnings(words)]):
                    pairs = np.unique(np.stack([words.text.astype(np.uint64), hashes], 1), axis=0)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "kind": pa.array(np.full(len(pairs), min(kind, 1)), pa.int32()),
                            "hash": pa.array(signed(np.ascontiguousarray(pairs[:, 1]))),
                            "label": pa.array(label[pairs[:, 0].astype(int)]),
                        }
                    )

    totals = sample.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).first()
    positive, negative = totals["pos"] or 0.0, totals["neg"] or 0.0
    odds = (
        sample.select("text", "label")
        .mapInArrow(seen, "kind int, hash bigint, label double")
        .groupBy("kind", "hash")
        .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
        .where(F.col("pos") >= MIN_DOCS)
        .withColumn(
            "weight",
            F.log((F.col("pos") + 0.5) / (positive + 1)) - F.log((F.col("neg") + 0.5) / (negative + 1)),
        )
        .where(F.col("weight") >= MIN_WEIGHT)
    )
    found = []
    for kind in (0, 1):
        best = odds.where(F.col("kind") == kind).orderBy(F.desc(F.col("weight") * F.sqrt("pos")), "hash")
        rows = best.limit(LEXICON).collect()
        hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        found += [hashes[order], np.array([r["weight"] for r in rows], float)[order]]
    return Lexicon(*found)


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


def fitted(sample: DataFrame) -> Model:
    """Lexicons from half of the sample, trees from a third, calibration from the rest."""
    lexicon = learned_lexicon(sample.where("part < 4"))
    rows = written(with_features(sample.where("part >= 4"), lexicon, "label", "part").coalesce(4), "toxicity-features")
    rows = rows.withColumn("features", array_to_vector("features"))
    kinds = {
        (r["late"], r["label"]): r["count"]
        for r in rows.groupBy((F.col("part") >= 8).alias("late"), "label").count().collect()
    }
    positive = sum(n for (_, label), n in kinds.items() if label == 1)
    base = positive / max(1, sum(kinds.values()))
    if any(not kinds.get((late, label)) for late in (False, True) for label in (0.0, 1.0)):
        return Model(lexicon, None, None, base)
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, maxBins=64).fit(rows.where("part < 8"))
    margins = _margins(trees, rows.where("part >= 8"))
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
    return Model(lexicon, trees, calibration, base)


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    raw = trees.setPredictionCol("").setProbabilityCol("").setRawPredictionCol("raw").transform(rows)
    return raw.withColumn("margin", vector_to_array("raw")[1]).drop("raw")


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep``, the score and the prediction of every row."""
    rows = with_features(docs, model.lexicon, *keep)
    if model.trees is None:
        score: Column = F.lit(model.base)
    else:
        rows = _margins(model.trees, rows.withColumn("features", array_to_vector("features")))
        rows = model.calibration.setPredictionCol("calibrated").transform(rows)
        score = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
    return rows.select(*keep, score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
