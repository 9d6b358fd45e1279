"""Quality rules by distribution divergence (DataFrame functions only).

A document is compared with the references of its language: the distribution of
character classes, and the distribution of the language's common words (a parameter;
their shares are counted over all documents of the language). The distance is
Jensen-Shannon's (square root of the divergence in bits, 0 to 1). A document shorter than
a minimum gets no verdict from a comparison, as its histogram says little; the base rules
still hold. The limit of the word distance comes from the reference itself: a text without any
common word is as far from it as a lack of them can be, and three quarters of that distance is
the most a document may have (0.23 to 0.24 where common words are 18 to 19 % of all words).
``max_word_distance`` bounds it for languages rich in common words. The text is read once: every document becomes a row of counts, from which
references and verdicts are computed.

Defined results: a null text is an empty one (no words, so it fails the base rule); a
language without common words, null included, is compared by character classes only;
repeated rows are judged alike; an empty table gives an empty result; extra columns are
not read, and columns named like an internal one do no harm, as all rows carried along
are kept in one struct.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.llm.common import SPACE_CLASS, SPACES, text_or_empty, written

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_SHARE = 50

# Common words by language, most of them the shortest function words.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "was", "be", "with", "as", "by"),
    "de": ("der", "die", "und", "in", "zu", "den", "das", "von", "ist", "des", "mit", "auf", "für", "ein", "im", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "est", "pour", "qui", "par", "sur", "une"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "un", "por", "con", "una", "del", "es", "para"),
}


@dataclass(frozen=True)
class QualityRules:
    """Distances beyond which a document is rejected, and the lengths from which they count."""

    common_words: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: COMMON_WORDS)
    max_class_distance: float = 0.29
    min_class_chars: int = 200
    max_word_distance: float = 0.34
    # Share of the distance of a text without common words; None: ``max_word_distance`` alone.
    max_word_share: float | None = 0.75
    min_word_words: int = 120


def words_of(text: Column) -> Column:
    """The words of a text; one empty string if it has none."""
    return F.split(F.btrim(text, F.lit(SPACES)), f"{SPACE_CLASS}+")


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _covered(positions: Column) -> Column:
    """Words inside 3-word windows that start at these sorted positions."""
    return F.aggregate(
        positions,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
        lambda s, p: F.struct(
            p.alias("last"), (s["total"] + F.least(F.lit(3), p - s["last"])).alias("total")
        ),
        lambda s: s["total"],
    )


def _longs(values) -> Column:
    return F.array(*[F.coalesce(v, F.lit(0)).cast("long") for v in values])


def counted(docs: DataFrame, rules: QualityRules, kept: Column) -> DataFrame:
    """One row of counts for each document, with ``kept`` carried along as ``row``."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    common = F.array().cast("array<string>")
    for name, words in rules.common_words.items():
        common = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(common)
    longest = max([0, *(len(w.encode()) for words in rules.common_words.values() for w in words)])
    df = docs.select(
        kept.alias("row"), lang.alias("lang"), common.alias("common"), text_or_empty().alias("text")
    )
    text, words = F.col("text"), F.col("words")
    df = df.withColumns(
        {
            "words": words_of(text),
            "lines": F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]")),
        }
    )
    df = df.select(
        "row",
        "lang",
        "common",
        "words",
        F.when(F.get(words, F.lit(0)) == "", 0).otherwise(F.size(words)).cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(text).cast("long").alias("chars"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _removed(text, f"{SYMBOLS}+").alias("n_symbols"),
        _removed(text, r"\p{Lu}+").alias("n_upper"),
        # One hash for each 3-word window.
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ).alias("windows"),
        F.filter(
            words, lambda w: (F.octet_length(w) <= longest) & F.array_contains("common", w)
        ).alias("hits"),
    )
    df = df.withColumn("in_order", F.sort_array("windows"))
    df = df.withColumn(
        "twice",
        F.array_distinct(F.filter("in_order", lambda h, k: h == F.get(F.col("in_order"), k + 1))),
    )
    few = F.filter(
        F.sequence(F.lit(0), F.size("windows") - 1),
        lambda i: F.array_contains("twice", F.get(F.col("windows"), i)),
    )
    df = df.withColumn(  # many repeated windows are found by sorting them with their positions
        "placed",
        F.when(
            F.size("twice") > 32,
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    placed = F.col("placed")
    many = F.sort_array(
        F.transform(
            F.filter(
                placed,
                lambda x, k: x["h"].eqNullSafe(F.get(placed, k - 1)["h"])
                | x["h"].eqNullSafe(F.get(placed, k + 1)["h"]),
            ),
            lambda x: x["i"],
        )
    )
    repeated = (
        F.when(F.size("twice") == 0, 0).when(F.size("twice") <= 32, _covered(few)).otherwise(_covered(many))
    )
    space = F.col("chars") - F.col("word_chars")
    return df.select(
        "row",
        "lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.cast("long").alias("n_repeat_words"),
        "chars",
        _longs(
            [
                F.col("chars") - space - F.col("n_upper") - F.col("n_symbols"),
                F.col("n_upper"),
                F.col("n_symbols"),
                space,
            ]
        ).alias("classes"),
        F.concat(
            F.transform(
                "common", lambda w: (F.size("hits") - F.size(F.array_remove("hits", w))).cast("long")
            ),
            F.array(F.col("n_words") - F.size("hits")),
        ).alias("common_counts"),
    )


def references(counts: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per language: the sums of both histograms over all its documents."""
    longest = max([0, *map(len, rules.common_words.values())]) + 1

    def sums(name: str, size: int) -> Column:
        return F.array(*[F.sum(F.get(F.col(name), F.lit(i))) for i in range(size)])

    return counts.groupBy("lang").agg(
        sums("classes", 4).alias("class_sums"),
        F.filter(sums("common_counts", longest), lambda x: x.isNotNull()).alias("common_sums"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 where either is empty."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(F.lit(0.0))

    bits = F.aggregate(
        F.zip_with(p, q, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.struct(F.lit(0.0).alias("bits"), (1.0 / total(p)).alias("p"), (1.0 / total(q)).alias("q")),
        lambda s, x: F.struct(
            (
                s["bits"]
                + (part(x["a"] * s["p"], x["b"] * s["q"]) + part(x["b"] * s["q"], x["a"] * s["p"])) / 2
            ).alias("bits"),
            s["p"].alias("p"),
            s["q"].alias("q"),
        ),
        lambda s: s["bits"],
    )
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(bits, F.lit(0.0)))).otherwise(F.lit(0.0))


def word_limit(sums: Column, rules: QualityRules) -> Column:
    """The word distance beyond which a document of a language with these sums is rejected.

    Where no document has a common word, a lack of them says nothing.
    """
    most = F.lit(rules.max_word_distance)
    if rules.max_word_share is None:
        return most
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    none = F.concat(F.array_repeat(zero, F.size(sums) - 1), F.array(one))
    seen = F.exists(F.slice(sums, 1, F.size(sums) - 1), lambda n: n > 0)
    return F.when(seen, F.least(most, rules.max_word_share * distance(none, sums))).otherwise(most)


def judged(docs: DataFrame, rules: QualityRules, *keep: str) -> DataFrame:
    """Columns ``keep`` of every row, its base counts, both distances and the verdict.

    The rows of counts are written once, with the kept columns, which should be small.
    """
    counts = written(counted(docs, rules, F.struct(*[F.col(f"`{c}`") for c in keep])), "quality-counts")
    return _compared(counts, references(counts, rules), rules)


def _compared(counts: DataFrame, refs: DataFrame, rules: QualityRules) -> DataFrame:
    # A row per language; small by its files' size, so the planner may broadcast it.
    refs = refs.withColumn("word_limit", word_limit(F.col("common_sums"), rules))
    df = counts.join(written(refs, "quality-references"), "lang", "left")
    df = df.withColumn("class_distance", distance(F.col("classes"), F.col("class_sums"))).withColumn(
        "word_distance",
        F.when(F.size("common_counts") > 1, distance(F.col("common_counts"), F.col("common_sums"))).otherwise(0.0),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    odd = ((F.col("chars") >= rules.min_class_chars) & (F.col("class_distance") > rules.max_class_distance)) | (
        (F.col("n_words") >= rules.min_word_words) & (F.col("word_distance") > F.col("word_limit"))
    )
    return df.select(
        "row.*",
        *[c for c in counts.columns if c == "barrier"],
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~odd).alias("kept"),
        "class_distance",
        "word_distance",
    )


def clean(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns."""
    own = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # Texts are read again for the verdict rather than copied beside the counts.
    refs = references(counted(docs, rules, F.struct(F.lit(0))), rules)
    # Without a column that may not be moved, the optimizer would copy the counts into the filter.
    counts = counted(docs, rules, own).withColumn("barrier", F.monotonically_increasing_id())
    return _compared(counts, refs, rules).where(F.col("kept") & (F.col("barrier") >= 0)).select("doc.*")
