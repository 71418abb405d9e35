"""Quality classifier: a sparse rule ensemble over text statistics.

A small random forest is fitted on a bounded sample of labelled texts. Every path from a root
is a rule, a conjunction of conditions on statistics. A logistic regression with a lasso
penalty gives most rules weight zero, and those that remain compile into one Spark column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import first_by_hash, let, text_or_empty
from tidemark.llm.trees import trees_of
from tidemark.session import written

#: Bound of the fit: labelled documents that are read at most, those whose ids hash lowest.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED, PENALTY = 16, 3, 11, 0.002
STATISTICS = (
    "log_words", "word_length", "letter_share", "upper_share", "symbol_share", "digit_share", "distinct_share", "repeat_share", "words_per_line",
    "repeated_line_share",
)


def statistics(text: str | Column = "text") -> Column:
    """A struct of doubles over the whole text (null: empty; then all are 0).

    One expression that splits and scans the text once, also where a filter on it is pushed to
    the scan: what is used more than once is bound by ``let``, and no lambda over the words sees
    anything but its own elements.
    """

    def left(t: Column, pattern: str) -> Column:
        return F.char_length(F.regexp_replace(t, pattern, "")).cast("double")

    def counted(t: Column) -> Column:
        return F.struct(
            F.split(F.trim(t), r"\s+").alias("words"), F.split(t, "\n").alias("lines"), F.char_length(t).cast("double").alias("n"), left(t, r"[^\p{L}]+").alias("letters"),
            left(t, r"[^\p{Lu}]+").alias("upper"), left(t, r"[\p{L}\p{N}\s.,;:'\"()-]+").alias("odd"), left(t, "[^0-9]+").alias("digits"),
        )

    def sized(c: Column) -> Column:
        following = F.zip_with(c["words"], F.slice(c["words"], 2, 1 << 30), lambda w, after: w == after)  # null behind the last
        return F.struct(
            c["n"].alias("n"), F.greatest(c["n"], F.lit(1.0)).alias("some"), c["letters"].alias("letters"), c["upper"].alias("upper"), c["odd"].alias("odd"), c["digits"].alias("digits"),
            F.size(c["words"]).cast("double").alias("words"), F.size(c["lines"]).cast("double").alias("lines"), F.size(F.array_distinct(c["words"])).alias("different"),
            F.size(F.filter(following, lambda same: same)).cast("double").alias("again"), F.size(F.array_distinct(c["lines"])).alias("different_lines"),
        )

    def shares(c: Column) -> Column:
        words, lines, some, filled = c["words"], c["lines"], c["some"], c["n"] > 0
        stats = {
            "log_words": F.when(filled, F.log1p(words)).otherwise(F.lit(0.0)), "word_length": c["n"] / words, "letter_share": c["letters"] / some,
            "upper_share": c["upper"] / F.greatest(c["letters"], F.lit(1.0)), "symbol_share": c["odd"] / some, "digit_share": c["digits"] / some,
            "distinct_share": F.when(filled, c["different"] / words).otherwise(F.lit(0.0)), "repeat_share": c["again"] / words,
            "words_per_line": F.when(filled, words / lines).otherwise(F.lit(0.0)), "repeated_line_share": 1 - c["different_lines"] / lines,
        }
        return F.struct(*(stats[name].alias(name) for name in STATISTICS))

    return let(let(let(text_or_empty(text), counted), sized), shares)


Rule = tuple[tuple[int, str, float], ...]


def holds(rule: Rule, stats: Column) -> Column:
    """A rule as a Boolean column over a struct of statistics."""
    out = None
    for feature, side, cut in rule:
        value = stats[STATISTICS[feature]]
        test = value <= F.lit(cut) if side == "<=" else value > F.lit(cut)
        out = test if out is None else out & test
    return out


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, text: str | Column = "text") -> Column:
        """The probability of label 1, as one expression over a text column."""

        def of(stats: Column) -> Column:
            logit = F.lit(self.intercept)
            for rule, weight in zip(self.rules, self.weights, strict=True):
                logit = logit + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

        return let(statistics(text), of)

    def described(self) -> list[str]:
        """The rules as text, heaviest first."""
        named = [(w, " and ".join(f"{STATISTICS[f]} {side} {cut:.4g}" for f, side, cut in rule)) for rule, w in zip(self.rules, self.weights, strict=True)]
        return [f"{w:+.3f} if {text}" for w, text in sorted(named, key=lambda x: -abs(x[0]))]


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text leaves 2 at division by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out part.

    Null labels and ids are not used; a document with several different labels counts once for
    each. With one class only, or no label at all, the ensemble has no rules and scores
    (ones + 1) / (rows + 2) everywhere.
    """
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    known = first_by_hash(known.distinct(), "_id", sample_rows)
    # the sample is broadcast: sample_rows rows at most
    texts = documents.select(F.col(key).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(known), "_id")
    rows = written(texts.select("_id", statistics("_t").alias("_stats"), F.col("_y").cast("double").alias("label")), "quality-sample")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones, total = sizes.get(1.0, 0), sum(sizes.values())
    if len(sizes) < 2:
        share = (ones + 1) / (total + 2)
        return RuleEnsemble((), (), math.log(share / (1 - share)))
    vector = array_to_vector(F.array(*(F.col(f"_stats.{name}") for name in STATISTICS)))
    ordered = rows.coalesce(2).sortWithinPartitions("_id").withColumn("features", vector)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.7, minInstancesPerNode=5).fit(ordered)
    rules = list(dict.fromkeys(path for tree in trees_of(forest) for path in tree.paths()))
    marks = array_to_vector(F.array(*(holds(rule, F.col("_stats")).cast("double") for rule in rules)))
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60).fit(rows.coalesce(2).select("label", marks.alias("features")))
    kept = [(rule, float(w)) for rule, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > 1e-9]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(lasso.intercept))


def score_documents(documents: DataFrame, model: RuleEnsemble, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score) for every row; the text alone decides the score (null: as empty).

    Repeated rows each get their score; other columns, clashing names included, are left out.
    """
    return documents.select(F.col(key), held_out(key).alias("held_out"), model.score(text).alias("score"))


def keep_good(documents: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows that score at least the threshold, with their own columns."""
    return documents.where(model.score(text) >= threshold)
