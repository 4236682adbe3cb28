"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Spark columns.

Random trees propose conjunctions of thresholds, a lasso logistic regression over these rules and the
statistics keeps a few of them, and the kept ones become one column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import WORD
from tillbook.sources import write_and_read

#: Labelled documents that a model is fitted on at most (expected number; drawn by a hash of the id).
MAX_TRAINING_ROWS = 50_000

#: Statistics by name, as shares of a text's characters that belong to a class.
CLASSES = {
    "upper": "A-ZÀ-ÖØ-Þ",
    "digit": "0-9",
    "stop": ".,;:?",
    "bang": "!",
    "bar": "|",
    "symbol": "#$%&*~^<>{}=+@_\\\\",
    "break": "\\n",
}


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Statistics of a whole text, given with its words; without any characters they are zeros."""
    chars = F.greatest(F.length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    after = F.slice(words, F.lit(2), count)
    repeats = F.filter(F.zip_with(words, after, lambda a, b: a == b), lambda same: same)
    # Distinct words grow with the text's length about as its square root.
    spread = F.size(F.array_distinct(words)) / F.sqrt(count)
    found = {
        "length": F.log1p(F.length(text)),
        "words": F.log1p(F.size(words)),
        "word_length": F.length(text) / count,
        "distinct": F.size(F.array_distinct(words)) / count,
        "spread": spread,
        "repeats": F.size(repeats) / count,
    }
    for name, members in CLASSES.items():
        found[name] = F.length(F.regexp_replace(text, f"[^{members}]+", "")) / chars
    return {k: c.cast("double") for k, c in found.items()}


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``statistic <= threshold`` (True) or ``>`` (False) conditions."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, below, threshold in self.conditions:
            value = stats[name]
            out = out & (value <= F.lit(threshold) if below else value > F.lit(threshold))
        return out


@dataclass
class RuleEnsemble:
    """Log-odds of label 1: intercept, weighted rules, weighted statistics."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, float]] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        """Probability of label 1 from a struct of statistics."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            odds = odds + F.when(rule.column(stats), F.lit(weight)).otherwise(0.0)
        for name, weight in self.linear:
            odds = odds + stats[name] * F.lit(weight)
        return 1 / (1 + F.exp(-odds))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` as the struct ``row``, and the struct ``stats``.

    The statistics pass a generator of one row, so that a later filter on the score does not make Spark
    compute them again for every rule. Text and words are columns before it, as inside a generator
    Spark would extract the words anew at each mention.
    """
    text = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    split = df.select(F.struct("*").alias("row"), text.alias("text"), words.alias("words"))
    one = F.array(F.struct(*[c.alias(n) for n, c in statistics(F.col("text"), F.col("words")).items()]))
    return split.select("row", F.explode(one).alias("stats"))


def statistic_names() -> list[str]:
    return list(statistics(F.lit(""), F.array()))


def tree_rules(forest) -> list[Rule]:
    """Every path from a root to an inner or outer node of every tree, as rules without repeats."""
    names = statistic_names()
    rules: dict[Rule, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            rules[Rule(path)] = None
        if node.subtreeDepth() > 0:
            split = node.split()
            name, cut = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, True, cut)))
            walk(node.rightChild(), (*path, (name, False, cut)))

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), ())
    return list(rules)


def fit(training: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fit on ``training(stats, label)``, a written table; null labels are ignored.

    Without both labels there, the model is the constant (ones + 1) / (rows + 2).
    """
    names = statistic_names()
    training = training.filter("label is not null")
    n, ones = training.agg(F.count("*"), F.sum(F.col("label").cast("double"))).first()
    if not n or not ones or ones == n:
        share = ((ones or 0.0) + 1) / (n + 2)
        return RuleEnsemble(intercept=_log_odds(share))
    data = training.select(
        "stats",
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.array(*[F.col("stats")[c] for c in names])).alias("features"),
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed
    ).fit(data)
    rules = tree_rules(forest)
    fired = [F.when(r.column(F.col("stats")), 1.0).otherwise(0.0) for r in rules]
    linear = [F.col("stats")[c] for c in names]
    design = write_and_read(data.select("label", F.array(*fired, *linear).alias("x")))
    design = design.select("label", array_to_vector("x").alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(design)
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(
        float(lasso.intercept),
        [(r, w) for r, w in zip(rules, weights) if w],
        [(c, w) for c, w in zip(names, weights[len(rules):]) if w],
    )


def _log_odds(share: float) -> float:
    return math.log(share / (1 - share))


def training_rows(labels: DataFrame, learn: Column, target: str, most: int, seed: int = 7) -> DataFrame:
    """``(doc_id, label)`` of labelled ids that may be learned from: all, or about ``most`` of them
    drawn by a hash of the id. An id that is labelled several times counts once, with its largest label."""
    known = labels.filter(learn & F.col(target).isNotNull()).groupBy("doc_id").agg(F.max(target).alias("label"))
    share = min(1.0, most / max(known.count(), 1))
    lot = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return write_and_read(known.filter(lot < share))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document belongs to the fold that is never learned from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, **options) -> RuleEnsemble:
    """Fit on the labelled documents outside the held-out fold."""
    rows = training_rows(labels, ~held_out(F.col("doc_id")), "quality", most)
    known = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most about `most` rows
    return fit(write_and_read(with_statistics(known).select("stats", "row.label")), **options)


def score_documents(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``docs`` as the struct ``row`` with ``score`` (0 to 1) of every whole text, empty ones too."""
    return with_statistics(docs).select("row", model.score(F.col("stats")).alias("score"))


def keep_good(docs: DataFrame, model: RuleEnsemble, least: float = 0.3) -> DataFrame:
    """Documents whose score reaches ``least``; same columns, nothing shuffled."""
    return score_documents(docs, model).filter(F.col("score") >= least).select("row.*")
