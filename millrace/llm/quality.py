"""Quality scores by a sparse rule ensemble.

Statistics of the whole text are column expressions. Small trees grown on labelled rows give paths;
each path is a rule, a conjunction of bounds on statistics. A lasso logistic fit keeps a few rules and
weighs them, and the score compiles into one column expression over the statistics: no model object is
needed to score. Trees and fit run on all labelled rows outside the held-out fold.

Edge cases: null and empty texts have all statistics 0 and get a score like any other. Labels that are
null or contradict each other for an id are not learned from. Without labelled rows every score is 0.5;
with one class it is (ones + 1) / (rows + 2). Rows are scored one by one; extra columns pass through
`with_score`.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, held_out
from millrace.session import settle

TREES, DEPTH, SEED = 24, 3, 7
LASSO = 0.002
GOOD = 0.7
SYMBOLS = r"[#$%&*|<>=@^~{}\[\]\\_+]"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)).cast("double")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    base = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.length("t").alias("chars"), F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.split("t", "\n").alias("lines"), count(SYMBOLS).alias("symbols"), count(r"\p{Lu}{2,}").alias("capitals"),
        count(r"\d").alias("digits"), count(r"[.!?](?=\s|$)").alias("ends"), count(r"!").alias("shouts"),
        count(r",").alias("commas"), count(r"(?:^|\s)\p{Lu}").alias("initials"), count(r"\s").alias("blanks"))
    base = base.select(
        "*", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("kinds"),
        F.size(F.array_distinct("lines")).alias("line_kinds"), F.size("lines").alias("n_lines"))
    words = F.col("words")
    return base.select(
        "doc_id", F.log1p(words).alias("log_words"), _share(F.col("chars") - F.col("blanks"), words).alias("word_chars"),
        _share(F.col("symbols"), words).alias("symbols"), _share(F.col("capitals"), words).alias("capitals"),
        _share(F.col("digits"), F.col("chars")).alias("digits"), _share(F.col("ends"), words).alias("ends"),
        _share(F.col("shouts"), words).alias("shouts"), _share(F.col("commas"), words).alias("commas"),
        _share(F.col("initials"), words).alias("initials"), _share(F.col("kinds"), words).alias("variety"),
        _share(F.col("kinds"), F.sqrt(words)).alias("richness"),
        _share(F.col("line_kinds"), F.col("n_lines")).alias("line_variety"),
        _share(words, F.col("n_lines")).alias("line_words"))


FEATURES = ["log_words", "word_chars", "symbols", "capitals", "digits", "ends", "shouts", "commas", "initials",
            "variety", "richness", "line_variety", "line_words"]
Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most the bound?, bound), all must hold


def tree_rules(tree: str) -> set[Rule]:
    """The paths of a printed tree, to inner nodes and leaves, bounds of a statistic merged."""
    found, path = set(), []
    for line in tree.splitlines():
        if test := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-+\w.]+)\)", line):
            depth = len(line) - len(line.lstrip())
            path = [p for p in path if p[0] < depth]
            path.append((depth, FEATURES[int(test[1])], test[2] == "<=", float(test[3])))
            bounds: dict[tuple[str, bool], float] = {}
            for _, name, most, at in path:
                key = (name, most)
                bounds[key] = at if key not in bounds else (min if most else max)(at, bounds[key])
            found.add(tuple(sorted((n, m, at) for (n, m), at in bounds.items())))
    return found


def rule_column(rule: Rule) -> Column:
    held = F.lit(True)
    for name, most, at in rule:
        held = held & ((F.col(name) <= at) if most else (F.col(name) > at))
    return held.cast("double")


class Ensemble:
    """Weighted rules; `score` is a column over the statistics."""

    def __init__(self, bias: float, weights: dict[Rule, float]):
        self.bias, self.weights = bias, weights

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.weights.items():
            total = total + F.lit(weight) * rule_column(rule)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with label for the rows that may be learned from."""
    sure = labels.where("quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other")
    return stats.where(~held_out(F.col("doc_id"))).join(sure.select("doc_id", "label"), "doc_id").select(
        F.col("label").cast("double").alias("label"), *FEATURES)


def fit(stats: DataFrame, labels: DataFrame) -> Ensemble:
    rows = settle(labelled(stats, labels), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = (ones + 1) / (n + 2)
        return Ensemble(log_odds(share), {})
    vectors = rows.select("label", array_to_vector(F.array(*FEATURES)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, bootstrap=False, seed=SEED,
                                    featureSubsetStrategy="onethird", minInstancesPerNode=5).fit(vectors)
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return Ensemble(log_odds((ones + 1) / (n + 2)), {})
    held = settle(rows.select("label", F.array(*map(rule_column, rules)).alias("rules")), "rules")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(
        held.select("label", array_to_vector("rules").alias("features")))
    weights = {r: float(w) for r, w in zip(rules, model.coefficients) if w}
    return Ensemble(float(model.intercept), weights)


def log_odds(share: float) -> float:
    return math.log(share / (1 - share))


def with_score(stats: DataFrame, ensemble: Ensemble) -> DataFrame:
    """stats with score and predicted (1 from GOOD on)."""
    return stats.withColumn("score", ensemble.score()).withColumn(
        "predicted", (F.col("score") >= GOOD).cast("int"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    stats = settle(statistics(docs), "statistics")
    told = with_score(stats, fit(stats, labels))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
