"""Quality of documents by a sparse ensemble of rules.

Statistics of the text are Spark columns. On a bounded sample of labelled rows,
boosted trees are grown over them; every path of a tree is a conjunctive rule;
an L1-penalised logistic fit gives most rules weight zero; the rest become one
column expression. Scoring is a narrow native projection over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.base import let
from pageloom.llm.trees import boost, lasso_logistic, sigmoid

SAMPLE = 4000  # labelled rows that training looks at, at every size of the corpus
CUT = 0.3  # a score of at least this predicts label 1


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never looked at; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def statistics(text: Column) -> dict[str, Column]:
    """What the rules may test. All are 0 for a null or empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.trim(text), r"\s+")
    length = F.length(text)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")

    return {
        "chars": length.cast("double"),
        "upper": share(F.regexp_count(text, F.lit(r"\p{Lu}")), length),
        "symbols": share(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")), length),
        "digits": share(F.regexp_count(text, F.lit(r"[0-9]")), length),
        "stops": share(F.regexp_count(text, F.lit(r"[.,]")), length),
        "lines": share(F.regexp_count(text, F.lit(r"\n")), length),
        "word_length": share(length, F.size(words)),
        "distinct": share(F.size(F.array_distinct(words)), F.size(words)),
        "words": F.size(words).cast("double"),
    }


Rule = tuple[tuple[int, str, float], ...]


@dataclass
class RuleEnsemble:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self, stats: Column) -> Column:
        """The score over a struct with fields of these names."""

        def holds(rule: Rule) -> Column:
            tests = [stats[self.names[f]] <= t if op == "<=" else stats[self.names[f]] > t for f, op, t in rule]
            return reduce(lambda a, b: a & b, tests)

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _matrix(rules: list[Rule], rows: np.ndarray) -> np.ndarray:
    out = np.ones((len(rows), len(rules)))
    for k, rule in enumerate(rules):
        for f, op, t in rule:
            out[:, k] *= rows[:, f] <= t if op == "<=" else rows[:, f] > t
    return out


def fit_rules(names: list[str], rows: np.ndarray, labels: np.ndarray, trees: int = 30, depth: int = 3) -> RuleEnsemble:
    """Rules from tree paths, their weights from the lasso; the penalty is chosen on every fourth row."""
    if len(rows) == 0:
        return RuleEnsemble(names, 0.0, [])
    paths = [p for tree in boost(rows, labels, trees, depth).trees for p in tree.paths()]
    rules, seen = [], set()
    matrix = _matrix(paths, rows)
    for k, path in enumerate(paths):
        cover = matrix[:, k].astype(bool).tobytes()
        if cover not in seen and 0 < matrix[:, k].mean() < 1:
            seen.add(cover)
            rules.append((path, k))
    matrix = matrix[:, [k for _, k in rules]]
    check = np.arange(len(rows)) % 4 == 3
    best = (np.inf, 1e-3)
    for penalty in (3e-2, 1e-2, 3e-3, 1e-3):
        bias, weights = lasso_logistic(matrix[~check], labels[~check], penalty)
        p = np.clip(sigmoid(matrix[check] @ weights + bias), 1e-6, 1 - 1e-6)
        loss = -np.mean(labels[check] * np.log(p) + (1 - labels[check]) * np.log(1 - p)) if check.any() else 0.0
        if loss < best[0] - 1e-4:
            best = (loss, penalty)
    bias, weights = lasso_logistic(matrix, labels, best[1])
    kept = [(rule, float(w)) for (rule, _), w in zip(rules, weights, strict=True) if abs(w) > 1e-4]
    return RuleEnsemble(names, bias, kept)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled rows, chosen by a hash of the id, held-out rows excluded.

    Without usable labels every score is 0.5.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    # Bounded: a top-k by hash, so the broadcast is at most `sample` small rows.
    picked = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample).dropDuplicates(["_id"])
    stats = statistics(F.col("text"))
    joined = docs.select(F.col("doc_id").alias("_id"), F.col("text")).join(F.broadcast(picked), "_id")
    # Repeated ids must not make the sample larger than stated.
    rows = joined.select("_id", "_y", *[c.alias(n) for n, c in stats.items()]).orderBy(F.xxhash64("_id"), "_id", *stats).limit(sample).toPandas()
    names = list(stats)
    return fit_rules(names, rows[names].to_numpy(float), rows["_y"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; existing columns keep their names and values.

    The statistics are bound once to a struct that all rules look at, so a filter on
    the score does not compute them again for each rule, and no name can clash.
    """
    stats = statistics(F.col("text"))
    return docs.withColumn(column, let(F.struct(*[stats[n].alias(n) for n in model.names]), model.column))


def judged(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).cast("int").alias("predicted"),
    )
