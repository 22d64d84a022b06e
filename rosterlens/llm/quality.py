"""Quality by a sparse ensemble of rules over text statistics.

Every text gets a row of statistics, Spark columns all. On a bounded sample of labelled rows small trees are
boosted over them in numpy; each path of a tree is a conjunctive rule (`symbol_share > 0.1 AND ...`). A
logistic regression with a lasso penalty keeps few of the rules, and those are compiled into one Spark
column expression: scoring is a scan with a projection, without a shuffle or a UDF.

Defined results: a null text counts as empty; all its statistics are 0, and it is scored like any text. Without
labelled rows of both classes no rule is kept and every score is the smoothed share of good rows, 0.75 if
there are none. Rows are independent, so ties, repeats and null ids pass through. Other columns are kept
as they are; the statistics have names of their own while scoring and do not stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.common import staged

PREFIX = "__statistic_"
Condition = tuple[int, bool, float]  # statistic, above?, threshold
Rule = tuple[Condition, ...]


def statistics(text: Column) -> dict[str, Column]:
    """Name -> statistic of a text, each a number that is never null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.split(text, r"\s+")
    size = F.greatest(F.length(text), F.lit(1))
    count = F.greatest(F.size(words), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_chars": F.length(text) / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "upper_share": share(r"\p{Lu}"),
        "digit_share": share(r"[0-9]"),
        "symbol_share": share(r"[#$%&*!|<>{}=_~^]"),
        "stop_share": share(r"[.,;:]"),
        "line_share": share(r"\n") * 100,
    }


@dataclass
class QualityModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, columns: list[Column]) -> Column:
        """The probability, as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for statistic, above, threshold in rule:
                c = columns[statistic]
                holds = holds & ((c > threshold) if above else (c <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for statistic, above, threshold in rule:
        out &= (x[:, statistic] > threshold) == above
    return out


def grow(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule = ()) -> list[tuple[Rule, float]]:
    """The leaves (path, mean gradient) of a regression tree over the given rows."""
    if depth and len(rows) >= 40:
        best = (1e-9, None)
        total, n = gradient[rows].sum(), len(rows)
        for f, thresholds in enumerate(cuts):
            bin_of = np.searchsorted(thresholds, x[rows, f], "left")
            sums = np.cumsum(np.bincount(bin_of, gradient[rows], len(thresholds) + 1))[:-1]
            below = np.cumsum(np.bincount(bin_of, minlength=len(thresholds) + 1))[:-1]
            fits = (below >= 10) & (n - below >= 10)
            if fits.any():
                gain = np.where(fits, sums**2 / np.maximum(below, 1) + (total - sums) ** 2 / np.maximum(n - below, 1), -1) - total**2 / n
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(thresholds[k])))
        if best[1]:
            f, t = best[1]
            up = x[rows, f] > t
            return [
                leaf for above, part in ((False, rows[~up]), (True, rows[up]))
                for leaf in grow(x, gradient, part, cuts, depth - 1, (*path, (f, above, t)))
            ]
    return [(path, float(gradient[rows].mean()))]


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 7) -> list[Rule]:
    """The distinct paths, and beginnings of paths, of boosted trees, each grown on half of the rows."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    raw = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-raw))
        rows = random.choice(len(y), max(len(y) // 2, 1), replace=False)
        for path, value in grow(x, gradient, rows, cuts, depth):
            raw[holds(path, x)] += np.clip(2 * value, -1, 1)
            for i in range(1, len(path) + 1):
                rules[tuple(sorted(path[:i]))] = None
    return list(rules)


def lasso(features: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a logistic regression with a lasso penalty, by accelerated proximal steps."""
    n, d = features.shape
    weights, b = np.zeros(d), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    bound = np.ones(d + 1) / np.sqrt(d + 1)
    for _ in range(20):  # largest eigenvalue of the curvature bound, by power iteration
        v = features @ bound[:d] + bound[d]
        bound = np.r_[features.T @ v, v.sum()] / n
        norm = np.linalg.norm(bound)
        bound /= norm
    step = 1 / (0.25 * norm * 1.1)
    ahead, ahead_b = weights, b
    for t in range(steps):
        error = (1 / (1 + np.exp(-(features @ ahead + ahead_b))) - y) / n
        moved = ahead - step * (features.T @ error)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = ahead_b - step * error.sum()
        speed = t / (t + 3)
        ahead, ahead_b = new + speed * (new - weights), new_b + speed * (new_b - b)
        weights, b = new, new_b
    return b, weights


def fit_quality(sample: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 2e-3) -> QualityModel:
    """A model from a bounded sample (label, text), of whose rows only statistics reach the driver."""
    of = statistics(F.col("text"))
    rows = staged(sample.select("label", F.array(*[c.cast("double") for c in of.values()]).alias("x"))).collect()
    y = np.array([r.label for r in rows], float)
    if len(set(y)) < 2:
        share = (y.sum() + 1.5) / (len(y) + 2)
        return QualityModel(float(np.log(share / (1 - share))), [])
    x = np.array([r.x for r in rows])
    rules = boosted_rules(x, y, trees, depth)
    if not rules:
        share = (y.sum() + 1.5) / (len(y) + 2)
        return QualityModel(float(np.log(share / (1 - share))), [])
    intercept, weights = lasso(np.array([holds(r, x) for r in rules], np.float32).T, y, penalty)
    return QualityModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-3])


def quality_scores(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for each text, in place of a column that has its name."""
    of = statistics(F.col(text_col))
    used = {s for rule, _ in model.rules for s, _, _ in rule}
    named = {f"{PREFIX}{n}": c.cast("double") for i, (n, c) in enumerate(of.items()) if i in used}
    names = [f"{PREFIX}{n}" for n in of]
    return docs.select("*", *[c.alias(n) for n, c in named.items()]).withColumn(
        score_col, model.score([F.col(n) for n in names])
    ).drop(*named)
