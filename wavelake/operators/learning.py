"""Models: outliers among runs, and flakiness from history features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship, written

SUBSAMPLE = 256
#: The score that cuts off the outliers is off by 1 / RANKS of all rows in rank at most.
RANKS = 100_000
HISTORY = ("runs", "pass_rate", "flake_rate", "transitions", "transition_rate", "longest_streak")


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """(feature, cut, left, right, path) of each node, the root first; a leaf has feature -1 and its expected path length."""
    nodes: list = []

    def grow(rows: np.ndarray, at: int) -> int:
        me = len(nodes)
        nodes.append(None)
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if at >= depth or len(rows) < 2 or not len(wide):
            nodes[me] = (-1, 0.0, 0, 0, at + average_path(len(rows)))
            return me
        j = int(wide[rng.integers(len(wide))])
        cut = float(rng.uniform(low[j], high[j]))
        left = x[rows, j] < cut
        nodes[me] = (j, cut, grow(rows[left], at + 1), grow(rows[~left], at + 1), 0.0)
        return me

    grow(np.arange(len(x)), 0)
    return nodes


def walk(nodes: list[tuple], x: np.ndarray) -> np.ndarray:
    """The path length of each row."""
    feature, cut, left, right, path = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(x), int)
    while (feature[at] >= 0).any():
        inner = feature[at] >= 0
        here = at[inner]
        at[inner] = np.where(x[inner, feature[here]] < cut[here], left[here], right[here])
    return path[at]


def isolation_forest(cells: DataFrame, contamination: float = 0.05, seed: int = 42, trees: int = 200, min_rows: int = 20) -> DataFrame:
    """cells (run_id, feature, value) -> run_id, score, is_anomaly, trained, reason, by an isolation forest on the features that every run has.

    Each tree draws SUBSAMPLE rows at most, by hash; trees are grown in groups of one task each
    and their nodes (a bounded number) are broadcast to score all rows.
    """
    from .kpi import common_features

    spark = cells.sparkSession
    ship(spark)
    names = [r.feature for r in common_features(cells).orderBy("feature").collect()]  # columns, not rows
    own = cells.where(F.col("feature").isin(names)) if names else cells.limit(0)
    wide = own.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "value"))), lambda x: x["value"]).alias("x"))
    n = cells.select("run_id").distinct().count()
    if n < min_rows or not names:
        reason = f"only {n} rows, need {min_rows}" if n < min_rows else "no feature is present across all rows"
        return cells.select("run_id").distinct().select("run_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("is_anomaly"), F.lit(False).alias("trained"), F.lit(reason).alias("reason"))
    size = min(SUBSAMPLE, n)
    keep = int(min(1.0, 4.0 * size / n) * (1 << 40))  # enough candidates for each tree, so that no tree sorts all rows
    # each row is copied for the trees that want it alone
    wants = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("run_id", t.cast("long"), F.lit(seed)), F.lit(1 << 40)) < keep)
    drawn = wide.withColumn("tree", F.explode(wants).alias("tree")).withColumn("tree", F.col("tree").cast("long")).withColumn("h", F.xxhash64("run_id", "tree", F.lit(seed)))
    drawn = drawn.withColumn("r", F.row_number().over(W.partitionBy("tree").orderBy("h"))).where(F.col("r") <= size)
    depth = int(np.ceil(np.log2(max(size, 2))))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("run_id", kind="stable")
        number = int(group["tree"].iloc[0])
        nodes = grow_tree(np.stack(group["x"].to_numpy()), np.random.default_rng([seed, number]), depth)
        return pd.DataFrame([(number, i, *x) for i, x in enumerate(nodes)], columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree long, node int, feature int, cut double, left int, right int, path double").toPandas()
    forest = [list(t.sort_values("node")[["feature", "cut", "left", "right", "path"]].itertuples(index=False, name=None)) for _, t in grown.groupby("tree")]
    shared = spark.sparkContext.broadcast(forest)
    scale = average_path(size) or 1.0

    def score(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                yield pd.DataFrame({"run_id": b["run_id"], "score": 2 ** (-np.mean([walk(t, x) for t in shared.value], 0) / scale)})

    scored = written(wide.mapInPandas(score, f"run_id {dict(cells.dtypes)['run_id']}, score double"), "scores")
    cut = scored.agg(F.percentile_approx("score", 1 - contamination, RANKS).alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).select("run_id", "score", (F.col("score") > F.col("cut")).alias("is_anomaly"), F.lit(True).alias("trained"), F.lit("").alias("reason"))


def flake_classifier(history: DataFrame, truth: DataFrame, seed: int = 42, trees: int = 200, test: float = 0.3, key: str = "nodeid") -> DataFrame | None:
    """key, truth, predicted, in_test, with precision, recall, f1, trusted (five positives in the test part at least) and importances (features with their share, the greatest first) of a random forest on history features; None for fewer than eight rows or one class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from .results import labelled_intersection

    rows = labelled_intersection(history, truth, key).withColumn("label", F.col("truth").cast("double"))
    w = W.partitionBy("label").orderBy(F.xxhash64(key, F.lit(seed)))
    n = F.count("*").over(W.partitionBy("label"))
    rows = rows.withColumns({"in_test": F.row_number().over(w) <= F.round(n * test), "n": n}).crossJoin(F.broadcast(rows.agg(F.count("*").alias("all"))))
    rows = VectorAssembler(inputCols=list(HISTORY), outputCol="features").transform(rows.withColumns({c: F.col(c).cast("double") for c in HISTORY}).withColumn("weight", F.col("all") / (2 * F.col("n")))).persist()
    if rows.count() < 8 or rows.select("label").distinct().count() < 2:
        return None
    model = RandomForestClassifier(numTrees=trees, seed=seed, weightCol="weight", maxDepth=10).fit(rows.where("not in_test"))
    out = model.transform(rows).select(key, "truth", (F.col("prediction") > 0.5).alias("predicted"), "in_test")
    c = F.col
    score = out.where("in_test").agg(F.count_if(c("predicted") & c("truth")).alias("tp"), F.count_if(c("predicted") & ~c("truth")).alias("fp"), F.count_if(~c("predicted") & c("truth")).alias("fn"))
    share = lambda x: F.when(c("tp") + c(x) > 0, c("tp") / (c("tp") + c(x))).otherwise(0.0)
    score = score.select(share("fp").alias("precision"), share("fn").alias("recall"), F.when(2 * c("tp") + c("fp") + c("fn") > 0, 2 * c("tp") / (2 * c("tp") + c("fp") + c("fn"))).otherwise(0.0).alias("f1"), (c("tp") + c("fn") >= 5).alias("trusted"))
    weights = sorted(zip(HISTORY, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])
    told = F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(v).alias("importance")) for k, v in weights))
    return out.crossJoin(F.broadcast(score)).withColumn("importances", told)
