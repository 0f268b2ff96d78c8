"""Feature importance: by impurity, by permutation, alone, by cluster; orthogonal features; correlations as long tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folds import assembled, fits, fold_scores, held, predictions, scores
from .ordered import by_span, numbered
from .stored import materialize

KEYS = ("market",)


def by_trees(rows: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(feature, mean, std) of importances (tree, feature, v): 0 counts as missing, deviation over sqrt(n), scaled to sum to 1; by cluster if (feature, cluster_id) is given."""
    rows = rows.select("tree", "feature", F.when(F.col("v") != 0, F.col("v")).alias("v"))
    if clusters is not None:
        rows = rows.join(clusters, "feature").groupBy("tree", F.col("cluster_id").cast("string").alias("feature")).agg(F.sum("v").alias("v"))
    out = rows.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("std"))
    total = F.sum("mean").over(Window.partitionBy())
    return out.select("feature", (F.col("mean") / total).alias("mean"), (F.col("std") / total).alias("std"))


def impurity(model, features: list[str], spark: SparkSession, clusters: DataFrame | None = None) -> DataFrame:
    """(feature, mean, std): a fitted forest's importances over its trees."""
    trees = [(t, f, float(v)) for t, tree in enumerate(model.trees) for f, v in zip(features, tree.featureImportances.toArray(), strict=True)]
    return by_trees(spark.createDataFrame(trees, "tree int, feature string, v double"), clusters)


def permuted(rows: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """``rows`` with each of the columns dealt anew, by itself: rows numbered twice, by their place and by a seeded hash, and joined.

    Numbers come from buckets (of time, of the hash) and the buckets' counts, so no task orders a fold.
    """
    order = ["ts_us", *[k for k in KEYS if k in rows.columns]]
    keyed = numbered(rows, ["fold"], order, by_span(), "_n")
    for j, c in enumerate(columns):
        drawn = keyed.select("fold", F.col(f"`{c}`").alias("_v"), F.xxhash64("_n", F.lit(seed + j)).alias("_h"), F.col("_n").alias("_was"))
        drawn = numbered(drawn, ["fold"], ["_h", "_was"], F.shiftright("_h", 48), "_n").select("fold", "_v", "_n")
        keyed = keyed.drop(c).join(drawn, ["fold", "_n"]).withColumnRenamed("_v", c)
    return keyed.drop("_n")


def _dealt(tests: DataFrame, features: list[str], most: int, seed: int, keys: tuple[str, ...]) -> DataFrame:
    """Test rows (fold, _own, _dealt, label, weight): their features, and for each of ``most`` seeds those of the row that ``permuted`` deals to their place.

    All orders of all folds come from one numbering by (fold, order), of rows that hold numbers only.
    """
    kept = numbered(tests, ["fold"], ["ts_us", *keys], by_span(), "_n")
    kept = materialize(kept.select("fold", "_n", "label", "weight", F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_own")))
    drawn = kept.select("fold", "_n", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_j"))
    drawn = drawn.select("fold", "_j", F.xxhash64("_n", (F.lit(seed) + F.col("_j")).cast("int")).alias("_h"), F.col("_n").alias("_was"))
    drawn = numbered(drawn, ["fold", "_j"], ["_h", "_was"], F.shiftright("_h", 48), "_n")
    drawn = drawn.join(kept.select("fold", F.col("_n").alias("_was"), F.col("_own").alias("_x")), ["fold", "_was"])
    # one entry for each order, and there are as many orders as a group has columns
    dealt = drawn.groupBy("fold", "_n").agg(F.array_sort(F.collect_list(F.struct("_j", "_x"))).alias("_dealt"))
    return kept.join(dealt, ["fold", "_n"]).drop("_n")


def permutation(classifier, rows: DataFrame, roles: DataFrame, features: list[str], metric: str = "neg_log_loss", seed: int = 0, groups: dict[str, list[str]] | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(feature, mean, std): per fold one fit; the loss of score with a feature (or each column of a group) permuted, as a share of what it could lose.

    Every test row is scored as it is and once for each group, all in one table: one job and one aggregation, however many features there are.
    """
    from pyspark.ml.functions import array_to_vector

    groups = groups or {f: [f] for f in features}
    data, numbers = held(rows, roles, keys)
    train = {(k,): assembled(data.where((F.col("fold") == k) & (F.col("role") == "train")), features).select("label", "weight", "features") for k in numbers}
    models = fits(classifier, train)
    tests = _dealt(data.where("role = 'test'"), features, max(map(len, groups.values())), seed, keys)
    x = lambda f, columns: F.col("_dealt")[columns.index(f)]["_x"] if f in columns else F.col("_own")
    forms = [F.struct(F.lit(None).cast("string").alias("name"), F.col("_own").alias("x"))]
    forms += [F.struct(F.lit(g).alias("name"), F.array(*[x(f, columns)[i] for i, f in enumerate(features)]).alias("x")) for g, columns in groups.items()]
    tests = materialize(tests, "fold")
    data.unpersist()
    long = tests.select("fold", "label", "weight", F.explode(F.array(*forms)).alias("form")).where(F.forall("form.x", lambda v: v.isNotNull() & ~F.isnan(v)))
    long = long.select("fold", "label", "weight", "form.name", array_to_vector("form.x").alias("features"))
    scored = scores(predictions(models, {(k,): long.where(F.col("fold") == k) for k in numbers}, ["fold"]), metric, ["fold", "name"])
    base = F.max(F.when(F.col("name").isNull(), F.col("score"))).over(Window.partitionBy("fold"))
    room = (1 - F.col("score")) if metric == "accuracy" else -F.col("score")
    lost = scored.withColumn("base", base).where("name is not null").select(F.col("name").alias("feature"), F.try_divide(F.col("base") - F.col("score"), room).alias("v"))
    return _summary(lost)


def _summary(values: DataFrame) -> DataFrame:
    """(feature, mean, std) of (feature, v): the mean over the folds and its standard error."""
    return values.groupBy("feature").agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("std"))


def alone(classifier, rows: DataFrame, roles: DataFrame, groups: dict[str, list[str]], metric: str = "neg_log_loss", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(feature, mean, std): the score with one feature, or the columns of one cluster, alone."""
    return _summary(fold_scores(classifier, rows, roles, groups, metric, keys).select(F.col("group").alias("feature"), F.col("score").alias("v")))


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """(f1, f2, rho) for f1 before f2, from one aggregation."""
    pairs = list(combinations(features, 2))
    one = rows.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)]))
    return one.select(cells.alias("c")).select("c.*")


def distance(corr: DataFrame, method: str = "default", rounded: bool = True) -> DataFrame:
    """(f1, f2, distance): sqrt((1 - rho) / 2) or, by "abs", sqrt(1 - |rho|)."""
    d = F.sqrt(1 - F.abs("rho")) if method == "abs" else F.sqrt((1 - F.col("rho")) / 2)
    return corr.select("f1", "f2", (F.bround(d, 5) if rounded else d).alias("distance"))


def to_covariance(corr: DataFrame, deviations: DataFrame) -> DataFrame:
    """(f1, f2, cov) from correlations and (feature, std)."""
    a, b = (deviations.select(F.col("feature").alias(f), F.col("std").alias(f"s_{f}")) for f in ("f1", "f2"))
    return corr.join(a, "f1").join(b, "f2").select("f1", "f2", (F.col("rho") * F.col("s_f1") * F.col("s_f2")).alias("cov"))


def to_correlation(cov: DataFrame, deviations: DataFrame) -> DataFrame:
    """(f1, f2, rho) from covariances, clipped to [-1, 1]."""
    a, b = (deviations.select(F.col("feature").alias(f), F.col("std").alias(f"s_{f}")) for f in ("f1", "f2"))
    rho = F.try_divide("cov", F.col("s_f1") * F.col("s_f2"))
    return cov.join(a, "f1").join(b, "f2").select("f1", "f2", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("rho"))


def orthogonal(rows: DataFrame, features: list[str], ids: list[str], share: float = 0.95) -> DataFrame:
    """(ids, pc0, pc1, ...): standardised columns on the leading components that hold ``share`` of the variance, and one more.

    Only the features' means, deviations and cross sums, a table of features x features, reach the driver.
    """
    names = [f"`{f}`" for f in features]
    rows = rows.dropna(subset=features)
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    s = rows.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_samp(n).alias(f"s{i}") for i, n in enumerate(names)], *[F.corr(F.col(names[i]), F.col(names[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    gram = np.ones((len(names), len(names)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = s[f"c{i}_{j}"] if i != j else 1.0
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    kept = min(int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1, len(names))
    z = [(F.col(n) - s[f"m{i}"]) / s[f"s{i}"] for i, n in enumerate(names)]
    signs = [1.0 if v[np.argmax(np.abs(v))] > 0 else -1.0 for v in vectors.T]
    return rows.select(*ids, *[sum((z[i] * float(vectors[i, k] * signs[k]) for i in range(1, len(z))), z[0] * float(vectors[0, k] * signs[k])).alias(f"pc{k}") for k in range(kept)])
