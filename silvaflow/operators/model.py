"""Stock models: allometries by land cover, forests, their skill and their application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.student import two_sided
from .stats import skill

#: The allometric model of a land-cover class; others take m8.
MODEL_OF = {111: "m3", 113: "m3", 121: "m3", 123: "m3", 112: "m1", 114: "m1", 122: "m1", 124: "m1"}
OFFSET = 100.0


def model_name(land_cover: Column) -> Column:
    out = F.lit("m8")
    for name in ("m3", "m1"):
        out = F.when(land_cover.isin(*[k for k, m in MODEL_OF.items() if m == name]), name).otherwise(out)
    return out


def allometric(df: DataFrame, land_cover: str, heights: Sequence[str], coefficients: Mapping[str, Sequence[float]], smearing: Mapping[str, float]) -> DataFrame:
    """Density from heights (plus an offset): the linear prediction, at least 0, squared, times the model's smearing ratio."""
    out = df.withColumn("model", model_name(F.col(land_cover)))
    linear, ratio = F.lit(None).cast("double"), F.lit(None).cast("double")
    for name, c in coefficients.items():
        value = F.lit(float(c[0]))
        for h, w in zip(heights, c[1:]):
            value = value + w * (F.col(h) + OFFSET)
        linear, ratio = F.when(F.col("model") == name, value).otherwise(linear), F.when(F.col("model") == name, smearing[name]).otherwise(ratio)
    return out.withColumn("density", ratio * F.greatest(linear, F.lit(0.0)) * F.greatest(linear, F.lit(0.0)))


def allometric_by_table(df: DataFrame, land_cover: str, heights: Sequence[str], table: DataFrame) -> DataFrame:
    """The same with coefficients from a table (model, intercept, one column for each height, smearing, variance): a handful of rows."""
    out = df.withColumn("model", model_name(F.col(land_cover))).join(F.broadcast(table), "model", "left")
    linear_ = F.col("intercept")
    for h in heights:
        linear_ = linear_ + F.col(f"w_{h}") * (F.col(h) + OFFSET)
    linear_ = F.greatest(linear_, F.lit(0.0))
    return out.withColumn("density", F.col("smearing") * linear_ * linear_).drop("intercept", "smearing", *[f"w_{h}" for h in heights])


def smearing_ratio(fit: Column, root: Column) -> Column:
    """mean(fit squared) / mean(root) squared."""
    return F.avg(fit * fit) / (F.avg(root) * F.avg(root))


def resampled(coefficients: Sequence[float], covariance: Sequence[Sequence[float]], n: int, seed: int) -> np.ndarray:
    """n draws of a model's few coefficients."""
    root = np.linalg.cholesky(np.asarray(covariance) + 1e-12 * np.eye(len(coefficients)))
    return np.asarray(coefficients) + np.random.default_rng(seed).standard_normal((n, len(coefficients))) @ root.T


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 500, per_split: int = 6, seed: int = 1, depth: int = 10):
    """A random forest by MLlib, which splits on aggregated bins: rows stay on the executors."""
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, featureSubsetStrategy=str(min(per_split, len(features))), seed=seed, maxDepth=depth).fit(assembled(df, features))


def boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 20, seed: int = 1):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, seed=seed).fit(assembled(df, features))


def linear(df: DataFrame, features: Sequence[str], label: str):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(featuresCol="features", labelCol=label).fit(assembled(df, features))


def searched(df: DataFrame, features: Sequence[str], label: str, depths: Sequence[int] = (3, 6), trees: Sequence[int] = (10, 20), k: int = 3, seed: int = 1):
    """The forest that a grid search with k folds finds best."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(trees)).build()
    return CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=k, seed=seed).fit(assembled(df, features))


def robust_scaled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import RobustScaler

    rows = assembled(df, features)
    return RobustScaler(inputCol="features", outputCol="scaled", lower=0.25, upper=0.75, withCentering=True).fit(rows).transform(rows)


def importances(model, features: Sequence[str], k: int = 4) -> list[tuple[str, float]]:
    """The k most important features."""
    return sorted(zip(features, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))[:k]


def applied(models: Sequence, pixels: DataFrame, features: Sequence[str], mask: Column | None = None) -> DataFrame:
    """The prediction of each model for each pixel; masked pixels are 0.

    Pixels are read once: each model adds a column, and the columns become rows in place.
    """
    keep, rows = pixels.columns, assembled(pixels, features)
    for k, m in enumerate(models):
        rows = m.transform(rows).withColumnRenamed("prediction", f"_p{k}")
    values = F.array(*[F.col(f"_p{k}") if mask is None else F.when(mask, F.col(f"_p{k}")).otherwise(0.0) for k in range(len(models))])
    return rows.select(*keep, F.posexplode(values).alias("iteration", "value"))


def iteration_totals(mapped: DataFrame, by: Sequence[str], factor: float, extents: Mapping[str, Column]) -> DataFrame:
    """The stock of each iteration by group, for several extents side by side."""
    return mapped.groupBy(*by, "iteration").agg(*[F.sum(F.when(where, F.col("value") * factor).otherwise(0.0)).alias(f"{n}_total") for n, where in extents.items()])


def skill_table(observed: str, predicted: str, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*skill(F.col(observed), F.col(predicted)))


def save(model, accuracy: DataFrame, path: str) -> None:
    """The fitted model, and beside it a table of its accuracy."""
    model.write().overwrite().save(f"{path}/model")
    accuracy.write.mode("overwrite").parquet(f"{path}/accuracy")


def load(spark, kind, path: str):
    """(model, accuracy table) as save() wrote them; kind: the model's class."""
    return kind.load(f"{path}/model"), spark.read.parquet(f"{path}/accuracy")


#: Known rows of a leaf and wanted rows of a block in nearest(); tasks a core that it deals the latter to.
LEAF, SEEKERS, WAVES = 128, 64, 4


def halved(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the rows of x, cut at medians of the widest feature into pieces of at most `most` rows."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) <= most:
            out.append(at)
            continue
        by = x[at][:, np.argmax(np.ptp(x[at], axis=0))]
        order = np.argpartition(by, len(at) // 2)
        stack += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


class Known:
    """Rows (features x, label y) in leaves with their boxes, of rows with equal features those of the k smallest labels: no other can be among the k nearest."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int):
        order = np.lexsort((y, *x.T))
        x, y, self.k = x[order], y[order], k
        first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
        place = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate([first, [len(x)]])))
        x, y = x[place < k], y[place < k]
        self.least = np.sort(y)[:k]
        self.leaves = [(x[at], y[at]) for at in halved(x, LEAF)]
        self.low, self.high = (np.array([f(p, axis=0) for p, _ in self.leaves]) for f in (np.min, np.max))

    def predicted(self, z: np.ndarray) -> np.ndarray:
        """The mean label of the k rows nearest to each of z; rows without a distance are all as near."""
        out = np.full(len(z), self.least.mean())
        known = np.flatnonzero(np.isfinite(z).all(axis=1))
        for block in halved(z[known], SEEKERS) if len(known) else ():
            out[known[block]] = self._block(z[known[block]])
        return out

    def _block(self, z: np.ndarray) -> np.ndarray:
        away = np.maximum(0, np.maximum(self.low - z.max(axis=0), z.min(axis=0) - self.high))
        bound = (away**2).sum(axis=1)
        order, at, step = np.argsort(bound), 0, 1
        far, labels = np.empty((len(z), 0)), np.empty((len(z), 0))
        while at < len(order):
            # distances are rounded, so a leaf goes only if it is farther by more than that
            if far.shape[1] == self.k and (bound[order[at]] > far[:, -1] * (1 + 1e-12) + 2e-9).all():
                break
            x, y = (np.concatenate(c) for c in zip(*(self.leaves[i] for i in order[at : at + step])))
            new = ((z[:, None, :] - x[None, :, :]) ** 2).sum(axis=2).round(9)
            far, labels = np.concatenate([far, new], axis=1), np.concatenate([labels, np.broadcast_to(y, new.shape)], axis=1)
            best = np.lexsort((labels, far), axis=1)[:, : self.k]
            far, labels = np.take_along_axis(far, best, 1), np.take_along_axis(labels, best, 1)
            at, step = at + step, min(2 * step, 8)
        return labels.mean(axis=1)


def nearest(train: DataFrame, rows: DataFrame, ident: str, features: Sequence[str], label: str, k: int = 5) -> DataFrame:
    """The mean label of the k training rows nearest in robustly scaled features (ties to nine digits of the squared distance go to the smaller label).

    train: a sample that fits a task, as forests take it; rows stay distributed and meet it as a broadcast tree of
    leaves, of which a block of neighbouring rows reads those that its distances can't rule out.
    """
    some = [F.col(f).cast("double").alias(f) for f in features]
    known = train.select(*some, F.col(label).cast("double").alias(label)).na.drop().toArrow()
    x, y = np.stack([known.column(f).to_numpy() for f in features], axis=1), known.column(label).to_numpy()
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    scale = np.where(high > low, high - low, 1.0)
    session = train.sparkSession.sparkContext
    shared = session.broadcast((Known((x - mid) / scale, y, k), mid, scale))

    def run(batches):
        tree, mid, scale = shared.value
        for batch in batches:
            yield batch[[ident]].assign(prediction=tree.predicted((batch[list(features)].to_numpy(float) - mid) / scale))

    dealt = rows.select(ident, *some).repartition(WAVES * session.defaultParallelism, ident)
    return dealt.mapInPandas(run, f"{ident} {dict(rows.dtypes)[ident]}, prediction double")


def randomly_searched(df: DataFrame, features: Sequence[str], label: str, tries: int = 4, depths: tuple[int, int] = (2, 8), trees: tuple[int, int] = (5, 30), k: int = 3, seed: int = 1):
    """The forest that does best of some random settings, with k folds."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator

    rf, rng = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed), np.random.default_rng(seed)
    grid = [{rf.maxDepth: int(rng.integers(*depths, endpoint=True)), rf.numTrees: int(rng.integers(*trees, endpoint=True))} for _ in range(tries)]
    return CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=k, seed=seed).fit(assembled(df, features))


def neural(df: DataFrame, features: Sequence[str], label: str, hidden: int = 8, rounds: int = 200, rate: float = 0.05, seed: int = 1):
    """A net of one hidden layer, trained by full gradients that tasks add up; returns a function of a table.

    Features and label are scaled by their mean and deviation, found in one pass.
    """
    names = [*features, label]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    m = rows.agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(names) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    mid, scale = (np.array([m[f"{n}{k}"] for k in range(len(names))], float) for n in "ms")
    scale = np.where(scale > 0, scale, 1.0)
    d, rng = len(features), np.random.default_rng(seed)
    w = np.concatenate([rng.normal(0, d**-0.5, d * hidden), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), [0.0]])

    def forward(w, x):
        a, b, c = w[: d * hidden].reshape(d, hidden), w[d * hidden : (d + 1) * hidden], w[(d + 1) * hidden : (d + 2) * hidden]
        h = np.tanh(x @ a + b)
        return h, h @ c + w[-1], c

    def gradient(w):
        def run(batches):
            total, n = np.zeros(len(w)), 0
            for batch in batches:
                z = (batch[names].to_numpy(float) - mid) / scale
                h, out, c = forward(w, z[:, :d])
                e = out - z[:, d]
                back = e[:, None] * c * (1 - h * h)
                total += np.concatenate([(z[:, :d].T @ back).reshape(-1), back.sum(axis=0), h.T @ e, [e.sum()]])
                n += len(e)
            import pandas as pd

            yield pd.DataFrame({"place": np.arange(len(w) + 1), "g": np.append(total, n)})

        got = rows.mapInPandas(run, "place int, g double").groupBy("place").agg(F.sum("g").alias("g")).collect()  # the few weights
        g = np.zeros(len(w) + 1)
        for r in got:
            g[r["place"]] = r["g"]
        return g[:-1] / max(1.0, g[-1])

    rows = rows.persist()
    speed, size = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, rounds + 1):
        g = gradient(w)
        speed, size = 0.9 * speed + 0.1 * g, 0.99 * size + 0.01 * g * g
        w = w - rate * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    rows.unpersist()

    def predict(table: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def value(*columns):
            import pandas as pd

            x = (np.stack([c.to_numpy(float) for c in columns], axis=1) - mid[:d]) / scale[:d]
            return pd.Series(forward(w, x)[1] * scale[d] + mid[d])

        return table.withColumn("prediction", value(*[F.col(f).cast("double") for f in features]))

    return predict


def correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson's r with the label, n, its t statistic and the two-sided p by Student's t, for each feature, in one pass."""

    @F.pandas_udf("double")
    def p(t, n):
        import pandas as pd

        return pd.Series([two_sided(abs(a), b - 2) if a == a and b > 2 else None for a, b in zip(t, n)], dtype="float64")

    both = lambda f: F.count(F.when(F.col(f).isNotNull() & F.col(label).isNotNull(), 1))
    row = df.agg(*[F.struct(F.lit(f).alias("feature"), F.corr(f, label).alias("r"), both(f).alias("n")).alias(f) for f in features])
    out = row.select(F.explode(F.array(*features)).alias("x")).select("x.*")  # a row a feature
    out = out.withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r"))))
    return out.withColumn("p", p("t", "n"))


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson's r of each pair of features, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
