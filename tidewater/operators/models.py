"""Walk-forward models and calibration with Spark ML; the fold loop is on the driver, the rows are not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.columns import clip, finite, logit
from tidewater.operators.boosting import Fit, boosted
from tidewater.operators.fits import grouped_logistic, past_maps
from tidewater.operators.metrics import auc, dispersion, losses


def probability(name: str = "probability") -> Column:
    return vector_to_array(name)[1]


def _stages(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Median-imputed numbers with missing-value flags, indexed categories, one vector."""
    index = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categorical]
    fill = Imputer(inputCols=list(numeric), outputCols=[f"_{c}" for c in numeric], strategy="median")
    inputs = [f"_{c}" for c in numeric] + [f"_na_{c}" for c in numeric] + [f"_{c}" for c in categorical]
    return [*index, fill, VectorAssembler(inputCols=inputs, outputCol="features")]


def _flagged(events: DataFrame, numeric: Sequence[str], label: str) -> DataFrame:
    """Numbers as doubles with a flag where they are missing, and the label as `_y`."""
    out = events.withColumns({f"_na_{c}": F.col(c).isNull().cast("double") for c in numeric})
    return out.withColumns({c: F.col(c).cast("double") for c in numeric}).withColumn("_y", F.col(label).cast("double"))


def walk_forward(events: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, weight: str, folds: Sequence[int], embargo: int, name: str = "p_model", trees: int = 10, depth: int = 3, frozen: Mapping[int, Mapping] | None = None) -> DataFrame:
    """Out-of-fold probabilities of boosted trees: fold k is scored by rows of earlier folds that end in time.

    `events` has fold, decision_us and exit_us. A training row must end `embargo` before the fold starts. A fold in
    `frozen` takes its configuration and number of trees from there.
    """
    scored = walk_forwards(events, [(numeric, categorical)], label, weight, folds, embargo, trees, depth, frozen)
    return scored.withColumn(name, F.col("_arms")[0]).select(*events.columns, name)


def walk_forwards(
    events: DataFrame, arms: Sequence[tuple[Sequence[str], Sequence[str]]], label: str, weight: str, folds: Sequence[int], embargo: int, trees: int = 10, depth: int = 3, frozen: Mapping[int, Mapping] | None = None,
) -> DataFrame:
    """`walk_forward` of several arms (numbers and categories) at once: `_arms` has a probability for each. All folds and arms are
    fitted together and scored in one pass."""
    numeric, kinds = list(dict.fromkeys(c for n, _ in arms for c in n)), list(dict.fromkeys(c for _, k in arms for c in k))
    flagged = _flagged(events, numeric, label)
    starts = {r["fold"]: r["s"] for r in flagged.groupBy("fold").agg(F.min("decision_us").alias("s")).collect()}  # one row a fold
    past = F.array_compact(F.array(*(F.when((F.col("fold") < k) & (F.col("exit_us") < starts[k] - embargo), k) for k in folds)))
    train = flagged.withColumns({"_for": F.explode(past), "_u": F.col(weight).cast("double"), "_valid": F.lit(False)})
    fits = []
    for k in folds:
        how = {"trees": trees, "depth": depth}
        if frozen and k in frozen:
            from tidewater.operators.search import fitted_as

            how = fitted_as(frozen[k], frozen[k]["trees"])
        fits += [Fit(k, (*n, *c), **how) for n, c in arms]
    model = boosted(train, numeric, kinds, fits)
    return flagged.where(F.col("fold").isin(list(folds))).withColumn("_arms", model.scores("fold"))


def _balanced(train: DataFrame, weight: str) -> DataFrame:
    """`_w`: the weight, of positives times the ratio of class masses."""
    mass = {r["_y"]: r["w"] for r in train.groupBy("_y").agg(F.sum(weight).alias("w")).collect()}  # two rows
    return train.withColumn("_w", F.col(weight) * F.when(F.col("_y") == 1, mass.get(0.0, 1.0) / mass.get(1.0, 1.0)).otherwise(1.0))


def final_refit(events: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, weight: str, name: str = "p_final", trees: int = 10, depth: int = 3) -> DataFrame:
    """Scores of a model fitted on all rows; `refit` gives the model itself."""
    return refit(events, numeric, categorical, label, weight, trees, depth).transform(_flagged(events, numeric, label)).withColumn(name, probability()).select(*events.columns, name)


def refit(events: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, weight: str, trees: int = 10, depth: int = 3):
    learner = GBTClassifier(labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=depth, seed=7, maxBins=64)
    return Pipeline(stages=[*_stages(numeric, categorical), learner]).fit(_balanced(_flagged(events, numeric, label), weight))


def final_calibrators(events: DataFrame, score: str, label: str, weight: str, folds: Sequence[int] | None = None) -> DataFrame:
    """(weighted, slope, intercept, n, base_rate) of logistic maps fitted on all evaluated rows, with the weights and without."""
    rows = events.where(F.col("fold").isin(list(folds))) if folds else events
    both = rows.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("weighted"), score, label, F.col(weight).alias("_u"))
    both = both.withColumn("_u", F.when(F.col("weighted"), F.col("_u")).otherwise(1.0))
    rates = both.groupBy("weighted").agg((F.sum(F.col(label) * F.col("_u")) / F.sum("_u")).alias("base_rate"))
    return grouped_logistic(both, ["weighted"], score, label, "_u").select("weighted", "slope", "intercept", "n").join(rates, "weighted")


def seed_post_mortem(events: DataFrame, score: str, label: str, weight: str, folds: Sequence[int], at_least: int = 2) -> DataFrame:
    """Per seed and fold: rows, AUC, weighted log loss and spread of the raw scores, and the logistic map that the
    folds before it would have given, or why there is none. Diagnostic only; all maps are fitted together."""
    rows = events.where(F.col("fold").isin(list(folds)))
    by = ["seed", "fold"]
    table = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).join(auc(rows, score, label, by).select(*by, "auc"), by)
    table = table.join(losses(rows, score, label, weight, by).select(*by, "weighted_log_loss"), by).join(dispersion(rows, score, by), by)
    maps = past_maps(rows, score, label, weight, folds, ["seed"], at_least)
    fits = maps.select(*by, "slope", "intercept", F.col("n").alias("trained_on"), "method", "reason")
    out = table.join(fits, by, "left")
    return out.withColumn("reason", F.when(F.col("method").isNull(), "no_past_fold").otherwise(F.col("reason")))


def apply_map(df: DataFrame, score: str, kind: str, params, name: str) -> DataFrame:
    """A fitted map of probabilities: `identity`, `platt` (slope, intercept) or `isotonic` (knots of x and y, flat outside).

    Scores that are missing, not finite or outside [0, 1] give NULL and a mark in `violation`.
    """
    x = finite(F.col(score).cast("double"))
    bad = ~F.coalesce(x.between(0, 1), F.lit(False))
    if kind == "identity":
        value = x
    elif kind == "platt":
        slope, intercept = params
        value = 1 / (1 + F.exp(-(slope * logit(x) + intercept)))
    elif kind == "isotonic":
        value = F.when(x <= params[0][0], params[0][1])
        for (x0, y0), (x1, y1) in zip(params, params[1:]):
            value = value.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
        value = value.otherwise(params[-1][1])
    else:
        raise ValueError(f"no such map: {kind}")
    return df.withColumns({name: F.when(~bad, value), "violation": bad})


def platt(train: DataFrame, score: str, label: str, weight: str) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit on the logit; a slope must be positive to be used."""
    rows = train.select(logit(F.col(score)).alias("_x"), F.col(label).cast("double").alias("_y"), F.col(weight).alias("_w"))
    rows = VectorAssembler(inputCols=["_x"], outputCol="features").transform(rows)
    m = LogisticRegression(labelCol="_y", weightCol="_w", regParam=1e-9, standardization=False, maxIter=100).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(df: DataFrame, score: str, slope: float, intercept: float, name: str) -> DataFrame:
    z = slope * logit(F.col(score)) + intercept
    return df.withColumn(name, 1 / (1 + F.exp(-z)))


def isotonic(train: DataFrame, score: str, label: str, weight: str):
    rows = train.select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"), F.col(weight).alias("w"))
    return IsotonicRegression(weightCol="w").fit(rows)


def walk_forward_calibration(events: DataFrame, score: str, label: str, weight: str, folds: Sequence[int], at_least: int = 300) -> DataFrame:
    """Adds p_platt and p_isotonic: fold k is mapped by fits on earlier folds, the first and thin ones stay raw."""
    out = None
    for k in folds:
        train, test = events.where(F.col("fold") < k), events.where(F.col("fold") == k)
        if train.limit(at_least).count() < at_least:
            part = test.withColumns({"p_platt": F.col(score), "p_isotonic": F.col(score)})
        else:
            slope, intercept = platt(train, score, label, weight)
            part = apply_platt(test, score, slope, intercept, "p_platt") if slope > 0 else test.withColumn("p_platt", F.col(score))
            part = isotonic(train, score, label, weight).setFeaturesCol(score).setPredictionCol("p_isotonic").transform(part)
            part = part.withColumn("p_isotonic", clip(F.col("p_isotonic"), 0, 1))
        part = part.select(*events.columns, "p_platt", "p_isotonic")
        out = part if out is None else out.unionByName(part)
    return out
