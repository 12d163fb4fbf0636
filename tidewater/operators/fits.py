"""Many small weighted fits at once: logistic maps of one score, one for each key, by Newton steps that are sums.

Every step is one aggregation over all rows of all keys, so the maps of a whole walk-forward and of all seeds cost
as many jobs as one map. Only the parameters, a row a key, are on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import logit
from tidewater.sources.store import materialise

RIDGE = 1e-6  # penalty of half a squared slope
AT_LEAST = 300


def grouped_logistic(rows: DataFrame, keys: Sequence[str], score: str, label: str, weight: str, steps: int = 60, at_least: int = 2) -> DataFrame:
    """(keys, slope, intercept, n, steps, method, reason): label ~ 1 / (1 + exp(-(slope * logit(score) + intercept))) for each key.

    Rows without score, label or weight take no part. A key has method `platt`, or `identity` and a reason where it has
    fewer than `at_least` rows, one class, no weight, or a slope that is not positive. A step that makes the loss
    worse is halved until it does not.
    """
    spark, keys = rows.sparkSession, list(keys)
    kept = rows.select(*keys, logit(F.col(score)).alias("_x"), F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w")).dropna(subset=["_x", "_y", "_w"])
    tied = materialise(kept.groupBy(*keys, "_x", "_y").agg(F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_n")), "logits")
    types = {f.name: f.dataType.simpleString() for f in tied.schema.fields}
    sums = tied.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("p"), F.min("_y").alias("lo"), F.max("_y").alias("hi")).collect()
    out, now = [], {}
    for r in sums:  # one row a key
        key = tuple(r[k] for k in keys)
        reason = "too_few" if r["n"] < at_least else "one_class" if r["lo"] == r["hi"] else "no_weight" if not r["w"] > 0 or not 0 < r["p"] < r["w"] else None
        if reason:
            out.append((*key, None, None, r["n"], 0, "identity", reason))
        else:
            now[key] = {"n": r["n"], "w": r["w"], "at": (0.0, math.log(r["p"] / (r["w"] - r["p"]))), "from": None, "loss": math.inf, "steps": 0}
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    done = {}
    for _ in range(steps):
        if not now:
            break
        params = spark.createDataFrame([(*key, *s["at"]) for key, s in now.items()], f"{schema}, _a double, _b double")
        z = F.col("_a") * F.col("_x") + F.col("_b")
        q = 1 / (1 + F.exp(-z))
        miss, curve = F.col("_w") * (q - F.col("_y")), F.col("_w") * q * (1 - q)
        loss = F.col("_w") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("_y") * z)
        x = F.col("_x")
        sums = {"ga": miss * x, "gb": miss, "haa": curve * x * x, "hab": curve * x, "hbb": curve, "loss": loss}
        joined = tied.join(params, keys)
        for r in joined.groupBy(*keys).agg(*(F.sum(v).alias(n) for n, v in sums.items())).collect():
            key = tuple(r[k] for k in keys)
            s = now[key]
            a, b = s["at"]
            total = r["loss"] + RIDGE * a * a / 2
            s["steps"] += 1
            if s["from"] and total > s["loss"] + 1e-12 * abs(s["loss"]) and s["steps"] < steps:
                s["at"] = tuple((u + v) / 2 for u, v in zip(s["at"], s["from"], strict=True))
                continue
            ga, haa = r["ga"] + RIDGE * a, r["haa"] + RIDGE
            if max(abs(ga), abs(r["gb"])) <= 1e-10 * s["w"]:
                done[key] = now.pop(key)
                continue
            det = haa * r["hbb"] - r["hab"] ** 2
            if not det > 0:
                done[key] = now.pop(key)
                continue
            s["from"], s["loss"] = (a, b), total
            s["at"] = (a - (r["hbb"] * ga - r["hab"] * r["gb"]) / det, b - (haa * r["gb"] - r["hab"] * ga) / det)
    for key, s in {**done, **now}.items():
        a, b = s["at"]
        good = math.isfinite(a) and math.isfinite(b) and a > 0
        out.append((*key, a, b, s["n"], s["steps"], "platt" if good else "identity", None if good else "slope_not_positive"))
    return spark.createDataFrame(out, f"{schema}, slope double, intercept double, n long, steps int, method string, reason string")


def past_maps(events: DataFrame, score: str, label: str, weight: str, folds: Sequence[int], keys: Sequence[str] = (), at_least: int = AT_LEAST) -> DataFrame:
    """A map for every fold after the first, fitted on the rows of the `folds` before it, for each of `keys`; see `grouped_logistic`."""
    pairs = events.sparkSession.createDataFrame([(k, j) for k in folds for j in folds if j < k], "_for int, fold int")
    history = events.join(pairs, "fold").drop("fold").withColumnRenamed("_for", "fold")
    return grouped_logistic(history, [*keys, "fold"], score, label, weight, at_least=at_least)


def usable(maps: DataFrame) -> DataFrame:
    """Slopes and intercepts of the maps that may be applied."""
    return maps.where("method = 'platt'").drop("n", "steps", "method", "reason")
