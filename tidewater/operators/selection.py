"""Feature selection that never sees its test folds: an inner purged split, a forest, permuted columns in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.evaluation import importance_summary
from tidewater.operators.labels import selection_split
from tidewater.operators.metrics import weighted_auc
from tidewater.operators.series import ordinal
from tidewater.sources.store import materialise

SHARE = 0.2
REPEATS = 5
SPREAD = 1 << 54  # hashes are cut into 1024 ranges


def selection_rows(events: DataFrame, folds: Sequence[int], embargo: int, share: float = SHARE) -> DataFrame:
    """The rows that may choose features for each outer fold: `outer` and `part` (train, validation or purged).

    Of the events of earlier folds that end `embargo` before the outer fold begins, the last share by time validates;
    the rest trains where it ends before the validation begins.
    """
    starts = events.groupBy("fold").agg(F.min("decision_us").alias("_starts")).where(F.col("fold").isin(list(folds)))
    past = events.join(F.broadcast(starts.withColumnRenamed("fold", "outer")), (F.col("fold") < F.col("outer")) & (F.col("exit_us") < F.col("_starts") - embargo))
    return selection_split(past.drop("_starts"), share, ["outer"])


def _vectors(rows: DataFrame, numeric: Sequence[str], label: str, weight: str | None) -> DataFrame:
    made = rows.dropna(subset=[*numeric, label]).withColumn("_x", F.array(*(F.col(c).cast("double") for c in numeric)))
    return made.select("outer", "part", "event_id", "_x", F.col(label).cast("double").alias("_y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_u"))


def permuted(rows: DataFrame, n_features: int, repeats: int, seed: int) -> DataFrame:
    """Rows (outer, feature, repeat, _x, _y, _u): every row of `rows` once as it is (feature -1) and once for each feature and
    repeat with the feature's value from the row that takes its place in a random order.

    Rows are ordered by two hashes, ranked in two passes each, and joined by rank: a true permutation of the outer
    fold's rows, found without one sort of them all. The pairs are written; the copies for each feature are made as they are read.
    """
    each = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def ranked(salt: int) -> DataFrame:
        order = each.withColumn("_h", F.xxhash64("event_id", "repeat", F.lit(seed), F.lit(salt)))
        return ordinal(order, ["outer", "repeat"], ["_h", "event_id"], "_rank", SPREAD)

    donors = ranked(1).select("outer", "repeat", "_rank", F.col("_x").alias("_other"))
    both = materialise(ranked(2).join(donors, ["outer", "repeat", "_rank"]).select("outer", "repeat", "_x", "_other", "_y", "_u"), "permuted")
    changed = both.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))))
    mixed = F.array(*(F.when(F.col("feature") == i, F.col("_other")[i]).otherwise(F.col("_x")[i]) for i in range(n_features)))
    cols = ["outer", "feature", "repeat", "_x", "_y", "_u"]
    plain = rows.withColumns({"feature": F.lit(-1), "repeat": F.lit(0)})
    return changed.withColumn("_x", mixed).select(*cols).unionByName(plain.select(*cols))


def fold_importances(parts: DataFrame, numeric: Sequence[str], label: str, weight: str | None, repeats: int = REPEATS, seed: int = 7, trees: int = 10, depth: int = 4) -> DataFrame:
    """(outer, feature, importance): mean loss of weighted AUC on validation rows when a feature is permuted.

    `parts` has outer and part as from `selection_rows`, and event_id. One forest is fitted for each outer fold on its
    training rows; all permutations of all folds are scored once, summed up per distinct score and judged in one aggregation. Outer folds
    whose training or validation rows lack a class are left out.
    """
    rows = materialise(_vectors(parts.where("part != 'purged'"), numeric, label, weight), "parts")
    seen = rows.groupBy("outer", "part").agg(F.countDistinct("_y").alias("classes"), F.sum(F.when(F.col("_y") == 1, F.col("_u"))).alias("p"), F.sum(F.when(F.col("_y") != 1, F.col("_u"))).alias("q"))
    of = {(r["outer"], r["part"]): r for r in seen.collect()}  # two rows an outer fold
    usable = sorted(k for k, part in of if part == "train" and of[k, part]["classes"] == 2 and (k, "validation") in of and of[k, "validation"]["classes"] == 2)
    table = permuted(rows.where((F.col("part") == "validation") & F.col("outer").isin(usable)), len(numeric), repeats, seed)
    scored, by = None, ["outer", "feature", "repeat"]
    for k in usable:
        ratio = of[k, "train"]["q"] / of[k, "train"]["p"]
        train = rows.where((F.col("part") == "train") & (F.col("outer") == k)).select("event_id", array_to_vector("_x").alias("features"), "_y", (F.col("_u") * F.when(F.col("_y") == 1, ratio).otherwise(1.0)).alias("_w"))
        n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        train = train.repartition(n, "event_id").sortWithinPartitions("event_id").drop("event_id")  # bagging goes by place
        forest = RandomForestClassifier(labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
        judged = forest.transform(table.where(F.col("outer") == k).withColumn("features", array_to_vector("_x")))
        part = judged.select("outer", "feature", "repeat", "_y", "_u", vector_to_array("probability")[1].alias("_s"))
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return parts.sparkSession.createDataFrame([], "outer int, feature string, importance double")
    tied = materialise(scored.groupBy(*by, "_s", "_y").agg(F.sum("_u").alias("_u")), "scores")  # a forest gives few scores
    area = weighted_auc(tied, "_s", "_y", "_u", by).withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    whole = area.where("feature = -1").select("outer", F.col("auc").alias("_whole"))
    name = F.get(F.array(*map(F.lit, numeric)), F.col("feature"))
    lost = area.where("feature >= 0").join(whole, "outer").groupBy("outer", name.alias("feature"))
    return lost.agg(F.avg(F.col("_whole") - F.col("auc")).alias("importance"))


def select_features(events: DataFrame, numeric: Sequence[str], label: str, weight: str | None, folds: Sequence[int], embargo: int = 0, keep: float = 0.5, repeats: int = REPEATS, share: float = SHARE) -> DataFrame:
    """Mean permutation importance over the outer folds, and the top share of features that is kept.

    Each fold's importances come from rows of earlier folds alone, so nothing in a test fold, least of all in the last
    one, takes part. `positive` tells whether the mean importance is above 0.
    """
    found = fold_importances(selection_rows(events, folds, embargo, share), numeric, label, weight, repeats)
    table = found.select(F.concat(F.lit("fold_"), F.col("outer").cast("string")).alias("symbol"), "feature", "importance")
    return importance_summary(table, keep).withColumn("positive", F.col("mean_importance") > 0)


def permutation_importance(events: DataFrame, numeric: Sequence[str], label: str, weight: str | None = None, repeats: int = REPEATS, share: float = SHARE, seed: int = 7) -> DataFrame:
    """(feature, importance) of all rows: a forest of the first rows by time, judged on the last share, purged between."""
    parts = selection_split(events.withColumn("outer", F.lit(0)), share, ["outer"])
    return fold_importances(parts, numeric, label, weight, repeats, seed).drop("outer")
