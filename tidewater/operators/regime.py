"""Walk-forward market regimes: sticky Gaussian hidden Markov models over sliding windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.series import SPAN, asof_join, ordinal, rolling

NAMES = ("bear", "neutral", "bull")


def fit_windows(x: np.ndarray, states: int = 3, steps: int = 30, sticky: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (window, row, state) and state means of many windows (window, row, column) at once.

    Expectation-maximisation with diagonal covariances; the passes over rows run for all windows together.
    States start at the terciles of the first column and end up ordered by its mean.
    """
    m, n, d = x.shape
    order = np.argsort(x[:, :, 0], axis=1, kind="stable")
    mean = np.stack([np.take_along_axis(x, part[:, :, None], 1).mean(1) for part in np.array_split(order, states, axis=1)], 1)
    var = np.repeat(x.var(1)[:, None] + 1e-3, states, 1)
    start, move = np.full((m, states), 1 / states), np.full((m, states, states), 0.1 / (states - 1))
    move[:, range(states), range(states)] = 0.9
    for _ in range(steps):
        log = np.stack([-0.5 * ((x - mean[:, k, None]) ** 2 / var[:, k, None] + np.log(2 * np.pi * var[:, k, None])).sum(2) for k in range(states)], 2)
        b = np.exp(log - log.max(2, keepdims=True))
        a, scale = np.empty((m, n, states)), np.empty((m, n))
        for t in range(n):
            row = (start if t == 0 else np.matmul(a[:, t - 1, None], move)[:, 0]) * b[:, t]
            scale[:, t] = np.maximum(row.sum(1), 1e-300)
            a[:, t] = row / scale[:, t, None]
        back = np.ones((m, n, states))
        for t in range(n - 2, -1, -1):
            back[:, t] = np.matmul(move, (b[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None])[:, :, None])[:, :, 0]
        post = a * back
        post /= post.sum(2, keepdims=True)
        ahead = b[:, 1:] * back[:, 1:] / scale[:, 1:, None]
        joint = np.matmul(a[:, :-1].transpose(0, 2, 1), ahead) * move + sticky * np.eye(states) + 1e-3
        start, move = post[:, 0], joint / joint.sum(2, keepdims=True)
        mass = post.sum(1)[:, :, None] + 1e-9
        mean = np.matmul(post.transpose(0, 2, 1), x) / mass
        var = np.stack([(post[:, :, k, None] * (x - mean[:, k, None]) ** 2).sum(1) for k in range(states)], 1) / mass
        var = np.maximum(var, 1e-3)
    by = np.argsort(mean[:, :, 0], axis=1)
    return np.take_along_axis(post, by[:, None], 2), np.take_along_axis(mean, by[:, :, None], 1)


def fit_hmm(x: np.ndarray, states: int = 3, steps: int = 30, sticky: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each row and state means of one window, see `fit_windows`."""
    post, mean = fit_windows(x[None], states, steps, sticky)
    return post[0], mean[0]


def walk_forward_regimes(features: DataFrame, columns: Sequence[str], window: int = 500, step: int = 1, chunk: int = 256, at_once: int = 64) -> DataFrame:
    """(symbol, open_us, bear, neutral, bull, regime, confidence) at every `step`-th bar.

    Each step sees the last `window` bars only. A series is cut into chunks of `chunk` bars, each with the `window` - 1 bars
    before it, so rows are copied about 1 + window / chunk times; the windows of a chunk are winsorised, scaled and
    fitted together, `at_once` of them at a time.
    """
    have = ordinal(features.dropna(subset=list(columns)), ["symbol"], ["open_us"], "_k").select("symbol", "open_us", "_k", *columns)
    spread = have.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_k") / chunk), F.floor((F.col("_k") + window - 1) / chunk))))

    def infer(table: pa.Table) -> pa.Table:
        table = table.sort_by("_k")
        k, own = table.column("_k").to_numpy(), table.column("_chunk")[0].as_py()
        x = np.column_stack([table.column(c).to_numpy() for c in columns]).astype(float)
        ends = [i for i in range(window - 1, len(k)) if k[i] // chunk == own and k[i] % step == step - 1]
        last = []
        for i in range(0, len(ends), at_once):
            w = np.stack([x[e - window + 1 : e + 1] for e in ends[i : i + at_once]])
            lo, hi = np.quantile(w, [0.01, 0.99], axis=1, keepdims=True)
            w = np.clip(w, lo, hi)
            q1, q2, q3 = np.quantile(w, [0.25, 0.5, 0.75], axis=1, keepdims=True)
            spread_, deviation = q3 - q1, w.std(1, keepdims=True)
            scale = np.where(spread_ > 1e-12, spread_, np.where(deviation > 1e-12, deviation, 1))
            last.append(fit_windows(np.clip((w - q2) / scale, -8, 8))[0][:, -1])
        p = np.concatenate(last) if last else np.zeros((0, 3))
        best = p.argmax(1)
        arrays = [
            pa.array([table.column("symbol")[0].as_py()] * len(ends), pa.string()), pa.array(table.column("open_us").to_numpy()[ends], pa.int64()),
            *(pa.array(p[:, j]) for j in range(3)), pa.array([NAMES[j] for j in best], pa.string()), pa.array(p.max(1) if len(ends) else np.zeros(0)),
        ]
        return pa.table(arrays, names=["symbol", "open_us", *NAMES, "regime", "confidence"])

    schema = "symbol string, open_us long, bear double, neutral double, bull double, regime string, confidence double"
    return spread.groupBy("symbol", "_chunk").applyInArrow(infer, schema)


def policy(regimes: DataFrame, regime: str = "regime", confidence: str = "confidence", changed: str | None = None, age: str | None = None) -> DataFrame:
    """Adds margin, entropy and policy: allow in a bull, block in a bear, else caution; caution too under a confidence of
    0.50 and, where given, within two bars of a change."""
    p = F.sort_array(F.array(*NAMES), asc=False)
    entropy = -sum(F.when(F.col(n) > 0, F.col(n) * F.ln(n)).otherwise(0.0) for n in NAMES)
    r = F.col(regime)
    verdict = F.when(F.col(confidence) < 0.5, "caution").when(r == "bull", "allow").when(r == "bear", "block").otherwise("caution")
    if changed and age:
        verdict = F.when(F.col(changed) & (F.col(age) < 2), "caution").otherwise(verdict)
    return regimes.withColumns({"margin": p[0] - p[1], "entropy": entropy, "policy": verdict})


def regime_summary(regimes: DataFrame) -> DataFrame:
    """Share and mean confidence of each regime per symbol."""
    total = regimes.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    each = regimes.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
    return each.join(total, "symbol").withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def confirm_switches(df: DataFrame, key: str, ts: str, state: str, confirm: int = 2, span: int = SPAN) -> DataFrame:
    """Add accepted, previous, changed and age_bars: a new state counts once it came `confirm` times in a row.

    The first row of a key is accepted at once. The accepted state is thus that of the last row
    whose state equals those of the `confirm` - 1 rows before it, an as-of lookup; so is the age.
    Times must be distinct within a key; `state` must not be NULL.
    """

    def settled(w) -> dict:
        same = F.lit(True)
        for i in range(1, confirm):
            same &= F.coalesce(F.lag(state, i).over(w) == F.col(state), F.lit(False))
        return {"_settled": same | (F.col("pos") == 0)}

    marked = rolling(df, [key], [ts], confirm, settled, span=span)
    anchors = marked.where("_settled").select(key, F.col(ts).alias("at"), F.col(state).alias("state"))
    held = asof_join(marked.drop("_settled", "pos"), anchors, [key], ts, "at", prefix="_held_", span=span)
    held = held.withColumnRenamed("_held_state", "accepted").drop("_held_at")
    held = rolling(held, [key], [ts], 1, lambda w: {"previous": F.lag("accepted").over(w)}, span=span)
    held = held.withColumn("changed", F.coalesce(F.col("previous") != F.col("accepted"), F.lit(False)))
    starts = held.where("changed or previous is null").select(key, F.col(ts).alias("at"), F.col("pos").alias("start"))
    aged = asof_join(held, starts, [key], ts, "at", prefix="_since_", span=span)
    return aged.withColumn("age_bars", F.col("pos") - F.col("_since_start") + 1).drop("pos", "_since_at", "_since_start")


def anchored(regimes: DataFrame, confirm: int = 2) -> DataFrame:
    """Regimes with confirmed switches, the margin of the proposed over the previously accepted one, and the policy
    of the accepted one by its own probability and age."""
    chance = lambda c: F.coalesce(*(F.when(F.col(c) == n, F.col(n)) for n in NAMES), F.lit(0.0))
    out = confirm_switches(regimes, "symbol", "open_us", "regime", confirm)
    out = out.withColumns({"switch_margin": chance("regime") - chance("previous"), "accepted_confidence": chance("accepted")})
    return policy(out, "accepted", "accepted_confidence", "changed", "age_bars")


def regime_probabilities(states: DataFrame) -> DataFrame:
    """(symbol, open_us, bear, neutral, bull) from state posteriors (symbol, open_us, state_regime, p).

    Probabilities of states of one regime add up and are divided by their sum; without any
    probability mass the row is neutral for certain.
    """
    out = states.groupBy("symbol", "open_us").pivot("state_regime", list(NAMES)).agg(F.sum("p")).fillna(0.0, list(NAMES))
    total = sum(F.col(n) for n in NAMES)
    share = {n: F.when(total > 1e-12, F.col(n) / F.when(total > 1e-12, total)).otherwise(1.0 if n == "neutral" else 0.0) for n in NAMES}
    return out.select("symbol", "open_us", *(v.alias(n) for n, v in share.items()))


def state_statistics(rows: DataFrame, states: int = 3) -> DataFrame:
    """Per symbol, window and state: occupancy, mean trend and return, size of mean volatility and range, persistence, regime.

    `rows` has symbol, window, pos, post (array of state probabilities), trend, ret, vol, range. A row is in its likeliest
    state, the first on ties; states without rows have zeros. By trend + ret / 2 the lowest state is a bear, the highest a
    bull, others are neutral. Where all of three or more are within 1e-8, the state of most volatility and range is
    the bear and the one most often occupied of the rest the bull. A single state is neutral.
    """
    w = Window.partitionBy("symbol", "window").orderBy("pos")  # a window has a bounded number of bars
    hard = rows.withColumn("_state", (F.array_position("post", F.array_max("post")) - 1).cast("int"))
    each = hard.withColumns({"_next": F.lead("_state").over(w), "_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol", "window"))})
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    seen = each.groupBy("symbol", "window", F.col("_state").alias("state")).agg(
        (count() / F.first("_rows")).alias("occupancy"), mean("trend").alias("mean_trend"), mean("ret").alias("mean_ret"), F.abs(mean("vol")).alias("mean_vol"), F.abs(mean("range")).alias("mean_range"),
        F.coalesce(F.avg(F.when(F.col("_next").isNotNull(), (F.col("_next") == F.col("_state")).cast("double"))), F.lit(0.0)).alias("persistence"),
    )
    every = rows.select("symbol", "window").distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    names = ["occupancy", "mean_trend", "mean_ret", "mean_vol", "mean_range", "persistence"]
    out = every.join(seen, ["symbol", "window", "state"], "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names})  # NaN stays
    group = Window.partitionBy("symbol", "window")  # `states` rows
    score = F.col("mean_trend") + 0.5 * F.col("mean_ret")
    place = lambda *by: F.row_number().over(group.orderBy(*by))
    out = out.withColumn("score", score).withColumns(
        {"_low": place("score", "state"), "_high": place(F.desc("score"), F.desc("state")), "_risk": place(F.desc(F.col("mean_vol") + F.col("mean_range")), "state"), "_spread": F.max("score").over(group) - F.min("score").over(group)}
    )
    out = out.withColumn("_rest", place(F.col("_risk") == 1, F.desc("occupancy"), "state"))
    plain = F.when(F.col("_low") == 1, "bear").when(F.col("_high") == 1, "bull").otherwise("neutral")
    level = F.when(F.col("_risk") == 1, "bear").when(F.col("_rest") == 1, "bull").otherwise("neutral")
    regime = F.lit("neutral") if states == 1 else plain if states == 2 else F.when(F.col("_spread") <= 1e-8, level).otherwise(plain)
    return out.withColumn("regime", regime).drop("_low", "_high", "_risk", "_rest", "_spread")


def count():
    return F.count(F.lit(1))


def follow_states(centers: np.ndarray, before: np.ndarray | None) -> tuple[list[int] | None, float]:
    """For each state the nearest state of the window before, paired greedily by distance, and the largest distance."""
    if before is None or before.shape != centers.shape:
        return None, float("inf")
    gap = np.sqrt(((centers[:, None] - before[None]) ** 2).sum(2))
    pair: dict[int, int] = {}
    for at in np.argsort(gap, axis=None, kind="stable"):
        state, old = divmod(int(at), len(before))
        if state not in pair and old not in pair.values():
            pair[state] = old
    return [pair[k] for k in range(len(centers))], max(float(gap[k, pair[k]]) for k in pair)


def match_states(windows: DataFrame, limit: float = 2.0, rebase: float = 0.5) -> DataFrame:
    """(symbol, window, state, regime, method, distance): regimes of states, carried from window to window.

    `windows` has symbol, window, centers (array of state centres), scores and regimes (by score) of each state. A window's
    states take the regimes of the nearest states of the window before, if all of them pair within `limit` and, where
    that differs from the order of scores, the scores spread by `rebase` at most; else the regimes by score stand. The next
    window is compared with this one's centres and regimes. Windows of a symbol pass through one task in order, which
    keeps one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, held = None, None, []
        for batch in batches:
            rows = []
            for symbol, window, centers, scores, regimes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.nan_to_num(np.asarray(centers, float), nan=0.0, posinf=0.0, neginf=0.0)
                if symbol != now:
                    now, before, held = symbol, None, []
                pairs, distance = follow_states(x, before)
                method, mapping = "score_order", list(regimes)
                if pairs is not None and distance <= limit:
                    carried = [held[old] for old in pairs]
                    if carried == mapping or max(scores) - min(scores) <= rebase:
                        method, mapping = "matched", carried
                before, held = x, mapping
                rows += [(symbol, window, k, r, method, distance if np.isfinite(distance) else None) for k, r in enumerate(mapping)]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["symbol", "window", "state", "regime", "method", "distance"])

    rows = windows.select("symbol", F.col("window").cast("long").alias("window"), "centers", "scores", "regimes").repartition("symbol").sortWithinPartitions("symbol", "window")
    return rows.mapInArrow(run, "symbol string, window long, state int, regime string, method string, distance double")


def regime_report(rows: DataFrame) -> DataFrame:
    """Per symbol: share of ok rows, switches between following ok rows, and by regime share, mean forward return and hit rate.

    `rows` has symbol, pos, ok, regime, fwd and previous (regime of the row before, where that was ok).
    A hit is a rise after a bull and a fall after a bear.
    """
    ok = F.col("ok")
    hit = F.when(F.col("regime") == "bull", F.col("fwd") > 0).when(F.col("regime") == "bear", F.col("fwd") < 0)
    of = {n: ok & (F.col("regime") == n) for n in NAMES}
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(ok.cast("int")).alias("ok_rate"), F.count_if(ok & F.col("previous").isNotNull() & (F.col("previous") != F.col("regime"))).alias("switches"),
        *((F.count_if(t) / F.count_if(ok)).alias(f"{n}_share") for n, t in of.items()), *(F.avg(F.when(t, F.col("fwd"))).alias(f"{n}_fwd") for n, t in of.items()),
        *(F.avg(F.when(of[n], hit.cast("int"))).alias(f"{n}_hits") for n in ("bear", "bull")),
    ).withColumn("spread", F.col("bull_fwd") - F.col("bear_fwd"))
