"""Market states: labels of single bars, their transitions, features of regimes, and a screen of symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hmm

# The labels of a bar and the change in percent that each must exceed, first match wins.
STEPS = [("Strong Increase", 2.0), ("Moderate Increase", 1.0), ("Slight Increase", 0.0), ("Stable", -0.5), ("Slight Decrease", -1.0), ("Moderate Decrease", -2.0)]
LOWEST, DEFAULT = "Strong Decrease", "Stable"


def _zeroed(x: Column) -> Column:
    """Null, NaN and infinities become zero."""
    return F.when(F.abs(x) < float("inf"), x).otherwise(0.0)


def _change(w, n: int = 1) -> Column:
    return F.try_divide(F.col("close"), F.lag("close", n).over(w)) - 1


def with_states(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds pct_change and state; a bar without one before it is Stable."""
    w = Window.partitionBy(*keys).orderBy("ts")
    df = df.withColumn("pct_change", _change(w) * 100)
    p = F.col("pct_change")
    chain = reduce(lambda c, s: c.when(p > s[1], s[0]), STEPS[1:], F.when(p > STEPS[0][1], STEPS[0][0]))
    return df.withColumn("state", chain.when(p <= STEPS[-1][1], LOWEST).otherwise(DEFAULT))


def transitions(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows (keys, source, target, count, probability) of the state that follows each state; absent pairs have no row."""
    w = Window.partitionBy(*keys).orderBy("ts")
    pairs = df.select(*keys, F.lag("state").over(w).alias("source"), F.col("state").alias("target")).where("source is not null")
    counts = pairs.groupBy(*keys, "source", "target").agg(F.count("*").alias("count"))
    return counts.withColumn("probability", F.col("count") / F.sum("count").over(Window.partitionBy(*keys, "source")))


def regime_features(df: DataFrame, vol_window: int = 20, trend_window: int = 20, volume_window: int = 20, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ret, vol, range, trend (slope of the close) and volume_z; windows that aren't full give zero."""
    w = Window.partitionBy(*keys).orderBy("ts")
    over = lambda x, y, n: F.when(F.count(y).over(w.rowsBetween(1 - n, 0)) >= n, x.over(w.rowsBetween(1 - n, 0)))
    v, c = F.col("volume"), F.col("close")
    df = df.withColumns({"ret": F.coalesce(_change(w), F.lit(0.0)), "_row": F.row_number().over(w).cast("double")})
    return df.withColumns(
        {
            "vol": _zeroed(over(F.stddev_samp("ret"), F.col("ret"), vol_window)),
            "range": _zeroed(F.try_divide(F.col("high") - F.col("low"), c)),
            "trend": _zeroed(over(F.regr_slope(c, F.col("_row")), c, trend_window)),
            "volume_z": _zeroed(F.try_divide(v - over(F.avg(v), v, volume_window), over(F.stddev_samp(v), v, volume_window))),
        }
    ).drop("_row")


def regime_label(limits: dict | None = None) -> Column:
    """The label with the highest score of a row of features or of their means; the first of equal ones."""
    at = {k: float((limits or {}).get(k, 0.0)) for k in ("trend_up", "trend_down", "vol_high", "vol_low", "liq_stress")}
    trend, vol, spread, z = (F.col(c) for c in ("trend", "vol", "range", "volume_z"))
    quiet = at["vol_low"] - vol
    # The labels in the order in which equal scores are decided, with the terms of each one's score.
    scores = {
        "Trending up": trend - at["trend_up"],
        "Trending down": at["trend_down"] - trend,
        "Mean reverting": quiet,
        "High volatility": vol - at["vol_high"],
        "Low volatility": quiet,
        "Liquidity stress": spread + z - at["liq_stress"],
        "Expansion": vol + spread,
        "Contraction": quiet,
        "Risk-on": trend + vol,
        "Risk-off": vol - trend,
    }
    best = F.array_max(F.array(*(F.struct(F.greatest(x, F.lit(0.0)).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("label")) for k, (name, x) in enumerate(scores.items()))))
    return F.when(best["score"] > 0, best["label"]).otherwise("Mean reverting")


def screen_features(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ret, vol, range, trend (change over 20 bars) and drawdown from the highest close so far."""
    w = Window.partitionBy(*keys).orderBy("ts")
    df = df.withColumn("ret", F.coalesce(_change(w), F.lit(0.0)))
    full = F.row_number().over(w) >= 20
    return df.withColumns(
        {
            "vol": _zeroed(F.when(full, F.stddev_samp("ret").over(w.rowsBetween(-19, 0)))),
            "range": _zeroed(F.try_divide(F.col("high") - F.col("low"), F.col("close"))),
            "trend": _zeroed(_change(w, 20)),
            "drawdown": _zeroed(F.try_divide(F.col("close"), F.max("close").over(w)) - 1),
        }
    )


def screen(df: DataFrame, filters: dict, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row for each symbol: candles, average quote volume of 30 bars, worst drawdown of 60, quote volume of the last 24 hours, and the first filter that it fails (null: none)."""
    w = Window.partitionBy(*keys).orderBy("ts")
    left = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc()))
    # the peak counts from the start of the 60 bars, so earlier closes are blanked first
    df = df.withColumn("_left", left).withColumn("_late", F.when(F.col("_left") <= 60, F.col("close")))
    df = df.withColumn("_dd", F.try_divide(F.col("_late"), F.max("_late").over(w)) - 1)
    day = F.unix_seconds(F.max("ts").over(Window.partitionBy(*keys))) - F.unix_seconds("ts") < 86400
    df = df.withColumn("_today", F.when(day, F.col("close") * F.col("volume")))
    found = df.groupBy(*keys).agg(
        F.count("*").alias("candles"),
        F.coalesce(F.avg(F.when(F.col("_left") <= 30, F.col("close") * F.col("volume"))), F.lit(0.0)).alias("avg_quote_volume_30d"),
        F.coalesce(F.min("_dd"), F.lit(0.0)).alias("max_drawdown_60d"),
        F.coalesce(F.sum("_today"), F.lit(0.0)).alias("quote_volume_24h"),
    )
    least, quote, worst = int(filters.get("min_candles", 0)), float(filters.get("min_avg_quote_volume_30d", 0)), float(filters.get("max_drawdown_60d", -1))
    today = float(filters.get("min_quote_volume_24h", 0))
    reason = F.when(F.col("candles") < least, "candles").when((F.lit(today) > 0) & (F.col("quote_volume_24h") < today), "24h quote volume").when((F.lit(quote) > 0) & (F.col("avg_quote_volume_30d") < quote), "quote volume").when(F.col("max_drawdown_60d") < worst, "drawdown")
    return found.withColumn("reason", reason)


def horizon_quantiles(df: DataFrame, horizons: tuple[int, ...] = (30, 60), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row for each symbol: p25, p50 and p75 of the changes of the close over each number of bars."""
    w = Window.partitionBy(*keys).orderBy("ts")
    moves = df.select(*keys, *(_change(w, h).alias(f"_h{h}") for h in horizons))
    return moves.groupBy(*keys).agg(*(F.percentile(f"_h{h}", q / 100).alias(f"p{q}_{h}") for h in horizons for q in (25, 50, 75)))


def ranked(outlook: DataFrame) -> DataFrame:
    """Adds score, a weighted sum of the median and lower changes over 30 and 60 bars, and rank, the greatest score first; symbols without one come last."""
    score = 100 * F.col("p50_30") + 50 * F.col("p50_60") + 100 * F.col("p25_30")
    # one row a symbol: the order of all is the report
    return outlook.withColumn("score", score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "symbol")))


FEATURES = ["ret", "vol", "range", "trend", "volume_z"]


def train_regimes(bars: DataFrame, states: int = 6, rounds: int = 100, limits: dict | None = None, keys: tuple[str, ...] = ("symbol",), by: tuple[str, ...] | None = None, windows: tuple[int, int, int] = (20, 20, 20)) -> tuple[DataFrame, DataFrame]:
    """(models, labels): a hidden Markov model of the bars' regime features for each key, and for each of its states the mean features of the bars on the likeliest path and their label. Bars without a close are passed over."""
    df = regime_features(bars.where("close is not null"), *windows, keys)
    model = hmm.train(df, FEATURES, states, rounds, keys, by)
    own = [c for c in model.columns if c not in hmm.PARTS]
    seen = hmm.apply(df, model, FEATURES, keys)
    seen = seen.withColumn("_all", F.lit(0)) if own == ["_all"] else seen
    stats = seen.groupBy(*own, "state").agg(*(F.avg(c).alias(c) for c in FEATURES))
    return model, stats.withColumn("label", regime_label(limits))


def apply_regimes(bars: DataFrame, model: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("symbol",), windows: tuple[int, int, int] = (20, 20, 20)) -> DataFrame:
    """The bars with regime_label and regime_conf; a state that no bar was in while training has no label."""
    own = [c for c in model.columns if c not in hmm.PARTS]
    df = hmm.apply(regime_features(bars.where("close is not null"), *windows, keys), model, FEATURES, keys)
    df = df.withColumn("_all", F.lit(0)) if own == ["_all"] else df
    named = df.join(labels.select(*own, "state", F.col("label").alias("regime_label")), [*own, "state"], "left")
    return named.select(*bars.columns, "regime_label", F.col("confidence").alias("regime_conf"))


def save_regimes(path: str, model: DataFrame, labels: DataFrame) -> None:
    """Writes models and labels; those that were there are replaced."""
    model.write.mode("overwrite").parquet(f"{path}/model")
    labels.write.mode("overwrite").parquet(f"{path}/labels")


def load_regimes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/model"), spark.read.parquet(f"{path}/labels")
