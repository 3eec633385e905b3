"""Baseline forecasts, ensembles, reconciliation and horizon checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.nulls import ratio
from tideline.functions.rolling import add_ema, series_window

KEYS = ("series_key",)
#: Rows of a stretch of ``walk_forward``, at least.
STRETCH = 4096
BASELINES = ("naive", "seasonal_naive", "mean", "linear_trend", "decomposed_linear")


def _baseline(name: str, x: str, h: Column, lags: Callable[[Column], Column]) -> Column:
    """Value of a baseline at step h from the window figures added by ``_window_figures``."""
    line = lambda at: F.col("__intercept") + F.col("__slope") * at
    future = F.col("__i") + h - 1
    season_value, season_at = lags(h)
    return {
        "naive": F.col("__last"),
        "seasonal_naive": season_value,
        "mean": F.col("__mean"),
        "linear_trend": line(future),
        "decomposed_linear": line(future) + season_value - line(season_at),
    }[name]


def _window_figures(df: DataFrame, column: str, seq_len: int, season: int, w, offset: int) -> DataFrame:
    """Figures of the ``seq_len`` rows that end ``offset`` rows before the current one."""
    f = w.rowsBetween(-(seq_len - 1 + offset), -offset)
    # the regression is taken against positions relative to the row, so that large row
    # numbers do not cancel
    d = df.withColumn("__i", F.row_number().over(w).cast("double"))
    return d.withColumns(
        {
            "__n": F.count(column).over(f),
            "__last": F.lag(column, offset).over(w) if offset else F.col(column),
            "__mean": F.avg(column).over(f),
            "__slope": F.regr_slope(column, "__i").over(f),
            "__intercept": F.regr_intercept(column, "__i").over(f),
            **{f"__lag{k}": (F.lag(column, k + offset - 1).over(w) if k + offset > 1 else F.col(column)) for k in range(1, season + 1)},
        }
    )


def rolling_forecast(df: DataFrame, column: str = "close", seq_len: int = 24, pred_len: int = 3, season: int = 7,
                     models: Sequence[str] = BASELINES, keys: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    """For every row with ``seq_len`` rows before it: forecasts of it and the following rows.

    All models read figures of one window frame and lags, so they share one sort. Long form
    ``(keys, ts, model, horizon, predicted)``.
    """
    w = series_window(keys, order)
    d = _window_figures(df, column, seq_len, season, w, 1).where(f"__n = {seq_len}")
    return _steps(d, column, seq_len, pred_len, season, models, [*keys, *order], 0)


def _steps(d: DataFrame, column: str, seq_len: int, pred_len: int, season: int, models: Sequence[str], lead: Sequence[str], shift: int) -> DataFrame:
    structs = []
    for m in models:
        for h in range(1, pred_len + 1):
            k = season - (h - 1) % season
            lags = lambda _h, k=k: (F.col(f"__lag{k}"), F.col("__i") + shift - k)
            value = _baseline(m, column, F.lit(h + shift), lags)
            structs.append(F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), value.alias("predicted")))
    return d.select(*lead, F.explode(F.array(*structs)).alias("f")).select(*lead, "f.*")


def forecast_latest(df: DataFrame, column: str = "close", seq_len: int = 24, pred_len: int = 3, season: int = 7, step_seconds: int = 86400,
                    models: Sequence[str] = BASELINES, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Forecasts after the last row of each series, at future timestamps.

    Only the last rows of a series enter the windows.
    """
    from tideline.operators.splits import tail_rows

    tail = tail_rows(df.select(*keys, order, column), max(seq_len, season), keys, order)
    w = series_window(keys, [order])
    d = _window_figures(tail, column, seq_len, season, w, 0)
    d = d.withColumn("__next", F.lead(order).over(w)).where("__next IS NULL")
    out = _steps(d.where(f"__n = {seq_len}"), column, seq_len, pred_len, season, models, [*keys, order], 1)
    return out.withColumn(order, F.timestamp_seconds(F.unix_timestamp(order) + F.col("horizon") * step_seconds))


def walk_forward(df: DataFrame, windows: DataFrame, predict: Callable[[pd.DataFrame, pd.DataFrame], Sequence[float]], column: str = "close",
                 keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """User model ``predict(train, validation) -> values`` on every validation window.

    ``df`` carries ``rn``; ``windows`` is a fold table with roles train and val. A task holds a stretch of
    one series and all windows that start in it, however many overlap: stretches are as long as the
    longest window, at least ``STRETCH`` rows, so every row is sent to two of them at most. The rows of a task
    follow the windows' length and not that of the series.
    """
    on = [*keys, "fold"]
    folds = windows.where("hi > lo").groupBy(*on).agg(
        *[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("train", "val") for c in ("lo", "hi")],
        F.min("lo").alias("__lo"), F.max("hi").alias("__hi"),
    ).where("train_lo IS NOT NULL AND val_lo IS NOT NULL")
    size = folds.agg(F.greatest(F.max(F.col("__hi") - F.col("__lo")), F.lit(STRETCH)).cast("bigint").alias("__size"))  # one row
    folds = folds.crossJoin(F.broadcast(size)).withColumn("__stretch", F.floor(F.col("__lo") / F.col("__size"))).drop("__lo", "__hi", "__size")
    own = F.floor(F.col("rn") / F.col("__size"))
    rows = df.select(*keys, order, "rn", F.col(column).cast("double").alias(column)).crossJoin(F.broadcast(size))
    # a window that starts in the stretch before may reach here
    rows = rows.withColumn("__stretch", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), own))).drop("__size")
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("fold", T.IntegerType()), df.schema[order], T.StructField("actual", T.DoubleType()), T.StructField("predicted", T.DoubleType())])

    def run(rows: pd.DataFrame, folds: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn").drop(columns="__stretch").reset_index(drop=True)
        folds, hidden = folds.sort_values("fold"), rows.drop(columns=[column])
        ends = rows["rn"].to_numpy().searchsorted(folds[["train_lo", "train_hi", "val_lo", "val_hi"]].to_numpy().astype("int64"))
        picked, names, values = [], [], []
        # a window costs two slices and the model's call; its rows are put together once for all windows
        for fold, (train_lo, train_hi, lo, hi) in zip(folds["fold"], ends.tolist(), strict=True):
            if train_hi > train_lo and hi > lo:
                predicted = list(predict(rows.iloc[train_lo:train_hi], hidden.iloc[lo:hi]))
                if len(predicted) != hi - lo:
                    raise ValueError(f"the model gave {len(predicted)} values for {hi - lo} rows")
                picked += range(lo, hi)
                names += [fold] * (hi - lo)
                values += predicted
        out = rows.take(picked).assign(fold=names, predicted=values).rename(columns={column: "actual"})
        return out[[c.name for c in schema]]

    by = [*keys, "__stretch"]
    folds = folds.withColumnsRenamed({c: f"__fold_{c}" for c in by})  # the windows may come from the same table
    return rows.groupBy(*by).cogroup(folds.groupBy(*[f"__fold_{c}" for c in by])).applyInPandas(run, schema)


# --- ensembles -----------------------------------------------------------------------------

def inverse_mse_weights(forecasts: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    m = forecasts.groupBy(*by, "model").agg(F.avg(e * e).alias("mse"))
    inv = ratio(F.lit(1.0), F.col("mse"))
    return m.withColumn("weight", inv / F.sum(inv).over(Window.partitionBy(*by)))  # one row per model


def ensemble_apply(forecasts: DataFrame, weights: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Weighted prediction per time; the weights are one row per series and model."""
    d = forecasts.join(weights.select(*by, "model", "weight"), [*by, "model"])
    return d.groupBy(*by, *order).agg(F.max("actual").alias("actual"), F.sum(F.col("weight") * F.col("predicted")).alias("predicted"))


def ensemble_eval(combined: DataFrame, by: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    from tideline.operators.evaluation import evaluate

    return evaluate(combined, ["mse", "mae", "mape", "directional_accuracy"], by, order)


def ensemble_improvement(forecasts: DataFrame, weights: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """MSE of the ensemble and its gain over the best single model, in percent."""
    combined = ensemble_eval(ensemble_apply(forecasts, weights, by), by).select(*by, F.col("mse").alias("ensemble_mse"))
    best = weights.groupBy(*by).agg(F.min("mse").alias("best_mse"))
    return combined.join(best, list(by)).withColumn("improvement", ratio(F.col("best_mse") - F.col("ensemble_mse"), F.col("best_mse")) * 100)


def moment_matrix(forecasts: DataFrame, models: Sequence[str], by: Sequence[str] = KEYS, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Means of all products of errors p_i - y: one pass, then any weights can be judged."""
    wide = forecasts.groupBy(*by, *order).pivot("model", list(models)).agg(F.first(F.col("predicted") - F.col("actual")))
    return wide.groupBy(*by).agg(
        *[F.avg(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models) if i <= j]
    )


def simplex_grid(spark, n_models: int, step: float = 0.1) -> DataFrame:
    """Weights that sum to 1 on a grid; bounded by (1/step + 1)^(n-1) rows."""
    k = round(1 / step)
    d = spark.range(1).select(F.lit(0).alias("w0")).drop("w0")
    for i in range(n_models - 1):
        d = d.withColumn(f"k{i}", F.explode(F.sequence(F.lit(0), F.lit(k))))
    total = sum((F.col(f"k{i}") for i in range(n_models - 1)), F.lit(0))
    d = d.where(total <= k)
    return d.select(*[(F.col(f"k{i}") / k).alias(f"w{i}") for i in range(n_models - 1)], ((k - total) / k).alias(f"w{n_models - 1}"))


def dirichlet_draws(spark, n_models: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Random weights on the simplex (flat), for more models than a grid can cover."""
    d = spark.range(draws)
    d = d.withColumns({f"e{i}": -F.ln(1 - F.rand(seed + i)) for i in range(n_models)})
    total = sum(F.col(f"e{i}") for i in range(n_models))
    return d.select(*[(F.col(f"e{i}") / total).alias(f"w{i}") for i in range(n_models)])


def ensemble_grid(forecasts: DataFrame, models: Sequence[str], by: Sequence[str] = KEYS, step: float = 0.1, draws: int | None = None) -> DataFrame:
    """Best weights on the grid, MSE(w) = w'Aw from the moments.

    The grid has C(1/step + n - 1, n - 1) weight rows. For many models ask for ``draws`` random
    weights from the simplex instead; nothing switches by itself.
    """
    spark = forecasts.sparkSession
    n = len(models)
    grid = simplex_grid(spark, n, step) if draws is None else dirichlet_draws(spark, n, draws)
    d = moment_matrix(forecasts, models, by).crossJoin(F.broadcast(grid))  # weight rows: a number of models and steps, not of data
    mse = sum(
        F.col(f"w{i}") * F.col(f"w{j}") * F.col(f"m_{i}_{j}") * (1 if i == j else 2) for i in range(n) for j in range(i, n)
    )
    d = d.withColumn("mse", F.round(mse, 9))
    best = d.groupBy(*by).agg(F.min(F.struct("mse", *[f"w{i}" for i in range(n)])).alias("b"))
    return best.select(*by, "b.mse", *[F.col(f"b.w{i}").alias(f"weight_{m}") for i, m in enumerate(models)])


def performance_ema(errors: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts",), keep: float = 0.9) -> DataFrame:
    """Running performance: p <- (1 - keep) / (1 + mse) + keep * p, starting from the first value."""
    span = 2 / (1 - keep) - 1  # need not be whole
    return add_ema(errors, {"performance": (1 / (1 + F.col("mse")), span)}, keys, order, adjust=False)


def prediction_interval(samples: DataFrame, by: Sequence[str], z: float = 1.96) -> DataFrame:
    m, s = F.avg("predicted"), F.stddev_samp("predicted")
    return samples.groupBy(*by).agg(m.alias("mean"), (m - z * s).alias("lower"), (m + z * s).alias("upper"), (m - s).alias("lower_1"), (m + s).alias("upper_1"))


def reconcile(levels: dict[str, DataFrame], ratios: dict[tuple[str, str], int], keys: Sequence[str] = KEYS, keep: float = 0.7) -> dict[str, DataFrame]:
    """Bottom-up: a parent step becomes 0.7 of itself and 0.3 of the mean of its child steps.

    ``levels`` runs from the finest to the coarsest; each is (keys, step, predicted) with
    steps from 0. Pairs without a known ratio are left alone, incomplete child groups too.
    """
    out = dict(levels)
    names = list(levels)
    for child, parent in zip(names, names[1:]):
        r = ratios.get((child, parent))
        if r is None:
            continue
        up = out[child].groupBy(*keys, F.floor(F.col("step") / r).alias("step")).agg(F.avg("predicted").alias("__up"), F.count("*").alias("__n"))
        up = up.where(f"__n = {r}").drop("__n")
        p = out[parent].join(up, [*keys, "step"], "left")
        blended = F.when(F.col("__up").isNotNull(), keep * F.col("predicted") + (1 - keep) * F.col("__up")).otherwise(F.col("predicted"))
        out[parent] = p.withColumn("predicted", blended).drop("__up")
    return out


def horizon_consistency(a: DataFrame, b: DataFrame, on: Sequence[str], by: Sequence[str] = KEYS) -> DataFrame:
    """Mean squared difference where two horizons forecast the same step."""
    d = a.select(*on, F.col("predicted").alias("__a")).join(b.select(*on, F.col("predicted").alias("__b")), list(on))
    return d.groupBy(*by).agg(F.avg(F.pow(F.col("__a") - F.col("__b"), F.lit(2.0))).alias("consistency_mse"), F.count("*").alias("n"))
