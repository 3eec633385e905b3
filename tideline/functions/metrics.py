"""Forecast errors and losses as aggregate expressions, looked up by name.

They read ``actual`` and ``predicted``; the directional ones also ``d_actual`` and
``d_predicted``, the changes to the row before inside the same window (NULL on its first
row), and the two-pass ones ``mean_actual``, ``mean_predicted`` or ``delta`` of the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.nulls import ratio

A, P, DA, DP = "actual", "predicted", "d_actual", "d_predicted"


def _e() -> Column:
    return F.col(P) - F.col(A)


def mae() -> Column:
    return F.avg(F.abs(_e()))


def mse() -> Column:
    return F.avg(_e() * _e())


def rmse() -> Column:
    return F.sqrt(mse())


def mape() -> Column:
    return F.avg(F.abs(ratio(_e(), F.col(A))))


def mspe() -> Column:
    return F.avg(F.pow(ratio(_e(), F.col(A)), F.lit(2.0)))


def mape_eps(eps: float = 1e-8) -> Column:
    return F.avg(F.abs(_e() / F.when(F.abs(A) < eps, F.lit(eps)).otherwise(F.col(A))))


def rse() -> Column:
    return ratio(F.sqrt(F.sum(_e() * _e())), F.sqrt(F.var_pop(A) * F.count(A)))


def r2() -> Column:
    return 1 - ratio(F.sum(_e() * _e()), F.var_pop(A) * F.count(A))


def corr_ratio() -> Column:
    """Sum of products over the root of the sum of squared products: not Pearson's r."""
    a, b = F.col(A) - F.col("mean_actual"), F.col(P) - F.col("mean_predicted")
    return ratio(F.sum(a * b), F.sqrt(F.sum(a * a * b * b)))


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).when(F.col(DA).isNotNull() & F.col(DP).isNotNull(), 0.0))


def mda() -> Column:
    """Share of steps where both changes point the same way; ties count as wrong."""
    return _share(F.col(DP) * F.col(DA) > 0)


def directional_accuracy() -> Column:
    """Share of steps with equal sign; ties count as right."""
    return _share(F.signum(DP) == F.signum(DA))


def mismatch() -> Column:
    return _share(F.signum(DP) != F.signum(DA))


def sharpe_metric(eps: float = 1e-8) -> Column:
    return F.avg(DP) / (F.stddev_samp(DP) + eps)


def sharpe_loss(eps: float = 1e-8) -> Column:
    return -sharpe_metric(eps)


def madl() -> Column:
    return F.avg(-F.signum(F.col(A) * F.col(P)) * F.abs(A))


def gmadl(a: float = 1.0, b: float = 1.0) -> Column:
    sigmoid = 1 / (1 + F.exp(-(F.lit(a) * F.col(A) * F.col(P))))
    return F.avg(-(sigmoid - 0.5) * F.pow(F.abs(A), F.lit(b)))


def dlf(weight: float = 0.5) -> Column:
    return weight * mismatch() + (1 - weight) * mae()


def asymmetric_loss(under: float = 0.7, over: float = 0.3) -> Column:
    return F.avg(F.when(_e() < 0, under * F.abs(_e())).otherwise(over * _e()))


def quantile_loss(quantiles=(0.1, 0.5, 0.9)) -> Column:
    e = F.col(A) - F.col(P)
    return sum(F.avg(F.greatest(q * e, (q - 1) * e)) for q in quantiles) / len(quantiles)


def trading_loss(cost: float = 0.001, weight: float = 0.5) -> Column:
    return (1 - weight) * mae() + weight * mismatch() + cost * F.avg(F.abs(F.signum(DP)))


def robust_huber() -> Column:
    """Huber loss whose threshold is the 75th percentile of the absolute errors of the group."""
    e = F.abs(_e())
    return F.avg(F.when(e <= F.col("delta"), 0.5 * e * e).otherwise(F.col("delta") * (e - 0.5 * F.col("delta"))))


METRICS: dict[str, Callable[[], Column]] = {
    f.__name__: f
    for f in (mae, mse, rmse, mape, mspe, mape_eps, rse, r2, corr_ratio, mda, directional_accuracy, sharpe_metric, sharpe_loss,
              madl, gmadl, dlf, asymmetric_loss, quantile_loss, trading_loss, robust_huber)
}
DIRECTIONAL = {"mda", "directional_accuracy", "sharpe_metric", "sharpe_loss", "dlf", "trading_loss"}

# The named loss combinations.
COMBINATIONS = {
    "basic": ["mse", "mae"],
    "trading_focused": ["dlf", "trading_loss", "sharpe_loss"],
    "robust_prediction": ["mse", "dlf", "robust_huber"],
    "comprehensive": ["mse", "dlf", "trading_loss", "asymmetric_loss"],
    "directional_focused": ["dlf", "madl", "asymmetric_loss"],
}
