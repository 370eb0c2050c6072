"""Series functions as Columns over a symbol's rows by date, and cross-section functions over a date's rows.

Missing values are NULL; a division by zero is NULL. Rolling windows count rows, the missing ones too, and need one
value (``min_periods=1``) unless the name ends in ``_full``. A function receives plain columns: the formula compiler
materialises inner windows first, as Spark's windows do not nest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def seq():
    """A symbol's rows by date."""
    return Window.partitionBy("symbol").orderBy("date")


def cross():
    """A date's rows."""
    return Window.partitionBy("date")


def over(n: int):
    return seq().rowsBetween(-(int(n) - 1), 0)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def full(x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(over(n)) >= n, value)


def corr(x: Column, y: Column, w=None) -> Column:
    """Correlation of the pairs present, as an aggregate or over a window; NULL where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sx, sy = parts if w is None else [p.over(w) for p in parts]
    return div(cov, sx * sy)


def skew(x: Column, n: int) -> Column:
    c = F.count(x).over(over(n)).cast("double")
    return F.when(c >= 3, F.sqrt(c * (c - 1)) / (c - 2) * F.skewness(x).over(over(n)))


def kurt(x: Column, n: int) -> Column:
    c = F.count(x).over(over(n)).cast("double")
    return F.when(c >= 4, (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.kurtosis(x).over(over(n)) + 6))


def window_values(x: Column, n: int) -> Column:
    return F.collect_list(x).over(over(n))


def ts_rank(x: Column, n: int) -> Column:
    """(Place of the window's last maximum) / rows of the window; 0 where the newest value is missing."""
    h = window_values(x, n)
    place = F.size(h) - F.array_position(F.reverse(h), F.array_max(h)) + 1
    return F.when(x.isNull(), 0.0).otherwise(place / F.count(F.lit(1)).over(over(n)))


def ts_rank_pct(x: Column, n: int) -> Column:
    h = window_values(x, n)
    less, same = F.size(F.filter(h, lambda y: y < x)), F.size(F.filter(h, lambda y: y == x))
    return F.when(x.isNotNull(), (less + (same + 1) / 2) / F.size(h))


def cci_deviation(x: Column, n: int) -> Column:
    """Mean distance of the window's values from their mean."""
    h = window_values(x, n)
    mean = F.avg(x).over(over(n))
    return F.aggregate(h, F.lit(0.0), lambda a, y: a + F.abs(y - mean)) / nonzero(F.size(h))


def cross_rank(x: Column) -> Column:
    """Average rank as a share of the date's values."""
    by = Window.partitionBy("date").orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy("date", x))
    return F.when(x.isNotNull(), (F.rank().over(by) + (ties - 1) / 2) / F.count(x).over(cross()))


def greatest_strict(*xs: Column) -> Column:
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.greatest(*xs))


def least_strict(*xs: Column) -> Column:
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.least(*xs))


def true_range(h: Column, low: Column, c: Column) -> Column:
    return greatest_strict(h - low, F.abs(h - F.lag(c).over(seq())), F.abs(low - F.lag(c).over(seq())))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    y = x if lo is None else F.greatest(x, F.lit(float(lo)))
    y = y if hi is None else F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def lag(x: Column, n: int) -> Column:
    return F.lag(x, int(n)).over(seq())


def pseudo_return(x: Column, n: int) -> Column:
    """sign(x) (x - x n ago) / |x|: divides by the present value."""
    return div(F.signum(x) * (x - lag(x, n)), F.abs(x))


#: Name -> (function, whether it makes a window). Arguments are Columns, trailing numbers plain.
FUNCTIONS: dict[str, tuple[Callable[..., Column], bool]] = {
    "ts_mean": (lambda x, n: F.avg(x).over(over(n)), True),
    "ts_std": (lambda x, n: F.stddev_samp(x).over(over(n)), True),
    "ts_sum": (lambda x, n: F.sum(x).over(over(n)), True),
    "ts_median": (lambda x, n: F.percentile(x, F.lit(0.5)).over(over(n)), True),
    "ts_max": (lambda x, n: F.max(x).over(over(n)), True),
    "ts_min": (lambda x, n: F.min(x).over(over(n)), True),
    "ts_midpoint": (lambda x, n: (F.max(x).over(over(n)) + F.min(x).over(over(n))) / 2, True),
    "ts_inverse_cv": (lambda x, n: div(F.avg(x).over(over(n)), nonzero(F.stddev_samp(x).over(over(n)))), True),
    "ts_maxmin": (lambda x, n: div(x - F.min(x).over(over(n)), F.max(x).over(over(n)) - F.min(x).over(over(n))), True),
    "ts_pseudo_return": (pseudo_return, True),
    "ts_skew": (skew, True),
    "ts_kurt": (kurt, True),
    "ts_delay": (lag, True),
    "ts_delta": (lambda x, n: x - lag(x, n), True),
    "ts_rank": (ts_rank, True),
    "ts_zscore": (lambda x, n: div(x - F.avg(x).over(over(n)), nonzero(F.stddev_samp(x).over(over(n)))), True),
    "ts_rank_pct": (ts_rank_pct, True),
    "ts_corr": (lambda x, y, n: corr(x, y, over(n)), True),
    "ts_cov": (lambda x, y, n: F.covar_samp(x, y).over(over(n)), True),
    "ts_regression_beta": (lambda x, y, n: div(F.covar_samp(x, y).over(over(n)), nonzero(F.var_samp(F.when(x.isNotNull(), y)).over(over(n)))), True),
    "tr": (true_range, True),
    "rank": (cross_rank, True),
    "zscore": (lambda x: div(x - F.avg(x).over(cross()), nonzero(F.stddev_samp(x).over(cross()))), True),
    "sign": (F.signum, False),
    "abs": (F.abs, False),
    "log": (lambda x: F.when(x > 0, F.ln(x)), False),
    "sqrt": (lambda x: F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0)))), False),
    "exp": (F.exp, False),
    "clip": (clip, False),
    "max_df": (greatest_strict, False),
    "min_df": (least_strict, False),
    # beyond the user's language: for indicators and factor plug-ins
    "signed_power": (lambda x, p: F.signum(x) * F.pow(F.abs(x), F.lit(float(p))), False),
    "signed_log": (lambda x: F.signum(x) * F.log1p(F.abs(x)), False),
    "if_gt": (lambda a, b, x, y: F.when(a > b, x).otherwise(y), False),
    "greatest": (lambda *xs: F.greatest(*xs), False),
    "coalesce": (lambda *xs: F.coalesce(*xs), False),
    "nonzero": (nonzero, False),
    "ts_mean_full": (lambda x, n: full(x, n, F.avg(x).over(over(n))), True),
    "ts_sum_full": (lambda x, n: full(x, n, F.sum(x).over(over(n))), True),
    "ts_std_full": (lambda x, n: full(x, n, F.stddev_samp(x).over(over(n))), True),
    "ts_max_full": (lambda x, n: full(x, n, F.max(x).over(over(n))), True),
    "ts_min_full": (lambda x, n: full(x, n, F.min(x).over(over(n))), True),
    "ts_std_pop": (lambda x, n: F.stddev_pop(x).over(over(n)), True),
    "ts_deviation": (cci_deviation, True),
    "cum_sum": (lambda x: F.sum(x).over(seq().rowsBetween(Window.unboundedPreceding, 0)), True),
}
#: Composite names of the user's language, by formula of their arguments.
MACROS = {
    "ts_mean_return": "ts_mean(ts_pseudo_return({0}, 1), {1})",
    "ts_mad": "ts_mean(abs({0} - ts_mean({0}, {1})), {1})",
    "ts_dema": "2 * ema({0}, {1}) - ema(ema({0}, {1}), {1})",
    "atr": "ts_mean(tr({0}, {1}, {2}), {3})",
}
#: Recursive averages: name -> (alpha of the argument, adjust).
RECURSIVE = {"ema": (lambda n: 2 / (n + 1), False), "ewm": (lambda a: a, False), "ema_adjusted": (lambda n: 2 / (n + 1), True)}
FIELDS = ("open", "high", "low", "close", "volume", "amount")
