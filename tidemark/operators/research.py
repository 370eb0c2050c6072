"""Cross-section research on factors: filters, neutralisation, evaluation and composition.

Inputs are long tables (symbol, date, ...). Every step groups or windows by date or by symbol, never over the whole
table, and a date's cross-section is reduced by aggregates, not gathered.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import corr, cross, cross_rank, div, seq

CONDITION = re.compile(r"^(val|pct):(==|!=|>=|<=|>|<)(.+)$")


def forward_returns(panel: DataFrame, periods: int = 1, name: str = "fwd") -> DataFrame:
    """Return over the next ``periods`` rows; gaps are filled with the last close before the ratio."""
    held = F.last("close", ignorenulls=True).over(seq().rowsBetween(Window.unboundedPreceding, 0))
    filled = panel.withColumn("_held", held)
    return filled.withColumn(name, div(F.lead("_held", periods).over(seq()), F.col("_held")) - 1).drop("_held")


# ---------------------------------------------------------------- filters


def condition(field: str, text: str) -> Column:
    """``val:<op>number`` on the value; ``pct:>=share`` or ``pct:<=share`` on its rank within the date. NULL is false."""
    m = CONDITION.match(text.strip())
    if not m:
        raise ValueError(f"not a filter condition: {text!r}")
    kind, sign, value = m.groups()
    x = F.col(field).cast("double")
    if kind == "pct":
        if sign not in (">=", "<=") or not 0 <= float(value) <= 1:
            raise ValueError(f"pct: takes >= or <= and a share from 0 to 1, not {text!r}")
        x = F.col(f"_rank_{field}")
    v = F.lit(float(value))
    found = {"==": x == v, "!=": x != v, ">=": x >= v, "<=": x <= v, ">": x > v, "<": x < v}[sign]
    return F.coalesce(found, F.lit(False))


def filter_rows(rows: DataFrame, conditions: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows with ``kept``: conditions (field, text, and?) combine from left to right, without precedence."""
    ranked = rows
    for field in dict.fromkeys(f for f, t, _ in conditions if t.startswith("pct:")):
        ranked = ranked.withColumn(f"_rank_{field}", cross_rank(F.col(field)))
    first, *rest = conditions
    kept = reduce(lambda a, c: (a & condition(c[0], c[1])) if c[2] else (a | condition(c[0], c[1])), rest, condition(first[0], first[1]))
    return ranked.withColumn("kept", kept).select(*rows.columns, "kept")


def filter_statistics(filtered: DataFrame) -> DataFrame:
    """One row of what ``filter_rows`` kept and removed."""
    kept = F.col("kept")
    return filtered.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(kept, 1)).alias("retained"), F.count(F.when(~kept, 1)).alias("removed"), F.coalesce(F.avg(kept.cast("double")), F.lit(0.0)).alias("retained_share"))


# ---------------------------------------------------------------- neutralisation


def demean_by(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """``neutral``: the value less the mean of its date and groups."""
    return rows.withColumn("neutral", F.col(value) - F.avg(value).over(Window.partitionBy("date", *groups)))


def quantile_bucket(rows: DataFrame, value: str, n: int, name: str = "bucket") -> DataFrame:
    """``bucket`` from 0 by the date's interpolated quantile edges, right-closed, equal edges dropped."""
    shares = F.array(*[F.lit(k / n) for k in range(n + 1)])
    edges = rows.groupBy("date").agg(F.array_distinct(F.percentile(value, shares)).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bucket = F.when(F.col(value).isNotNull() & (F.size("_edges") > 1), F.size(F.filter(inner, lambda e: e < F.col(value))))
    return rows.join(edges, "date").withColumn(name, bucket).drop("_edges")


def demean_by_decile(rows: DataFrame, value: str, size: str, n: int = 10) -> DataFrame:
    return demean_by(quantile_bucket(rows, size, n), value, "bucket").drop("bucket")


def residual(rows: DataFrame, value: str, industry: str, cap: str, least: int = 10) -> DataFrame:
    """``neutral``: the value's residual on industry and log cap per date.

    The regression on industry dummies and one regressor is solved within groups: both sides less their industry's
    mean, then one slope per date. Dates of fewer than ``least`` complete rows pass the value through.
    """
    ok = F.col(value).isNotNull() & (F.col(cap) > 0) & F.col(industry).isNotNull()
    x, y = F.when(ok, F.ln(F.when(F.col(cap) > 0, F.col(cap)))), F.when(ok, F.col(value))
    by = Window.partitionBy("date", industry)
    r = rows.withColumn("_x", x).withColumn("_y", y)
    r = r.withColumn("_dx", F.col("_x") - F.avg("_x").over(by)).withColumn("_dy", F.col("_y") - F.avg("_y").over(by))
    slope = div(F.sum(F.col("_dx") * F.col("_dy")).over(cross()), F.sum(F.col("_dx") * F.col("_dx")).over(cross()))
    n = F.count("_y").over(cross())
    r = r.withColumn("_n", n).withColumn("_slope", F.coalesce(slope, F.lit(0.0)))
    neutral = F.when(F.col("_n") < least, F.col(value)).otherwise(F.col("_dy") - F.col("_slope") * F.col("_dx"))
    return r.withColumn("neutral", neutral).select(*rows.columns, "neutral")


def residual_general(rows: DataFrame, value: str, regressors: list[str], least: int = 10) -> DataFrame:
    """``neutral``: least-squares residuals on a few numeric regressors and a constant, of each date.

    A date is reduced to its means and second moments by one aggregation, from which elimination gives the coefficients; no
    date is ever gathered. A regressor that is constant, or follows from those before it, has coefficient 0. Dates with
    fewer than ``least`` whole rows, or too few for the regressors, keep their values; other incomplete rows have none.
    """
    k = len(regressors)
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (value, *regressors)])
    r = rows.withColumns({f"_v{i}": F.when(ok, F.col(c).cast("double")) for i, c in enumerate((*regressors, value))})
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    m = r.groupBy("date").agg(F.count("_v0").alias("_n"), *[F.avg(f"_v{i}").alias(f"_m{i}") for i in range(k + 1)], *[F.covar_pop(f"_v{i}", f"_v{j}").alias(f"_s{i}_{j}") for i, j in pairs])
    # elimination of the normal equations, a column per step: a[i][j] with the right side as column k
    name = lambda i, j: f"_s{min(i, j)}_{max(i, j)}" if j < k else f"_s{i}_{k}"
    a = {(i, j): F.col(name(i, j)) for i in range(k) for j in range(k + 1)}
    for p in range(k):
        flat = a[p, p] <= 1e-12 * F.abs(F.col(name(p, p)))
        for i in range(p + 1, k):
            f = F.when(flat, 0.0).otherwise(div(a[i, p], a[p, p]))
            step = {f"_e{p}_{i}_{j}": a[i, j] - f * a[p, j] for j in range(p, k + 1)}
            m = m.withColumns(step)
            a |= {(i, j): F.col(f"_e{p}_{i}_{j}") for j in range(p, k + 1)}
    for p in reversed(range(k)):
        known = sum((a[p, j] * F.col(f"_b{j}") for j in range(p + 1, k)), F.lit(0.0))
        m = m.withColumn(f"_b{p}", F.when(a[p, p] <= 1e-12 * F.abs(F.col(name(p, p))), 0.0).otherwise(F.coalesce(div(a[p, k] - known, a[p, p]), F.lit(0.0))))
    m = m.select("date", "_n", *[f"_m{i}" for i in range(k + 1)], *[f"_b{i}" for i in range(k)])
    fitted = sum((F.col(f"_b{i}") * (F.col(f"_v{i}") - F.col(f"_m{i}")) for i in range(k)), F.col(f"_m{k}"))
    enough = (F.col("_n") >= least) & (F.col("_n") > k + 1)
    return r.join(m, "date").withColumn("neutral", F.when(enough, F.col(f"_v{k}") - fitted).otherwise(F.col(value))).select(*rows.columns, "neutral")


# ---------------------------------------------------------------- evaluation


def paired(rows: DataFrame, value: str, fwd: str = "fwd") -> DataFrame:
    return rows.where(F.col(value).isNotNull() & F.col(fwd).isNotNull())


def daily_ic(rows: DataFrame, value: str, fwd: str = "fwd", method: str = "spearman") -> DataFrame:
    """(date, ic) for dates of three or more pairs; constant cross-sections go."""
    r = paired(rows, value, fwd)
    if method == "spearman":
        r = r.withColumn("_a", cross_rank(F.col(value))).withColumn("_b", cross_rank(F.col(fwd)))
    else:
        r = r.withColumn("_a", F.col(value)).withColumn("_b", F.col(fwd))
    return r.groupBy("date").agg(F.count(F.lit(1)).alias("n"), corr(F.col("_a"), F.col("_b")).alias("ic")).where("n >= 3 and ic is not null and not isnan(ic)").select("date", "ic")


def ic_summary(ic: DataFrame) -> DataFrame:
    return ic.agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))


def quantile_returns(rows: DataFrame, value: str, fwd: str = "fwd", n: int = 5) -> DataFrame:
    """(date, q1..qn, long_short): mean forward return by bucket, 0 for an empty one; dates of n pairs or more."""
    r = quantile_bucket(paired(rows, value, fwd), value, n)
    means = [F.coalesce(F.avg(F.when(F.col("bucket") == q, F.col(fwd))), F.lit(0.0)).alias(f"q{q + 1}") for q in range(n)]
    days = r.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), *means).where(F.col("_n") >= n).drop("_n")
    return days.withColumn("long_short", F.col(f"q{n}") - F.col("q1"))


def turnover(rows: DataFrame, value: str) -> DataFrame:
    """(date, turnover): one less the correlation of a date's ranks with the date before."""
    r = rows.withColumn("_rank", cross_rank(F.col(value))).withColumn("_prev", F.lag("_rank").over(seq())).where("_rank is not null and _prev is not null")
    days = r.groupBy("date").agg(F.count(F.lit(1)).alias("n"), (1 - corr(F.col("_rank"), F.col("_prev"))).alias("turnover"))
    return days.where("n >= 2 and turnover is not null and not isnan(turnover)").select("date", "turnover")


def coverage(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("symbol").agg(F.avg(F.col(value).isNotNull().cast("double")).alias("share")).agg(F.avg("share").alias("coverage"))


def ic_by_year(ic: DataFrame) -> DataFrame:
    return ic.groupBy(F.year("date").alias("year")).agg(F.avg("ic").alias("ic_mean"))


def grown(days: DataFrame, columns: list[str]) -> DataFrame:
    """Daily returns compounded from the first date on, less 1; a row per date."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("date", *[(F.product(1 + F.col(c)).over(w) - 1).alias(c) for c in columns])


def curve_statistics(curve: DataFrame, column: str) -> DataFrame:
    """One row of a compounded curve: its end, yearly mean and Sharpe of its daily steps, and the deepest drawdown."""
    w = Window.orderBy("date")
    peak = F.max(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = curve.withColumn("_step", F.col(column) - F.lag(column).over(w)).withColumn("_down", div(F.col(column) - peak, 1 + peak))
    dev = F.stddev_samp("_step")
    return r.agg(F.max_by(column, "date").alias("long_short_return"), (F.avg("_step") * 252).alias("long_short_annual_return"), F.when(dev > 0, F.avg("_step") / dev * F.sqrt(F.lit(252.0))).alias("long_short_sharpe"), F.min("_down").alias("long_short_max_drawdown"))


def report(rows: DataFrame, value: str, fwd: str = "fwd", n: int = 5) -> DataFrame:
    """One row: span, IC statistics of both kinds, compounded returns of buckets and of long less short, turnover, coverage.

    The panel is read more than once; callers persist it if it is costly.
    """
    span = rows.agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.countDistinct("date").alias("periods"), F.countDistinct("symbol").alias("symbols"))
    s = ic_summary(daily_ic(rows, value, fwd)).select(*[F.col(c).alias(f"rank_{c}") for c in ("n_dates", "ic_mean", "ic_std", "icir", "positive_ratio")])
    p = ic_summary(daily_ic(rows, value, fwd, "pearson")).select("ic_mean", "ic_std", "icir", "positive_ratio")
    buckets = [f"q{k}" for k in range(1, n + 1)]
    curve = grown(quantile_returns(rows, value, fwd, n), [*buckets, "long_short"])
    q = curve.agg(*[F.max_by(b, "date").alias(f"{b}_return") for b in buckets])
    t = turnover(rows, value).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"))
    one = F.lit(True)
    out = span
    for part in (s, p, q, curve_statistics(curve, "long_short"), t, coverage(rows, value)):
        out = out.join(part, one)  # tables of one row
    return out


def greedy_decorrelated(scores: DataFrame, correlations: DataFrame, most: float = 0.7) -> list[str]:
    """Names of factors kept: from the highest score (name, score) on, each that no kept one correlates with by ``most`` or more.

    ``correlations`` (a, b, corr) has a row per pair of factors, a number that a search bounds; both are small.
    """
    near: dict[str, set[str]] = {}
    for a, b in correlations.where(F.abs("corr") >= most).select("a", "b").collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept: list[str] = []
    for (name,) in scores.orderBy(F.desc("score"), "name").select("name").collect():
        if near.get(name, set()).isdisjoint(kept):
            kept.append(name)
    return kept


# ---------------------------------------------------------------- composition


def equal_weight(rows: DataFrame, factors: list[str]) -> DataFrame:
    """(symbol, date, composite): the mean of the factors' ranks where all are present."""
    r = rows
    for f in factors:
        r = r.withColumn(f"_r_{f}", cross_rank(F.col(f)))
    total = reduce(lambda a, b: a + b, [F.col(f"_r_{f}") for f in factors])
    return r.select("symbol", "date", (total / len(factors)).alias("composite")).where("composite is not null")


def icir_series(ic: DataFrame, recall: int, shift: int, least: int | None = None) -> DataFrame:
    """(date, icir): rolling mean over rolling deviation of daily IC, moved by ``shift`` dates so it knows no future."""
    seq = Window.orderBy("date")  # one row per date
    w = seq.rowsBetween(-(recall - 1), 0)
    std = F.stddev_samp("ic").over(w)
    icir = F.when(F.count("ic").over(w) >= (least or max(1, recall // 2)), div(F.avg("ic").over(w), F.when(std == 0, 1e-8).otherwise(std)))
    return ic.withColumn("icir", icir).select("date", F.lag("icir", shift).over(seq).alias("icir") if shift else "icir")


def icir_weighted(rows: DataFrame, factors: list[str], fwd: str = "fwd", recall: int = 10, shift: int = 1) -> DataFrame:
    """(symbol, date, composite): ranks weighted by each factor's lagged ICIR, where all are present."""
    out = None
    for f in factors:
        weights = icir_series(daily_ic(rows, f, fwd), recall, shift)
        part = rows.select("symbol", "date", cross_rank(F.col(f)).alias("_r")).join(F.broadcast(weights), "date").select("symbol", "date", (F.col("_r") * F.col("icir")).alias(f"_w_{f}"))
        out = part if out is None else out.join(part, ["symbol", "date"])
    total = reduce(lambda a, b: a + b, [F.col(f"_w_{f}") for f in factors])
    return out.select("symbol", "date", total.alias("composite")).where("composite is not null")
