"""Hundreds of candidate factors evaluated at once by their second moments.

A panel with a column per factor is dealt by date, so that a date's rows meet in one task once; there each date gives its
information coefficients for all factors together, and the matrices of second moments of all pairs of factors are added
up over the task's dates before they are handed on, in blocks of columns. Correlations of factors, IC and ICIR follow from
the sums; the panel is read once whatever the number of factors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.series import div

#: Pairs that a date needs for an IC; common values that two factors need to be compared.
LEAST_PAIRS, LEAST_COMMON = 3, 20
#: Factors of a block of columns: a task holds six matrices of all pairs, and multiplies by blocks.
COLUMNS = 64

FIELDS = [("date", None), ("a", T.IntegerType()), ("b", T.IntegerType()), ("n", T.LongType()), *[(c, T.DoubleType()) for c in ("mean_a", "mean_b", "ss_a", "ss_b", "ss_ab", "ic", "rank_ic")]]


def correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column of x its correlation with y over the rows that have both, and their number; NaN where a side is constant."""
    there = ~np.isnan(x) & ~np.isnan(y)[:, None]
    n = there.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        dx = np.where(there, x - np.where(there, x, 0.0).sum(axis=0) / n, 0.0)
        full = np.broadcast_to(y[:, None], x.shape)
        dy = np.where(there, full - np.where(there, full, 0.0).sum(axis=0) / n, 0.0)
        sx, sy = (dx * dx).sum(axis=0), (dy * dy).sum(axis=0)
        flat = (sx <= 1e-24 * n * np.nanmax(np.where(there, x * x, 0.0), axis=0, initial=0.0)) | (sy <= 1e-24 * n * np.nanmax(np.where(there, full * full, 0.0), axis=0, initial=0.0))
        return np.where(flat, np.nan, (dx * dy).sum(axis=0) / np.sqrt(sx * sy)), n


def rank_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of average ranks, of the rows that have both."""
    gone = np.isnan(x) | np.isnan(y)[:, None]
    rx = pd.DataFrame(np.where(gone, np.nan, x)).rank().to_numpy()
    if not gone.any():
        return correlations(rx, pd.Series(y).rank().to_numpy())[0]
    ry = pd.DataFrame(np.where(gone, np.nan, np.broadcast_to(y[:, None], x.shape))).rank().to_numpy()
    out = np.full(x.shape[1], np.nan)
    for i in range(x.shape[1]):
        out[i] = correlations(rx[:, i : i + 1], ry[:, i])[0][0]
    return out


class PairSums:
    """Second moments of all pairs of columns over rows that have both, about a first guess of each column's mean."""

    def __init__(self, k: int):
        self.k, self.about = k, None
        self.n, self.sum, self.square, self.product = (np.zeros((k, k)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        if self.about is None:
            there = ~np.isnan(x)
            self.about = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
        m = (~np.isnan(x)).astype(float)
        z = np.where(m > 0, x - self.about, 0.0)
        for i in range(0, self.k, COLUMNS):
            s = slice(i, i + COLUMNS)
            self.n[s] += m[:, s].T @ m
            self.sum[s] += z[:, s].T @ m
            self.square[s] += (z[:, s] ** 2).T @ m
            self.product[s] += z[:, s].T @ z

    def rows(self) -> pd.DataFrame:
        """A row per pair a < b that has common rows: means and centred sums."""
        a, b = np.triu_indices(self.k, 1)
        keep = self.n[a, b] > 0
        a, b = a[keep], b[keep]
        n, sa, sb = self.n[a, b], self.sum[a, b], self.sum[b, a]
        return pd.DataFrame({"a": a, "b": b, "n": n, "mean_a": self.about[a] + sa / n, "mean_b": self.about[b] + sb / n, "ss_a": self.square[a, b] - sa**2 / n, "ss_b": self.square[b, a] - sb**2 / n, "ss_ab": self.product[a, b] - sa * sb / n})


def moments(panel: DataFrame, factors: list[str], target: str, by: str = "date") -> DataFrame:
    """The one pass over a wide ``panel``: rows (by, a, ic, rank_ic, n) per date and factor, and (a, b, moments) per pair
    of factors and task. Persist or store it when both kinds are read.

    Missing and infinite values take no part, pair by pair. Rows without a date are a date of their own.
    """
    columns = [by, *[c for c, _ in FIELDS[1:]]]
    schema = T.StructType([T.StructField(by if t is None else c, panel.schema[by].dataType if t is None else t) for c, t in FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, held = PairSums(len(factors)), []

        def one_date(rows: pd.DataFrame) -> pd.DataFrame:
            x, y = rows[factors].to_numpy(dtype=float), rows[target].to_numpy(dtype=float)
            x, y = np.where(np.isfinite(x), x, np.nan), np.where(np.isfinite(y), y, np.nan)
            pairs.add(x)
            ic, n = correlations(x, y)
            out = pd.DataFrame({"a": range(len(factors)), "b": -1, "n": n, "ic": ic, "rank_ic": rank_correlations(x, y)})
            out.insert(0, by, [rows[by].iloc[0]] * len(out))
            return out.reindex(columns=columns)[out["n"] >= LEAST_PAIRS]

        for batch in batches:
            if batch.empty:
                continue
            number = (~((batch[by] == batch[by].shift()) | (batch[by].isna() & batch[by].shift().isna()))).cumsum()
            groups = [g for _, g in batch.groupby(number, sort=False)]
            same = held and (held[-1][by].iloc[0] == groups[0][by].iloc[0] or pd.isna(held[-1][by].iloc[0]) and pd.isna(groups[0][by].iloc[0]))
            if held and not same:
                yield one_date(pd.concat(held))
                held = []
            for g in groups[:-1]:
                yield one_date(pd.concat([*held, g]))
                held = []
            held.append(groups[-1])
        if held:
            yield one_date(pd.concat(held))
        if pairs.about is not None:
            yield pairs.rows().assign(**{by: None, "n": lambda r: r["n"].astype("int64")}).reindex(columns=columns)

    slim = panel.select(by, *[F.col(c).cast("double").alias(c) for c in factors], F.col(target).cast("double").alias(target))
    return slim.repartition(by).sortWithinPartitions(by).mapInPandas(run, schema)


def named(df: DataFrame, factors: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with the names of the factors whose numbers are in ``columns`` (number -> name of the new column)."""
    names = F.array(*[F.lit(f) for f in factors])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*[names[F.col(c)].alias(new) for c, new in columns.items()], *rest)


def factor_scores(found: DataFrame, factors: list[str]) -> DataFrame:
    """Per factor: dates, ic_mean, ic_std, icir, rank_ic_mean, rank_icir from ``moments``; null for one without dates."""
    ics = found.where("b < 0").select("a", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("ic", "rank_ic")])
    s = ics.groupBy("a").agg(
        F.count("ic").alias("dates"), F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), div(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.avg("rank_ic").alias("rank_ic_mean"), div(F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_icir"))
    every = found.sparkSession.range(len(factors)).select(F.col("id").cast("int").alias("a"))
    return named(every.join(F.broadcast(s), "a", "left"), factors, {"a": "factor"}).withColumn("dates", F.coalesce("dates", F.lit(0).cast("long")))  # a row per factor


def factor_correlations(found: DataFrame, factors: list[str], least: int = LEAST_COMMON) -> DataFrame:
    """(a, b, n, corr) of every pair of factors with ``least`` common values or more; null where one is constant.

    The tasks' centred moments are put together: within tasks as they are, between tasks by their means.
    """
    pair = Window.partitionBy("a", "b")  # a row per task; the sums below have the same partitioning
    parts = found.where("b >= 0").withColumns({"da": F.col("mean_a") - F.avg("mean_a").over(pair), "db": F.col("mean_b") - F.avg("mean_b").over(pair)})
    between = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y)) - F.sum(F.col("n") * F.col(x)) * F.sum(F.col("n") * F.col(y)) / F.sum("n")
    s = parts.groupBy("a", "b").agg(F.sum("n").alias("n"), (F.sum("ss_a") + between("da", "da")).alias("va"), (F.sum("ss_b") + between("db", "db")).alias("vb"), (F.sum("ss_ab") + between("da", "db")).alias("c"),
                                    F.sum(F.col("n") * F.col("mean_a") ** 2).alias("ma"), F.sum(F.col("n") * F.col("mean_b") ** 2).alias("mb"))
    moving = (F.col("va") > 1e-24 * F.col("ma")) & (F.col("vb") > 1e-24 * F.col("mb"))
    pairs = s.where(F.col("n") >= least).select("a", "b", "n", F.when(moving, F.col("c") / F.sqrt(F.col("va") * F.col("vb"))).alias("corr"))
    return named(pairs, factors, {"a": "left", "b": "right"}).withColumnsRenamed({"left": "a", "right": "b"})


def chosen_factors(scores: DataFrame, pairs: DataFrame, least_rank_ic: float = 0.02, least_icir: float = 0.0, most_correlation: float = 0.7, top: int = 20) -> DataFrame:
    """(place, factor, rank_ic_mean): factors of enough rank IC and rank ICIR, from the strongest on, without those that
    correlate by ``most_correlation`` or more with one chosen before; at most ``top``.

    Scores and pairs have a row per factor and per pair of factors; the greedy choice is made on the driver, on the ones
    that pass the first test. Equal strengths go by name.
    """
    strength, icir = F.abs("rank_ic_mean"), F.coalesce(F.abs("rank_icir"), F.lit(0.0))
    able = scores.where(F.col("rank_ic_mean").isNotNull() & (strength >= least_rank_ic) & (icir >= least_icir))
    names = [r[0] for r in able.orderBy(F.desc(strength), "factor").select("factor").collect()]
    near = {frozenset((r.a, r.b)) for r in pairs.where(F.abs("corr") >= most_correlation).select("a", "b").collect()}
    kept: list[str] = []
    for name in names:
        if len(kept) < top and all(frozenset((name, k)) not in near for k in kept):
            kept.append(name)
    place = F.row_number().over(Window.orderBy(F.desc(strength), "factor"))  # at most ``top`` rows
    return scores.where(F.col("factor").isin(kept)).select(place.alias("place"), "factor", "rank_ic_mean")
