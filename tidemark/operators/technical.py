"""Technical patterns by window predicates: pivots, candles, trend, breakout; position sizes and Pareto fronts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import seq


def pivots(bars: DataFrame, k: int = 5) -> DataFrame:
    """``pivot_high`` and ``pivot_low``: extrema among k rows on either side; edge rows are none."""
    w = seq().rowsBetween(-k, k)
    inside = F.count(F.lit(1)).over(w) == 2 * k + 1
    return bars.withColumn("pivot_high", F.coalesce(inside & (F.col("high") == F.max("high").over(w)), F.lit(False))).withColumn("pivot_low", F.coalesce(inside & (F.col("low") == F.min("low").over(w)), F.lit(False)))


def candles(bars: DataFrame) -> DataFrame:
    """Candle patterns of each bar, as booleans."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, pc, ph, pl = (F.lag(x).over(seq()) for x in ("open", "close", "high", "low"))
    ppo, ppc = F.lag("open", 2).over(seq()), F.lag("close", 2).over(seq())
    body, span = F.abs(c - o), h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    made = {
        "bullish_engulfing": (pc < po) & (c > o) & (c >= po) & (o <= pc), "bearish_engulfing": (pc > po) & (c < o) & (o >= pc) & (c <= po),
        "doji": (span > 0) & (body <= 0.1 * span), "inside_bar": (h < ph) & (lo > pl), "hammer": (span > 0) & (lower >= 2 * body) & (upper <= body),
        "pin_bar": (span > 0) & (F.greatest(upper, lower) >= 0.66 * span), "morning_star": (ppc < ppo) & (F.abs(pc - po) < F.abs(ppc - ppo) * 0.3) & (c > o) & (c > (ppo + ppc) / 2),
        "evening_star": (ppc > ppo) & (F.abs(pc - po) < F.abs(ppc - ppo) * 0.3) & (c < o) & (c < (ppo + ppc) / 2),
    }
    return bars.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in made.items()})


def trend(bars: DataFrame) -> DataFrame:
    """Latest row per symbol with its moving-average order: up, down or sideways."""
    r = bars
    for n in (5, 10, 20):
        r = r.withColumn(f"ma{n}", F.avg("close").over(seq().rowsBetween(-(n - 1), 0)))
    last = r.groupBy("symbol").agg(F.max_by(F.struct("close", "ma5", "ma10", "ma20"), "date").alias("x")).select("symbol", "x.*")
    return last.withColumn("trend", F.when((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")), "up").when((F.col("ma5") < F.col("ma10")) & (F.col("ma10") < F.col("ma20")), "down").otherwise("sideways"))


def breakouts(bars: DataFrame, n: int = 10) -> DataFrame:
    """Bars that close beyond the n bars before, with volume above their mean; ``fakeout`` if the next closes back."""
    before = seq().rowsBetween(-n, -1)
    r = bars.withColumn("top", F.max("high").over(before)).withColumn("floor", F.min("low").over(before)).withColumn("usual", F.avg("volume").over(before)).withColumn("next_close", F.lead("close").over(seq()))
    up, down = F.col("close") > F.col("top"), F.col("close") < F.col("floor")
    r = r.where((up | down) & (F.col("volume") > F.col("usual"))).withColumn("side", F.when(up, "up").otherwise("down"))
    fake = F.when(F.col("side") == "up", F.col("next_close") < F.col("top")).otherwise(F.col("next_close") > F.col("floor"))
    return r.select("symbol", "date", "close", "side", F.coalesce(fake, F.lit(False)).alias("fakeout"))


def position_size(equity: float, profile: str, entry, stop, multiplier: float = 10.0):
    """Lots so that a stop costs the profile's share of equity, and exposure stays under its cap."""
    risk, cap = {"conservative": (0.01, 0.3), "balanced": (0.02, 0.5), "aggressive": (0.03, 0.7)}[profile]
    by_risk = F.try_divide(F.lit(equity * risk), F.abs(entry - stop) * multiplier)
    by_cap = F.try_divide(F.lit(equity * cap), entry * multiplier)
    return F.greatest(F.lit(0), F.floor(F.least(by_risk, by_cap))).cast("long")


def pareto_front(points: DataFrame, key: str, larger: list[str]) -> DataFrame:
    """Rows that none dominates; of equal rows all stay. A row that lacks a measure compares with none and stays too.

    For two measures a point is on the front if none with a larger first measure has as large a second: one aggregation
    and one running maximum, without pairs. For more measures each row is held against the distinct points, which suits
    a search's population.
    """
    if len(larger) == 2:
        a, b = larger
        lacking = points.where(F.col(a).isNull() | F.col(b).isNull())
        best = points.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.max(b).alias("_own"))
        ahead = Window.orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct first measure
        front = best.withColumn("_ahead", F.max("_own").over(ahead)).where("_ahead IS NULL OR _own > _ahead").select(F.col(a).alias("_a"), F.col("_own").alias("_b"))
        return points.join(front, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b"))).select(points.columns).union(lacking)
    other = points.select(*[F.col(c).alias(f"_{c}") for c in larger]).distinct()
    geq, gt = F.lit(True), F.lit(False)
    for c in larger:
        geq, gt = geq & (F.col(f"_{c}") >= F.col(c)), gt | (F.col(f"_{c}") > F.col(c))
    return points.join(other, geq & gt, "left_anti")


def crowding(front: DataFrame, measures: list[str]) -> DataFrame:
    """``crowding``: over all measures, the sum of gaps between a row's neighbours as shares of the range; ends are infinite."""
    r = front
    for c in measures:
        w = Window.orderBy(c)  # a front is small
        span = F.max(c).over(Window.partitionBy()) - F.min(c).over(Window.partitionBy())
        gap = F.try_divide(F.lead(c).over(w) - F.lag(c).over(w), span)
        r = r.withColumn(f"_{c}", F.when(F.lag(c).over(w).isNull() | F.lead(c).over(w).isNull(), F.lit(float("inf"))).otherwise(F.coalesce(gap, F.lit(0.0))))
    return r.withColumn("crowding", sum((F.col(f"_{c}") for c in measures), F.lit(0.0))).drop(*[f"_{c}" for c in measures])


def pareto_ranks(points: DataFrame, key: str, larger: list[str]) -> DataFrame:
    """``front``: 0 for rows that none dominates, 1 for those only front 0 dominates, and so on.

    For the population of a search, which its driver holds anyway: a round peels one front and starts from its rows anew.
    """
    out, left = None, points.withColumn("front", F.lit(None).cast("int"))
    while not (todo := left.where("front IS NULL")).isEmpty():
        now = pareto_front(todo, key, larger).select(F.col(key).alias("_k"))
        n = 0 if out is None else out + 1
        marked = left.join(now, F.col(key) == F.col("_k"), "left").withColumn("front", F.when(F.col("front").isNull() & F.col("_k").isNotNull(), n).otherwise(F.col("front")))
        left, out = points.sparkSession.createDataFrame(marked.drop("_k").collect(), left.schema), n  # a population is small
    return left
