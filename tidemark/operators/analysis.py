"""The latest state of each symbol: trend, divergence, patterns, structure, levels, regime and a composite score.

All are windows over a symbol's bars and aggregates of their last rows; nothing is gathered beyond a fixed number of bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.library import INDICATORS, TR_SKIP
from tidemark.functions.series import div, seq
from tidemark.plans.formula import with_formulas


def last_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """(symbol, columns, bars): each symbol's latest row and its number of rows."""
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*columns), "date").alias("x"), F.count(F.lit(1)).alias("bars")).select("symbol", "x.*", "bars")


def from_end() -> Column:
    """1 for a symbol's latest row, 2 for the one before it, and so on."""
    return F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))


def extremum(name: str, k: int, high: bool) -> Column:
    """Whether a row has the largest (or least) value of the k rows on either side; rows nearer to an end have not."""
    w = seq().rowsBetween(-k, k)
    best = F.max(name).over(w) if high else F.min(name).over(w)
    return F.coalesce((F.count(F.lit(1)).over(w) == 2 * k + 1) & (F.col(name) == best), F.lit(False))


def last_extrema(rows: DataFrame, points: dict[str, tuple[str, int, bool]], n: int) -> DataFrame:
    """(symbol, <point>1 .. <point>n): the latest n values of each named (column, k, high) extremum, 1 the latest."""
    flagged = rows.select("symbol", "date", *[F.struct(F.lit(p).alias("point"), extremum(c, k, high).alias("is"), F.col(c).cast("double").alias("value")).alias(p) for p, (c, k, high) in points.items()])
    found = flagged.select("symbol", "date", F.inline(F.filter(F.array(*points), lambda x: x["is"])))
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "point").orderBy(F.desc("date")))).where(F.col("_n") <= n)
    return ranked.groupBy("symbol").agg(*[F.max(F.when((F.col("point") == p) & (F.col("_n") == i), F.col("value"))).alias(f"{p}{i}") for p in points for i in range(1, n + 1)])


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---------------------------------------------------------------- divergence, patterns, trend

DIVERGENT = ("macd_bar", "rsi24", "kdj_j")


def divergence(rows: DataFrame, indicators: tuple[str, ...] = DIVERGENT) -> DataFrame:
    """(symbol, divergence, <indicator>_top, <indicator>_bottom): the close's last two extrema against the indicator's own.

    A top: the close's highs rise and the indicator's fall; a bottom: lows fall and the indicator's rise. Tops come first;
    fewer than 20 bars are ``short``.
    """
    points = {f"{c}_{side}": (c, 5, side == "high") for c in ("close", *indicators) for side in ("high", "low")}
    p = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")).join(last_extrema(rows, points, 2), "symbol", "left")
    enough, made = F.col("bars") >= 20, {}
    for i in indicators:
        made[f"{i}_top"] = _true(enough & (F.col("close_high1") > F.col("close_high2")) & (F.col(f"{i}_high1") < F.col(f"{i}_high2")))
        made[f"{i}_bottom"] = _true(enough & (F.col("close_low1") < F.col("close_low2")) & (F.col(f"{i}_low1") > F.col(f"{i}_low2")))
    p = p.withColumns(made)
    some = lambda side: F.greatest(*[F.col(f"{i}_{side}").cast("int") for i in indicators]) == 1
    kind = F.when(~enough, "short").when(some("top"), "top").when(some("bottom"), "bottom").otherwise("none")
    return p.select("symbol", kind.alias("divergence"), *made)


def patterns(bars: DataFrame) -> DataFrame:
    """(symbol, pattern, engulfing, tail, doji): double tops and bottoms and triangles of pivots, candles of the last bar.

    Fewer than 30 bars are ``short``; fewer than three pivots on a side give ``none`` and no candles.
    """
    pivots = last_extrema(bars, {"h": ("high", 3, True), "l": ("low", 3, False)}, 3)
    rows = bars.withColumns({"po": F.lag("open").over(seq()), "pc": F.lag("close").over(seq())})
    r = last_rows(rows, "open", "high", "low", "close", "po", "pc").join(pivots, "symbol", "left")
    h1, h2, h3, l1, l2, l3 = (F.col(f"{s}{i}") for s in "hl" for i in (1, 2, 3))
    near = lambda a, b, of: F.abs(a - b) / (of + 1e-10) < 0.03
    some = (F.col("bars") >= 30) & h3.isNotNull() & l3.isNotNull()
    kind = F.when(F.col("bars") < 30, "short").when(~_true(some), "none").when((h2 > h3) & (h2 > h1) & near(h3, h1, h2), "double_top").when((l2 < l3) & (l2 < l1) & near(l3, l1, l2), "double_bottom").when((h3 > h2) & (h2 > h1) & (l3 < l2) & (l2 < l1), "triangle").otherwise("none")
    o, h, lo, c, po, pc = (F.col(x) for x in ("open", "high", "low", "close", "po", "pc"))
    engulf = F.when((pc < po) & (c > o) & (c > po) & (o < pc), "bullish").when((pc > po) & (c < o) & (c < po) & (o > pc), "bearish").otherwise("")
    body, lower, upper = F.abs(c - o), F.least(o, c) - lo, h - F.greatest(o, c)
    tail = F.when((body > 0) & (div(lower, body) > 2) & (div(upper, body) < 0.5), F.when(c > o, "hammer").otherwise("hanging")).otherwise("")
    return r.select("symbol", kind.alias("pattern"), F.when(_true(some), engulf).otherwise("").alias("engulfing"), F.when(_true(some), tail).otherwise("").alias("tail"), _true(some & (body / (h - lo + 1e-10) < 0.1)).alias("doji"))


TREND = ("ma5", "ma20", "ma60", "adx14", "plus_di", "minus_di")


def trend_state(rows: DataFrame) -> DataFrame:
    """(symbol, direction, strength, dmi) from the latest close, averages, ADX and DMI of ``rows``."""
    r = last_rows(rows, "close", *TREND)
    a, b, c = F.col("ma5"), F.col("ma20"), F.col("ma60")
    over20, over60 = _true(F.col("close") > b), _true(F.col("close") > c)
    direction = F.when((a > b) & (b > c), "up").when((a < b) & (b < c), "down").when(over20 & over60, "firm").when(~over20 & ~over60, "soft").otherwise("range")
    strength = F.when(F.col("adx14") > 40, "strong").when(F.col("adx14") > 25, "medium").otherwise("weak")
    return r.select("symbol", direction.alias("direction"), strength.alias("strength"), F.when(F.col("plus_di") > F.col("minus_di"), "long").otherwise("short").alias("dmi"))


# ---------------------------------------------------------------- composite score

SCORED = (*TREND, *DIVERGENT, "wr14", "vol_ratio", "obv", "boll_upper", "boll_lower", "boll_mid")


def bounded(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def composite_score(bars: DataFrame) -> DataFrame:
    """(symbol, trend, momentum, volume, pattern, volatility, score, rating): 30 + 25 + 15 + 15 + 15 points, 8 for divergence.

    Symbols with fewer than 20 bars have no score.
    """
    rows = with_formulas(bars, {n: INDICATORS[n] for n in SCORED})
    wide = rows.withColumns({"obv5": F.avg("obv").over(seq().rowsBetween(-4, 0)), "obv20": F.avg("obv").over(seq().rowsBetween(-19, 0))})
    r = last_rows(wide, "close", *SCORED, "obv5", "obv20").where("bars >= 20")
    r = r.join(trend_state(rows), "symbol").join(patterns(bars), "symbol").join(divergence(rows).select("symbol", "divergence"), "symbol")
    rising, falling = F.col("direction").isin("up", "firm"), F.col("direction").isin("down", "soft")
    step = F.when(F.col("strength") == "strong", 15).otherwise(10)
    up = lambda c, low, a, b: F.when(F.col(c) > low, a).otherwise(b)
    rsi = F.when(F.col("rsi24") > 70, -2).when(F.col("rsi24") > 50, 2).when(F.col("rsi24") < 30, 2).otherwise(-2)
    width = F.col("boll_upper") - F.col("boll_lower")
    place = F.when(width > 0, (F.col("close") - F.col("boll_lower")) / width)
    parts = {
        "trend": bounded(15 + F.when(rising, step).when(falling, -step).otherwise(0), 0, 30),
        "momentum": bounded(12.5 + up("macd_bar", 0, 3, -3) + rsi + F.when(F.col("kdj_j") > 80, -2).when(F.col("kdj_j") < 20, 2).otherwise(0) + F.when(F.col("wr14") < -80, 2).when(F.col("wr14") > -20, -2).otherwise(0), 0, 25),
        "volume": bounded(7.5 + F.when(F.col("vol_ratio") > 1.5, 4).when(F.col("vol_ratio") > 1.2, 2).when(F.col("vol_ratio") < 0.8, -3).otherwise(0) + F.when(F.col("obv5") > F.col("obv20"), 2).otherwise(-2), 0, 15),
        "pattern": bounded(7.5 + F.when(F.col("pattern") == "double_bottom", 5).when(F.col("pattern") == "double_top", -5).otherwise(0) + F.when(F.col("engulfing") == "bullish", 3).when(F.col("engulfing") == "bearish", -3).otherwise(0) + F.when(F.col("tail") == "hammer", 2).when(F.col("tail") == "hanging", -2).otherwise(0), 0, 15),
        "volatility": bounded(7.5 + F.when(place > 0.8, -3).when(place < 0.2, 3).otherwise(0), 0, 15),
    }
    total = sum(parts.values(), F.lit(0.0)) + F.when(F.col("divergence") == "top", -8).when(F.col("divergence") == "bottom", 8).otherwise(0)
    r = r.select("symbol", *[v.cast("double").alias(k) for k, v in parts.items()], bounded(total, 0, 100).alias("score"))
    return r.withColumn("rating", F.when(F.col("score") >= 70, "strong").when(F.col("score") >= 55, "firm").when(F.col("score") >= 45, "neutral").when(F.col("score") >= 30, "soft").otherwise("weak"))


# ---------------------------------------------------------------- structure, levels, strength of a bar


def true_range() -> Column:
    before = F.lag("close").over(seq())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def structure(bars: DataFrame) -> DataFrame:
    """(symbol, trend, direction, strength): averages of 5 and 20 closes with the highs and lows of the last bars."""
    ma = lambda n: F.avg("close").over(seq().rowsBetween(-(n - 1), 0))
    rows = bars.withColumns({"s": ma(5), "l": ma(20), "tr": true_range()})
    rows = rows.withColumns({"s0": F.lag("s").over(seq()), "l0": F.lag("l").over(seq()), "atr": F.avg("tr").over(seq().rowsBetween(-13, 0)), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol")), "at": from_end()})
    w = F.least(F.lit(20), F.expr("n div 2"))
    inside, before, now = F.col("at") <= w, (F.col("at") >= 2) & (F.col("at") <= w), F.col("at") == 1
    only = lambda c, when: F.when(when, F.col(c))
    r = rows.groupBy("symbol").agg(
        F.max("n").alias("n"), *[F.max(only(c, now)).alias(c) for c in ("close", "high", "low", "s", "l", "s0", "l0", "atr")],
        F.max(only("high", before)).alias("top"), F.min(only("low", before)).alias("floor"), F.max(only("high", inside)).alias("highest"), F.min(only("low", inside)).alias("lowest"))
    bull, bear = (F.col("s") > F.col("l")) & (F.col("s0") > F.col("l0")), (F.col("s") < F.col("l")) & (F.col("s0") < F.col("l0"))
    hh, hl, lh, ll = (_true(x) for x in (F.col("high") > F.col("top"), F.col("low") > F.col("floor"), F.col("high") < F.col("top"), F.col("low") < F.col("floor")))
    flat = div(F.when(F.col("n") >= 15, F.col("atr")).otherwise(F.col("high") - F.col("low")), F.col("close")) < 0.005
    wide = div(F.col("highest") - F.col("lowest"), F.col("close")) > 0.03
    kind = F.when(F.col("n") < 25, "short").when(bull & (hh | hl), "uptrend").when(bear & (lh | ll), "downtrend").when(_true(flat) | (~bull & ~bear), F.when(wide, "range_bound").otherwise("sideways")).otherwise("mixed")
    tens = lambda a, b: 70 + 10 * (a.cast("int") + b.cast("int"))
    r = r.withColumn("kind", kind).withColumn("up", tens(hh, hl)).withColumn("down", tens(lh, ll))
    strength = F.when(F.col("kind") == "short", 0).when(F.col("kind") == "uptrend", F.col("up")).when(F.col("kind") == "downtrend", F.col("down")).when(F.col("kind") == "sideways", 20).otherwise(30)
    named = F.when(F.col("kind").isin("short", "mixed"), "sideways").otherwise(F.col("kind"))
    return r.select("symbol", named.alias("trend"), F.when(F.col("kind") == "uptrend", "up").when(F.col("kind") == "downtrend", "down").otherwise("neutral").alias("direction"), strength.cast("double").alias("strength"))


#: Bars that are looked back on, the share of their deviation (or of their mean) that makes one level.
LOOKBACK, NEAR_DEVIATION, NEAR_MEAN = 20, 0.3, 0.005


def price_levels(bars: DataFrame, touches: int = 2, most: int = 5) -> DataFrame:
    """(symbol, place, side, level, touches, strength): the strongest levels that turning points of the last bars touch.

    The turning points of a side are folded, in order, into levels: one joins the first level whose mean is near, else it
    starts a level. The fold is over ``LOOKBACK`` bars at most. Strength counts touches and the volume at them.
    """
    recent = bars.withColumn("at", from_end()).where(F.col("at") <= LOOKBACK)
    w = seq()
    turns = recent.withColumns({f"{c}{d}": F.lag(c, d).over(w) for c in ("high", "low") for d in (-1, 1)})
    point = lambda c, turn: F.when(_true(turn), F.struct("date", F.col(c).alias("price"), F.col("volume").cast("double").alias("volume")))
    turned = turns.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg("volume").alias("usual"),
        *[F.when(F.stddev_pop(c) > 0, F.stddev_pop(c) * NEAR_DEVIATION).otherwise(F.avg(c) * NEAR_MEAN).alias(f"{c}_near") for c in ("high", "low")],
        F.sort_array(F.collect_list(point("high", (F.col("high") > F.col("high1")) & (F.col("high") > F.col("high-1"))))).alias("tops"),
        F.sort_array(F.collect_list(point("low", (F.col("low") < F.col("low1")) & (F.col("low") < F.col("low-1"))))).alias("floors"))
    turned = turned.where(F.col("n") == LOOKBACK)

    def levels(points: str, near: str, side: str) -> Column:
        empty = F.array().cast("array<struct<mean:double,n:int,volume:double>>")

        def join(held: Column, p: Column) -> Column:
            first = F.array_position(F.transform(held, lambda x: F.abs(x["mean"] - p["price"]) <= F.col(near)), F.lit(True))
            alone = F.struct(p["price"].alias("mean"), F.lit(1).alias("n"), p["volume"].alias("volume"))
            joined = lambda x: F.struct(((x["mean"] * x["n"] + p["price"]) / (x["n"] + 1)).alias("mean"), (x["n"] + 1).alias("n"), (x["volume"] + p["volume"]).alias("volume"))
            return F.when(first == 0, F.concat(held, F.array(alone))).otherwise(F.transform(held, lambda x, i: F.when(i + 1 == first, joined(x)).otherwise(x)))

        found = F.filter(F.aggregate(F.col(points), empty, join), lambda x: x["n"] >= touches)
        return F.transform(found, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("i"), x["mean"].alias("level"), x["n"].cast("long").alias("touches"), (x["volume"] / x["n"]).alias("at")))

    r = turned.select("symbol", "usual", F.inline(F.concat(levels("tops", "high_near", "resistance"), levels("floors", "low_near", "support"))))
    volume = F.when(F.col("usual") != 0, F.col("at") / F.col("usual")).otherwise(F.col("at"))
    r = r.withColumn("strength", F.round(F.least(F.lit(50.0), F.col("touches") * 15.0) + F.least(F.lit(50.0), volume * 20), 1))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("strength"), "side", "i"))).where(F.col("place") <= most)
    return r.select("symbol", "place", "side", F.round("level", 2).alias("level"), "touches", "strength")


def bar_strength(bars: DataFrame) -> DataFrame:
    """(symbol, score, state, volume_ratio, confirmed): bulls against bears in the latest bar, from -1 to 1."""
    w10 = seq().rowsBetween(-9, 0)
    oi = F.col("open_interest") if "open_interest" in bars.columns else F.lit(None).cast("double")
    rows = bars.withColumns({"usual": F.avg("volume").over(w10), "oi_step": div(oi - F.lag(oi).over(seq()), F.when(F.lag(oi).over(seq()) > 0, F.lag(oi).over(seq())))})
    r = last_rows(rows, "open", "high", "low", "close", "volume", "usual", "oi_step")
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = F.when(h > lo, h - lo)
    body = (c - o) / span
    shadow = F.when((h - F.greatest(o, c)) / span > 0.4, -0.3).otherwise(0.0) + F.when((F.least(o, c) - lo) / span > 0.4, 0.3).otherwise(0.0)
    side = F.when(body > 0, 1).otherwise(-1)
    loud = _true((F.col("usual") > 0) & (F.col("volume") > F.col("usual") * 1.2))
    total = (((c + o) / 2 - lo) / span * 2 - 1) * 0.25 + body * 0.35 + shadow * 0.2 + F.when(loud, 0.2 * side).otherwise(0.0) + F.when(F.col("oi_step") > 0.001, 0.15 * side).otherwise(0.0)
    score = F.coalesce(F.when((F.col("bars") >= 5) & span.isNotNull(), bounded(total, -1, 1)), F.lit(0.0))
    r = r.select("symbol", score.alias("score"), F.coalesce(div(F.col("volume"), F.when(F.col("usual") > 0, F.col("usual"))), F.lit(1.0)).alias("volume_ratio"))
    return r.select("symbol", "score", F.when(F.col("score") > 0.3, "bulls").when(F.col("score") < -0.3, "bears").otherwise("even").alias("state"), "volume_ratio", (F.col("volume_ratio") > 1.2).alias("confirmed"))


# ---------------------------------------------------------------- regime

_UP, _DOWN = "ts_delta(high, 1)", "abs(ts_delta(low, 1))"
_WILDER = repr(1 / 14)
_ATR = f"ewm({TR_SKIP}, {_WILDER})"
_PLUS = f"(100 * ewm(if_gt({_UP}, 0, if_gt({_UP}, {_DOWN}, {_UP}, 0), 0), {_WILDER}) / {_ATR})"
_MINUS = f"(100 * ewm(if_gt({_DOWN}, 0, if_gt({_DOWN}, {_UP}, {_DOWN}, 0), 0), {_WILDER}) / {_ATR})"
#: The series that a regime is judged by; Wilder's smoothing is a recursive average of 1/14.
REGIME = {
    "adx": f"ewm(100 * abs({_PLUS} - {_MINUS}) / ({_PLUS} + {_MINUS}), {_WILDER})", "ma20": "ts_mean_full(close, 20)", "atr_share": f"ts_mean_full({TR_SKIP}, 14) / close",
    "band": "4 * ts_std_full(close, 20) / ts_mean_full(close, 20)", "high20": "ts_max(high, 20)", "low20": "ts_min(low, 20)",
}
#: Closes and lags of the rescaled range, and the bounds of its exponent.
HURST_CLOSES, HURST_LAG, HURST_BOUNDS = 252, 20, (0.1, 0.95)


def hurst(bars: DataFrame) -> DataFrame:
    """(symbol, hurst): the slope of log rescaled range over log chunk length, of the last closes; 0.5 for too few.

    The rescaled range of a chunk is the range of its running deviation from its mean over its standard deviation. All
    chunks of all lengths are rows that one window and two aggregations reduce.
    """
    recent = bars.where("close IS NOT NULL").withColumn("at", from_end()).where(F.col("at") <= HURST_CLOSES)
    recent = recent.select("symbol", "close", F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"), "at").withColumn("i", F.col("n") - F.col("at"))
    lags = F.sequence(F.lit(2).cast("long"), F.least(F.lit(HURST_LAG).cast("long"), F.expr("n div 2") - 1))
    rows = recent.where(F.col("n") >= 2 * HURST_LAG).select("symbol", "close", "n", "i", F.explode(lags).alias("lag")).withColumn("chunk", F.expr("i div lag")).where("(chunk + 1) * lag <= n")
    chunk = Window.partitionBy("symbol", "lag", "chunk")
    walk = rows.withColumn("step", F.col("close") - F.avg("close").over(chunk)).withColumn("walk", F.sum("step").over(chunk.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    spans = walk.groupBy("symbol", "lag", "chunk").agg((F.max("walk") - F.min("walk")).alias("span"), F.stddev_pop("close").alias("dev")).where("dev > 1e-12 AND span > 0")
    means = spans.groupBy("symbol", "lag").agg(F.ln(F.avg(F.col("span") / F.col("dev"))).alias("y"), F.ln(F.col("lag").cast("double")).alias("x"))
    fitted = means.groupBy("symbol").agg(F.when(F.count(F.lit(1)) >= 3, bounded(F.regr_slope("y", "x"), *HURST_BOUNDS)).alias("slope"))
    return bars.select("symbol").distinct().join(fitted, "symbol", "left").select("symbol", F.coalesce("slope", F.lit(0.5)).alias("hurst"))


def recent_slope(name: str, n: int) -> Column:
    """Aggregate: the slope of the last n values that are there, over their mean size; 0 for fewer than three."""
    inside = F.when(F.col(f"{name}_at") <= n, F.col(name))
    x = F.when(F.col(f"{name}_at") <= n, -F.col(f"{name}_at").cast("double"))
    return F.when(F.count(inside) >= 3, F.regr_slope(inside, x) / F.when(F.avg(F.abs(inside)) > 0, F.avg(F.abs(inside))).otherwise(1.0)).otherwise(0.0)


def rank_of_last(name: str) -> Column:
    """Aggregate: the mean rank of the latest value among all, as a share; 0.5 if there is none."""
    last, v = F.col(f"{name}_last"), F.col(name)
    less, same = F.count(F.when(v < last, 1)), F.count(F.when(v == last, 1))
    return F.coalesce(div(less + (same + 1) / 2, F.when(same > 0, F.count(v))), F.lit(0.5))


def market_regime(bars: DataFrame) -> DataFrame:
    """(symbol, regime, confidence, adx, ma20_slope, ma60_slope, vol_rank, band_rank, hurst) of symbols with 30 bars."""
    r = with_formulas(bars, REGIME)
    w60 = seq().rowsBetween(-59, 0)
    r = r.withColumn("ma60", F.when(F.count("close").over(w60) >= 20, F.avg("close").over(w60)))
    back = lambda c: F.when(F.col(c).isNotNull(), F.count(c).over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    latest = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = r.withColumns({"ma20_at": back("ma20"), "ma60_at": back("ma60"), **{f"{c}_last": F.last(c).over(latest) for c in ("atr_share", "band")}})
    m = r.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.max_by(F.struct("adx", "close", "high20", "low20"), "date").alias("x"), recent_slope("ma20", 5).alias("ma20_slope"), recent_slope("ma60", 10).alias("ma60_slope"),
        rank_of_last("atr_share").alias("vol_rank"), rank_of_last("band").alias("band_rank")).where("bars >= 30")
    m = m.join(hurst(bars), "symbol").select("symbol", F.coalesce("x.adx", F.lit(20.0)).alias("adx"), "ma20_slope", "ma60_slope", "vol_rank", "band_rank", "hurst", "x.close", "x.high20", "x.low20")
    adx, s20, s60, vol, band, h = (F.col(c) for c in ("adx", "ma20_slope", "ma60_slope", "vol_rank", "band_rank", "hurst"))
    sure = F.least(adx / 60 + 0.3, F.lit(0.95))
    rules = [
        ((adx > 35) & (s20 > 0.001) & (s60 > 0), "trending_up", sure), ((adx > 35) & (s20 < -0.001) & (s60 < 0), "trending_down", sure),
        ((vol < 0.3) & (band < 0.3) & (adx < 20), "low_volatility", 0.9 - vol), ((vol > 0.7) & (adx > 20), "high_volatility", 0.5 + vol * 0.3),
        ((adx < 20) & (band > 0.3) & (band < 0.7), "range_bound", 0.5 + (20 - adx) * 0.02), ((h < 0.4) & (adx < 22), "range_bound", 1.0 - h),
        ((F.col("close") >= F.col("high20") * 0.99) & (s20 > 0), "trending_up", F.lit(0.55)), ((F.col("close") <= F.col("low20") * 1.01) & (s20 < 0), "trending_down", F.lit(0.55)),
    ]
    regime, confidence = F.lit("range_bound"), F.lit(0.5)
    for when, name, how in reversed(rules):
        regime, confidence = F.when(when, name).otherwise(regime), F.when(when, how).otherwise(confidence)
    return m.select("symbol", regime.alias("regime"), confidence.alias("confidence"), "adx", "ma20_slope", "ma60_slope", "vol_rank", "band_rank", "hurst")
