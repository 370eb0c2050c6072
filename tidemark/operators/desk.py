"""Desk operators: scores of strategies, stops and targets, plans, access views, alerts, exposures, calendars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.series import div, seq

# ---------------------------------------------------------------- scores


def bounded(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


#: What each component adds to the fitness of a strategy.
FITNESS = {"sharpe_score": 0.30, "calmar_score": 0.25, "win_score": 0.10, "profit_score": 0.10, "count_score": 0.10, "simplicity_score": 0.15}


def fitness_scores(m: DataFrame, conditions: Column | int = 1, weights: dict[str, float] | None = None) -> DataFrame:
    """Component scores from 0 to 100 and their weighted ``fitness``.

    ``m`` has sharpe, annualized_return_pct, max_drawdown_pct, win_rate_pct, profit_factor and trade_count; ``conditions``
    is the number of a strategy's conditions.
    """
    sharpe, ret, dd, win, pf, n = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("sharpe", "annualized_return_pct", "max_drawdown_pct", "win_rate_pct", "profit_factor", "trade_count"))
    k = conditions if isinstance(conditions, Column) else F.lit(conditions)
    r = m.withColumns({
        "sharpe_score": F.when(sharpe <= 0, F.greatest(F.lit(0.0), 25 + sharpe * 10)).otherwise(F.least(F.lit(100.0), 50 + sharpe * 25)),
        "calmar_score": F.when(ret < 0, 0.0).otherwise(F.least(F.lit(100.0), F.abs(ret) / F.greatest(dd, F.lit(0.1)) * 25)),
        "win_score": F.when(win <= 30, F.greatest(F.lit(0.0), win)).otherwise(F.least(F.lit(100.0), 30 + (win - 30) * 2.5)),
        "profit_score": F.when(pf <= 1, F.greatest(F.lit(0.0), pf * 20)).otherwise(F.least(F.lit(100.0), 30 + pf * 24)),
        "count_score": F.when(n < 3, 20.0).when(n < 5, 50.0).when(n <= 30, 100.0).when(n <= 60, F.greatest(F.lit(50.0), 100 - (n - 30) * 1.5)).otherwise(F.greatest(F.lit(20.0), 50 - (n - 60) * 0.3)),
        "simplicity_score": F.when(k <= 2, 100.0).when(k == 3, 85.0).when(k == 4, 65.0).when(k == 5, 40.0).otherwise(F.greatest(F.lit(5.0), 100.0 - k * 18.0)),
    })
    total = sum((F.col(c) * w for c, w in (weights or FITNESS).items()), F.lit(0.0))
    return r.withColumn("fitness", F.round(bounded(total), 2))


#: How much stability out of sample counts, and where half of that is taken from.
STABILITY, LESS = 0.25, {"win_score": 0.05, "profit_score": 0.05}


def fitness_out_of_sample(scored: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """``scored`` (from ``fitness_scores``, with in-sample ``sharpe``) with ``stability_score`` and ``fitness`` anew.

    Stability is the share of the in-sample Sharpe that ``test`` (keys, sharpe) keeps, in per cent from 0 to 100; without
    an in-sample one it is 100 if there is none out of sample either, else 0; without a test it is 50. Weights of wins and
    profits give way, and all are normalised.
    """
    weights = {c: max(0.05, w - LESS[c]) if c in LESS else w for c, w in FITNESS.items()} | {"stability_score": STABILITY}
    total = sum(weights.values())
    out = test.select(*keys, F.coalesce("sharpe", F.lit(0.0)).alias("_out"), F.lit(True).alias("_tested"))
    inner = F.coalesce("sharpe", F.lit(0.0))
    ratio = F.when(F.abs(inner) > 0.01, F.col("_out") / inner).otherwise(F.when(F.abs("_out") < 0.01, 1.0).otherwise(0.0))
    stable = F.when(F.col("_tested"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), ratio * 100))).otherwise(50.0)
    r = scored.join(out, keys, "left").withColumn("stability_score", stable).drop("_out", "_tested")
    fitness = reduce(lambda a, b: a + b, [F.col(c) * (w / total) for c, w in weights.items()])
    return r.withColumn("fitness", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), fitness)), 2))


def train_and_test(spans: DataFrame, test_share: float = 0.3, least_train: int = 40, least_test: int = 10) -> DataFrame:
    """``spans`` (first, last: dates) with train_start, train_end, test_start and test_end: the test follows the training by a
    day and none is drawn at random. All null where there are too few days for both."""
    days = F.datediff("last", "first")
    test = F.floor(days * F.lit(test_share)).cast("int")
    train_end = F.date_add("first", days - test)
    start = F.date_add(train_end, 1)
    enough = (days >= least_train * 1.5) & (days - test >= least_train) & (F.datediff("last", start) >= least_test)
    return spans.withColumns({n: F.when(enough, c) for n, c in {"train_start": F.col("first"), "train_end": train_end, "test_start": start, "test_end": F.col("last")}.items()})



#: What each part adds to the decay of a strategy, and the scores from which it is no more kept as it is.
DECAY = {"sharpe": 0.40, "profit_factor": 0.25, "win_rate_pct": 0.15, "trade_count": 0.20}
DECAY_STEPS = ((20, "active"), (40, "paper"), (70, "degraded"))


def decay_score(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, decay, status): how far a strategy fell behind its base, from 0 to 100.

    Sharpe falls relative to the base's size; with a base near 0 only a clear loss counts. Profit factor and trade count
    count as ratios. The win rate's fall is absolute: 20 points are all.
    """
    j = before.alias("b").join(now.alias("n"), key)
    b, n = (lambda c: F.coalesce(F.col(f"b.{c}").cast("double"), F.lit(0.0))), (lambda c: F.coalesce(F.col(f"n.{c}").cast("double"), F.lit(0.0)))
    ratio = lambda c: bounded((1 - div(n(c), b(c))) * 100)
    parts = {
        "sharpe": F.when(F.abs(b("sharpe")) < 0.01, F.when(n("sharpe") < -0.1, 100.0).otherwise(0.0)).otherwise(bounded(div(b("sharpe") - n("sharpe"), F.abs(b("sharpe"))) * 100)),
        "profit_factor": F.when(F.abs(b("profit_factor")) < 0.01, F.when(n("profit_factor") < 0.5, 100.0).otherwise(0.0)).otherwise(ratio("profit_factor")),
        "win_rate_pct": bounded((b("win_rate_pct") - n("win_rate_pct")) / 20 * 100), "trade_count": F.when(b("trade_count") <= 0, 0.0).otherwise(ratio("trade_count")),
    }
    score = sum((parts[c] * w for c, w in DECAY.items()), F.lit(0.0))
    status = F.lit("retired")
    for limit, name in reversed(DECAY_STEPS):
        status = F.when(F.col("decay") < limit, name).otherwise(status)
    return j.select(key, F.round(score, 2).alias("decay")).withColumn("status", status)


def trend_signal(values: Column, at: Column) -> Column:
    """Aggregate: whether values by time improve, worsen or stay, from their least-squares slope."""
    slope = F.coalesce(F.regr_slope(values, at), F.lit(0.0))
    return F.when(slope > 1e-9, "improving").when(slope < -1e-9, "worsening").otherwise("steady")


def lifecycle_ranking(strategies: DataFrame) -> DataFrame:
    """Strategies by decay, least first; those never judged come last."""
    return strategies.orderBy(F.asc_nulls_last("decay"), "symbol")


def risk_ratios(run: DataFrame, initial_cash: float) -> DataFrame:
    """(symbol, calmar, sortino, excess_return_pct, information_ratio, mean_hold_days) of a backtest's rows.

    Excess and information are against holding the symbol.
    """
    by = Window.partitionBy("symbol").orderBy("date")
    e = run.withColumns({"_r": div(F.col("equity"), F.lag("equity").over(by)) - 1, "_b": div(F.col("close"), F.lag("close").over(by)) - 1, "_dd": div(F.col("equity"), F.max("equity").over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1})
    down, active = F.stddev_pop(F.when(F.col("_r") < 0, F.col("_r"))), F.col("_r") - F.col("_b")
    grown = F.max_by("equity", "date") / initial_cash
    annual = F.when(grown > 0, (F.pow(grown, 252 / F.count("equity")) - 1) * 100).otherwise(-100.0)
    return e.groupBy("symbol").agg(
        div(annual, F.when(F.min("_dd") < 0, -F.min("_dd") * 100)).alias("calmar"), F.when(down > 0, F.avg("_r") / (down + 1e-12) * F.sqrt(F.lit(252.0))).alias("sortino"),
        ((grown - div(F.max_by("close", "date"), F.min_by("close", "date"))) * 100).alias("excess_return_pct"), F.when(F.stddev_pop(active) > 0, F.avg(active) / (F.stddev_pop(active) + 1e-12) * F.sqrt(F.lit(252.0))).alias("information_ratio"),
        F.avg(F.datediff(F.when(F.col("reason").isNotNull(), F.col("date")).cast("date"), F.col("entry_date").cast("date")).cast("double")).alias("mean_hold_days"))


def rolling_year(run: DataFrame, bars: int = 252) -> DataFrame:
    """(symbol, date, year_return): the change of equity over a year of bars."""
    return run.select("symbol", "date", (div(F.col("equity"), F.lag("equity", bars).over(seq())) - 1).alias("year_return"))


def alignment(trends: DataFrame) -> DataFrame:
    """(symbol, alignment, agreed) from rows (symbol, timeframe, direction -1 0 1): weights 1, .8, .6, .4, .2 from long to short."""
    weight = F.element_at(F.create_map(*[F.lit(x) for p in (("1w", 1.0), ("1d", 0.8), ("4h", 0.6), ("1h", 0.4), ("15m", 0.2)) for x in p]), F.col("timeframe"))
    return trends.withColumn("_w", weight).groupBy("symbol").agg(div(F.sum(F.col("_w") * F.col("direction")), F.sum("_w")).alias("alignment"), (F.countDistinct("direction") == 1).alias("agreed"))


# ---------------------------------------------------------------- stops and targets


def stop_methods(latest: DataFrame, levels: DataFrame, side: str = "long", tick: float = 0.01, atr_multiple: float = 2.0, fixed_pct: float = 3.0) -> DataFrame:
    """(symbol, method, used, stop, risk, risk_pct): the stop of a position at the latest close, by each of five methods.

    ``latest`` has symbol, close, atr14, low5, high5 and std20, ``levels`` (symbol, level). What lacks its data falls back
    to the fixed share. Stops are rounded to ticks.
    """
    sign = 1 if side == "long" else -1
    c = F.col("close")
    beyond = F.when(sign * (c - F.col("level")) > 0, F.col("level"))
    near = levels.join(latest.select("symbol", "close"), "symbol").groupBy("symbol").agg((F.max(beyond) if sign > 0 else F.min(beyond)).alias("near"))
    r = latest.join(near, "symbol", "left")
    swing = F.col("low5") if sign > 0 else F.col("high5")
    stops = {"atr": c - sign * F.col("atr14") * atr_multiple, "fixed_pct": c * (1 - sign * fixed_pct / 100), "swing": swing - sign * 2 * tick, "level": F.col("near") - sign * 2 * tick, "volatility": c - sign * 2 * F.col("std20")}
    fixed = stops["fixed_pct"]
    each = F.array(*[F.struct(F.lit(k).alias("method"), F.when(v.isNull(), "fixed_pct").otherwise(k).alias("used"), F.coalesce(v, fixed).cast("double").alias("stop")) for k, v in stops.items()])
    r = r.select("symbol", "close", F.inline(each)).withColumn("stop", F.bround(F.col("stop") / tick) * tick)
    risk = F.abs(F.col("close") - F.col("stop"))
    return r.select("symbol", "close", "method", "used", "stop", risk.alias("risk"), F.coalesce(div(risk, F.when(c > 0, c)) * 100, F.lit(0.0)).alias("risk_pct"))


def target_methods(stops: DataFrame, latest: DataFrame, levels: DataFrame, side: str = "long", reward: float = 2.0, atr_multiple: float = 3.0, trailing_pct: float = 5.0, fixed_pct: float = 6.0) -> DataFrame:
    """(symbol, method, used, target, trailing_stop, reward_ratio): the target that goes with a stop, by five methods.

    A trailing target triggers at 0.7 of the wanted reward and then follows by a share.
    """
    sign = 1 if side == "long" else -1
    c, risk = F.col("close"), F.col("risk")
    ahead = F.when(sign * (F.col("level") - c) > 0, F.col("level"))
    near = levels.join(latest.select("symbol", "close"), "symbol").groupBy("symbol").agg((F.min(ahead) if sign > 0 else F.max(ahead)).alias("near"))
    r = stops.select("symbol", "close", "risk").join(latest.select("symbol", "atr14"), "symbol").join(near, "symbol", "left")
    by_risk = c + sign * risk * reward
    targets = {"risk_reward": by_risk, "atr": c + sign * F.col("atr14") * atr_multiple, "level": F.col("near"), "trailing": c + sign * risk * reward * 0.7, "fixed_pct": c * (1 + sign * fixed_pct / 100)}
    each = F.array(*[F.struct(F.lit(k).alias("method"), F.when(v.isNull(), "risk_reward").otherwise(k).alias("used"), F.coalesce(v, by_risk).cast("double").alias("target")) for k, v in targets.items()])
    r = r.select("symbol", "close", "risk", F.inline(each))
    trail = F.when(F.col("method") == "trailing", F.col("target") * (1 - sign * trailing_pct / 100))
    return r.select("symbol", "method", "used", "target", trail.alias("trailing_stop"), F.coalesce(div(F.abs(F.col("target") - c), F.when(risk > 0, risk)), F.lit(0.0)).alias("reward_ratio"))


def entry_rows(bars_with_atr: DataFrame) -> DataFrame:
    """What stops and targets need of each symbol's latest bar."""
    last = lambda n: seq().rowsBetween(-(n - 1), 0)
    full = lambda n, v: F.when(F.count("close").over(last(n)) >= n, v)
    r = bars_with_atr.withColumns({"low5": full(5, F.min("low").over(last(5))), "high5": full(5, F.max("high").over(last(5))), "std20": full(20, F.stddev_samp("close").over(last(20)))})
    return r.groupBy("symbol").agg(F.max_by(F.struct("close", "atr14", "low5", "high5", "std20"), "date").alias("x")).select("symbol", "x.*")


#: Daily loss, drawdown and halt in percent by risk level.
DRAWDOWN = {"low": (2.0, 10.0, 15.0), "medium": (3.0, 20.0, 30.0), "high": (5.0, 30.0, 40.0)}


def drawdown_control(accounts: DataFrame) -> DataFrame:
    """Limits of accounts (owner, balance, level): daily loss and drawdown in money, halt, losses in a row (3 to 15)."""
    limit = F.element_at(F.create_map(*[x for k, v in DRAWDOWN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("level"))
    return accounts.select("owner", "level", (F.col("balance") * limit[0] / 100).alias("daily_loss"), (F.col("balance") * limit[1] / 100).alias("drawdown"), (limit[2] / 100).alias("halt"), bounded((limit[1] / 3).cast("int"), 3, 15).cast("int").alias("losses"))


def trade_plan(structure: DataFrame, stops: DataFrame, targets: DataFrame, strength: DataFrame, least_reward: float = 1.5) -> DataFrame:
    """(symbol, action, entry, stop, target, confidence, allowed): one plan per symbol from its structure, stop and target.

    Trade with the trend if the latest bar does not speak against it; the risk check asks for a reward of ``least_reward``
    times the risk and a risk of at most 10 %.
    """
    r = structure.select("symbol", "direction", F.col("strength").alias("trend_strength")).join(strength.select("symbol", "score", "confirmed"), "symbol").join(stops, "symbol").join(targets.select("symbol", "target", "reward_ratio"), "symbol")
    against = F.when(F.col("direction") == "up", F.col("score") < -0.3).when(F.col("direction") == "down", F.col("score") > 0.3)
    action = F.when((F.col("direction") == "neutral") | against, "wait").when(F.col("direction") == "up", "buy").otherwise("sell")
    confidence = bounded(F.col("trend_strength") * 0.7 + F.abs("score") * 20 + F.when(F.col("confirmed"), 10).otherwise(0))
    ok = (F.col("reward_ratio") >= least_reward) & (F.col("risk_pct") <= 10) & (action != "wait")
    return r.select("symbol", action.alias("action"), F.col("close").alias("entry"), "stop", "target", confidence.alias("confidence"), ok.alias("allowed"))


# ---------------------------------------------------------------- access, alerts, calendar


def access_views(spark: SparkSession, tables: dict[str, DataFrame], owner: dict[str, str], user: int) -> list[str]:
    """Registers each table as a view of the user's own rows (tables without an owner column: all) and names them."""
    for name, df in tables.items():
        (df.where(F.col(owner[name]) == user) if name in owner else df).createOrReplaceTempView(name)
    return list(tables)


def own_children(children: DataFrame, parents: DataFrame, key: str, parent_key: str, owner: str, user: int) -> DataFrame:
    """Child rows whose parent is the user's."""
    own = parents.where(F.col(owner) == user).select(F.col(parent_key).alias("_p"))
    return children.join(own, F.col(key) == F.col("_p"), "left_semi")


def triggered(alerts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Alerts (alert_id, symbol, side, target) that the latest quotes (symbol, price) reach."""
    return alerts.join(quotes, "symbol").where(((F.col("side") == "above") & (F.col("price") >= F.col("target"))) | ((F.col("side") == "below") & (F.col("price") <= F.col("target"))))


def last_trading_days(dates: DataFrame, unit: str) -> DataFrame:
    """(period, date): the last date of each week or month."""
    return dates.groupBy(F.date_trunc(unit, "date").cast("date").alias("period")).agg(F.max("date").alias("date"))


def exposure(positions: DataFrame, quotes: DataFrame, multiplier: float = 10.0) -> DataFrame:
    """Per owner: floating profit and notional of open positions (owner, symbol, side, lots, price) at the quotes."""
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    j = positions.join(quotes.withColumnRenamed("price", "now"), "symbol", "left")
    pnl = sign * (F.col("now") - F.col("price")) * F.col("lots") * multiplier
    return j.groupBy("owner").agg(F.sum(pnl).alias("floating"), F.sum(F.col("price") * F.col("lots") * multiplier).alias("notional"), F.sum(F.col("now").isNull().cast("long")).alias("unpriced"))


def account_state(exposure: DataFrame, balance: float = 100_000.0) -> DataFrame:
    """Adds balance and drawdown_pct, the floating loss as a share of the balance, to exposures."""
    loss = F.greatest(F.lit(0.0), -F.coalesce("floating", F.lit(0.0)))
    return exposure.withColumn("balance", F.lit(balance)).withColumn("drawdown_pct", loss / balance * 100)


def unrealised(positions: DataFrame, multiplier: float = 10.0) -> DataFrame:
    """Positions (owner, side, lots, price, now) with profit in money and as a share of their notional."""
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    r = positions.withColumn("pnl", sign * (F.col("now") - F.col("price")) * F.col("lots") * multiplier).withColumn("notional", F.col("price") * F.col("lots") * multiplier)
    return r.withColumn("pnl_pct", F.coalesce(div(F.col("pnl"), F.when(F.col("notional") > 0, F.col("notional"))) * 100, F.lit(0.0)))
