"""Strategy simulation: signals as Columns, path-dependent fills per symbol, metrics as aggregates.

Which fill follows which depends on the fills before it, so a symbol (and parameter set) is run in order in one group;
groups run in parallel. Signals, parameter grids, windows and metrics are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import div, seq

# ---------------------------------------------------------------- conditions


def compare(a: Column, op: str, b: Column | float | tuple[float, float]) -> Column:
    """A strategy condition; NULL and unknown operators are false."""
    if op == "between":
        lo, hi = b
        found = (a > lo) & (a < hi)
    else:
        b = b if isinstance(b, Column) else F.lit(float(b))
        a0, b0 = F.lag(a).over(seq()), F.lag(b).over(seq())
        table = {"above": a > b, "greater_than": a > b, "below": a < b, "less_than": a < b, "equal": F.abs(a - b) < 1e-9, "cross_above": (a0 <= b0) & (a > b), "cross_below": (a0 >= b0) & (a < b)}
        found = table.get(op, F.lit(False))
    return F.coalesce(found, F.lit(False))


def moving_average(n: int) -> Column:
    """The mean of the last n closes, null before there are n."""
    w = seq().rowsBetween(-(n - 1), 0)
    return F.when(F.count("close").over(w) >= n, F.avg("close").over(w))


def ma_cross_signals(bars: DataFrame, short: int, long: int, direction: str = "long") -> DataFrame:
    """``entry`` and ``exit`` of a moving-average cross; averages need full windows. A short enters where a long exits."""
    r = bars.withColumn("_s", moving_average(short)).withColumn("_l", moving_average(long))
    up, down = compare(F.col("_s"), "cross_above", F.col("_l")), compare(F.col("_s"), "cross_below", F.col("_l"))
    enter, leave = (down, up) if direction == "short" else (up, down)
    return r.withColumn("entry", enter).withColumn("exit", leave).drop("_s", "_l")


# ---------------------------------------------------------------- single position


@dataclass(frozen=True)
class Rules:
    direction: str = "long"
    initial_cash: float = 100_000.0
    quantity: int = 1
    multiplier: float = 10.0
    fee_rate: float = 0.0001
    stop: tuple[str, float] | None = None  # fixed_price, percent_below, percent_above, atr_multiple
    target: tuple[str, float] | None = None  # target_price, percent_below, percent_above, risk_reward_ratio


RUN = "date date, equity double, close double, entry_date date, entry_price double, exit_price double, pnl double, fee double, reason string"


def stop_levels(rules: Rules, entry: float, atr: float) -> tuple[float | None, float | None]:
    """Stop and target of a position; a kind that is not known sets none."""
    sign = 1 if rules.direction == "long" else -1
    stop = target = None
    if rules.stop:
        kind, v = rules.stop
        stop = {"fixed_price": v, "percent_below": entry * (1 - v), "percent_above": entry * (1 + v), "atr_multiple": entry - sign * (0.0 if atr != atr else atr) * v}.get(kind)
    if rules.target:
        kind, v = rules.target
        if kind == "risk_reward_ratio":
            target = None if stop is None else entry + sign * abs(entry - stop) * v
        else:
            target = {"target_price": v, "percent_below": entry * (1 - v), "percent_above": entry * (1 + v)}.get(kind)
    return stop, target


def walk(bars: pd.DataFrame, rules: Rules) -> list[tuple]:
    """``fills`` of the bars of one key, with their columns entry and exit."""
    bars = bars.sort_values("date")
    return fills(bars.to_dict("records"), bars["entry"].tolist(), bars["exit"].tolist(), rules)


def fills(rows: list[dict], entry: list, exit: list, rules: Rules) -> list[tuple]:
    """Per bar after the first, in order: equity, and the trade that closed at it if one did (``RUN``).

    A signal at a bar's close fills at the next open; a stop comes before a target.
    """
    sign, cash, size = (1 if rules.direction == "long" else -1), rules.initial_cash, rules.quantity * rules.multiplier
    held, since, out = None, None, []
    for enter, leave, bar in zip(entry, exit, rows[1:], strict=False):
        price, reason, closed = bar["open"], None, (None,) * 6
        if held is not None:
            stop, target = stop_levels(rules, held, bar["atr"])
            worst, best = (bar["low"], bar["high"]) if sign > 0 else (bar["high"], bar["low"])
            if stop is not None and sign * (worst - stop) <= 0:
                reason, price = "stop_loss", sign * min(sign * bar["open"], sign * stop)
            elif target is not None and sign * (best - target) >= 0:
                reason, price = "take_profit", sign * max(sign * bar["open"], sign * target)
        if held is None:
            if enter:
                held, since = bar["open"], bar["date"]
        elif reason or leave:
            fee = (held + price) * size * rules.fee_rate
            pnl = sign * (price - held) * size - fee
            cash += pnl
            closed = (since, held, price, pnl, fee, reason or "signal")
            held = None
        out.append((bar["date"], cash + (0.0 if held is None else sign * (bar["close"] - held) * size), bar["close"], *closed))
    return out


def with_atr(signals: DataFrame, n: int = 14) -> DataFrame:
    prev = F.lag("close").over(seq())
    tr = signals.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    w = seq().rowsBetween(-(n - 1), 0)
    return tr.withColumn("atr", F.when(F.count("_tr").over(w) >= n, F.avg("_tr").over(w))).drop("_tr")


def backtest(signals: DataFrame, rules: Rules, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per key and bar after its first, columns ``by`` and ``RUN``: equity and trades of one grouped pass.

    ``signals`` has the bars with entry, exit and, for ATR stops, atr. A key is one group, as each fill depends on the
    fills before it.
    """
    names = [*by, *(c.split()[0] for c in RUN.split(", "))]
    slim = signals if "atr" in signals.columns else signals.withColumn("atr", F.lit(None).cast("double"))
    slim = slim.select(*by, "date", "open", "high", "low", "close", "entry", "exit", "atr")
    kinds = dict(slim.dtypes)

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        key = tuple(bars[k].iloc[0] for k in by)
        return pd.DataFrame([(*key, *r) for r in walk(bars, rules)], columns=names)

    schema = ", ".join(f"{k} {kinds[k]}" for k in by) + ", " + RUN.replace("date date", f"date {kinds['date']}").replace("entry_date date", f"entry_date {kinds['date']}")
    return slim.groupBy(*by).applyInPandas(run, schema)


def trades_of(run: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return run.where("reason IS NOT NULL").select(*by, "entry_date", F.col("date").alias("exit_date"), "entry_price", "exit_price", "pnl", "fee", "reason")


def backtest_trades(signals: DataFrame, rules: Rules) -> DataFrame:
    return trades_of(backtest(with_atr(signals), rules))


#: What the metrics of a run are made of.
FACTS = "last double, bars long, worst double, mean_return double, spread double, trade_count long, wins long, win_sum double, losses long, loss_sum double, total_fee double, mean_fee double"


def equity_metrics(run: DataFrame, initial_cash: float, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Return, drawdown, Sharpe and trade statistics per key of a run: windows for peaks and returns, one aggregation."""
    seq = Window.partitionBy(*by).orderBy("date")
    peak = F.max("equity").over(seq.rowsBetween(Window.unboundedPreceding, 0))
    e = run.withColumn("_dd", div(F.col("equity"), peak) - 1).withColumn("_r", div(F.col("equity"), F.lag("equity").over(seq)) - 1)
    won, lost = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    values = [F.max_by("equity", "date"), F.count("equity"), F.min("_dd"), F.avg("_r"), F.stddev_pop("_r"), F.count("reason"), F.count(won), F.sum(won), F.count(lost), F.sum(lost), F.sum("fee"), F.avg("fee")]
    return metrics_of(e.groupBy(*by).agg(*[v.alias(f.split()[0]) for v, f in zip(values, FACTS.split(", "), strict=True)]), initial_cash, by)


def facts_of(run: list[tuple]) -> tuple:
    """The ``FACTS`` of the fills of one key, of which there is one at least."""
    equity = np.array([r[1] for r in run], dtype=float)
    pnl, fee = (np.array([r[k] for r in run if r[8] is not None], dtype=float) for k in (6, 7))
    peak = np.fmax.accumulate(equity)
    with np.errstate(divide="ignore", invalid="ignore"):
        fall, change = np.where(peak == 0, np.nan, equity / peak - 1), np.where(equity[:-1] == 0, np.nan, equity[1:] / equity[:-1] - 1)
    fall, change = fall[~np.isnan(fall)], change[~np.isnan(change)]
    won, lost = pnl[pnl > 0], pnl[pnl < 0]
    of = lambda x, f: float(f(x)) if len(x) else None
    return (float(equity[-1]), int((~np.isnan(equity)).sum()), of(fall, np.min), of(change, np.mean), of(change, np.std), len(pnl), len(won), of(won, np.sum), len(lost), of(lost, np.sum), of(fee, np.sum), of(fee, np.mean))


def metrics_of(facts: DataFrame, initial_cash: float, by: tuple[str, ...]) -> DataFrame:
    """The metrics and score of runs from their ``FACTS``."""
    grown, c = F.col("last") / initial_cash, F.col
    per = lambda n: F.coalesce(F.try_divide(n, c("trade_count")) * 100, F.lit(0.0))
    wins = c("wins").cast("double")
    m = facts.select(
        *by, ((grown - 1) * 100).alias("total_return_pct"), F.when(grown <= 0, -100.0).otherwise((F.pow(grown, 252 / c("bars")) - 1) * 100).alias("annualized_return_pct"), (-c("worst") * 100).alias("max_drawdown_pct"),
        F.coalesce(c("mean_return") / (c("spread") + 1e-12) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"), "trade_count", per(c("wins")).alias("win_rate_pct"), per(c("losses")).alias("loss_rate_pct"),
        F.coalesce(div(c("win_sum"), F.abs("loss_sum")), wins).alias("profit_factor"), F.coalesce(div(div(c("win_sum"), c("wins")), F.abs(div(c("loss_sum"), c("losses")))), wins).alias("profit_loss_ratio"),
        F.coalesce("total_fee", F.lit(0.0)).alias("total_fee"), F.coalesce("mean_fee", F.lit(0.0)).alias("mean_fee"))
    return m.withColumn("score", trade_score(c("total_return_pct"), c("max_drawdown_pct"), c("win_rate_pct"), c("profit_factor"), c("trade_count")))


def trade_score(ret: Column, drawdown: Column, win: Column, factor: Column, trades: Column) -> Column:
    bound = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    score = 50 + bound(ret, -30, 50) * 0.5 - F.least(drawdown, F.lit(40.0)) * 0.7 + F.least(factor, F.lit(3.0)) * 4 + (bound(win, 30, 70) - 50) * 0.1
    score = score - F.when(trades < 3, 15).when(trades < 5, 5).otherwise(0)
    return F.when(trades == 0, 0).otherwise(F.bround(bound(score, 0, 100))).cast("int")


def period_returns(equity: DataFrame, unit: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Return per calendar month or year, from the last equity of each."""
    last = equity.groupBy(*by, F.date_trunc(unit, "date").cast("date").alias("period")).agg(F.max_by("equity", "date").alias("equity"))
    prev = F.lag("equity").over(Window.partitionBy(*by).orderBy("period"))
    return last.withColumn("period_return", div(F.col("equity"), prev) - 1)


def streaks(trades: DataFrame) -> DataFrame:
    """(symbol, longest_loss): the longest run of losing trades, by gaps and islands."""
    seq = Window.partitionBy("symbol").orderBy("entry_date")
    r = trades.withColumn("_loss", F.col("pnl") < 0).withColumn("_all", F.row_number().over(seq)).withColumn("_own", F.row_number().over(Window.partitionBy("symbol", "_loss").orderBy("entry_date")))
    runs = r.where("_loss").groupBy("symbol", (F.col("_all") - F.col("_own")).alias("island")).count()
    return runs.groupBy("symbol").agg(F.max("count").alias("longest_loss"))


# ---------------------------------------------------------------- futures account


@dataclass(frozen=True)
class Contract:
    multiplier: float = 10.0
    margin_rate: float = 0.1
    tick: float = 0.0
    slippage_ticks: float = 0.0
    fee_rate: float = 0.0
    fee_per_lot: float = 0.0


@dataclass(frozen=True)
class Account:
    cash: float = 100_000.0
    lag: int = 1
    allow_short: bool = True
    clamp: bool = True
    maintenance: float = 0.0


def target_lots(entry: list[bool], exit_: list[bool], lots: int) -> list[int]:
    """Flat until an entry, then ``lots`` until an exit."""
    out, now = [], 0
    for e, x in zip(entry, exit_, strict=True):
        now = lots if now == 0 and e else 0 if now and x else now
        out.append(now)
    return out


ACCOUNT = "date date, close double, lots long, equity double, margin double, realized double, fee double, fill double, closed long, entry_date date, entry_price double, reason string"


def run_account(bars: pd.DataFrame, contract: Contract, account: Account) -> list[tuple]:
    """``ACCOUNT`` per bar of one symbol; column ``target`` has the lots wanted at its close.

    ``closed`` lots of a position of ``entry_date`` and ``entry_price`` ended at ``fill``; ``reason`` names a margin call.
    """
    rows = bars.sort_values("date").to_dict("records")
    cash, lots, price, since, out = account.cash, 0, 0.0, None, []

    def trade(to: int, at: float, date) -> tuple:
        nonlocal cash, lots, price, since
        step = to - lots
        fill = at + (1 if step > 0 else -1) * contract.slippage_ticks * contract.tick
        fee = abs(step) * (fill * contract.multiplier * contract.fee_rate + contract.fee_per_lot)
        closed = min(abs(lots), abs(step)) * (1 if lots > 0 else -1) if lots * step < 0 else 0
        won = closed * (fill - price) * contract.multiplier
        ended = (closed, since, price) if closed else (0, None, None)
        if lots * to <= 0:
            price, since = (fill, date) if to else (0.0, None)  # closed or flipped
        elif abs(to) > abs(lots):
            price = (price * abs(lots) + fill * (abs(to) - abs(lots))) / abs(to)
        cash += won - fee
        lots = to
        return won, fee, fill, ended

    for i, bar in enumerate(rows):
        won, fee, fill, ended, reason = 0.0, 0.0, None, (0, None, None), None
        if i >= account.lag:
            want = int(rows[i - account.lag]["target"])
            want = max(want, 0) if not account.allow_short else want
            if account.clamp and contract.margin_rate > 0:
                equity = cash + lots * (bar["open"] - price) * contract.multiplier
                needed = abs(bar["open"]) * contract.multiplier * contract.margin_rate
                if needed > 0:
                    most = max(0, floor(equity / needed))
                    want = max(-most, min(most, want))
            if want != lots:
                won, fee, fill, ended = trade(want, bar["open"], bar["date"])
        equity = cash + lots * (bar["close"] - price) * contract.multiplier
        margin = abs(lots) * bar["close"] * contract.multiplier * contract.margin_rate
        if lots and margin > 0 and equity <= margin * account.maintenance:
            more = trade(0, bar["close"], bar["date"])
            won, fee, fill, ended, reason = won + more[0], fee + more[1], more[2], more[3], "margin_call"
            equity, margin = cash, 0.0
        out.append((bar["date"], bar["close"], lots, equity, margin, won, fee, fill, *ended, reason))
    return out


def futures_account(signals: DataFrame, contract: Contract, account: Account, lots: int = 1) -> DataFrame:
    """The account of each symbol (``ACCOUNT``) from its entry and exit signals."""
    names = ["symbol", *(c.split()[0] for c in ACCOUNT.split(", "))]

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("date")
        bars["target"] = target_lots(bars["entry"].tolist(), bars["exit"].tolist(), lots)
        return pd.DataFrame([(bars["symbol"].iloc[0], *r) for r in run_account(bars, contract, account)], columns=names)

    slim = signals.select("symbol", "date", "open", "close", "entry", "exit")
    return slim.groupBy("symbol").applyInPandas(run, f"symbol string, {ACCOUNT}")


def futures_orders(run: DataFrame) -> DataFrame:
    """(symbol, date, before, lots, traded, fill, fee, reason): a row per bar that changed the position."""
    before = F.coalesce(F.lag("lots").over(seq()), F.lit(0).cast("long"))
    r = run.withColumn("before", before).where("lots <> before OR closed <> 0")
    return r.select("symbol", "date", "before", "lots", F.abs(F.col("lots") - F.col("before")).alias("traded"), "fill", "fee", F.coalesce("reason", F.lit("signal")).alias("reason"))


def futures_trades(run: DataFrame) -> DataFrame:
    """(symbol, entry_date, exit_date, side, lots, entry_price, exit_price, pnl, reason) of what each bar closed."""
    side = F.when(F.col("closed") > 0, "long").otherwise("short")
    return run.where("closed <> 0").select("symbol", "entry_date", F.col("date").alias("exit_date"), side.alias("side"), F.abs("closed").alias("lots"), "entry_price", F.col("fill").alias("exit_price"), F.col("realized").alias("pnl"), F.coalesce("reason", F.lit("signal")).alias("reason"))


def futures_metrics(run: DataFrame, initial_cash: float) -> DataFrame:
    """Return, drawdown, Sharpe, trades, fees and score per symbol of an account."""
    return equity_metrics(run.withColumn("pnl", F.when(F.col("closed") != 0, F.col("realized"))).withColumn("reason", F.when(F.col("closed") != 0, F.coalesce("reason", F.lit("signal")))), initial_cash)


# ---------------------------------------------------------------- experiments


def walk_forward_windows(dates: DataFrame, train: int, test: int, step: int, rolling: bool = False) -> DataFrame:
    """(window_id, train_start, train_end, test_start, test_end) by position among the dates, ends inclusive."""
    n = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row per date
    size = n.agg(F.count(F.lit(1)).alias("n"))
    w = size.select(F.explode(F.expr(f"sequence(0, int((n - {train + test}) div {step}))")).alias("window_id")).where(f"window_id >= 0")
    first = F.col("window_id") * step if rolling else F.lit(0)
    w = w.select("window_id", first.alias("a"), (F.col("window_id") * step + train).alias("b"))
    for name, i in (("train_start", F.col("a")), ("train_end", F.col("b") - 1), ("test_start", F.col("b")), ("test_end", F.col("b") + test - 1)):
        side = n.select(F.col("date").alias(name), F.col("i").alias(f"_{name}"))
        w = w.join(side, i == F.col(f"_{name}")).drop(f"_{name}")
    return w.select("window_id", "train_start", "train_end", "test_start", "test_end")


def grid(spark, **values: list) -> DataFrame:
    """A row per combination of parameters, at most 1000."""
    total = 1
    for v in values.values():
        total *= len(v)
    if total > 1000:
        raise ValueError(f"{total} combinations; at most 1000")
    out = spark.range(1).drop("id")
    for name, v in values.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, v))))
    return out.withColumn("param_id", F.concat_ws("_", *values))


#: Parameter sets whose signals travel in one number.
SETS = 60


def backtest_sets(rows: DataFrame, sets: list, entry: Callable, exit: Callable, rules: Rules) -> DataFrame:
    """Metrics per parameter set (at most 1000, each with a ``param_id``) and symbol, each a backtest of its own.

    ``rows`` are bars with all that ``entry`` and ``exit`` need, which give a Column for a parameter set. The signals of
    ``SETS`` sets are the bits of two numbers, so bars move once for so many sets; a task runs the sets of a symbol one
    after the other and gives a row for each, never its equity. Symbols of a single bar have no run and no row.
    """
    parts = [sets[i : i + SETS] for i in range(0, len(sets), SETS)]
    bits = lambda signal, part: reduce(Column.bitwiseOR, [F.when(signal(p), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(part)])
    slim = rows if "atr" in rows.columns else rows.withColumn("atr", F.lit(None).cast("double"))
    signals = F.array(*[F.struct(F.lit(k).alias("part"), bits(entry, p).alias("entry"), bits(exit, p).alias("exit")) for k, p in enumerate(parts)])
    slim = slim.withColumn("_signals", signals).select("symbol", "date", "open", "high", "low", "close", "atr", F.inline("_signals")).repartition("symbol", "part")
    ids = [[p["param_id"] for p in part] for part in parts]
    names = ["param_id", "symbol", *(f.split()[0] for f in FACTS.split(", "))]

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars, out = bars.sort_values("date"), []
        symbol, part, enter, leave = bars["symbol"].iloc[0], bars["part"].iloc[0], bars["entry"].to_numpy(), bars["exit"].to_numpy()
        records = bars.to_dict("records")
        for i, param in enumerate(ids[part]):
            one = fills(records, ((enter >> i) & 1).tolist(), ((leave >> i) & 1).tolist(), rules)
            out += [(param, symbol, *facts_of(one))] if one else []
        return pd.DataFrame(out, columns=names)

    facts = slim.groupBy("symbol", "part").applyInPandas(run, f"param_id string, symbol {dict(rows.dtypes)['symbol']}, {FACTS}")
    return metrics_of(facts, rules.initial_cash, ("param_id", "symbol"))


#: Parameter sets whose sums are columns of one aggregation.
SUMS = 100


def grid_cross_returns(bars: DataFrame, params: DataFrame) -> DataFrame:
    """Per parameter set and symbol: the return of holding while the short average is above the long one, a bar late.

    Each distinct average, of however many bars, is one window over the bars; parameter sets only pick from them.
    """
    sets = params.collect()  # at most 1000 rows
    lengths = sorted({p[c] for p in sets for c in ("short", "long")})
    r = bars.select("symbol", "date", (div(F.col("close"), F.lag("close").over(seq())) - 1).alias("_ret"), *[moving_average(n).alias(f"_ma{n}") for n in lengths])
    before = r.select("symbol", "_ret", *[F.struct(F.col(f"_ma{n}").alias("now"), F.lag(f"_ma{n}").over(seq()).alias("before")).alias(f"_ma{n}") for n in lengths])
    above = lambda p, at: F.coalesce((F.col(f"_ma{p['short']}")[at] > F.col(f"_ma{p['long']}")[at]).cast("int"), F.lit(0))
    # a sum per set and symbol, as columns: bars are not multiplied by the sets, only their sums are
    out = None
    for i in range(0, len(sets), SUMS):
        part = sets[i : i + SUMS]
        sums = [F.struct(*[F.lit(v).alias(k) for k, v in p.asDict().items()], F.sum(F.coalesce(F.col("_ret") * above(p, "before"), F.lit(0.0))).alias("total"), F.sum(above(p, "now")).alias("bars_in")) for p in part]
        rows = before.groupBy("symbol").agg(F.array(*sums).alias("_sets")).select("symbol", F.inline("_sets")).select("param_id", "short", "long", "symbol", "total", "bars_in")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- optimisation and walk-forward

#: What each metric adds to the score of a parameter set.
WEIGHTS = {"sharpe": 0.4, "total_return_pct": 0.3, "max_drawdown_pct": -0.2, "win_rate_pct": 0.1}


def composite_score(weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of metrics, less 20 below three trades and 5 below five."""
    total = F.lit(0.0)
    for name, w in (weights or WEIGHTS).items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return total - F.when(F.col("trade_count") < 3, 20.0).when(F.col("trade_count") < 5, 5.0).otherwise(0.0)


def optimise_cross(bars: DataFrame, params: DataFrame, rules: Rules, weights: dict[str, float] | None = None) -> DataFrame:
    """Metrics and score of a moving-average cross for every parameter set and symbol, each a backtest of its own.

    Averages are computed once per distinct length; see ``backtest_sets``.
    """
    sets = params.collect()  # at most 1000 rows
    lengths = sorted({p[c] for p in sets for c in ("short", "long")})
    r = with_atr(bars).withColumns({f"_ma{n}": moving_average(n) for n in lengths})
    r = r.withColumns({f"_was{n}": F.lag(f"_ma{n}").over(seq()) for n in lengths})

    def cross(up: bool):
        def column(p) -> Column:
            a, b, a0, b0 = (F.col(f"{c}{p[k]}") for c in ("_ma", "_was") for k in ("short", "long"))
            return F.coalesce((a0 <= b0) & (a > b) if up else (a0 >= b0) & (a < b), F.lit(False))

        return column

    enter, leave = (cross(True), cross(False)) if rules.direction == "long" else (cross(False), cross(True))
    return backtest_sets(r, sets, enter, leave, rules).withColumn("composite", composite_score(weights))


def best_parameters(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n parameter sets of highest composite score per symbol; of equal ones the first by id."""
    w = Window.partitionBy("symbol").orderBy(F.desc("composite"), "param_id")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def in_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """The bars of each window's training and test span: columns window_id and phase (train, test) are added.

    Windows and dates are small; bars join by date.
    """
    spans = windows.select("window_id", F.inline(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(f"{p}_start").alias("start"), F.col(f"{p}_end").alias("end")) for p in ("train", "test")])))
    days = spans.select("window_id", "phase", F.explode(F.sequence(F.col("start").cast("date"), F.col("end").cast("date"))).alias("day"))
    return bars.join(days, F.col("date").cast("date") == F.col("day")).drop("day")


def walk_forward(bars: DataFrame, windows: DataFrame, signals, rules: Rules) -> DataFrame:
    """Metrics per window, phase and symbol of a fixed strategy; ``signals`` adds entry and exit to bars by symbol.

    Indicators start anew in every window, as it is run on its own bars.
    """
    mark = F.concat_ws("/", F.col("window_id").cast("string"), "phase", "symbol")
    keyed = in_windows(bars, windows).withColumn("_own", F.col("symbol")).withColumn("symbol", mark)
    run = backtest(with_atr(signals(keyed)), rules)
    m = equity_metrics(run, rules.initial_cash)
    parts = F.split("symbol", "/", 3)
    return m.select(parts[0].cast("int").alias("window_id"), parts[1].alias("phase"), parts[2].alias("symbol"), *[c for c in m.columns if c != "symbol"])


def stability(results: DataFrame, windows: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Per symbol: out-of-sample means and medians, shares of positive windows, consistency, and what they say.

    ``validation`` is inconclusive with fewer than ``least`` complete windows (of both phases; the figures are null then)
    or if one of ``windows`` (window_id; default: all in ``results``) is missing; else stable with 60 % of test windows in
    profit and a median test Sharpe that is not negative; else unstable. ``reason`` says why it is inconclusive.
    """
    test, train = (results.where(F.col("phase") == p).select("symbol", "window_id", *[F.col(c).alias(f"{p}_{c}") for c in ("total_return_pct", "sharpe", "score")]) for p in ("test", "train"))
    r, sharpe = (F.coalesce(F.col(f"test_{c}"), F.lit(0.0)) for c in ("total_return_pct", "sharpe"))
    figures = {
        "return_mean": F.avg(r), "return_median": F.median(r), "sharpe_mean": F.avg(sharpe), "sharpe_median": F.median(sharpe), "score_mean": F.avg(F.coalesce("test_score", F.lit(0))),
        "positive_return_rate": F.avg((r > 0).cast("double")), "positive_sharpe_rate": F.avg((sharpe > 0).cast("double")), "consistency": F.greatest(F.lit(0.0), 100 - F.avg(F.abs(F.coalesce("train_sharpe", F.lit(0.0)) - sharpe)) * 20)}
    s = test.join(train, ["symbol", "window_id"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), *[c.alias(n) for n, c in figures.items()])
    planned = (windows if windows is not None else results).agg(F.countDistinct("window_id").alias("_planned"))
    s = results.select("symbol").distinct().join(s, "symbol", "left").join(F.broadcast(planned), F.lit(True)).withColumn("windows", F.coalesce("windows", F.lit(0).cast("long")))
    s = s.withColumn("failed_windows", F.greatest(F.col("_planned") - F.col("windows"), F.lit(0))).withColumns({n: F.when(F.col("windows") >= least, F.col(n)) for n in figures})
    few, lost = F.col("windows") < least, F.col("failed_windows") > 0
    good = (F.col("positive_return_rate") >= 0.6) & (F.col("sharpe_median") >= 0)
    return s.drop("_planned").withColumn("validation", F.when(few | lost, "inconclusive").when(good, "stable").otherwise("unstable")).withColumn("reason", F.when(few, "too_few_windows").when(lost, "failed_windows"))


def sensitivity(results: DataFrame, params: list[str], score: str) -> DataFrame:
    """(param, value, mean score)."""
    long = results.unpivot([score], params, "param", "value")
    return long.groupBy("param", "value").agg(F.avg(score).alias("mean_score"))
