"""Strategies as documents: named indicators and conditions become signal columns."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.library import TR_SKIP, TYPICAL, _rsi, _rsv
from tidemark.operators.simulate import Rules, backtest_sets, compare, composite_score, with_atr
from tidemark.plans.formula import with_formulas

FIELDS = ("open", "high", "low", "close", "volume", "amount")
_K = f"ewm({_rsv(9)}, 0.3333333333333333)"


def _kdj(line: str, n: int) -> str:
    k = f"ewm({_rsv(n)}, 0.3333333333333333)"
    d = f"ewm({k}, 0.3333333333333333)"
    return {"k": k, "d": d, "j": f"3 * {k} - 2 * {d}"}[line]


def _cci(n: int) -> str:
    mean = f"ts_mean_full({TYPICAL}, {n})"
    return f"({TYPICAL} - {mean}) / (0.015 * ts_mean_full(abs({TYPICAL} - {mean}), {n}) + 0.000000000001)"


#: Names without a period.
PLAIN = {
    "sma": "ts_mean_full(close, 20)", "ema": "ema_adjusted(close, 20)", "rsi": _rsi(14, "ts_mean_full", "0"), "macd_dif": "ema_adjusted(close, 12) - ema_adjusted(close, 26)", "macd_dea": "ema_adjusted(ema_adjusted(close, 12) - ema_adjusted(close, 26), 9)",
    "macd": "ema_adjusted(close, 12) - ema_adjusted(close, 26) - ema_adjusted(ema_adjusted(close, 12) - ema_adjusted(close, 26), 9)", "boll_mid": "ts_mean_full(close, 20)", "boll_upper": "ts_mean_full(close, 20) + 2 * ts_std_full(close, 20)", "boll_lower": "ts_mean_full(close, 20) - 2 * ts_std_full(close, 20)",
    "atr": f"ts_mean_full({TR_SKIP}, 14)", "kdj_k": _K, "kdj_d": f"ewm({_K}, 0.3333333333333333)", "kdj_j": f"3 * {_K} - 2 * ewm({_K}, 0.3333333333333333)", "cci": _cci(20),
}
#: (pattern of the name, formula of its numbers).
NUMBERED = (
    (r"volume_sma(\d+)", "ts_mean_full(volume, {0})"), (r"sma(\d+)", "ts_mean_full(close, {0})"), (r"ema(\d+)", "ema_adjusted(close, {0})"), (r"rsi(\d+)", lambda n: _rsi(int(n), "ts_mean_full", "0")), (r"cci(\d+)", lambda n: _cci(int(n))), (r"kdj_([kdj])[_-]?(\d+)", lambda line, n: _kdj(line, int(n))), (r"boll[_-]?(\d+)", "ts_mean_full(close, {0})"), (r"high_(\d+)", "ts_max_full(high, {0})"), (r"low_(\d+)", "ts_min_full(low, {0})"), (r"volume(\d+)", "ts_mean_full(volume, {0})"),
    (r"boll_upper_(\d+)_(\d+)", "ts_mean_full(close, {0}) + {1} * ts_std_full(close, {0})"), (r"boll_lower_(\d+)_(\d+)", "ts_mean_full(close, {0}) - {1} * ts_std_full(close, {0})"), (r"boll_mid_(\d+)_(\d+)", "ts_mean_full(close, {0})"),
    (r"atr_upper_(\d+)_(\d+)", f"close + {{1}} * ts_mean_full({TR_SKIP}, {{0}})"), (r"atr_lower_(\d+)_(\d+)", f"close - {{1}} * ts_mean_full({TR_SKIP}, {{0}})"),
)


def indicator_formula(name: str) -> str:
    """The formula of an indicator name; an unknown name means the close, as the strategy documents define it."""
    if name in FIELDS:
        return name
    if name in PLAIN:
        return PLAIN[name]
    for pattern, formula in NUMBERED:
        if m := re.fullmatch(pattern, name):
            return formula(*m.groups()) if callable(formula) else formula.format(*m.groups())
    return "close"


def _names(conditions: list[dict]) -> set[str]:
    return {c[k] for c in conditions for k in ("indicator", "indicator2") if c.get(k)}


def _column(name: str) -> str:
    return f"_i_{name}"


def _condition(c: dict) -> Column:
    left, op = F.col(_column(c["indicator"])), c["operator"]
    if op == "between":
        return compare(left, op, tuple(c["value"]))
    if c.get("indicator2"):
        factor = c.get("multiply_value", 1.0)
        if not math.isfinite(factor) or factor <= 0:
            raise ValueError(f"a multiplier must be positive and finite, not {factor}")
        return compare(left, op, F.col(_column(c["indicator2"])) * factor)
    return compare(left, op, float(c["value"]))


def combine(conditions: list[dict], logic: str = "and") -> Column:
    parts = [_condition(c) for c in conditions]
    return reduce((lambda a, b: a | b) if logic == "or" else (lambda a, b: a & b), parts) if parts else F.lit(False)


def signals(bars: DataFrame, strategy: dict) -> DataFrame:
    """``bars`` with ``entry`` and ``exit`` from {entry: {conditions, logic}, exit: {...}}; a formula is computed once."""
    sides = {k: strategy.get(k, {}) for k in ("entry", "exit")}
    names = sorted(set().union(*[_names(s.get("conditions", [])) for s in sides.values()]))
    rows = with_formulas(bars, {_column(n): indicator_formula(n) for n in names})
    rows = rows.withColumns({k: combine(s.get("conditions", []), s.get("logic", "and")) for k, s in sides.items()})
    return rows.select(*bars.columns, "entry", "exit")


def with_values(part, values: dict):
    """A strategy document with each text ``{name}`` replaced by a value; a text that is nothing else becomes the value."""
    if isinstance(part, dict):
        return {k: with_values(v, values) for k, v in part.items()}
    if isinstance(part, list):
        return [with_values(v, values) for v in part]
    if isinstance(part, str):
        whole = re.fullmatch(r"\{(\w+)\}", part)
        if whole and whole[1] in values:
            return values[whole[1]]
        return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), part)
    return part


def optimise(bars: DataFrame, template: dict, params: DataFrame, rules: Rules) -> DataFrame:
    """Metrics and composite score of a strategy document with ``{parameters}``, per parameter set (at most 1000) and symbol.

    Every indicator that any set uses is computed once; see ``backtest_sets``.
    """
    sets = params.collect()
    documents = {p["param_id"]: with_values(template, p.asDict()) for p in sets}
    names = sorted(set().union(*[_names(doc.get(side, {}).get("conditions", [])) for doc in documents.values() for side in ("entry", "exit")]))
    rows = with_atr(with_formulas(bars, {_column(n): indicator_formula(n) for n in names}))

    def signal(side: str):
        return lambda p: combine(documents[p["param_id"]].get(side, {}).get("conditions", []), documents[p["param_id"]].get(side, {}).get("logic", "and"))

    return backtest_sets(rows, sets, signal("entry"), signal("exit"), rules).withColumn("composite", composite_score())


def fee_rate(stored: Column) -> Column:
    """A stored commission of 0.05 or more is an amount per lot and stands for the usual rate."""
    return F.when(stored < 0.05, stored).otherwise(0.0001)


def order_labels(lots: Column, before: Column) -> Column:
    """What a change of the target does: entry, exit, flip, rebalance or hold."""
    return F.when(lots == before, "hold").when(before == 0, "entry").when(lots == 0, "exit").when(F.signum(lots) != F.signum(before), "flip").otherwise("rebalance")
