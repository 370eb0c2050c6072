"""Expressions of the factor-pack dialect, rewritten as formulas."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.formula import FormulaError, number

ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/"}
SAME = {"abs": 1, "sign": 1, "ts_mean": 2, "ts_std": 2, "ts_sum": 2, "ts_max": 2, "ts_min": 2, "ts_median": 2, "ts_skew": 2, "ts_kurt": 2, "ts_rank": 2, "ts_maxmin": 2, "ts_inverse_cv": 2, "ts_dema": 2, "ts_mean_return": 2, "ema": 2, "ts_corr": 3, "ts_cov": 3}
DERIVED = {"intraday_range": "((high - low) / close)", "amplitude": "((high - low) / close)", "gap": "(open / ts_delay(close, 1) - 1)"}
#: A category and what any of its expressions holds; the first that fits counts, else the last name.
CATEGORIES = [("volume_price", ["volume", "amount", "turnover"]), ("volatility", ["std", "amplitude", "intraday_range", "maxmin"]), ("momentum", ["ret_", "pct_change", "delta", "gap"]), ("fundamental", ["market_cap", "fund"]), ("technical", [""])]
#: Panel fields that derived ones are made of.
READS = {"intraday_range": {"high", "low", "close"}, "amplitude": {"high", "low", "close"}, "gap": {"open", "close"}}


def category(expression: Column) -> Column:
    """The category of a pack expression, by what it mentions; null is technical."""
    text = F.coalesce(F.lower(expression), F.lit(""))
    return F.coalesce(*[F.when(F.greatest(F.lit(False), *[F.contains(text, F.lit(w)) for w in words]), name) for name, words in CATEGORIES])


def fields(expression: str) -> list[str]:
    """The panel fields that an expression reads, sorted; none of one that is malformed."""
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except SyntaxError:
        return []
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    names = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}
    return sorted(set().union(*[READS.get(n, {"close"} if re.fullmatch(r"ret_\d+", n) else {n}) for n in names]))


def with_conversions(rows: DataFrame, expression: str = "expression") -> DataFrame:
    """Pack rows with ``formula`` (null if it cannot be), ``status`` (converted or unsupported), ``error``, ``fields`` and
    ``category``. An expression that is null or empty is unsupported. Columns of these names are replaced."""

    def one(text: str | None) -> tuple:
        text = text or ""
        try:
            return convert(text), "converted", None, fields(text)
        except FormulaError as e:
            return None, "unsupported", str(e), fields(text)

    @F.pandas_udf("formula string, status string, error string, fields array<string>")
    def converted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([one(t) for t in texts], columns=["formula", "status", "error", "fields"])

    name = F.col(f"`{expression}`")
    return rows.withColumn("_converted", converted(name)).withColumns({c: F.col(f"_converted.{c}") for c in ("formula", "status", "error", "fields")}).withColumn("category", category(name)).drop("_converted")


def convert(expression: str) -> str:
    """The formula of a pack expression; ``FormulaError`` for what it cannot express."""
    try:
        return _text(ast.parse(expression.strip(), mode="eval").body)
    except SyntaxError as e:
        raise FormulaError(f"malformed: {e}") from e


def _text(node: ast.expr) -> str:
    if number(node) is not None:
        return f"{number(node)}"
    if isinstance(node, ast.Name):
        if m := re.fullmatch(r"ret_(\d+)", node.id):
            return f"(close / ts_delay(close, {m[1]}) - 1)"
        return DERIVED.get(node.id, node.id)
    if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
        raise FormulaError(f"not in the dialect: {ast.unparse(node)}")
    name, args = node.func.id, [_text(a) for a in node.args]
    named = {k.arg: _text(k.value) for k in node.keywords}
    if name in ARITHMETIC and len(args) >= 2:
        text = args[0]
        for a in args[1:]:
            text = f"({text} {ARITHMETIC[name]} {a})"
        return text
    if name == "neg" and len(args) == 1:
        return f"(0 - {args[0]})"
    if name == "log" and len(args) == 1:
        return f"signed_log({args[0]})"
    if name == "delay" and len(args) == 2:
        return f"ts_delay({args[0]}, {args[1]})"
    if name == "delta" and len(args) in (1, 2):
        return f"ts_delta({args[0]}, {args[1] if len(args) == 2 else 1})"
    if name == "ts_pct_change" and len(args) == 2:
        return f"ts_pseudo_return({args[0]}, {args[1]})"
    if name == "signed_power" and len(args) + len(named) == 2:
        return f"signed_power({args[0]}, {named.get('exponent', args[-1])})"
    if name == "zscore" and len(args) in (1, 2):
        return f"zscore({args[0]})" if len(args) == 1 else f"ts_zscore({args[0]}, {args[1]})"
    if SAME.get(name) == len(args) and not named:
        return f"{name}({', '.join(args)})"
    raise FormulaError(f"not in the dialect: {name}")
