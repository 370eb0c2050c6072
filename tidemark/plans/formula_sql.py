"""The same formulas as plain SQL text, to hold the DataFrame plans against another engine's results."""

from __future__ import annotations

import ast

from tidemark.functions.series import RECURSIVE
from tidemark.plans.formula import number, parse

SEQ = "PARTITION BY symbol ORDER BY date"


def w(n) -> str:
    return f"OVER ({SEQ} ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"


def lag(x, n) -> str:
    n = int(n)
    return f"{'lag' if n >= 0 else 'lead'}({x}, {abs(n)}) OVER ({SEQ})"


def div(a, b) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def full(agg):
    return lambda x, n: f"(CASE WHEN count({x}) {w(n)} >= {int(n)} THEN {agg}({x}) {w(n)} END)"


def several(agg, x, n, least=2) -> str:
    return f"(CASE WHEN count({x}) {w(n)} >= {least} THEN {agg}({x}) {w(n)} END)"


def pair(agg, x, y, n) -> str:
    both = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) {w(n)}"
    value = f"{agg}({x}, {y}) {w(n)}"
    return f"(CASE WHEN {both} > 1 AND NOT isnan({value}) THEN {value} END)"


def strict(f, *xs) -> str:
    return f"(CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in xs)} THEN {f}({', '.join(xs)}) END)"


def values(x, n) -> str:
    return f"list_filter(list({x}) {w(n)}, lambda y: y IS NOT NULL)"


SQL = {
    "ts_mean": lambda x, n: f"avg({x}) {w(n)}", "ts_sum": lambda x, n: f"sum({x}) {w(n)}", "ts_max": lambda x, n: f"max({x}) {w(n)}", "ts_min": lambda x, n: f"min({x}) {w(n)}",
    "ts_std": lambda x, n: several("stddev_samp", x, n), "ts_median": lambda x, n: f"quantile_cont({x}, 0.5) {w(n)}", "ts_midpoint": lambda x, n: f"((max({x}) {w(n)} + min({x}) {w(n)}) / 2)",
    "ts_inverse_cv": lambda x, n: div(f"avg({x}) {w(n)}", several("stddev_samp", x, n)), "ts_maxmin": lambda x, n: div(f"({x} - min({x}) {w(n)})", f"(max({x}) {w(n)} - min({x}) {w(n)})"),
    "ts_pseudo_return": lambda x, n: div(f"(sign({x}) * ({x} - {lag(x, n)}))", f"abs({x})"), "ts_skew": lambda x, n: several("skewness", x, n, 3), "ts_kurt": lambda x, n: several("kurtosis", x, n, 4),
    "ts_delay": lag, "ts_delta": lambda x, n: f"({x} - {lag(x, n)})",
    "ts_rank": lambda x, n: f"(CASE WHEN {x} IS NULL THEN 0 ELSE CAST(len({values(x, n)}) - list_position(list_reverse({values(x, n)}), list_max({values(x, n)})) + 1 AS DOUBLE) / count(*) {w(n)} END)",
    "ts_zscore": lambda x, n: div(f"({x} - avg({x}) {w(n)})", several("stddev_samp", x, n)),
    "ts_rank_pct": lambda x, n: f"(CASE WHEN {x} IS NOT NULL THEN (len(list_filter({values(x, n)}, lambda y: y < {x})) + (len(list_filter({values(x, n)}, lambda y: y = {x})) + 1) / 2.0) / len({values(x, n)}) END)",
    "ts_corr": lambda x, y, n: pair("corr", x, y, n), "ts_cov": lambda x, y, n: pair("covar_samp", x, y, n), "ts_regression_beta": lambda x, y, n: div(pair("covar_samp", x, y, n), several("var_samp", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)", n)),
    "tr": lambda h, lo, c: strict("greatest", f"({h} - {lo})", f"abs({h} - {lag(c, 1)})", f"abs({lo} - {lag(c, 1)})"),
    "rank": lambda x: f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END)",
    "zscore": lambda x: div(f"({x} - avg({x}) OVER (PARTITION BY date))", f"(CASE WHEN count({x}) OVER (PARTITION BY date) > 1 THEN stddev_samp({x}) OVER (PARTITION BY date) END)"),
    "sign": lambda x: f"CAST(sign({x}) AS DOUBLE)", "abs": lambda x: f"abs({x})", "log": lambda x: f"(CASE WHEN {x} > 0 THEN ln({x}) END)", "sqrt": lambda x: f"(CASE WHEN {x} IS NOT NULL THEN sqrt(greatest({x}, 0)) END)", "exp": lambda x: f"exp({x})",
    "clip": lambda x, lo=None, hi=None: f"(CASE WHEN {x} IS NOT NULL THEN " + (f"least({hi}, " if hi is not None else "(") + (f"greatest({lo}, {x})" if lo is not None else f"{x}") + ") END)",
    "max_df": lambda *xs: strict("greatest", *xs), "min_df": lambda *xs: strict("least", *xs),
    "signed_power": lambda x, p: f"(sign({x}) * pow(abs({x}), {p}))", "signed_log": lambda x: f"(sign({x}) * ln(1 + abs({x})))", "if_gt": lambda a, b, x, y: f"(CASE WHEN {a} > {b} THEN {x} ELSE {y} END)",
    "greatest": lambda *xs: f"greatest({', '.join(xs)})", "coalesce": lambda *xs: f"coalesce({', '.join(xs)})", "nonzero": lambda x: f"nullif({x}, 0)",
    "ts_mean_full": full("avg"), "ts_sum_full": full("sum"), "ts_std_full": full("stddev_samp"), "ts_max_full": full("max"), "ts_min_full": full("min"), "ts_std_pop": lambda x, n: f"stddev_pop({x}) {w(n)}",
    "ts_deviation": lambda x, n: f"(list_sum(list_transform({values(x, n)}, lambda y: abs(y - avg({x}) {w(n)}))) / nullif(len({values(x, n)}), 0))", "cum_sum": lambda x: f"sum({x}) OVER ({SEQ} ROWS UNBOUNDED PRECEDING)",
}


def recursive(x: str, alpha: float, adjust: bool) -> str:
    """A fold over the symbol's values so far; missing values decay the weight."""
    state = f"list_reduce(list_prepend({{'m': NULL::DOUBLE, 'd': 0::DOUBLE, 'v': NULL::DOUBLE}}, list_transform(list({x}) OVER ({SEQ} ROWS UNBOUNDED PRECEDING), lambda v: {{'m': NULL::DOUBLE, 'd': 0::DOUBLE, 'v': v}})), lambda s, e: "
    keep = 1 - alpha
    gain, grown = (alpha, "1") if not adjust else (1.0, f"(s.d * {keep} + 1)")
    mean = f"CASE WHEN e.v IS NULL THEN s.m WHEN s.m IS NULL THEN e.v ELSE (s.d * {keep} * s.m + {gain} * e.v) / (s.d * {keep} + {gain}) END"
    return f"({state}{{'m': {mean}, 'd': CASE WHEN e.v IS NULL THEN s.d * {keep} WHEN s.m IS NULL THEN 1 ELSE {grown} END, 'v': NULL::DOUBLE}})).m"


class SqlCompiler:
    """Builds a chain of subqueries over ``source``, each adding one held column."""

    def __init__(self, source: str):
        self.sql, self.known = source, {}

    def hold(self, key: str, value: str) -> str:
        if key not in self.known:
            name = f"_f{len(self.known)}"
            self.sql = f"SELECT *, {value} AS {name} FROM ({self.sql})"
            self.known[key] = name
        return self.known[key]

    def text(self, node: ast.expr) -> str:
        if (n := number(node)) is not None:
            return f"CAST({n!r} AS DOUBLE)"
        key = ast.dump(node)
        if key in self.known:
            return self.known[key]
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.BinOp):
            a, b = self.text(node.left), self.text(node.right)
            forms = {ast.Add: f"({a} + {b})", ast.Sub: f"({a} - {b})", ast.Mult: f"({a} * {b})", ast.Div: div(a, b), ast.Pow: f"pow({a}, {b})", ast.Mod: f"({a} % {b})"}
            return forms[type(node.op)]
        if isinstance(node, ast.UnaryOp):
            return f"(-{self.text(node.operand)})"
        if isinstance(node, ast.Compare):
            sign = {ast.Gt: ">", ast.Lt: "<", ast.GtE: ">=", ast.LtE: "<=", ast.Eq: "=", ast.NotEq: "<>"}[type(node.ops[0])]
            return f"({self.text(node.left)} {sign} {self.text(node.comparators[0])})"
        name = node.func.id
        if name in RECURSIVE:
            alpha, adjust = RECURSIVE[name]
            x = self.hold("x" + ast.dump(node.args[0]), self.text(node.args[0]))
            return self.hold(key, recursive(x, alpha(number(node.args[1])), adjust))
        args = []
        for i, a in enumerate(node.args):
            n = number(a)
            if n is not None and i and (name.startswith("ts_") or name in ("clip", "signed_power")):
                args.append(n)
            else:
                args.append(self.hold("x" + ast.dump(a), self.text(a)) if not isinstance(a, (ast.Name, ast.Constant)) else self.text(a))
        return self.hold(key, SQL[name](*args))


def formulas_sql(source: str, formulas: dict[str, str], digits: int = 6, relative: bool = False) -> str:
    """(symbol, date, one rounded column per formula)."""
    compiler = SqlCompiler(source)
    columns = []
    for name, formula in formulas.items():
        value = compiler.text(parse(formula))
        columns.append((name, compiler.hold("out" + name, f"CAST({value} AS DOUBLE)")))
    return f"SELECT symbol, date, {', '.join(f'round({c}, {digits}) + 0.0 AS {n}' for n, c in columns)} FROM ({compiler.sql})"


def with_formulas_sql(source: str, formulas: dict[str, str]) -> str:
    """The rows of ``source`` with a column per formula, unrounded."""
    compiler = SqlCompiler(source)
    columns = [(name, compiler.hold("out" + name, f"CAST({compiler.text(parse(f))} AS DOUBLE)")) for name, f in formulas.items()]
    return f"SELECT *, {', '.join(f'{c} AS {n}' for n, c in columns)} FROM ({compiler.sql})"
