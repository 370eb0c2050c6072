"""Factor formulas compiled to Columns: ``close / ts_delay(close, 5) - 1`` becomes a plan that Catalyst optimises.

A formula is a Python expression of panel fields, numbers, arithmetic, comparisons and the functions in
``functions.series``; anything else is refused. A window over a window is materialised as a column first; equal
sub-expressions are computed once. All windows of a formula share the partitioning by symbol, so a formula costs one
shuffle however deep it nests. Recursive averages are the one thing windows cannot express: they run per symbol in
pandas, on the rows of that symbol alone.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.series import FIELDS, FUNCTIONS, MACROS, RECURSIVE, div
from tidemark.operators.blocks import BLOCK, order_statistics

OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: div, ast.Pow: F.pow, ast.Mod: lambda a, b: F.pmod(a, b)}
COMPARISONS = {ast.Gt: "__gt__", ast.Lt: "__lt__", ast.GtE: "__ge__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}

#: Order statistics of a window, by the kind of ``blocks.sliding`` that computes them where it is longer than so many rows.
ORDERED, LONG_WINDOW = {"ts_median": "median", "ts_rank": "last_max", "ts_rank_pct": "rank_pct", "ts_deviation": "deviation"}, 64


class FormulaError(ValueError):
    """A formula that is empty, malformed, or uses what the language does not have."""


def parse(formula: str) -> ast.expr:
    """The checked tree of a formula, macros expanded."""
    if not formula or not formula.strip():
        raise FormulaError("the formula is empty")
    try:
        tree = ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"the formula is malformed: {e}") from e
    return _Expand().visit(tree)


class _Expand(ast.NodeTransformer):
    """Refuses what is not in the language and expands macros."""

    def visit_Call(self, node: ast.Call) -> ast.expr:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise FormulaError("only plain calls of functions are possible")
        name = node.func.id
        if name not in FUNCTIONS and name not in MACROS and name not in RECURSIVE:
            raise FormulaError(f"unknown function: {name}")
        args = [self.visit(a) for a in node.args]
        if name in MACROS:
            try:
                text = MACROS[name].format(*[f"({ast.unparse(a)})" for a in args])
            except IndexError as e:
                raise FormulaError(f"too few arguments for {name}") from e
            return self.visit(ast.parse(text, mode="eval").body)
        return ast.Call(node.func, args, [])

    def visit_Name(self, node: ast.Name) -> ast.expr:
        if node.id not in FIELDS:
            raise FormulaError(f"unknown name: {node.id}")
        return node

    def generic_visit(self, node: ast.AST) -> ast.AST:
        if not isinstance(node, (ast.BinOp, ast.UnaryOp, ast.Compare, ast.Constant, ast.operator, ast.unaryop, ast.cmpop)):
            raise FormulaError(f"not in the language: {type(node).__name__}")
        if isinstance(node, ast.Constant) and (isinstance(node.value, bool) or not isinstance(node.value, (int, float))):
            raise FormulaError(f"only numbers are constants, not {node.value!r}")
        return super().generic_visit(node)


def number(node: ast.expr) -> float | int | None:
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return -node.operand.value
    return None


class Compiler:
    """Adds formula columns to a panel of (symbol, date, fields)."""

    def __init__(self, panel: DataFrame):
        self.df = panel
        self.known: dict[str, str] = {}

    def _hold(self, key: str, value: Column) -> Column:
        if key not in self.known:
            name = f"_f{len(self.known)}"
            self.df = self.df.withColumn(name, value)
            self.known[key] = name
        return F.col(self.known[key])

    def column(self, node: ast.expr) -> Column:
        if (n := number(node)) is not None:
            return F.lit(float(n))
        key = ast.dump(node)
        if key in self.known:
            return F.col(self.known[key])
        if isinstance(node, ast.Name):
            return F.col(node.id)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](self.column(node.left), self.column(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            x = self.column(node.operand)
            return -x if isinstance(node.op, ast.USub) else x
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARISONS:
            return getattr(self.column(node.left), COMPARISONS[type(node.ops[0])])(self.column(node.comparators[0]))
        if isinstance(node, ast.Call):
            return self._call(node, key)
        raise FormulaError(f"not in the language: {ast.unparse(node)}")

    def _call(self, node: ast.Call, key: str) -> Column:
        name = node.func.id
        if name in RECURSIVE:
            self._recursive({key: node})
            return F.col(self.known[key])
        function, windowed = FUNCTIONS[name]
        plain = name.startswith("ts_") or name in ("clip", "signed_power")
        args = []
        for i, a in enumerate(node.args):
            n = number(a)
            if n is not None and plain and i:
                args.append(n)
            else:
                c = self.column(a)
                args.append(self._hold(ast.dump(a), c) if windowed and not isinstance(a, ast.Name) else c)
        if name in ORDERED and len(args) == 2 and args[1] > LONG_WINDOW:  # a sorted window instead of a sort per row
            self.known[key] = out = f"_f{len(self.known)}"
            ranked = order_statistics(self.df.withColumns({BLOCK: F.lit(0), "_x": args[0]}), {out: (ORDERED[name], "_x", args[1])})
            self.df = ranked.select(*self.df.columns, out)
            return F.col(out)
        try:
            value = function(*args)
        except TypeError as e:
            raise FormulaError(f"wrong arguments for {name}: {e}") from e
        return self._hold(key, value) if windowed else value

    def prepare(self, trees: list[ast.expr]) -> None:
        """Computes the recursive averages of some formulas, those of one nesting depth together."""
        levels: dict[int, dict[str, ast.Call]] = {}

        def depth(node: ast.AST) -> int:
            inner = max((depth(c) for c in ast.iter_child_nodes(node)), default=0)
            if isinstance(node, ast.Call) and node.func.id in RECURSIVE:
                levels.setdefault(inner + 1, {})[ast.dump(node)] = node
                return inner + 1
            return inner

        for t in trees:
            depth(t)
        for level in sorted(levels):
            self._recursive({k: n for k, n in levels[level].items() if k not in self.known})

    def _recursive(self, nodes: dict[str, ast.Call]) -> None:
        """One grouped pass per symbol for averages whose arguments hold no average that is yet to come."""
        if not nodes:
            return
        todo = []
        for key, node in nodes.items():
            if len(node.args) != 2 or number(node.args[1]) is None:
                raise FormulaError(f"{node.func.id} takes a series and a number")
            alpha, adjust = RECURSIVE[node.func.id]
            x = self.column(node.args[0])
            source, out = f"_x{len(self.known)}", f"_f{len(self.known)}"
            self.df = self.df.withColumn(source, x.cast("double"))
            self.known[key] = out
            todo.append((source, out, alpha(number(node.args[1])), adjust))
        schema = T.StructType([*self.df.schema.fields, *[T.StructField(out, T.DoubleType()) for _, out, *_ in todo]])

        def average(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("date")
            return rows.assign(**{out: rows[source].ewm(alpha=alpha, adjust=adjust).mean() for source, out, alpha, adjust in todo})

        df = self.df.groupBy("symbol").applyInPandas(average, schema).drop(*[source for source, *_ in todo])
        self.df = df.withColumns({out: F.when(~F.isnan(out), F.col(out)) for _, out, *_ in todo})


def with_formulas(panel: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """The panel with a column per formula; shared parts of the formulas are computed once."""
    compiler, trees = Compiler(panel), {name: parse(text) for name, text in formulas.items()}
    compiler.prepare(list(trees.values()))
    for name, tree in trees.items():
        value = compiler.column(tree)
        compiler.df = compiler.df.withColumn(name, value.cast("double"))
    return compiler.df.select(*panel.columns, *formulas)


def factor(panel: DataFrame, formula: str, name: str = "factor") -> DataFrame:
    """(symbol, date, factor)."""
    return with_formulas(panel, {name: formula}).select("symbol", "date", name)
