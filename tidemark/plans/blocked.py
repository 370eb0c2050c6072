"""Formulas over symbols of very many rows: the same Columns as ``formula`` makes, over blocks with a halo.

What needs more than the last rows of a symbol (recursive averages, running sums) or the rows of other symbols
(cross-sections) is computed first, the innermost of it first, as a column of the dealt panel; what is left of a formula
reads a bounded number of earlier rows, and a block with that halo is a series of its own.
"""

from __future__ import annotations

import ast
import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.series import FUNCTIONS, RECURSIVE
from tidemark.operators.blocks import BLOCK, BLOCK_ROWS, deal, recursive_averages, running, with_halo
from tidemark.plans.formula import Compiler, FormulaError, number, parse

CROSS, RUNS = ("rank", "zscore"), ("cum_sum",)
#: Functions that read so many rows before a row as their number says; the other windows read one less.
SHIFTS = ("ts_delay", "ts_delta", "ts_pseudo_return")


def reach(node: ast.AST) -> int:
    """Rows before a row that a formula without barriers reads."""
    inner = max((reach(c) for c in ast.iter_child_nodes(node)), default=0)
    if not isinstance(node, ast.Call) or not FUNCTIONS[node.func.id][1]:
        return inner
    if node.func.id == "tr":
        return inner + 1
    n = number(node.args[-1])
    if n is None or n < 0:
        raise FormulaError(f"{node.func.id} looks ahead or lacks its number of rows")
    return inner + int(n) - (node.func.id not in SHIFTS)


def _series(df: DataFrame, trees: dict[str, ast.expr]) -> DataFrame:
    """Adds columns of formulas that read a bounded number of rows of their symbol."""
    haloed = with_halo(df, max(map(reach, trees.values())))
    keyed = haloed.withColumn("_symbol", F.col("symbol")).withColumn("symbol", F.to_json(F.struct("symbol", BLOCK)))
    compiler = Compiler(keyed)
    for name, tree in trees.items():
        value = compiler.column(tree)
        compiler.df = compiler.df.withColumn(name, value.cast("double"))
    out = compiler.df.where(~F.col("_halo")).withColumn("symbol", F.col("_symbol"))
    return out.select(*df.columns, *trees)


class _Lowered(ast.NodeTransformer):
    """Replaces the barriers that have a column by its name."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def visit_Call(self, node: ast.Call) -> ast.expr:
        name = self.known.get(ast.dump(node))
        return ast.Name(name, ast.Load()) if name else self.generic_visit(node)


def blocked_formulas(panel: DataFrame, formulas: dict[str, str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The panel with a column per formula, as ``with_formulas`` gives it, no task holding a symbol of many rows.

    Symbols of up to ``block_rows`` rows are one block. Formulas that look ahead are refused. A (symbol, date) that is
    repeated is ordered as it comes, as in any window.
    """
    trees = {name: parse(text) for name, text in formulas.items()}
    levels: dict[int, dict[str, ast.Call]] = {}

    def depth(node: ast.AST) -> int:
        inner = max((depth(c) for c in ast.iter_child_nodes(node)), default=0)
        if isinstance(node, ast.Call) and node.func.id in (*RECURSIVE, *CROSS, *RUNS):
            levels.setdefault(inner + 1, {})[ast.dump(node)] = node
            return inner + 1
        return inner

    for tree in trees.values():
        depth(tree)
    df, known = deal(panel, block_rows), {}
    for level in sorted(levels):
        nodes = list(levels[level].items())
        sources = {f"_a{level}_{i}": _Lowered(known).visit(copy.deepcopy(node.args[0])) for i, (_, node) in enumerate(nodes)}
        df = _series(df, sources)
        named = {f"_b{level}_{i}": (f"_a{level}_{i}", node) for i, (_, node) in enumerate(nodes)}
        averages = {}
        for out, (source, node) in named.items():
            if node.func.id in RECURSIVE:
                if len(node.args) != 2 or number(node.args[1]) is None:
                    raise FormulaError(f"{node.func.id} takes a series and a number")
                alpha, adjust = RECURSIVE[node.func.id]
                averages[out] = source, alpha(number(node.args[1])), adjust
        if averages:
            df = recursive_averages(df, averages)
        sums = {out: ("sum", source) for out, (source, node) in named.items() if node.func.id in RUNS}
        if sums:
            df = running(df, sums)
        for out, (source, node) in named.items():
            if node.func.id in CROSS:
                df = df.withColumn(out, FUNCTIONS[node.func.id][0](F.col(source)))
        df = df.drop(*sources)
        known |= {key: out for (key, _), out in zip(nodes, named, strict=True)}
    df = _series(df, {name: _Lowered(known).visit(copy.deepcopy(tree)) for name, tree in trees.items()})
    return df.select(*panel.columns, *formulas)
