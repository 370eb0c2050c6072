"""A registry of factors by name: formulas with a category, searched by text, checked when they are added."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.library import INDICATORS, SEEDS
from tidemark.plans.formula import parse, with_formulas

#: Columns of bars that a choice of indicators keeps.
BAR = ("symbol", "date", "open", "high", "low", "close", "volume")


@dataclass
class Registry:
    factors: dict[str, tuple[str, str]] = field(default_factory=dict)

    def add(self, name: str, formula: str, category: str = "other") -> None:
        """Adds or replaces a factor; a formula that does not parse is refused."""
        parse(formula)
        self.factors[name] = (formula, category)

    def remove(self, name: str) -> None:
        del self.factors[name]

    def search(self, text: str = "", category: str | None = None) -> list[str]:
        """Names that contain the text, in their order."""
        return sorted(n for n, (_, c) in self.factors.items() if text.lower() in n.lower() and category in (None, c))

    def columns(self, panel: DataFrame, names: list[str]) -> DataFrame:
        return with_formulas(panel, {n: self.factors[n][0] for n in names})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, f, c) for n, (f, c) in sorted(self.factors.items())], "name string, formula string, category string")

    @classmethod
    def seeded(cls) -> Registry:
        """The factors that a new store begins with."""
        out = cls()
        for name, (category, formula) in SEEDS.items():
            out.add(name, formula, category)
        return out

    @classmethod
    def load(cls, rows: DataFrame) -> Registry:
        """From a table (name, formula, category), such as a manifest; a registry is small."""
        out = cls()
        for r in rows.collect():
            out.add(r["name"], r["formula"], r["category"])
        return out


def chosen_indicators(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Bars with the indicators of these names (default: all), in the library's order; only these are computed.

    Case and outer blanks of names do not matter, columns of bars may be among them, and a name that is neither is
    refused before anything runs.
    """
    wanted = {n.lower().strip() for n in names} if names else set(INDICATORS)
    if unknown := sorted(wanted - set(INDICATORS) - set(BAR)):
        raise ValueError(f"unknown indicators: {', '.join(unknown)}")
    formulas = {n: f for n, f in INDICATORS.items() if n in wanted}
    return with_formulas(panel, formulas).select(*BAR, *formulas)
