"""Symbols that texts speak of, found by a trie of their names.

A text is cut at commas, else at joining words; a part's symbol is its first code of one or two letters, else the longest
of the known names in it. A part between words of exclusion is taken out of a category that is named whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names and members of categories together at most: they are a dimension, broadcast to all tasks.
MOST_NAMES = 1_000_000
#: Words that part names, and those around what is left out.
COMMAS, JOINING, EXCLUDED = re.compile(r"[，,]"), re.compile(r"(?:和|与|及|以及|、)"), re.compile(r"除\s*(.+?)\s*(?:外|之外|以外)")
CODE = re.compile(r"\b([A-Z]{1,2})\b")


class NameTrie:
    """Finds the longest of many names in a text, in a walk from each of its places."""

    def __init__(self, names: list[tuple[str, str]]):
        self.root: dict = {}
        for place, (name, symbol) in enumerate(names):
            if name:
                node = self.root
                for c in name:
                    node = node.setdefault(c, {})
                node.setdefault("", (place, symbol))  # of equal names the first

    def longest(self, text: str) -> str | None:
        """The symbol of the longest name; of names of equal length the one that is listed first."""
        best = None
        for i in range(len(text)):
            node, j = self.root, i
            while j < len(text) and (node := node.get(text[j])) is not None:
                j += 1
                if "" in node:
                    place, symbol = node[""]
                    if best is None or (i - j, place) < best[:2]:
                        best = i - j, place, symbol
        return best and best[2]


class Resolver:
    """Symbols of texts, by the rules above; ``categories`` maps a keyword to its symbols, looked for in this order."""

    def __init__(self, names: list[tuple[str, str]], categories: list[tuple[str, list[str]]]):
        self.trie, self.categories = NameTrie(names), categories

    def one(self, text: str) -> str | None:
        text = text.strip()
        code = CODE.search(text.upper())
        symbol = code[1] if code else self.trie.longest(text)
        return symbol and symbol.upper()

    def parts(self, text: str) -> list[str]:
        found = (COMMAS if COMMAS.search(text) else JOINING).split(text)
        return [p.strip() for p in found if p.strip()]

    def all(self, text: str | None) -> list[str]:
        """In order of mention, each once; none for a null or empty text."""
        if not text:
            return []
        gone = EXCLUDED.search(text)
        excluded = {self.one(p) for p in self.parts(gone[1])} if gone else set()
        for keyword, members in self.categories:
            if keyword in text and (left := [m.upper() for m in members if m.upper() not in excluded]):
                return left
        parts = self.parts(text)
        found = list(dict.fromkeys(s for s in map(self.one, parts) if s)) if len(parts) >= 2 else []
        return found or [s for s in [self.one(text)] if s]


def with_symbols(rows: DataFrame, text_col: str, names: DataFrame, categories: DataFrame | None = None, out: str = "symbols") -> DataFrame:
    """``rows`` with ``out``: the symbols (array of strings) that the text speaks of, in order of mention.

    ``names`` has name, symbol and place (its rank among names of equal length); ``categories`` keyword, place and symbols
    (array). Both are collected once, by jobs that run here, refused above ``MOST_NAMES``, and broadcast as a trie.
    """
    listed = names.where("name <> '' AND symbol IS NOT NULL").orderBy("place", "name").select("name", "symbol").limit(MOST_NAMES + 1).collect()
    groups = categories.orderBy("place", "keyword").select("keyword", "symbols").limit(MOST_NAMES + 1).collect() if categories is not None else []
    if len(listed) + sum(len(g.symbols) for g in groups) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names and members of categories")
    resolver = rows.sparkSession.sparkContext.broadcast(Resolver([tuple(r) for r in listed], [(g.keyword, list(g.symbols)) for g in groups]))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([resolver.value.all(t) for t in texts])

    return rows.withColumn(out, found(F.col(text_col)))
