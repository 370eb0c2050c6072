"""Functions of tables for SQL: ``SELECT * FROM swing_levels(TABLE(bars) PARTITION BY (symbol) ORDER BY (date), 3)``.

Each streams over the rows that it is given and holds a bounded number of them; partitions run in parallel.
"""

from __future__ import annotations

import datetime as dt
from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, SkipRestOfInputTableException


class LatestRows:
    """latest_rows(TABLE(t) PARTITION BY (key) ORDER BY (time DESC), n): the first n rows of each partition, all columns."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or n.isTable:
            raise ValueError("latest_rows takes a table and a number of rows")
        return AnalyzeResult(schema=rows.dataType)

    def __init__(self):
        self.seen = 0

    def eval(self, row: Row, n: int) -> Iterator[tuple]:
        if self.seen >= n:
            raise SkipRestOfInputTableException("enough rows")
        self.seen += 1
        yield tuple(row)


class MissingWeekdays:
    """missing_weekdays_of(TABLE(bars) PARTITION BY (symbol) ORDER BY (date), most): weekdays between a symbol's dates that have
    no row, the first ``most`` of each symbol; rows without a date are passed over."""

    def __init__(self):
        self.last, self.told = None, 0

    def eval(self, row: Row, most: int) -> Iterator[tuple[str, dt.date]]:
        day = row["date"]
        if isinstance(day, dt.datetime):
            day = day.date()
        if day is None:
            return
        at = self.last + dt.timedelta(days=1) if self.last else day
        while at < day and self.told < most:
            if at.weekday() < 5:
                self.told += 1
                yield row["symbol"], at
            at += dt.timedelta(days=1)
        self.last = day


class SwingLevels:
    """swing_levels(TABLE(bars) PARTITION BY (symbol) ORDER BY (date), span): highs that no high of the ``span`` bars before and
    after exceeds, and lows likewise; bars that lack a price are passed over, the first and last ``span`` bars are none."""

    def __init__(self):
        self.rows, self.span = deque(), 0

    def eval(self, row: Row, span: int) -> Iterator[tuple[str, dt.date, str, float]]:
        if row["high"] is None or row["low"] is None:
            return
        self.rows.append((row["symbol"], row["date"], row["high"], row["low"]))
        if len(self.rows) > 2 * span + 1:
            self.rows.popleft()
        if len(self.rows) == 2 * span + 1:
            symbol, day, high, low = self.rows[span]
            if high >= max(r[2] for r in self.rows):
                yield symbol, day, "high", float(high)
            if low <= min(r[3] for r in self.rows):
                yield symbol, day, "low", float(low)


class BarIssues:
    """bar_issues(TABLE(bars)): a row per fault of a bar: price_missing, price_not_positive, high_below_low, close_outside."""

    def eval(self, row: Row) -> Iterator[tuple[str, dt.date, str]]:
        prices = [row[c] for c in ("open", "high", "low", "close")]
        if any(p is None for p in prices):
            yield row["symbol"], row["date"], "price_missing"
            return
        o, h, low, c = prices
        if min(prices) <= 0:
            yield row["symbol"], row["date"], "price_not_positive"
        if h < low:
            yield row["symbol"], row["date"], "high_below_low"
        elif not low <= c <= h or not low <= o <= h:
            yield row["symbol"], row["date"], "close_outside"


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("latest_rows", udtf(LatestRows))
    spark.udtf.register("missing_weekdays_of", udtf(MissingWeekdays, returnType="symbol: string, date: date"))
    spark.udtf.register("swing_levels", udtf(SwingLevels, returnType="symbol: string, date: date, kind: string, price: double"))
    spark.udtf.register("bar_issues", udtf(BarIssues, returnType="symbol: string, date: date, issue: string"))
