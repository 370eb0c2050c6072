"""Symbols in texts against a plain search; table functions in SQL."""

import datetime as dt

import pytest

from tidemark.functions.table_functions import register
from tidemark.operators import aliases as A

NAMES = [("螺纹", "rb"), ("螺纹钢", "RB"), ("热卷", "HC"), ("铁矿石", "I"), ("黄金", "AU"), ("白银", "AG"), ("铜", "CU"), ("金铜", "XX")]
GROUPS = [("黑色系", ["rb", "HC", "I"]), ("贵金属", ["AU", "AG"]), ("空", [])]


@pytest.mark.parametrize(("text", "symbols"), [
    ("RB, HC, I", ["RB", "HC", "I"]), ("螺纹钢和热卷以及铁矿石", ["RB", "HC", "I"]), ("螺纹钢、热卷、螺纹", ["RB", "HC"]), ("除螺纹钢外的黑色系", ["HC", "I"]), ("除 RB，HC 之外的黑色系", ["I"]), ("贵金属", ["AU", "AG"]), ("除黄金和白银以外的贵金属", ["AU", "AG"]),
    ("看看 au 的走势", ["AU"]), ("黄金走势", ["AU"]), ("金铜铜", ["XX"]), ("空", []), ("", []), (None, []), ("nothing known here", []), ("，，", [])])
def test_rules(text, symbols):
    assert A.Resolver(NAMES, GROUPS).all(text) == symbols


def test_trie_equals_a_search_of_every_name(documents_text):
    names = [(text[i : i + n], f"S{n}{i}") for text in documents_text[:20] for n, i in ((3, 5), (5, 30), (5, 31), (9, 60), (1, 0))]
    trie, by_length = A.NameTrie(names), sorted(enumerate(names), key=lambda x: (-len(x[1][0]), x[0]))
    for text in documents_text:
        want = next((s for _, (n, s) in by_length if n and n in text), None)
        assert trie.longest(text) == want


@pytest.fixture(scope="module")
def documents_text(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()][:120]


def test_columns(spark):
    rows = spark.createDataFrame([("RB和铜", 1), (None, 2)], "text string, symbols_ int")
    names = spark.createDataFrame([(n, s, i) for i, (n, s) in enumerate(NAMES)], "name string, symbol string, place int")
    assert [r.symbols for r in A.with_symbols(rows, "text", names).orderBy("symbols_").collect()] == [["RB", "CU"], []]


def test_table_functions(spark):
    register(spark)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in (0, 1, 4, 7, 8)]
    rows = [("a", d, 1.0, h, low, 1.5) for d, h, low in zip(days, [2.0, 5.0, 3.0, 2.0, None], [1.0, 0.5, 1.0, -1.0, 1.0], strict=True)] + [("b", None, 1.0, 2.0, 1.0, 9.0)]
    spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double").createOrReplaceTempView("few_bars")
    ask = lambda q: sorted(map(tuple, spark.sql(q).collect()), key=str)
    assert ask("SELECT * FROM missing_weekdays_of(TABLE(few_bars) PARTITION BY (symbol) ORDER BY (date), 2)") == [("a", dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 4))]
    assert ask("SELECT date, kind, price FROM swing_levels(TABLE(few_bars) PARTITION BY (symbol) ORDER BY (date), 1)") == [(days[1], "high", 5.0), (days[1], "low", 0.5)]
    assert ask("SELECT date, issue FROM bar_issues(TABLE(few_bars))") == [(None, "close_outside"), (days[3], "price_not_positive"), (days[4], "price_missing")]
    assert ask("SELECT symbol, close FROM latest_rows(TABLE(few_bars) PARTITION BY (symbol) ORDER BY (date DESC), 1)") == [("a", 1.5), ("b", 9.0)]
    assert ask("SELECT * FROM latest_rows(TABLE(few_bars) PARTITION BY (symbol) ORDER BY (date), 0)") == []
