import duckdb
import pytest

from tidemark.llm import url_filter as U
from tidemark.llm.shared import table

DATA = "/root/testdata/sf0.01"


def test_matches_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = sorted(duckdb.sql(U.oracle_sql()).fetchall())
    assert sorted(map(tuple, U.judge_urls(table(spark, DATA, "pages")).collect())) == want


CASES = [
    ("http://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://x.net/a", "x.net", "/a", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"), ("http://planet/a", "planet", "/a", None, "allow"),
    ("https://a.example.com/de/1#z", "a.example.com", "/de/1", "example.com/de/", "block"), ("https://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"), ("https://www.casino-win.example.org/de/", "www.casino-win.example.org", "/de/", None, "block"),
    ("https://mycasino-winx.org/", "mycasino-winx.org", "/", None, "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x?u=http://q.org/casino-win/b", "q.org", "/casino-win/b", None, "block"), ("http://x.org/banner/ad/1", "x.org", "/banner/ad/1", None, "block"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert U.judge_urls(df.limit(0)).count() == 0


def rules_of(spark, *rules):
    return U.parse_rules(spark.createDataFrame([(r,) for r in rules], "rule string"))


def test_index_uses_the_rarest_literal(spark):
    df = spark.createDataFrame([("http://a.b/spam/x",), ("http://a.b/spam/farm",), ("http://a.b/spam/y",)], "url string")
    assert [r.token for r in U.index_rules(rules_of(spark, "^spam-farm^"), df, "url").collect()] == ["farm"]


def test_no_python(spark):
    plan = U.judge_urls(table(spark, DATA, "pages"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


SYNTAX = [
    ("||casino^", "http://casino.com/", True), ("||casino^", "http://www.casino-x.com/", True), ("||casino^", "http://x.com/casino", False), ("||casino^", "http://mycasino.com/", False),
    ("|http://a^", "http://a.b", True), ("|http://a^", "x?http://a.b", False), ("^txt|", "http://a/b.txt", True), ("^txt|", "http://a/b.txt?x", False), ("*abc*", "http://xabcy", True), ("/a(b)[c]+d$", "http://x/a(b)[c]+d$e", True),
    ("^a*^z^", "http://x/a1/z", True), ("^a*^z^", "http://x/a1/zz", False), ("é^x^", "http://q/é/x", True), ("ABC^", "http://q/xabc", True), ("^a^b^", "http://q/a/b", True), ("a_b`c^", "http://q/a_b`c", True), ("^q^", None, False), ("^x\\y^", "http://q/x\\y", True),
]


@pytest.mark.parametrize("most", [0, 1000])
def test_syntax(spark, monkeypatch, most):
    """In the plan and joined as a table alike; ``regex_of`` makes the same expressions."""
    monkeypatch.setattr(U, "PLAN_RULES", most)
    for rule, url, hit in SYNTAX[:: 3 if most else 1]:  # both ways take the same expressions
        df = spark.createDataFrame([(1, url)], "page_id long, url string")
        assert U.judge_urls(df, host_rules=(), patterns=(rule,)).first().verdict == ("block" if hit else "allow"), (rule, url)


def test_regexes_agree(spark):
    rules = [r for r, *_ in SYNTAX] + list(U.PATTERNS)
    made = {r.rule: r.regex for r in rules_of(spark, *rules).collect()}
    assert made == {r.lower(): U.regex_of(r.lower()) for r in rules}


def test_exceptions_comments_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a/ads/x"), (2, "http://a/ads.txt"), (3, "http://a/b")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(df, patterns=("^ads^", "^ads^", "@@^ads.txt|", "! ^b^", "", "  ")).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


@pytest.mark.parametrize("most", [0, 10_000])
def test_thousands_of_rules(spark, monkeypatch, most):
    """Random rules over the tokens of the urls and others, against every rule on every url."""
    import random
    import re

    monkeypatch.setattr(U, "PLAN_RULES", most)
    rng = random.Random(5)
    pages = table(spark, DATA, "pages")
    urls = {r.page_id: r.url for r in pages.collect()}
    tokens = sorted({t for u in urls.values() for t in re.findall("[a-z0-9]+", (u or "").lower())})
    word = lambda: rng.choice(tokens) if rng.random() < 0.3 else f"zz{rng.randint(0, 10**6)}"
    near = [t for u in urls.values() if u for t in [re.findall("[a-z0-9]+", u.lower())] for _ in range(2)]
    rules = [rng.choice(("", "", "@@")) + rng.choice(("^", "||", "")) + rng.choice(("^", "*")).join(t[k : k + 2]) + rng.choice(("^", "*", "|")) for t in rng.sample(near, 120) for k in [rng.randrange(len(t))]]
    rules += [rng.choice(("", "", "", "@@")) + rng.choice(("^", "||", "/", "")) + rng.choice(("^", "*", "*^", "/", ".", "-")).join(word() for _ in range(rng.randint(2, 3))) + rng.choice(("^", "*", "|", "/")) for _ in range(3000)]
    made = [(r.startswith("@@"), re.compile(U.regex_of(r).replace(r"\z", r"\Z"))) for r in rules]

    def brute(url):
        hits = [allow for allow, x in made if x.search((url or "").lower())]
        return "block" if False in hits and True not in hits else "allow"

    got = {r.page_id: r.verdict for r in U.judge_urls(pages, host_rules=(), patterns=tuple(rules)).collect()}
    assert got == {i: brute(u) for i, u in urls.items()} and "block" in got.values()


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! a list\n^casino^\n@@^casino^royale^\n")
    rules = spark.read.text(str(tmp_path)).withColumnRenamed("value", "rule")
    df = spark.createDataFrame([(1, "http://casino.x/"), (2, "http://x/casino-royale"), (None, None), (4, "http://x/" + "a/" * 100_000 + "casino")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge_urls(df, host_rules=(), patterns=rules).collect()} == {1: "block", 2: "allow", None: "allow", 4: "block"}


def test_rules_parsed_here_and_in_a_table_are_the_same(spark):
    lines = [*U.PATTERNS, "  ^Shop*deal^ ", "|https://a.b/c?d|", "||x.y^z", "! a comment", "", "*", "a*b", "^a^*^b^", "@@||q^", "a.(b)+[c]{d}$e\\f", "^casino^", None]
    table_ = {(r.rule, r.allow, r.regex, tuple(r.literals)) for r in U.parse_rules(spark.createDataFrame([(x,) for x in lines], "rule string")).collect()}
    assert {(*r[:3], tuple(r[3])) for r in U.parse_local(tuple(lines))} == table_


def test_a_rule_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! list\n^forum^spam^\n\n@@^forum^spam^report^\n")
    pages = spark.createDataFrame([(1, "http://a.de/forum/spam/x"), (2, "http://a.de/forum/spam/report/1"), (3, "http://news.de/spam-report"), (4, None)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, patterns=U.read_rules(spark, str(tmp_path / "rules.txt"))).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_clean_urls_stay(spark):
    """Words of the rules in the paths of ordinary pages."""
    clean = ["news.de/spam-report", "school.org/adult-learning", "museum.fr/xxx-century", "blog.de/phishing-explained", "library.io/warez-history", "uni.edu/anti-spam", "paper.com/spam/filter", "shop.de/adult/education"]
    bad = ["spam.example.org/x", "www.xxx.com/", "porn.site/", "a.de/casino/play", "ads.example.de/ads/1", "a.de/porn/video/1"]
    pages = spark.createDataFrame(list(enumerate(f"https://{u}" for u in clean + bad)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, host_rules=()).collect()}
    assert [got[i] for i in range(len(got))] == ["allow"] * len(clean) + ["block"] * len(bad)


def test_too_many_rules_for_every_url(spark, monkeypatch):
    monkeypatch.setattr(U, "PLAN_RULES", 2)
    monkeypatch.setattr(U, "MOST_LOOSE", 3)
    with pytest.raises(ValueError):
        U.judge_urls(spark.createDataFrame([(1, "u")], "page_id long, url string"), patterns=("a*", "b*", "c*", "d*"))
