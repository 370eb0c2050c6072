"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern is text in which ``*`` stands for any characters and ``^`` for a separator or an end of the url; ``||`` before it
ties it to the start of a host name or of one of its labels, ``|`` to the start or, behind it, to the end of the url. A
pattern blocks; with ``@@`` before it, it is an exception. Lines that begin with ``!`` are comments.

The literal tokens of a rule are the runs of letters and digits that must stand in a matching url as whole tokens. Each
rule is filed under the one that is rarest among the tokens of all urls. A url's tokens fetch the rules filed under them,
and only those run their regular expressions. A few rules make an index of constant size in the plan, which serves a
narrow pass; any more are a table that is joined by token. A rule without a literal token runs against every url.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, table

#: (verdict, host and path): a rule fits its host and all subdomains if the url's path starts with the rule's.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Pattern rules by what such lists block everywhere, whatever the host.
PATTERNS = (
    # gambling
    "^casino^", "^poker^", "^slots^", "^betting^", "^bets^", "^roulette^", "@@^poker^face^",
    # goods and services that are advertised in bulk
    "^pills^", "^viagra^", "^pharma*^discount^", "^payday^loans^", "^buy^followers^", "^seo^backlinks^", "^link^farm^", "^replica^watches^",
    # adult
    "||adult^", "||porn^", "||xxx^", "||sex^", "^porn^video^", "^adult^chat^", "@@^adult^education^",
    # advertising and tracking
    "^ads^", "||adserver^", "||adservice^", "||doubleclick.net^", "^banner^ad^", "^click^track^", "^affiliate^redirect^", "@@^ads.txt|",
    # abuse
    "||spam^", "@@^anti^spam^", "@@^spam^filter^", "^torrent^*^crack^", "^keygen^", "||warez^", "||phishing^",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are an index in the plan, more are a joined table.
PLAN_RULES = 1_000
#: Rules without a literal token run on every url, as part of the plan; more than these are refused.
MOST_LOOSE = 1_000
#: Regular expressions for what a separator, and the start of a host's label, are.
SEPARATOR, LEFT, LABEL = r"(?:[^a-z0-9]|\z)", r"(?:\A|[^a-z0-9])", r"\A[^/?#]*://(?:[^/?#]*[.@])?"


def regex_of(rule: str) -> str:
    """The regular expression of one rule, for the SQL twin; ``parse_rules`` makes the same of a table of them."""
    body = rule.removeprefix("@@")
    start = LABEL if body.startswith("||") else r"\A" if body.startswith("|") else ""
    body, end = body.lstrip("|"), r"\z" if body.endswith("|") else ""
    body = body.rstrip("|")
    if body.startswith("^") and not start:
        start, body = LEFT, body[1:]
    parts = {"*": ".*", "^": SEPARATOR}
    return "(?s)" + start + "".join(parts.get(c) or (c if c.isalnum() or not c.isascii() else "\\" + c) for c in body) + end


def parse_rules(rules: DataFrame, rule_col: str = "rule") -> DataFrame:
    """(rule, allow, regex, literals) of the distinct rules; nulls, empty lines and comments are none."""
    rows = rules.select(F.trim(lower_ascii(F.col(rule_col))).alias("rule")).where("rule <> '' and not startswith(rule, '!')").distinct()
    rows = rows.select("rule", F.col("rule").startswith("@@").alias("allow"), F.regexp_replace("rule", "^@@", "").alias("body"))
    start = F.when(F.col("body").startswith("||"), LABEL).when(F.col("body").startswith("|"), r"\A").otherwise("")
    end = F.when(F.col("body").endswith("|"), r"\z").otherwise("")
    rows = rows.select("rule", "allow", start.alias("start"), end.alias("end"), F.regexp_replace("body", r"^\|+|\|+$", "").alias("core"))
    free = (F.col("start") == "") & F.col("core").startswith("^")
    escaped = F.regexp_replace(F.when(free, F.expr("substring(core, 2)")).otherwise(F.col("core")), r"([!-)+-/:-@\[-\]_-`{-~])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"(?<!\[)\^", SEPARATOR.replace("\\", "\\\\"))
    # a run of letters and digits is a whole token unless a * or an open end can extend it
    marked = F.concat(F.when(F.col("start") == "", "*").otherwise("|"), F.col("core"), F.when(F.col("end") == "", "*").otherwise("|"))
    literals = F.array_distinct(F.regexp_extract_all(marked, F.lit("(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)))
    return rows.select("rule", "allow", F.concat(F.lit("(?s)"), F.when(free, LEFT).otherwise(F.col("start")), body, F.col("end")).alias("regex"), literals.alias("literals"))


def parse_local(patterns: tuple) -> list[tuple[str, bool, str, list[str]]]:
    """The same rows as ``parse_rules``, of a few rules in the program."""
    out = {}
    for text in patterns:
        rule = (text or "").translate(str.maketrans(UPPER, LOWER)).strip(" ")
        if rule and not rule.startswith("!"):
            body = rule.removeprefix("@@")
            core = re.sub(r"^\|+|\|+$", "", body)
            marked = ("|" if body.startswith("|") else "*") + core + ("|" if body.endswith("|") else "*")
            literals = list(dict.fromkeys(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", marked)))
            out[rule] = rule, rule.startswith("@@"), regex_of(rule), literals
    return list(out.values())


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file, a rule a line, as the table that ``judge_urls`` takes."""
    return spark.read.text(path).withColumnRenamed("value", "rule")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for null and for urls without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.filter(F.split(lower_ascii(url), "[^a-z0-9]+"), lambda t: t != "")


def host_rule(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first, so it comes last here
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def index_rules(rules: DataFrame, pages: DataFrame, url_col: str) -> DataFrame:
    """(token, regex, allow) of the rules with a literal token, each under the one that is in the fewest urls."""
    literals = rules.select("rule", F.explode("literals").alias("token"))
    tokens = pages.select(F.explode(F.array_distinct(url_tokens(F.col(url_col)))).alias("token"))
    often = tokens.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("short"), "token")
    rarest = literals.join(often, "token", "left").groupBy("rule").agg(F.min(rank)["token"].alias("token"))
    return rules.join(rarest, "rule").select("token", "regex", "allow")


def local_index(rules: list[tuple], pages: DataFrame, url_col: str) -> list[dict]:
    """The index of a few rules; one job counts their tokens in the urls."""
    literals = sorted({t for r in rules for t in r[3]})
    tokens = pages.select(F.explode(F.array_distinct(F.filter(url_tokens(F.col(url_col)), lambda t: t.isin(literals)))).alias("token")) if literals else None
    often = {r.token: r.n for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()} if literals else {}
    return [{"token": min(r[3], key=lambda t: (often.get(t, 0), -len(t), t)), "regex": r[2], "allow": r[1]} for r in rules if r[3]]


def plan_index(index: list) -> Column:
    """The index as an array of buckets of (token, regex, allow), by a hash of the token."""
    size = 1 << max(4, (2 * len(index)).bit_length())
    buckets: list[list] = [[] for _ in range(size)]
    for r in sorted(index, key=lambda r: (r["token"], r["regex"], r["allow"])):
        buckets[xxhash.xxh64_intdigest(r["token"].encode(), 42) % size].append(r)
    empty = F.array().cast("array<struct<token:string,regex:string,allow:boolean>>")
    return F.array(*[F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("token", "regex", "allow")]) for r in b]) if b else empty for b in buckets])


def _any(rules: Column, url: Column, allow: bool) -> Column:
    return F.coalesce(F.exists(rules, lambda r: (r["allow"] == allow) & F.rlike(url, r["regex"])), F.lit(False))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple = HOST_RULES, patterns: tuple | DataFrame = PATTERNS) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict (allow or block).

    The longest fitting host rule decides (of equally long ones with different verdicts the last in ``host_rules``); where
    none fits, a url that matches a pattern rule and no exception is blocked and any other allowed. ``patterns`` are rules
    or a table of them with a column ``rule``; repeated rules count once. A null url, or one without ``://``, has an empty
    host and path, and patterns alone can block it. Urls of any length are matched whole. Null ids stay null; repeated
    rows are judged alike; other columns are ignored. An empty table gives an empty result.
    """
    spark, few = pages.sparkSession, None
    if not isinstance(patterns, DataFrame):
        if len(patterns) <= PLAN_RULES:
            few = parse_local(patterns)
        else:
            patterns = spark.createDataFrame([(p,) for p in patterns], "rule string")
    if few is None:
        rules = staged(parse_rules(patterns), "url-rules")
        if rules.count() <= PLAN_RULES:
            few = [(r.rule, r.allow, r.regex, list(r.literals)) for r in rules.collect()]
    if few is not None:
        loose = [{"regex": r[2], "allow": r[1]} for r in few if not r[3]]
    else:
        loose = rules.where("size(literals) = 0").select("regex", "allow").limit(MOST_LOOSE + 1).collect()
        if len(loose) > MOST_LOOSE:
            raise ValueError(f"more than {MOST_LOOSE} rules have no literal token, and would run on every url")
    low = lower_ascii(F.coalesce(F.col(url_col), F.lit("")))
    host, path = host_and_path(F.col(url_col))
    id_ = F.col(id_col).alias("page_id")
    if few is not None:
        held = plan_index(local_index(few, pages, url_col))
        fetched = F.flatten(F.transform(url_tokens(low), lambda t: F.filter(F.element_at(held, (F.pmod(F.xxhash64(t), F.size(held)) + 1).cast("int")), lambda r: r["token"] == t)))
        rows = pages.select(id_, host.alias("host"), path.alias("path"), low.alias("low"), _any(fetched, low, False).alias("bad"), _any(fetched, low, True).alias("good"))
    else:
        rows = staged(pages.select(id_, host.alias("host"), path.alias("path"), low.alias("low"), F.monotonically_increasing_id().alias("row")), "urls")
        index = staged(index_rules(rules.where("size(literals) > 0"), pages, url_col), "url-index")
        tokens = rows.select("row", F.explode(F.array_distinct(url_tokens(F.col("low")))).alias("token"))
        fetched = tokens.join(index, "token").select("row", "regex", "allow")  # urls come to the hits, not to every token
        hits = fetched.join(rows.select("row", "low"), "row").where("rlike(low, regex)").groupBy("row").agg(F.bool_or(~F.col("allow")).alias("bad"), F.bool_or("allow").alias("good"))
        rows = rows.join(hits, "row", "left").withColumn("bad", F.coalesce("bad", F.lit(False))).withColumn("good", F.coalesce("good", F.lit(False)))
    if loose:
        more = F.array(*[F.struct(F.lit(r["regex"]).alias("regex"), F.lit(r["allow"]).alias("allow")) for r in loose])
        rows = rows.withColumn("bad", F.col("bad") | _any(more, F.col("low"), False)).withColumn("good", F.col("good") | _any(more, F.col("low"), True))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad") & ~F.col("good"), "block").otherwise("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def oracle_sql() -> str:
    """The same verdicts without an index: every pattern against every url."""
    by_length = sorted(HOST_RULES, key=lambda r: -len(r[1]))
    when = lambda value: " ".join(f"WHEN (host = '{t.partition('/')[0]}' OR host LIKE '%.{t.partition('/')[0]}') AND starts_with(path, '/{t.partition('/')[2]}') THEN '{value(v, t)}'" for v, t in by_length)
    matches = lambda allow: " OR ".join(f"regexp_matches(low, '{regex_of(p)}')" for p in PATTERNS if p.startswith("@@") == allow)
    bad = f"({matches(False)}) AND NOT ({matches(True)})"
    low = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    return f"""
WITH parts AS (
  SELECT page_id, {low("coalesce(url, '')")} AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, low, {low("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path, CASE {when(lambda v, t: t)} END AS rule,
       CASE {when(lambda v, t: v)} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict
FROM split"""
