"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are),
normalised. The exponent nearest 1 that reaches the target entropy is found by bisection, but it never goes so low that
the most repeated source would exceed the repetition limit. The weights are realised as passes over blocks: every
source's documents lie in hash blocks; a pass takes the blocks in an order that changes from pass to pass, and the last,
partial pass ends where the source's token budget does, inside one block. Without a budget the smallest one is used at
which every source gets at least one whole pass, so nothing is lost and small sources are repeated.

Tokens are those of the tokenizer, counted once per row. No weight, block or row is gathered on the driver: exponents are judged by aggregating the table of source totals.
"""

from __future__ import annotations

from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import cut, own_columns, spare_name, table
from tidemark.llm.token_ids import default_tokenizer, encoded

#: Hash blocks per source.
BLOCKS = 4096
#: Share of the largest possible entropy, log(number of sources), to reach; most passes of a source for each of another.
TARGET_ENTROPY, REPEAT_LIMIT = 0.9, 2.0
SEED = 17
#: The query's target, which even sources fall short of, and its budget as a multiple of the corpus: whole and partial passes.
QUERY_ENTROPY, QUERY_BUDGET = 0.9999, 1.5
#: Exponents judged at once, and rounds: the bisection narrows by 16 a round.
SECTIONS, ROUNDS = 16, 7
#: A table of per-source plans is broadcast only up to this many rows (some 10 MB).
MOST_BROADCAST = 100_000


def n_tokens(text: Column, tokenizer: str | None = None) -> Column:
    """Token ids of a whole text; 0 for null."""
    path = tokenizer or default_tokenizer()

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) // 4 for ids in encoded(path, texts)], dtype="int64")

    return count(text)


def fit_exponent(totals: DataFrame, target_entropy: float, repeat_limit: float) -> float:
    """The exponent for a table of (tokens) per source: bisects on the share of the largest entropy and on repetition.

    Sources without tokens take no part. One source, or none, needs no mixing: 1.
    """
    t = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    n, least, most = t.agg(F.count("t"), F.min("t"), F.max("t")).first()
    if n < 2 or least == most:
        return 1.0

    def entropies(exponents: list[float]) -> list[float]:
        """Of normalised weights w: log Z - sum(x log x) / Z for x = (t / most)^exponent and Z = sum x."""
        x = [F.pow(F.col("t") / F.lit(most), F.lit(e)) for e in exponents]
        aggs = [a for v, e in zip(x, exponents, strict=True) for a in (F.sum(v), F.sum(v * F.lit(e) * F.log(F.col("t") / F.lit(most))))]
        row = t.agg(*[a.alias(str(i)) for i, a in enumerate(aggs)]).first()
        return [float(log(z) - s / z) for z, s in zip(row[::2], row[1::2], strict=True)]

    low, high = 0.0, 1.0  # entropy falls as the exponent rises
    wanted = target_entropy * log(n)
    if entropies([1.0])[0] >= wanted:
        low = 1.0
    else:
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
            enough = [e for e, h in zip(grid, entropies(grid), strict=True) if h >= wanted]
            low = max(enough, default=low)
            high = min([e for e in grid if e > low], default=high)
    # passes of a source per pass of another: at most (most / least)^(1 - exponent)
    by_limit = 1.0 - log(repeat_limit) / log(most / least)
    return min(1.0, max(low, by_limit, 0.0))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", *, tokens_col: str | None = None, tokenizer: str | None = None, budget: float | None = None, target_entropy: float = TARGET_ENTROPY, repeat_limit: float = REPEAT_LIMIT, seed: int = SEED, plan_columns: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its source's passes reach it, with all their columns.

    ``tokens_col`` is a column of ``docs`` with token counts; without it the texts are counted. With ``plan_columns``:
    also mix_tokens, mix_weight (of the source), mix_pass (from 1), mix_block (the block's place in the pass, a hash
    order) and mix_place (the row's in its block); sorting by the last three interleaves a pass. Without them the rows
    come in that order, dealt to partitions by range, so that a reader of the files meets the blocks as permuted.

    A null source is a source of its own. A null or empty text has no tokens; its row takes part in whole passes, and
    a source without any tokens gets one pass. Rows of equal id in a source share their place, so a partial pass takes all
    or none of them. A row without an id is placed by its text and its number in the scan, so each has a place of its
    own; where the rows of ``docs`` come in a changing order, the partial pass may take others of them. Plan columns are
    named apart from any column that ``docs`` has already. An empty table gives an empty result.
    """
    key = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    names = {n: spare_name(docs, f"mix_{n}") for n in ("source", "tokens", "place", "block", "weight", "pass", "row", "plan")}
    numbered = docs.withColumn(names["row"], F.monotonically_increasing_id())

    def by_id(seed: int) -> Column:
        return F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col))).otherwise(F.xxhash64(F.lit(seed), F.col(text_col) if text_col in docs.columns else F.lit(""), F.col(names["row"])))

    place, block = by_id(seed), F.pmod(by_id(seed + 1), F.lit(BLOCKS))
    tokens = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long")) if tokens_col else n_tokens(F.col(text_col), tokenizer)

    slim = cut(numbered.select(key.alias("source"), block.alias("block"), place.alias("place"), tokens.alias("tokens")))
    blocks = cut(slim.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")))
    totals = cut(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    exponent = fit_exponent(totals, target_entropy, repeat_limit)

    share = F.pow(F.col("tokens").cast("double"), F.lit(exponent))
    with_any = totals.where("tokens > 0")
    z, ratio = with_any.agg(F.sum(share), F.max(F.col("tokens") / share)).first()
    spend = budget if budget is not None else (ratio or 0.0) * (z or 0.0)
    passes = F.when(F.col("tokens") > 0, share / F.lit(z or 1.0) * F.lit(spend) / F.col("tokens")).otherwise(1.0)
    passes = F.when(F.abs(passes - F.round(passes)) < 1e-9, F.round(passes)).otherwise(passes)
    sources = totals.select("source", (share / F.lit(z or 1.0)).alias("weight"), F.floor(passes).alias("whole"), ((passes - F.floor(passes)) * F.col("tokens")).alias("rest"))

    # the partial pass: blocks in its order until the rest is spent, the last of them in part
    def order(source: Column, nth: Column, block: Column) -> Column:
        return F.xxhash64(F.lit(seed + 2), source, nth, block)

    turn = order(F.col("source"), F.col("whole") + 1, F.col("block"))
    upto = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    spent = blocks.join(sources, "source").withColumn("turn", turn).withColumn("upto", F.sum("tokens").over(upto))
    last = spent.where("upto > rest and upto - tokens <= rest and rest > 0").groupBy("source").agg(
        F.min(F.struct("turn", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("last")).select("source", "last.*")
    within = Window.partitionBy("source").orderBy("place")
    reached = slim.join(last, ["source", "block"]).withColumn("sum", F.sum("tokens").over(within)).where("sum <= left").groupBy("source").agg(F.max("place").alias("cutoff"))
    plan = cut(sources.join(last.select("source", "turn", F.col("block").alias("last_block")), "source", "left").join(reached, "source", "left"))
    if plan.count() <= MOST_BROADCAST:
        plan = F.broadcast(plan)

    plan = plan.select(F.col("source").alias(names["source"]), F.struct("weight", "whole", "rest", "turn", "last_block", "cutoff").alias(names["plan"]))
    rows = numbered.withColumn(names["source"], key).join(plan, names["source"])
    p = F.col(names["plan"])
    own_turn = order(F.col(names["source"]), p["whole"] + 1, block)
    before = (own_turn < p["turn"]) | ((own_turn == p["turn"]) & (block < p["last_block"]))
    more = F.when(before | ((block == p["last_block"]) & (place <= p["cutoff"])), 1).otherwise(0)
    more = F.when(p["rest"] > 0, F.when(p["turn"].isNull(), 1).otherwise(F.coalesce(more, F.lit(0)))).otherwise(0)
    rows = rows.withColumn(names["pass"], F.explode(F.when(p["whole"] + more > 0, F.sequence(F.lit(1).cast("long"), p["whole"] + more))))
    turned = order(F.col(names["source"]), F.col(names["pass"]), block)
    if not plan_columns:
        rows = rows.withColumn(names["block"], turned).withColumn(names["place"], place)
        by = [names[n] for n in ("pass", "block", "place", "row")]
        return rows.repartitionByRange(*by).sortWithinPartitions(*by).select(own_columns(docs))
    return rows.select(*own_columns(docs), tokens.alias(names["tokens"]), p["weight"].alias(names["weight"]), F.col(names["pass"]), turned.alias(names["block"]), place.alias(names["place"]))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = cut(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens")))
    budget = QUERY_BUDGET * (counted.agg(F.sum("n_tokens")).first()[0] or 0)
    mixed = mix(counted, tokens_col="n_tokens", budget=budget, target_entropy=QUERY_ENTROPY)
    return mixed.select("doc_id", "source", "n_tokens", F.col("mix_weight").alias("weight"), F.col("mix_pass").alias("pass"), F.col("mix_block").alias("block_order"), F.col("mix_place").alias("place"))
