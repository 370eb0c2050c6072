"""Everyday operators on market tables: cleaning, provider mapping, fallbacks, lookups, alerts' context, health, checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.series import div
from tidemark.operators.blocks import BLOCK_ROWS, deal_with_cuts

# ---------------------------------------------------------------- cleaning and mapping


def finite(rows: DataFrame) -> DataFrame:
    """Infinite and NaN doubles become NULL."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return rows.select(*[F.when(~bad(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])


def clean_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes (symbol, price, prev_close, change_percent) with a symbol and a positive price; a missing change is derived."""
    derived = div(F.col("price") - F.col("prev_close"), F.when(F.col("prev_close") > 0, F.col("prev_close"))) * 100
    return quotes.where("symbol IS NOT NULL AND price > 0").withColumn("change_percent", F.coalesce("change_percent", derived))


def adapt(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A provider's rows under the library's names: an SQL expression per name; what cannot be cast is NULL."""
    return rows.select(*[F.expr(e).alias(n) for n, e in mapping.items()])


#: Names of providers' fields; numbers come as text and may be empty.
PROVIDERS = {
    "daily": {"ts_code": "ts_code", "date": "try_to_timestamp(trade_date, 'yyyyMMdd')", **{n: f"try_cast({n} AS DOUBLE)" for n in ("open", "high", "low", "close")}, "volume": "try_cast(vol AS DOUBLE)", "amount": "try_cast(amount AS DOUBLE)", "open_interest": "try_cast(oi AS DOUBLE)"},
    "quote": {"symbol": "upper(symbol)", "price": "try_cast(current_price AS DOUBLE)", "prev_close": "try_cast(last_close AS DOUBLE)", "volume": "try_cast(volume AS DOUBLE)"},
}


def source_of(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that is there, and the name of where it came from."""
    value = F.coalesce(*[c for _, c in sources])
    name = reduce(lambda rest, s: F.when(s[1].isNotNull(), s[0]).otherwise(rest), reversed(sources), F.lit("unavailable"))
    return value, name


def to_tick(price: Column, tick: float) -> Column:
    """The price rounded to ticks, half to even."""
    return F.bround(price / tick) * tick


# ---------------------------------------------------------------- filters, limits, order


def since(rows: DataFrame, date, trading: str = "trading_date", time: str = "ts") -> DataFrame:
    """Rows whose trading date, or else whose time's date, is not before ``date``."""
    return rows.where(F.coalesce(F.col(trading), F.to_date(time)) >= F.lit(date))


def by_prefix(rows: DataFrame, column: str, *prefixes: str) -> DataFrame:
    """Rows that begin with the first prefix that any row begins with."""
    rank = reduce(lambda rest, p: F.when(F.col(column).startswith(p[1]), p[0]).otherwise(rest), reversed(list(enumerate(prefixes))), F.lit(None).cast("int"))
    ranked = rows.withColumn("_rank", rank).where("_rank IS NOT NULL")
    best = ranked.agg(F.min("_rank").alias("_best"))
    return ranked.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def moving(quotes: DataFrame, side: str) -> DataFrame:
    """Quotes with data that rose or stayed (up), or fell (down)."""
    return quotes.where(F.col("price").isNotNull() & ((F.col("change_percent") >= 0) if side == "up" else (F.col("change_percent") < 0)))


def visible(rows: DataFrame, user: int, owner: str = "owner") -> DataFrame:
    """Rows that are everyone's (no owner) or the user's own."""
    return rows.where(F.col(owner).isNull() | (F.col(owner) == user))


def clamped(rows: DataFrame, n: int, most: int = 500) -> DataFrame:
    return rows.limit(min(max(n, 1), most))


def sampled(rows: DataFrame, key: str, of: int, take: int) -> DataFrame:
    """``take`` in ``of`` rows, by a hash of the key: the same ones every time."""
    return rows.where(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(of)) < take)


def ordered_by(rows: DataFrame, column: str, allowed: set[str], descending: bool, tie: str) -> DataFrame:
    """Rows by one of the allowed columns, missing values as 0, ties by ``tie``."""
    if column not in allowed:
        raise ValueError(f"{column} is no column to sort by")
    v = F.coalesce(F.col(column), F.lit(0))
    return rows.orderBy(v.desc() if descending else v.asc(), tie)


# ---------------------------------------------------------------- joins


def supplemented(bars: DataFrame, daily: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Bars with missing ``columns`` filled from daily rows of equal keys; only daily rows that a bar needs travel."""
    extra = daily.join(bars.select(*keys).distinct(), keys, "left_semi").select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    j = bars.join(extra, keys, "left")
    return j.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(bars.columns)


def with_user_state(events: DataFrame, states: DataFrame, user: int) -> DataFrame:
    """Events with one user's state of them, where there is one."""
    own = states.where(F.col("user_id") == user).select("event_id", "state")
    return events.join(own, "event_id", "left")


def deviating(quotes: DataFrame, bars: DataFrame, limit: float = 0.01) -> DataFrame:
    """(symbol, price, close, deviation): quotes further than ``limit`` from the symbol's latest close."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    j = quotes.join(last, "symbol").withColumn("deviation", div(F.abs(F.col("price") - F.col("close")), F.when(F.col("close") != 0, F.abs("close"))))
    return j.where(F.col("deviation") > limit).select("symbol", "price", "close", "deviation")


def resolved(rows: DataFrame, contracts: DataFrame, code: str = "code") -> DataFrame:
    """``contract_id`` of a code, by the contracts' symbol, else by their exchange code."""
    by = lambda column, out: contracts.groupBy(F.col(column).alias(code)).agg(F.min("contract_id").alias(out))
    j = rows.join(by("symbol", "_a"), code, "left").join(by("ts_code", "_b"), code, "left")
    return j.withColumn("contract_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def looked_up(asked: DataFrame, quotes: DataFrame) -> DataFrame:
    """The symbols of ``asked`` (place, symbol) with their quotes; ``found`` is false where there is none."""
    q = quotes.withColumn("found", F.lit(True))
    return asked.join(q, "symbol", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def tagged_union(parts: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """(key, kind, value) of several small tables about one thing."""
    return reduce(DataFrame.unionByName, [df.select(F.col(key).alias("key"), F.lit(kind).alias("kind"), F.col(value).cast("string").alias("value")) for kind, df in parts.items()])


def children_of(edges: DataFrame, root, parent: str = "parent", child: str = "child") -> DataFrame:
    """(node, depth) of all that hangs below ``root``, by a recursive query over a parent and child table.

    A node that several paths lead to comes once for each; a path ends where it would come back to one of its own nodes.
    """
    spark, name = edges.sparkSession, f"tidemark_edges_{uuid.uuid4().hex}"
    kind = dict(edges.dtypes)[child]
    edges.select(F.col(parent).cast(kind).alias("parent"), F.col(child).alias("child")).createOrReplaceTempView(name)
    try:
        return spark.sql(f"""WITH RECURSIVE t(node, depth, path) AS (SELECT CAST(:root AS {kind}), 0, array(CAST(:root AS {kind}))
 UNION ALL SELECT e.child, t.depth + 1, array_append(t.path, e.child) FROM t JOIN {name} e ON e.parent = t.node WHERE NOT array_contains(t.path, e.child)) SELECT node, depth FROM t""", args={"root": root})
    finally:
        spark.catalog.dropTempView(name)


# ---------------------------------------------------------------- aggregates


def most_frequent(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the commonest value of each group, of equally common ones the least."""
    n = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(by, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def latest_rollup(rows: DataFrame, n: int, date: str, tie: str, value: str) -> DataFrame:
    """(date, total, n): sums per date over the latest n rows."""
    last = rows.orderBy(F.desc(date), tie).limit(n)
    return last.groupBy(F.col(date).alias("date")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def collection_health(runs: DataFrame, now, hours: int = 24) -> DataFrame:
    """One row: total, success, failed, mean duration and last success of runs (ts, status, seconds) of the last hours."""
    recent = runs.where(F.col("ts") >= F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))
    ok = F.col("status") == "success"
    return recent.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("success"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.avg("seconds").alias("mean_seconds"), F.max(F.when(ok, F.col("ts"))).alias("last_success"))


def health(quotes: DataFrame, limit: float) -> DataFrame:
    """One row: quotes, stale ones and the state: healthy, degraded up to a fifth of stale ones, else unhealthy."""
    stale = F.count(F.when(F.coalesce(F.col("age"), F.lit(float("inf"))) > limit, 1))
    r = quotes.agg(F.count(F.lit(1)).alias("total"), stale.alias("stale"))
    return r.withColumn("state", F.when(F.col("total") == 0, "unhealthy").when(F.col("stale") == 0, "healthy").when(F.col("stale") / F.col("total") <= 0.2, "degraded").otherwise("unhealthy"))


def severity(text: Column, critical: str, high: str) -> Column:
    """The severity of a text by two patterns of words."""
    return F.when(text.rlike(critical), "critical").when(text.rlike(high), "high")


def diversity(population: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of distinct individuals."""
    print_ = F.md5(F.to_json(F.struct(*columns)))
    return population.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(print_).alias("distinct")).withColumn("diversity", F.coalesce(div(F.col("distinct"), F.col("n")), F.lit(0.0)))


# ---------------------------------------------------------------- text sources


def new_articles(items: DataFrame, stored: DataFrame, longest: int = 500) -> DataFrame:
    """Items (url, title, body) whose url is not stored, one per url (the least title), bodies cut to a length."""
    one = items.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("title", "body")).alias("x")).select("url", "x.*")
    return one.join(stored.select("url").distinct(), "url", "left_anti").withColumn("body", F.substring("body", 1, longest))


# ---------------------------------------------------------------- checks of tables


def panel_checks(panel: DataFrame, rolls: DataFrame) -> DataFrame:
    """(check, severity, count) of a derived panel: rows without lineage, prices that are not positive, contracts that
    change on a date without a roll. ``rolls`` has symbol and date."""
    w = Window.partitionBy("symbol").orderBy("date")
    r = panel.withColumn("_before", F.lag("contract").over(w))
    changed = r.where("_before IS NOT NULL AND _before <> contract").join(rolls.select("symbol", "date"), ["symbol", "date"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
    one = panel.agg(F.count(F.when(F.col("lineage").isNull(), 1)).alias("a"), F.count(F.when(F.least("open", "high", "low", "close") <= 0, 1)).alias("b"))
    row = one.join(F.broadcast(changed), F.lit(True))  # one row each
    each = lambda name, level, c: F.struct(F.lit(name).alias("check"), F.lit(level).alias("severity"), F.col(c).alias("count"))
    return row.select(F.inline(F.array(each("lineage_missing", "warning", "a"), each("non_positive_price", "bad", "b"), each("unexplained_contract", "bad", "n"))))


def verification(bars: DataFrame, least_rows: int) -> DataFrame:
    """(symbol, n_rows, first_date, last_date, zero_volume, invalid, complete): a day's check of stored bars."""
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close"))
    r = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.when(F.col("volume") == 0, 1)).alias("zero_volume"), F.count(F.when(bad, 1)).alias("invalid"))
    return r.withColumn("complete", (F.col("n_rows") >= least_rows) & (F.col("zero_volume") == 0) & (F.col("invalid") == 0))


def rehearsal(original: DataFrame, copy: DataFrame, keys: list[str], group: str, parent: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """(group, rows, copied, missing, extra, same_bounds, duplicates, orphans): a copy held against its original.

    One full outer join by key counts what each side lacks; ``parent`` is what a copied row must refer to.
    """
    side = lambda df, n: df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias(n))
    both = side(original, "a").join(side(copy, "b"), [*keys, group], "full").fillna(0, ["a", "b"])
    k = F.struct(*keys)
    least, most = (lambda c, f: f(F.when(F.col(c) > 0, k))), (F.min, F.max)
    out = both.groupBy(group).agg(
        F.sum("a").alias("rows"), F.sum("b").alias("copied"), F.count(F.when(F.col("b") == 0, 1)).alias("missing"), F.count(F.when(F.col("a") == 0, 1)).alias("extra"),
        (least("a", most[0]).eqNullSafe(least("b", most[0])) & least("a", most[1]).eqNullSafe(least("b", most[1]))).alias("same_bounds"), F.sum(F.greatest(F.col("b") - 1, F.lit(0))).alias("duplicates"))
    if parent is None:
        return out.withColumn("orphans", F.lit(0).cast("long"))
    lost = copy.join(parent.select(F.col(parent_key)), parent_key, "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("orphans"))
    return out.join(lost, group, "left").fillna(0, ["orphans"])


#: Failures in a row that open a breaker, and those from which its window of ten results is full of them.
TRIPS, FULL = 5, 10


def breaker_steps(state: np.ndarray, late: bool, ok: bool, opens: np.ndarray | None = None) -> np.ndarray:
    """The failures counted after a call, from those before it (one number, or all 0 to 10 at once).

    ``late``: the cool-down since the last failure has passed, which starts the count anew, but not once the window of
    results is full. ``opens`` takes up whether the breaker refuses the call.
    """
    tripped = state >= TRIPS
    stays = tripped & ((state >= FULL) | (not late))
    if opens is not None:
        opens[:] = stays
    if ok:
        return np.zeros_like(state)
    return np.minimum(np.where(tripped & ~stays, 0, state) + 1, FULL)


def failures_before(late: np.ndarray, ok: np.ndarray, first: np.ndarray, start: np.ndarray, carried: int) -> np.ndarray:
    """The failures counted before each call, of sources one after the other in the order of their calls.

    ``first`` marks the calls that start from ``start``; ``carried`` is the count before the very first call if that is
    not one. A count climbs from call to call until a success; only one that trips is followed a call at a time.
    """
    begins = first.copy()
    begins[1:] |= ok[:-1]
    begins[0] = True
    at = np.flatnonzero(begins)
    length = np.diff(at, append=len(ok))
    state = np.where(first[at], start[at], 0)
    if not first[0]:
        state[0] = carried
    before = np.arange(len(ok)) + np.repeat(state - at, length)
    for i in np.flatnonzero(state + length > TRIPS):
        low, end = at[i] + max(TRIPS - state[i], 0), at[i] + length[i]
        count = before[low]
        for j in range(low, end):
            if count >= FULL:
                before[j:end] = FULL
                break
            before[j] = count
            count = 1 if count >= TRIPS and late[j] else count + 1
    return before


def breaker(calls: DataFrame, cool_down: int = 600, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Calls (source, ts in seconds, call_id, ok) with ``tripped`` and ``open``.

    Failures are counted until a success. From the fifth on the breaker is open, until ``cool_down`` seconds have passed
    since the last one: the next call is let through and the count starts anew. After ten failures without a success the
    rate of failures keeps it open. ``open`` is what a call finds, ``tripped`` whether it leaves it open by failing.

    The calls of all sources are sorted within partitions and pass through the workers as they come, batch after batch,
    so a source costs nothing of its own. The count is a machine of eleven states: of a source of very many calls a block
    is a map of them, maps are composed over its blocks in order, and each block starts from its state. So such a source
    is spread over tasks; sources of one block need none of this.
    """
    states = np.arange(FULL + 1)
    dealt = deal_with_cuts(calls, block_rows, "source", "ts")
    key = T.StructType([dealt.schema["source"], T.StructField("_block", T.IntegerType())])
    fields = lambda **types: T.StructType([*key.fields, *[T.StructField(n, t) for n, t in types.items()]])

    def maps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "call_id"])
        late, ok = np.diff(rows["ts"].to_numpy(dtype=float), prepend=np.nan) >= cool_down, rows["ok"].to_numpy(dtype=bool)
        done = np.flatnonzero(ok[1:])
        state, first = (np.zeros_like(states), done[-1] + 2) if len(done) else (states, 1)
        for i in range(first, len(ok)):
            if state.min() >= FULL:
                break
            state = breaker_steps(state, late[i], ok[i])
        return pd.DataFrame([(rows["source"].iloc[0], rows["_block"].iloc[0], float(rows["ts"].iloc[0]), float(rows["ts"].iloc[-1]), bool(ok[0]), state.tolist())], columns=["source", "_block", "first", "last", "ok", "map"])

    def starts(blocks: pd.DataFrame) -> pd.DataFrame:
        out, state, last = [], np.zeros(1, dtype=int), None
        for b in blocks.sort_values("_block").itertuples(index=False):
            out.append((b[0], b[1], int(state[0]), last))
            state = breaker_steps(state, last is not None and b[2] - last >= cool_down, b[4])
            state, last = np.asarray(b[5])[state], b[3]
        return pd.DataFrame(out, columns=["source", "_block", "_state", "_last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            late, ok, first, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_late", "_fine", "_first", "_start"))
            before = failures_before(late, ok, first, start, carried)
            tripped = before >= TRIPS
            stays = tripped & (~late | (before >= FULL))
            after = np.where(ok, 0, np.minimum(np.where(tripped & ~stays, 0, before) + 1, FULL))
            carried = int(after[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(after >= TRIPS), pa.array(stays)], names=[*batch.schema.names[:own], "tripped", "open"])

    number, own = T.DoubleType(), len(calls.columns)
    slim = dealt.where("_cuts IS NOT NULL").select("source", "_block", F.col("ts").cast("double").alias("ts"), "call_id", "ok")
    mapped = slim.groupBy("source", "_block").applyInPandas(maps, fields(first=number, last=number, ok=T.BooleanType(), map=T.ArrayType(T.IntegerType())))
    began = mapped.groupBy("source").applyInPandas(starts, fields(_state=T.IntegerType(), _last=number))
    few = began.where("_block > 0").select(F.col("source").alias("_of"), F.col("_block").alias("_at"), "_state", "_last")  # a row per block of many rows
    placed = dealt.drop("_cuts").join(F.broadcast(few), F.col("source").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_at")), "left")
    order = [F.asc_nulls_last("ts"), F.asc_nulls_last("call_id")]
    calls_in_order = placed.repartition("source", "_block").sortWithinPartitions("source", "_block", *order)
    w = Window.partitionBy("source", "_block").orderBy(*order)
    before, first = F.lag(F.col("ts").cast("double")).over(w), F.row_number().over(w) == 1
    gap = F.col("ts").cast("double") - F.when(first, F.col("_last")).otherwise(before)
    late = F.coalesce((gap >= cool_down) & ~F.isnan(gap), F.lit(False))
    ready = calls_in_order.select(*calls.columns, late.alias("_late"), F.coalesce("ok", F.lit(False)).alias("_fine"), first.alias("_first"), F.coalesce("_state", F.lit(0)).alias("_start"))
    out = T.StructType([*calls.schema.fields, T.StructField("tripped", T.BooleanType()), T.StructField("open", T.BooleanType())])
    return ready.mapInArrow(run, out)
