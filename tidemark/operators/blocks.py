"""Series of a key dealt in blocks, so that one symbol's rows need not lie in one task.

``deal`` cuts the rows of each key at approximate quantiles of their order, as many blocks as its rows ask for; a block is
a task's unit of work. What crosses a block's edge is small and of three kinds:

* running totals (sums, peaks, last known values): a block's total is one row, and what lies before a block is a window
  over these rows;
* recursive averages: a block is one affine map of the average that comes in, maps are composed over the blocks of a key
  in order, and a second pass starts each block from the average that reaches it;
* windows of n rows: a block gets the n - 1 rows before it as a halo, which is dropped once the windows are computed.

The tables of cuts, starts and carried states have at most one entry per block, that is per ``block_rows`` rows of input,
and are broadcast on that ground. Keys of few rows have one block and carry nothing.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, about; blocks of a key at most (a block grows beyond that).
BLOCK_ROWS, MOST_BLOCKS = 1_000_000, 1024
BLOCK = "_block"


def deal(rows: DataFrame, block_rows: int = BLOCK_ROWS, by: str = "symbol", at: str = "date") -> DataFrame:
    """Adds ``_block``: 0, 1, ... in the order of ``at`` (a date, time or number) within each ``by``.

    Rows of equal ``at`` share a block; rows without one are in block 0, as is every row of a key that has few. A null
    key is a key like any other. The rows are scanned once to count the keys and once for the cuts of those of many rows.
    """
    return deal_with_cuts(rows, block_rows, by, at).drop("_cuts")


def deal_with_cuts(rows: DataFrame, block_rows: int, by: str, at: str) -> DataFrame:
    """As ``deal``, with the least ``at`` of the blocks after the first as ``_cuts``: null for a key of few rows."""
    # quantiles are asked of keys of many rows only, else a thousand numbers are made for each of very many small keys
    many = rows.groupBy(F.col(by).alias("_by")).agg(F.count(at).alias("_n")).where(F.col("_n") > block_rows)
    shares = F.array(*[F.lit(i / MOST_BLOCKS) for i in range(1, MOST_BLOCKS)])
    theirs = rows.select(F.col(by).alias("_key"), F.col(at).alias("_at")).join(F.broadcast(many), F.col("_key").eqNullSafe(F.col("_by")))
    found = theirs.groupBy("_by").agg(F.first("_n").alias("_n"), F.percentile_approx("_at", shares, 20 * MOST_BLOCKS).alias("_q"))
    known = found.withColumn("_k", F.least(F.ceil(F.col("_n") / block_rows), F.lit(MOST_BLOCKS)).cast("int")).where("_k > 1")
    cuts = known.select("_by", F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_k") - 1), lambda i: F.col("_q")[F.floor(i * MOST_BLOCKS / F.col("_k")).cast("int") - 1])).alias("_cuts"))
    dealt = rows.join(F.broadcast(cuts), F.col(by).eqNullSafe(F.col("_by")), "left")
    before = F.size(F.filter("_cuts", lambda c: c <= F.col(at)))
    return dealt.withColumn(BLOCK, F.when(F.col("_cuts").isNull() | F.col(at).isNull(), 0).otherwise(before)).drop("_by")


def _in_block(by: str, order: list):
    return Window.partitionBy(by, BLOCK).orderBy(*order)


def _join_state(dealt: DataFrame, state: DataFrame, by: str) -> DataFrame:
    """Joins one row per (key, block after the first), which are few, to the rows of the block."""
    few = state.where(F.col(BLOCK) > 0).withColumnRenamed(by, "_by").withColumnRenamed(BLOCK, "_at")
    return dealt.join(F.broadcast(few), F.col(by).eqNullSafe(F.col("_by")) & (F.col(BLOCK) == F.col("_at")), "left").drop("_by", "_at")


#: Running totals: kind -> (aggregate of a block or of block totals, how what came before and what is in the block combine).
RUNNING = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(dealt: DataFrame, totals: dict[str, tuple[str, str]], by: str = "symbol", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """Adds per ``totals`` (name -> (kind, column)) the total over a key's rows so far, the row's own included.

    Kinds: sum, count, max and min of the values that are not null, and last: the last value that is not null. All but
    count are null where nothing has come yet.
    """
    upto = _in_block(by, list(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    parts, carries, out = [], [], dealt
    for name, (kind, source) in totals.items():
        if kind == "last":
            parts.append(F.max_by(F.when(F.col(source).isNotNull(), F.struct(F.col(source).alias("v"))), F.when(F.col(source).isNotNull(), F.struct(*order))).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(earlier)["v"].alias(f"_c_{name}"))
        else:
            parts.append(RUNNING[kind][0](source).alias(f"_t_{name}"))
            carries.append((F.sum if kind == "count" else RUNNING[kind][0])(f"_t_{name}").over(earlier).alias(f"_c_{name}"))
    state = dealt.groupBy(by, BLOCK).agg(*parts).select(by, BLOCK, *carries)
    out = _join_state(out, state, by)
    for name, (kind, source) in totals.items():
        own = F.last(source, ignorenulls=True).over(upto) if kind == "last" else RUNNING[kind][0](source).over(upto)
        carried = F.col(f"_c_{name}")
        out = out.withColumn(name, F.coalesce(own, carried) if kind == "last" else RUNNING[kind][1](carried, own)).drop(f"_c_{name}")
    return out


def as_of_blocks(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each left row with the values of the latest right row of equal ``by`` at or before ``at`` (left outer), in blocks.

    Of right rows of equal ``by`` and ``at`` the one of greatest values counts. Nothing is found for a null key or time.
    """
    packed = F.struct(*values)
    kind = right.select(packed.alias("v")).schema["v"].dataType
    lhs = left.select(F.col(by), F.col(at), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    rhs = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).groupBy(by, at).agg(F.max(packed).alias("_v")).select(by, at, F.lit(0).alias("_side"), F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row"), "_v")
    both = running(deal(lhs.unionByName(rhs), block_rows, by, at), {"_found": ("last", "_v")}, by, (at, "_side")).where("_side = 1")
    found = F.when(F.col(at).isNotNull() & F.col(by).isNotNull(), F.col("_found"))
    return both.select("_row.*", *[found[v].alias(v) for v in values])


# ---------------------------------------------------------------- recursive averages


def decayed(x: np.ndarray, keep: float, start: float) -> np.ndarray:
    """y[t] = keep * y[t - 1] + x[t] from y = ``start``."""
    alpha = 1 - keep
    if alpha == 0:
        return start + np.cumsum(x)
    return pd.Series(np.concatenate([[alpha * start], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:] / alpha


def averaged(x: np.ndarray, alpha: float, state: tuple[float, float, int] | None, adjust: bool) -> np.ndarray:
    """The recursive average of a block from the state that reaches it; NaN is missing and lets the weights decay.

    The state is (average, sum of weights, missing rows since) at the last value; without ``adjust`` weights count as 1.
    """
    if adjust:
        mean, weight, since = state or (np.nan, 0.0, 0)
        weight *= (1 - alpha) ** since
        there = ~np.isnan(x)
        top, low = decayed(np.where(there, x, 0.0), 1 - alpha, mean * weight if weight else 0.0), decayed(there.astype(float), 1 - alpha, weight)
        out = np.concatenate([[mean], top / np.where(low > 0, low, np.nan)])
        return pd.Series(out).ffill().to_numpy()[1:]  # weights that have decayed to nothing leave the mean as it was
    if state is None:
        return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    gone = min(state[2], 1 + int(800 / -np.log1p(-alpha))) if alpha < 1 else min(state[2], 1)
    return pd.Series(np.concatenate([[state[0]], np.full(gone, np.nan), x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1 + gone :]


def affine_map(x: np.ndarray, alpha: float, adjust: bool) -> tuple[int, int, int, float, float, float]:
    """A block as a map of the state: (rows, missing rows before its first value, after its last, first value, a, b).

    With ``adjust`` a and b are the block's own weighted sum and weight at its last value. Else an average of y at the first value is
    a * y + b at the last one. A block without values has as many leading missing rows as rows.
    """
    n, at = len(x), np.flatnonzero(~np.isnan(x))
    if not len(at):
        return n, n, n, 0.0, 0.0, 0.0
    keep, lead, tail = 1 - alpha, int(at[0]), int(n - 1 - at[-1])
    if adjust:
        upto, there = x[: n - tail], ~np.isnan(x[: n - tail])
        return n, lead, tail, float(x[at[0]]), float(decayed(np.where(there, upto, 0.0), keep, 0.0)[-1]), float(decayed(there.astype(float), keep, 0.0)[-1])
    old = np.power(keep, np.diff(at).astype(float))
    a = float(np.prod(old / (old + alpha)))
    last = float(pd.Series(x[at[0] :]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-1])
    return n, lead, tail, float(x[at[0]]), a, last - a * float(x[at[0]])


def composed(maps: list[tuple[int, int, int, float, float, float]], alpha: float, adjust: bool) -> list[tuple[float, float, int] | None]:
    """The state that reaches each block, from the maps of a key's blocks in order."""
    state, out, keep = None, [], 1 - alpha
    for n, lead, tail, first, a, b in maps:
        out.append(state)
        if lead == n:
            state = state and (state[0], state[1], state[2] + n)
        elif adjust:
            mean, weight, since = state or (0.0, 0.0, 0)
            old = weight * keep ** (since + n - tail)
            state = (old * mean + a) / (old + b), old + b, tail
        else:
            old = keep ** (state[2] + lead + 1) if state else 0.0
            y = (old * state[0] + alpha * first) / (old + alpha) if state else first
            state = a * y + b, 1.0, tail
    return out


def recursive_averages(dealt: DataFrame, averages: dict[str, tuple[str, float, bool]], by: str = "symbol", at: str = "date") -> DataFrame:
    """Adds per ``averages`` (name -> (column, alpha, adjust)) the recursive average of the key's rows so far.

    As pandas' ``ewm(alpha=alpha, adjust=adjust).mean()``, missing values counting as rows. One pass makes a block's maps
    of its rows, which are composed per key (a row per block each), and one applies the states; both passes read the same
    shuffle by (key, block).
    """
    jobs = list(averages.items())
    number = T.DoubleType()
    map_fields = [T.StructField(f, t) for f, t in zip(("n", "lead", "tail", "first", "a", "b"), [T.LongType()] * 3 + [number] * 3, strict=True)]
    state_fields = [T.StructField("mean", number), T.StructField("weight", number), T.StructField("since", T.LongType())]
    key = [dealt.schema[by], T.StructField(BLOCK, T.IntegerType())]

    def maps(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        out = [(rows[by].iloc[0], rows[BLOCK].iloc[0], i, *affine_map(rows[f"_x{i}"].to_numpy(dtype=float), alpha, adjust)) for i, (_, (_, alpha, adjust)) in enumerate(jobs)]
        return pd.DataFrame(out, columns=[by, BLOCK, "job", "n", "lead", "tail", "first", "a", "b"])

    def states(blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for job, some in blocks.groupby("job"):
            some = some.sort_values(BLOCK)
            _, (_, alpha, adjust) = jobs[int(job)]
            found = composed(list(some[["n", "lead", "tail", "first", "a", "b"]].itertuples(index=False, name=None)), alpha, adjust)
            out += [(k, b, int(job), *s) for k, b, s in zip(some[by], some[BLOCK], found, strict=True) if s]
        return pd.DataFrame(out, columns=[by, BLOCK, "job", "mean", "weight", "since"])

    def apply(rows: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        known = {int(r.job): (r.mean, r.weight, int(r.since)) for r in reached.itertuples()}
        new = {name: averaged(rows[f"_x{i}"].to_numpy(dtype=float), alpha, known.get(i), adjust) for i, (name, (_, alpha, adjust)) in enumerate(jobs)}
        return rows.drop(columns=[f"_x{i}" for i in range(len(jobs))]).assign(**new)

    sourced = dealt.withColumns({f"_x{i}": F.col(source).cast("double") for i, (_, (source, _, _)) in enumerate(jobs)})
    slim = sourced.select(by, at, BLOCK, *[f"_x{i}" for i in range(len(jobs))])
    mapped = slim.groupBy(by, BLOCK).applyInPandas(maps, T.StructType([*key, T.StructField("job", T.LongType()), *map_fields]))
    reached = mapped.groupBy(by).applyInPandas(states, T.StructType([*key, T.StructField("job", T.LongType()), *state_fields]))
    out = T.StructType([*dealt.schema.fields, *[T.StructField(name, number) for name in averages]])
    applied = sourced.groupBy(by, BLOCK).cogroup(reached.groupBy(by, BLOCK)).applyInPandas(apply, out)
    return applied.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in averages})


# ---------------------------------------------------------------- windows with a halo


def with_halo(dealt: DataFrame, rows_before: int, by: str = "symbol", at: str = "date") -> DataFrame:
    """Adds to each block the ``rows_before`` rows of its key before it, marked by ``_halo``; they may span blocks.

    A row's place in its key is its place in the block after the rows of earlier blocks, so the halo is exact whatever
    the blocks' sizes.
    """
    if rows_before <= 0:
        return dealt.withColumn("_halo", F.lit(False))
    sizes = dealt.groupBy(by, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_s", start).where(F.col(BLOCK) > 0).groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("_s").alias("s")))).alias("_starts"))
    placed = dealt.join(F.broadcast(starts), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    own_start = F.coalesce(F.get(F.filter("_starts", lambda x: x["b"] == F.col(BLOCK)), F.lit(0))["s"], F.lit(0))
    place = F.row_number().over(_in_block(by, [at])) - 1 + own_start
    later = F.filter("_starts", lambda x: (x["b"] > F.col(BLOCK)) & (x["s"] - rows_before <= F.col("_place")))
    to = F.concat(F.array(F.struct(F.col(BLOCK).alias("b"), F.lit(False).alias("h"))), F.coalesce(F.transform(later, lambda x: F.struct(x["b"].alias("b"), F.lit(True).alias("h"))), F.array().cast("array<struct<b:int,h:boolean>>")))
    sent = placed.withColumn("_place", place).withColumn("_to", F.explode(to))
    return sent.withColumn(BLOCK, F.col("_to.b")).withColumn("_halo", F.col("_to.h")).drop("_to", "_place", "_starts")


# ---------------------------------------------------------------- sliding order statistics


class RankTree:
    """Counts and sums of the values in a window, by rank among all values of a block (a Fenwick tree)."""

    def __init__(self, values: np.ndarray):
        self.levels = np.unique(values[~np.isnan(values)])
        self.n = len(self.levels)
        self.counts, self.sums = [0] * (self.n + 1), [0.0] * (self.n + 1)
        self.top = 1 << max(self.n.bit_length() - 1, 0)

    def add(self, rank: int, value: float, times: int) -> None:
        i = rank + 1
        while i <= self.n:
            self.counts[i] += times
            self.sums[i] += times * value
            i += i & -i

    def below(self, rank: int) -> tuple[int, float]:
        """Count and sum of the values of lower rank."""
        n, total, i = 0, 0.0, rank
        while i:
            n += self.counts[i]
            total += self.sums[i]
            i -= i & -i
        return n, total

    def kth(self, k: int) -> float:
        """The k-th least value, from 0."""
        i, step = 0, self.top
        while step:
            if i + step <= self.n and self.counts[i + step] <= k:
                i += step
                k -= self.counts[i]
            step >>= 1
        return float(self.levels[i])


def sliding(kind: str, x: np.ndarray, n: int) -> np.ndarray:
    """Per row a statistic of the last n rows; NaN is missing. A row costs the logarithm of the block, not the window.

    median: as interpolated; rank_pct: average rank of the newest value as a share of the values; deviation: mean distance
    of the values from their mean; last_max: place of the window's last maximum among its values, as a share of its rows,
    0 where the newest value is missing.
    """
    out = np.full(len(x), np.nan)
    if kind == "last_max":
        peak, missing = deque(), np.concatenate([[0], np.cumsum(np.isnan(x))])
        for i, v in enumerate(x.tolist()):
            lo = max(0, i - n + 1)
            while peak and peak[0] < lo:
                peak.popleft()
            if v != v:
                out[i] = 0.0
                continue
            while peak and x[peak[-1]] <= v:
                peak.pop()
            peak.append(i)
            at = peak[0]
            out[i] = (at - lo + 1 - (missing[at + 1] - missing[lo])) / (i - lo + 1)
        return out
    tree = RankTree(x)
    ranks = np.searchsorted(tree.levels, x).tolist()
    size, total, values = 0, 0.0, x.tolist()
    for i, v in enumerate(values):
        if i >= n and values[i - n] == values[i - n]:
            tree.add(ranks[i - n], values[i - n], -1)
            size -= 1
        if v == v:
            tree.add(ranks[i], v, 1)
            size += 1
        if not size:
            continue
        if kind == "median":
            out[i] = tree.kth(size // 2) if size % 2 else (tree.kth(size // 2 - 1) + tree.kth(size // 2)) / 2
        elif kind == "rank_pct":
            if v == v:
                less, same = tree.below(ranks[i])[0], tree.below(ranks[i] + 1)[0]
                out[i] = (less + (same - less + 1) / 2) / size
        else:
            total = tree.below(tree.n)[1]
            mean = total / size
            below, under = tree.below(int(np.searchsorted(tree.levels, mean, side="right")))
            out[i] = ((total - under) - mean * (size - below) + mean * below - under) / size
    return out


def order_statistics(dealt: DataFrame, statistics: dict[str, tuple[str, str, int]], by: str = "symbol", at: str = "date") -> DataFrame:
    """Adds per ``statistics`` (name -> (kind of ``sliding``, column, rows)) a statistic of the key's last rows.

    Works on blocks with a halo; rows of the halo come out with the statistics of what the halo holds.
    """
    jobs = list(statistics.items())

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at)
        new = {name: sliding(kind, rows[f"_x{i}"].to_numpy(dtype=float), n) for i, (name, (kind, _, n)) in enumerate(jobs)}
        return rows.drop(columns=[f"_x{i}" for i in range(len(jobs))]).assign(**new)

    sourced = dealt.withColumns({f"_x{i}": F.col(source).cast("double") for i, (_, (_, source, _)) in enumerate(jobs)})
    out = T.StructType([*dealt.schema.fields, *[T.StructField(name, T.DoubleType()) for name in statistics]])
    ranked = sourced.groupBy(by, BLOCK).applyInPandas(run, out)
    return ranked.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in statistics})

