"""Continuous series over contract rolls: detection, segments, as-of lookups and additive price adjustment.

Rolls are a small interval table per symbol. A row finds its segment by symbol and interval; the roll side is broadcast
by Spark's own size check when it is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import div, seq
from tidemark.operators.intervals import interval_join


def detect_rolls(main: DataFrame) -> DataFrame:
    """(symbol, effective, old_contract, new_contract) where a symbol's contract by date changes."""
    rows = main.withColumn("old_contract", F.lag("contract").over(seq()))
    return rows.where("old_contract is not null and old_contract <> contract").select("symbol", F.col("date").alias("effective"), "old_contract", F.col("contract").alias("new_contract"))


def mapped_rolls(mapping: DataFrame, current: DataFrame, contracts: DataFrame) -> DataFrame:
    """(symbol, effective, old_contract, new_contract) where a provider's mapping (symbol, mapped, date) names another main
    contract than the ``current`` one (symbol, contract). Codes of month 00 and contracts that are not known are skipped."""
    month = F.regexp_extract("mapped", r"([0-9]{2})$", 1)
    known = contracts.select(F.col("code").alias("mapped")).distinct()
    r = mapping.where(month != "00").join(known, "mapped", "left_semi").join(current, "symbol")
    return r.where(~F.col("mapped").eqNullSafe(F.col("contract"))).select("symbol", F.col("date").alias("effective"), F.col("contract").alias("old_contract"), F.col("mapped").alias("new_contract"))


def segments(rolls: DataFrame, start, end) -> DataFrame:
    """Half-open segments [start, end) per symbol with their contract; the first has the first roll's old contract."""
    by = Window.partitionBy("symbol").orderBy("effective")
    later = rolls.select("symbol", F.col("new_contract").alias("contract"), F.col("effective").alias("seg_start"), F.lead("effective").over(by).alias("seg_end"))
    first = rolls.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("symbol", F.col("old_contract").alias("contract"), F.lit(None).cast("date").alias("seg_start"), F.col("effective").alias("seg_end"))
    clipped = first.unionByName(later).withColumn("seg_start", F.greatest(F.coalesce("seg_start", F.lit(start)), F.lit(start))).withColumn("seg_end", F.least(F.coalesce("seg_end", F.lit(end)), F.lit(end)))
    return clipped.where("seg_start < seg_end")


#: Days of a bucket in which bars and the segments between rolls meet: about as long as a contract is the main one.
SEGMENT_DAYS = 32


def continuous(bars: DataFrame, segs: DataFrame) -> DataFrame:
    """The bars of each symbol's contract in force: an interval join by symbol, contract and bucket of days."""
    width = SEGMENT_DAYS if dict(bars.dtypes)["date"] == "date" else SEGMENT_DAYS * 86_400
    return interval_join(bars, segs, ["symbol", "contract"], "date", "seg_start", "seg_end", width).select(bars.columns)


def gaps(bars: DataFrame, rolls: DataFrame) -> DataFrame:
    """(symbol, effective, gap): the new contract's first close from the roll on, less the old one's last before it.

    Rolls are laid among the bars of their two contracts and read the close before or after them: no bar meets a roll that
    it does not border. Of bars of equal date the one of least close counts. Without both closes the gap is 0.
    """
    sides = F.array(F.struct(F.col("old_contract").alias("contract"), F.lit("old").alias("side")), F.struct(F.col("new_contract").alias("contract"), F.lit("new").alias("side")))
    marks = rolls.select("symbol", "effective", F.inline(sides)).select("symbol", "contract", F.col("effective").alias("date"), "side", F.lit(None).cast("double").alias("close"))
    one = bars.groupBy("symbol", "contract", "date").agg(F.min(F.col("close").cast("double")).alias("close")).select("symbol", "contract", "date", F.lit(None).cast("string").alias("side"), "close")
    by = Window.partitionBy("symbol", "contract")
    before = F.last("close", ignorenulls=True).over(by.orderBy("date", F.col("side").desc_nulls_last()))  # marks of a date come before its bar
    after = F.last("close", ignorenulls=True).over(by.orderBy(F.desc("date"), F.col("side").asc_nulls_first()))
    seen = marks.unionByName(one).select("*", before.alias("before"), after.alias("after")).where("side is not null")
    found = seen.groupBy("symbol", F.col("date").alias("effective")).agg(F.max(F.when(F.col("side") == "old", F.col("before"))).alias("old"), F.max(F.when(F.col("side") == "new", F.col("after"))).alias("new"))
    return rolls.select("symbol", "effective").join(found, ["symbol", "effective"], "left").select("symbol", "effective", F.coalesce(F.col("new") - F.col("old"), F.lit(0.0)).alias("gap"))


def adjusted(series: DataFrame, gap: DataFrame, direction: str) -> DataFrame:
    """``adjustment`` and shifted prices: less the gaps of later rolls (backward) or of rolls up to the date (forward).

    Cumulated by a window over the union of bars and gaps per symbol, so no bar is paired with every roll.
    """
    events = series.select("symbol", "date", F.lit(None).cast("double").alias("_gap")).unionByName(gap.select("symbol", F.col("effective").alias("date"), F.col("gap").alias("_gap")))
    by_date = events.groupBy("symbol", "date").agg(F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("_gap"))
    if direction == "backward":
        later = Window.partitionBy("symbol").orderBy(F.desc("date"))  # a frame of following rows would be summed anew per row
        total = F.sum("_gap").over(later.rowsBetween(Window.unboundedPreceding, -1))
    else:
        total = F.sum("_gap").over(seq().rowsBetween(Window.unboundedPreceding, 0))
    shift = by_date.select("symbol", "date", (-F.coalesce(total, F.lit(0.0))).alias("adjustment"))
    out = series.join(shift, ["symbol", "date"])
    return out.withColumns({c: F.col(c) + F.col("adjustment") for c in ("open", "high", "low", "close")})


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of equal ``by`` at or before ``at`` (left outer).

    Both sides are laid in one order per key and the last known values carried forward: one shuffle, no pairs.
    """
    n = len(left.columns)
    packed = F.struct(*values)
    lhs = left.select(F.col(by), F.col(at), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("_v"))
    rhs = right.select(F.col(by), F.col(at), F.lit(0).alias("_side"), F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row"), packed.alias("_v"))
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = lhs.unionByName(rhs).withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    assert n
    return joined.select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def panel_features(bars: DataFrame) -> DataFrame:
    """Returns, gap, amplitude, intraday range, volume ratio and a quality class; windows before any date filter."""
    c = F.col("close")
    prev = F.lag(c).over(seq())
    w = seq().rowsBetween(-19, 0)
    quality = F.when((F.col("high") < F.col("low")) | (F.col("close") <= 0), "bad").when(F.col("amount").isNull() | (F.col("volume") == 0), "warning").otherwise("good")
    return bars.withColumns({"ret_1": div(c, prev) - 1, "ret_5": div(c, F.lag(c, 5).over(seq())) - 1, "ret_20": div(c, F.lag(c, 20).over(seq())) - 1, "gap": div(F.col("open"), prev) - 1, "amplitude": div(F.col("high") - F.col("low"), c),
                             "intraday_range": div(c - F.col("open"), F.col("open")), "volume_ratio_20": div(F.col("volume"), F.avg("volume").over(w)), "quality": quality})


def next_trading_day(date, holidays: list | None = None):
    """The next weekday that is no holiday, at most a fortnight on."""
    days = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.date_add(date, i))
    free = F.array(*[F.lit(h) for h in holidays]) if holidays else F.array().cast("array<date>")
    return F.element_at(F.filter(days, lambda x: (F.weekday(x) < 5) & ~F.array_contains(free, x)), 1)


#: Minutes of the day, in Shanghai, in which futures trade: morning with its break, afternoon, night.
SESSIONS = ((540, 615, "morning"), (630, 690, "morning"), (810, 900, "afternoon"), (1260, 1440, "night"), (0, 150, "night"))


def session_state(ts):
    """The trading session that a UTC time is in, or closed."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Shanghai")
    minute, state = F.hour(local) * 60 + F.minute(local), F.lit("closed")
    for start, end, name in SESSIONS:
        state = F.when((minute >= start) & (minute < end), name).otherwise(state)
    return state


def trading_date(ts):
    """The trading date of a UTC time: from 20:00 in Shanghai on, the next calendar day."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), "Asia/Shanghai")
    return F.when(F.hour(local) >= 20, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
