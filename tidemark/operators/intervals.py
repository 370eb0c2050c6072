"""Points in intervals, as an equi-join: intervals are dealt to buckets of time, a point lies in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a list: so many points of a bucket meet so many of its intervals as one row.
LIST_ROWS = 256


def listed(rows: DataFrame, cell: list[str], order: str, out: str) -> DataFrame:
    """A row per ``LIST_ROWS`` rows of a cell, in ``order``: the cell, ``out``, an array of structs of the other columns, and the least and greatest ``order``."""
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(order))
    some = F.collect_list(F.struct(*[c for c in rows.columns if c not in cell])).alias(out)
    return rows.withColumn("_list", F.floor((place - 1) / LIST_ROWS)).groupBy(*cell, "_list").agg(some, F.min(order).alias(f"{out}_from"), F.max(order).alias(f"{out}_to")).drop("_list")


def as_number(c: Column, kind: str) -> Column:
    """Days of a date, seconds of a time, a number as it is."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")) / 1e6
    return c.cast("double")


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """The points with the columns of each half-open interval [``start``, ``end``) of equal ``by`` they lie in.

    ``width`` (days for dates, seconds for times) is best about an interval's length: an interval has a row per bucket that
    it touches, a point one, and both meet once, in the point's bucket; the bounds are compared after. So the rows of a key
    are spread over its buckets. A null bound is open: such an interval reaches to the ends of the key's points. Overlapping
    intervals give a row each; an empty or reversed one, a null key or a null point meets nothing. ``how`` is inner or left.
    Where many intervals overlap the pairs are far more than either side: so an inner join meets lists of a bucket's points
    with lists of its intervals, ``LIST_ROWS`` at most, and unfolds a pair of lists a point at a time. Points are never
    broadcast or held as a group. The next points repeat a point's intervals at once, however many the bucket has, so the
    rows stay small in a file whose columns are encoded and compressed.
    The intervals' columns besides ``by`` must not be named like those of the points.
    """
    kind = dict(points.dtypes)[at]
    bucket = lambda c: F.floor(as_number(c, kind) / width)
    rest = [c for c in intervals.columns if c not in by]
    reach = points.groupBy(*by).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    clipped = intervals.join(reach, by).where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) < F.col(end)))
    low, high = F.greatest(F.coalesce(F.col(start), F.col("_first")), F.col("_first")), F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last"))
    dealt = clipped.where(low <= high).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    right = dealt.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_bucket", *[F.col(c).alias(f"_r{i}") for i, c in enumerate(rest)])
    name = {c: f"_r{i}" for i, c in enumerate(rest)}
    left = points.withColumn("_at", bucket(F.col(at)))
    inside = (F.col(name[start]).isNull() | (F.col(at) >= F.col(name[start]))) & (F.col(name[end]).isNull() | (F.col(at) < F.col(name[end])))
    if how == "left":
        on = F.col("_at") == F.col("_bucket")
        for i, c in enumerate(by):
            on = on & (F.col(c) == F.col(f"_by{i}"))
        met = left.join(right, on & inside, how)
    else:
        own = {c: f"_p{i}" for i, c in enumerate(points.columns)}
        cell = [*[f"_by{i}" for i in range(len(by))], "_bucket"]
        placed = left.where(F.col("_at").isNotNull()).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_at").alias("_bucket"), *[F.col(c).alias(n) for c, n in own.items()])
        pairs = listed(placed, cell, own[at], "_points").join(listed(right, cell, name[start], "_spans").hint("merge"), cell)
        # leaves out what no point of the list can lie in, and gives the pairs one by one to what unfolds them
        may = lambda r: (r[name[start]].isNull() | (r[name[start]] <= F.col("_points_to"))) & (r[name[end]].isNull() | (r[name[end]] > F.col("_points_from")))
        unfolded = pairs.select("_points", F.filter("_spans", may).alias("_spans")).select("_spans", F.inline("_points"))
        met = unfolded.select(*[F.col(n).alias(c) for c, n in own.items()], F.inline("_spans")).where(inside)
    return met.select(*points.columns, *[F.col(n).alias(c) for c, n in name.items()])
