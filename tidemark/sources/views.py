"""Stored panel views that are built from one another, rebuilt a window at a time and swapped in whole.

A view lies in folders by month of its dates; a list of the folders in force is one small file, which is replaced in one
step once all views of a build are written. So a build that fails leaves everything as it was, a reader never sees half of
one, a builder may read the views that it is about to replace, and months before the window keep their files.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import continuous as C
from tidemark.sources.staging import drop_path, names_in, read_text, swap_text
from tidemark.sources.store import VIEWS, build_order

#: Views whose rows of all dates move with a later roll: always rebuilt from their first date on.
WHOLE = frozenset({"main_back_adjusted"})
#: Days of earlier bars that the windows of a feature may need: 20 trading days and the holidays among them.
WARM_UP_DAYS = 45
Reader = Callable[[str], DataFrame]
Builder = Callable[[Reader, dt.date | None], DataFrame]

RUNS = "view string, attempt int, status string, rows long, first_date date, last_date date, bad long, warning long, since date, version string"


def _listed(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/_current") or "{}")


def _read(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    schema = T.StructType.fromJson(entry["schema"])
    folders = [f"{path}/{folder}" for _, folder in sorted(entry["months"].items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_view(spark: SparkSession, path: str, view: str) -> DataFrame:
    """A view as of its last build."""
    listed = _listed(spark, path)
    if view not in listed:
        raise ValueError(f"no such view has been built: {view}")
    return _read(spark, path, listed[view])


def month_of(day: dt.date | None) -> dt.date | None:
    return day and day.replace(day=1)


def rebuild_views(spark: SparkSession, path: str, builders: dict[str, Builder], views: list[str], since: dt.date | None = None, attempts: int = 3, dry_run: bool = False, quality: Column | None = None) -> DataFrame:
    """Builds views and what they need, in that order, from the month of ``since`` on (None: all), and swaps them in.

    ``builders`` maps a view to a function of a reader of views (those of this build, where it has come to them) and the
    first date wanted; the function reads as far back as its windows ask for, and earlier rows of its result are dropped.
    A view that is not there yet, and one of ``WHOLE``, is built from its first date on. ``quality`` (default: the column
    of that name, if there is one) says bad or warning; counts of both, of rows and the span of dates are observed while
    a view is written, in the same job. Returns a row per view. A dry run writes and observes, and takes it back.

    Rows without a date belong to no month and are refused. A write that fails is tried again; Spark's own retries cover
    tasks only.
    """
    listed, version = _listed(spark, path), uuid.uuid4().hex
    new, runs, written = dict(listed), [], []

    def read(view: str) -> DataFrame:
        return _read(spark, path, new[view])

    try:
        for view in build_order(views):
            first = None if view in WHOLE or view not in listed else month_of(since)
            for attempt in range(1, attempts + 1):
                folder = f"{view}/{version}-{attempt}"
                written.append(folder)
                try:
                    rows = builders[view](read, first)
                    if first:
                        rows = rows.where(F.col("date") >= F.lit(first))
                    mark = quality if quality is not None else F.col("quality") if "quality" in rows.columns else F.lit(None).cast("string")
                    seen = Observation()
                    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.raise_error(F.lit("a row has no date")).cast("string"))
                    observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(F.col("date").cast("date")).alias("first_date"), F.max(F.col("date").cast("date")).alias("last_date"), F.count(F.when(mark == "bad", 1)).alias("bad"), F.count(F.when(mark == "warning", 1)).alias("warning"))
                    observed.withColumn("_month", month).write.partitionBy("_month").parquet(f"{path}/{folder}")
                    break
                except (OSError, RuntimeError) as error:
                    if attempt == attempts:
                        raise RuntimeError(f"{view} failed {attempts} times") from error
            kept = {m: f for m, f in listed.get(view, {"months": {}})["months"].items() if first and m < first.strftime("%Y-%m")}
            fresh = {n.removeprefix("_month="): f"{folder}/{n}" for n in names_in(spark, f"{path}/{folder}") if n.startswith("_month=")}
            new[view] = {"schema": rows.schema.jsonValue(), "months": kept | fresh}
            s = seen.get
            runs.append((view, attempt, "dry_run" if dry_run else "success", s["rows"], s["first_date"], s["last_date"], s["bad"], s["warning"], first, version))
        if not dry_run:
            swap_text(spark, f"{path}/_current", json.dumps(new))
            written.clear()
    finally:
        for folder in written:  # of a build that failed, or was a dry run
            drop_path(spark, f"{path}/{folder}")
    return spark.createDataFrame(runs, RUNS)


def drop_unused(spark: SparkSession, path: str) -> list[str]:
    """Deletes the folders of earlier builds that no view refers to any more. For when nothing reads them."""
    used = {f for entry in _listed(spark, path).values() for f in entry["months"].values()}
    gone = []
    for view in VIEWS:
        for build in names_in(spark, f"{path}/{view}"):
            months = [f"{view}/{build}/{m}" for m in names_in(spark, f"{path}/{view}/{build}") if m.startswith("_month=")]
            for m in months:
                if m not in used:
                    drop_path(spark, f"{path}/{m}")
                    gone.append(m)
            if not set(months) & used:
                drop_path(spark, f"{path}/{view}/{build}")
    return gone


def market_builders(bars: DataFrame, rolls: DataFrame, start: dt.date = dt.date(1900, 1, 1), end: dt.date = dt.date(2200, 1, 1)) -> dict[str, Builder]:
    """The four views of daily ``bars`` (symbol, contract, date, prices, volume, amount) and ``rolls``.

    Features of a contract's bars look back over ``WARM_UP_DAYS`` days. The gaps of rolls are taken from the raw view as
    it is after this build.
    """

    def raw(read: Reader, since: dt.date | None) -> DataFrame:
        rows = bars if since is None else bars.where(F.col("date") >= F.lit(since - dt.timedelta(days=WARM_UP_DAYS)))
        keyed = rows.withColumn("_symbol", F.col("symbol")).withColumn("symbol", F.to_json(F.struct("symbol", "contract")))
        return C.panel_features(keyed).withColumn("symbol", F.col("_symbol")).drop("_symbol")

    def main(read: Reader, since: dt.date | None) -> DataFrame:
        rows = read("raw_contract")
        rows = rows if since is None else rows.where(F.col("date") >= F.lit(since))
        return C.continuous(rows, C.segments(rolls, F.lit(start), F.lit(end)))

    def shifted(direction: str) -> Builder:
        def build(read: Reader, since: dt.date | None) -> DataFrame:
            series = read("main_continuous")
            series = series if since is None else series.where(F.col("date") >= F.lit(since))
            return C.adjusted(series, C.gaps(read("raw_contract").select("symbol", "contract", "date", "close"), rolls), direction)

        return build

    return {"raw_contract": raw, "main_continuous": main, "main_back_adjusted": shifted("backward"), "main_forward_adjusted": shifted("forward")}
