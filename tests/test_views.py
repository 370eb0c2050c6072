"""Stored views: a window rebuilt equals everything rebuilt; failures and dry runs leave no trace; observed runs."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import io
from tidemark.sources import store
from tidemark.sources import views as V

ALL = list(V.VIEWS)


@pytest.fixture(scope="module")
def bars(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(150)]
    rows = [(s, c, day, *[100.0 + k + i + 7 * int(c[1]) for k in (0, 3, -3, i % 5)], float(i % 11), None if i % 9 == 0 else 10.0) for s in ("A", "B") for c in ("c1", "c2", "c3") for i, day in enumerate(days)]
    return spark.createDataFrame(rows, "symbol string, contract string, date date, open double, high double, low double, close double, volume double, amount double").cache()


def rolls_of(spark, *rolls):
    return spark.createDataFrame([(*r, dt.datetime.combine(r[1], dt.time())) for r in rolls] or [], "symbol string, effective date, old_contract string, new_contract string, created_at timestamp")


EARLY = [("A", dt.date(2024, 2, 10), "c1", "c2"), ("B", dt.date(2024, 2, 20), "c1", "c2")]
LATE = ("A", dt.date(2024, 4, 12), "c2", "c3")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_window_equals_a_full_rebuild(spark, bars, tmp_path):
    part, full = str(tmp_path / "part"), str(tmp_path / "full")
    V.rebuild_views(spark, part, V.market_builders(bars, rolls_of(spark, *EARLY)), ALL)
    before = files(part)
    rolls = rolls_of(spark, *EARLY, LATE)
    since = store.late_start(dt.date(2024, 5, 20), dt.datetime(2024, 3, 1), rolls)
    runs = V.rebuild_views(spark, part, V.market_builders(bars, rolls), ALL, since)
    V.rebuild_views(spark, full, V.market_builders(bars, rolls), ALL)
    for view in ALL:
        assert rows(V.read_view(spark, part, view)) == rows(V.read_view(spark, full, view)), view
    run = {r.view: r for r in runs.collect()}
    assert run["raw_contract"].since == dt.date(2024, 4, 1) == run["raw_contract"].first_date and run["main_back_adjusted"].since is None
    assert run["main_continuous"].rows == V.read_view(spark, part, "main_continuous").where("date >= '2024-04-01'").count()
    q = V.read_view(spark, part, "raw_contract").where("date >= '2024-04-01'")
    assert run["raw_contract"].warning == q.where("quality = 'warning'").count() > 0
    after = files(part)
    assert all(after[f] == t for f, t in before.items())  # nothing is written over
    kept = [f for f in V._listed(spark, part)["raw_contract"]["months"].values() if any(f in old for old in before)]
    assert len(kept) == 3
    gone = V.drop_unused(spark, part)
    assert gone and not any("main_continuous" in g and "2024-02" in g for g in gone)
    for view in ALL:
        assert rows(V.read_view(spark, part, view)) == rows(V.read_view(spark, full, view)), view


def test_failures_and_dry_runs_leave_no_trace(spark, bars, tmp_path):
    path, builders = str(tmp_path), V.market_builders(bars, rolls_of(spark, *EARLY))
    V.rebuild_views(spark, path, builders, ["main_continuous"])
    before, want = files(path), rows(V.read_view(spark, path, "main_continuous"))
    failed = []

    def shaky(times):
        def build(read, since):
            failed.append(1)
            if len(failed) <= times:
                raise OSError("lost")
            return builders["main_continuous"](read, since)

        return build

    with pytest.raises(RuntimeError):
        V.rebuild_views(spark, path, builders | {"main_continuous": shaky(9)}, ["main_continuous"], attempts=2)
    dry = V.rebuild_views(spark, path, builders, ["main_continuous"], dry_run=True).collect()
    assert {r.status for r in dry} == {"dry_run"} and files(path) == before and rows(V.read_view(spark, path, "main_continuous")) == want
    failed.clear()
    run = V.rebuild_views(spark, path, builders | {"main_continuous": shaky(1)}, ["main_continuous"]).where("view = 'main_continuous'").first()
    assert run.attempt == 2 and rows(V.read_view(spark, path, "main_continuous")) == want
    with pytest.raises(ValueError):
        V.read_view(spark, path, "main_back_adjusted")


def test_a_builder_may_read_what_it_replaces(spark, bars, tmp_path):
    path = str(tmp_path)
    V.rebuild_views(spark, path, {"raw_contract": lambda read, since: bars}, ["raw_contract"])
    V.rebuild_views(spark, path, {"raw_contract": lambda read, since: read("raw_contract").withColumn("close", F.col("close") + 1)}, ["raw_contract"])
    assert V.read_view(spark, path, "raw_contract").agg(F.sum("close")).first()[0] == bars.agg(F.sum(F.col("close") + 1)).first()[0]
    with pytest.raises(Exception, match="no date"):
        V.rebuild_views(spark, path, {"raw_contract": lambda read, since: bars.withColumn("date", F.lit(None).cast("date"))}, ["raw_contract"])


def test_a_run_is_observed_by_its_own_job(spark, bars, tmp_path):
    out, runs = str(tmp_path / "out"), str(tmp_path / "runs")
    spark.sparkContext.setJobGroup("ingest", "")
    seen = io.ingest(bars, out, runs, "bars")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ingest"))
    spark.sparkContext.setJobGroup("other", "")
    assert seen["rows"] == spark.read.parquet(out).count() == bars.count() and seen["null_amount"] == bars.where("amount is null").count()
    assert jobs <= 2  # the rows, and the row of the log
    with pytest.raises(Exception, match="broken"):
        io.ingest(bars.withColumn("x", F.raise_error(F.lit("broken")).cast("string")), out, runs, "bars")
    assert sorted((r.status, r.rows) for r in spark.read.parquet(runs).collect()) == [("failed", None), ("success", bars.count())]
