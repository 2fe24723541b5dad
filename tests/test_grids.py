"""Grids, traces, interpolation, numbering."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import runlake
from runlake.operators.interpolate import interpolate_at
from runlake.operators.spans import every_nth, numbered, reading_gaps

T0 = datetime(2026, 3, 2, 7, 56, 30)
SCHEMA = (
    "run_id string, timestamp timestamp_ntz, elapsed_h double, source string, variable string, value double, "
    "unit string, source_file string"
)


def observations(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for run, offset in (("A", 0), ("B", 90_000), ("C", 5)):
        start = T0 + timedelta(seconds=offset)
        for source, variables in (("bioreactor", ("DO", "pH")), ("offgas", ("offgas_co2",)), ("offline", ("dcw",))):
            if run == "C" and source != "offline":
                continue
            for _ in range(60):
                t = start + timedelta(seconds=rng.randrange(0, 30_000, 15))
                for v in variables:
                    rows.append((run, t, (t - start).total_seconds() / 3600, source, v, rng.uniform(0, 9), "", "f"))
    return spark.createDataFrame(rows, SCHEMA)


def bins_of(readings, seconds):
    """For [(time, value)] of one series the mean of each bin, by its number from midnight of the first day on."""
    per_time = {}
    for at, value in readings:
        per_time.setdefault(at, []).append(value)
    midnight = datetime.combine(min(per_time).date(), datetime.min.time())
    filled = {}
    for at, values in per_time.items():
        number = int((at - midnight) / timedelta(seconds=seconds))
        filled.setdefault(number, []).append(sum(values) / len(values))
    return midnight, {k: sum(v) / len(v) for k, v in filled.items()}


@pytest.mark.parametrize(("step", "seconds"), [("5min", 300), ("7min", 420), ("6h", 21_600), ("2D", 172_800), ("45s", 45)])
def test_grid_equals_bin_arithmetic(spark, step, seconds):
    obs = observations(spark)
    names = ["DO", "offgas_co2"]
    found = {(r["run_id"], r["timestamp"]): r for r in runlake.resample_grid(obs, names, step).collect()}
    rows = [r for r in obs.collect() if r["variable"] in names]
    seen = 0
    for run, start in (("A", T0), ("B", T0 + timedelta(seconds=90_000))):
        times = [r["timestamp"] for r in rows if r["run_id"] == run]
        midnight, every = bins_of([(t, 0.0) for t in times], seconds)
        columns = {}
        for v in names:
            own = [(r["timestamp"], r["value"]) for r in rows if (r["run_id"], r["variable"]) == (run, v)]
            # numbered from the first day of the run, not of the variable
            columns[v] = bins_of([*own, (midnight, 0.0)], seconds)[1] if min(own)[0].date() != midnight.date() else bins_of(own, seconds)[1]
        for k in range(min(every), max(every) + 1):
            at = midnight + timedelta(seconds=k * seconds)
            row = found[run, at]
            seen += 1
            assert row["elapsed_h"] == pytest.approx((at - start).total_seconds() / 3600)
            for v in names:
                assert row[v] == (pytest.approx(columns[v][k]) if k in columns[v] else None)
    assert seen == len(found)


def test_grid_by_hand(spark):
    """Two readings in the bin of 08:00, none in that of 08:05, one in that of 08:10."""
    start = datetime(2026, 3, 2, 8)
    rows = [("A", start + timedelta(seconds=s), s / 3600, "bioreactor", "DO", v, "", "f") for s, v in ((10, 1.0), (299, 2.0), (600, 5.0))]
    found = runlake.resample_grid(spark.createDataFrame(rows, SCHEMA), ["DO"], "5min").orderBy("timestamp").collect()
    assert [(r["timestamp"] - start, r["DO"]) for r in found] == [(timedelta(minutes=m), v) for m, v in ((0, 1.5), (5, None), (10, 5.0))]


def test_grid_fills_gaps_across_spans(spark):
    """At one second a span is 4096 bins: one gap within a span, one over the edge of two, one over whole spans."""
    start = datetime(2026, 3, 2)
    seconds = [5, 9, 4090, 4100, 20_000]
    rows = [("A", start + timedelta(seconds=s), s / 3600, "bioreactor", "DO", float(s), "", "f") for s in seconds]
    rows.append(("B", start + timedelta(seconds=8191), 0.0, "bioreactor", "DO", 1.0, "", "f"))
    rows.append(("B", None, 0.0, "bioreactor", "DO", 2.0, "", "f"))
    found = runlake.resample_grid(spark.createDataFrame(rows, SCHEMA), ["DO"], "1s").collect()
    a = sorted((round((r["timestamp"] - start).total_seconds()), r["DO"]) for r in found if r["run_id"] == "A")
    assert a == [(s, float(s) if s in seconds else None) for s in range(5, 20_001)]
    assert all(r["elapsed_h"] == pytest.approx((r["timestamp"] - start).total_seconds() / 3600) for r in found if r["run_id"] == "A")
    assert [r["DO"] for r in found if r["run_id"] == "B"] == [1.0]


def test_grid_reads_its_rows_once(spark, tmp_path):
    observations(spark).write.parquet(f"{tmp_path}/obs")
    grid = runlake.resample_grid(spark.read.parquet(f"{tmp_path}/obs"), ["DO", "offgas_co2"], "5min")
    assert grid.count() > 0
    grid.collect()
    plan = grid._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan


def test_rows_without_key_or_time_are_numbered_too(spark):
    rows = [("A", T0), ("A", None), (None, T0), (None, None)]
    found = every_nth(spark.createDataFrame(rows, "run_id string, timestamp timestamp_ntz"), 1)
    assert sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame(rows, "run_id string, timestamp timestamp_ntz").collect())


def test_repeated_times_are_averaged_before_bins(spark):
    rows = [("A", T0, 0.0, "bioreactor", "DO", v, "", "f") for v in (1.0, 3.0)]
    rows.append(("A", T0 + timedelta(seconds=10), 10 / 3600, "bioreactor", "DO", 8.0, "", "f"))
    grid = runlake.resample_grid(spark.createDataFrame(rows, SCHEMA), ["DO"], "1min")
    assert [r["DO"] for r in grid.collect()] == [5.0]


def test_traces_grid_dense_and_keep_sparse(spark):
    obs = observations(spark)
    found = runlake.comparable_traces(obs, ["DO", "dcw"], step="30min")
    sizes = {(r["run_id"], r["variable"]): r["count"] for r in found.groupBy("run_id", "variable").count().collect()}
    assert sizes[("C", "dcw")] == 60 and ("C", "DO") not in sizes
    dense = runlake.resample_grid(obs, ["DO"], "30min").filter("DO is not null").groupBy("run_id").count()
    assert {r["run_id"]: r["count"] for r in dense.collect()} == {r: sizes[(r, "DO")] for r in ("A", "B")}
    assert found.filter("value is null").isEmpty()
    only = runlake.comparable_traces(obs, ["DO"], run_ids=["A"], step="7min")
    grid = runlake.resample_grid(obs, ["DO"], "7min", ["A"]).filter("DO is not null").select("elapsed_h", "DO")
    assert sorted((round(r[0], 9), r[1]) for r in only.select("elapsed_h", "value").collect()) == sorted(
        (round(r[0], 9), r[1]) for r in grid.collect()
    )


def test_first_source_decides_how_a_variable_is_drawn(spark):
    t = T0
    rows = [
        ("A", t, 0.0, "bioreactor", "product", 1.0, "g/L", "f"),
        ("A", t, 0.0, "analytical", "product", 5.0, "g/L", "f"),
        ("B", t, 0.0, "offgas", "product", 2.0, "g/L", "f"),
        ("A", t, 0.0, "bioreactor", "glucose", 1.0, "g/L", "f"),
        ("B", t, 0.0, "analytical", "glucose", 2.0, "g/L", "f"),
    ]
    obs = spark.createDataFrame(rows, SCHEMA)
    found = runlake.comparable_traces(obs, ["product", "glucose"])
    got = sorted((r["run_id"], r["variable"], r["value"]) for r in found.collect())
    # product: the first row is analytical, so all points stay. glucose: gridded, but B has points only.
    assert got == [("A", "glucose", 1.0), ("A", "product", 1.0), ("A", "product", 5.0), ("B", "glucose", 2.0), ("B", "product", 2.0)]
    kinds = {r["variable"]: r["is_sparse"] for r in runlake.variable_kinds(obs).collect()}
    assert kinds == {"product": True, "glucose": False}


@pytest.mark.parametrize("width", ["1min", "1h", "30d"])
def test_interpolation_equals_numpy(spark, width):
    rng = random.Random(2)
    knots = sorted(rng.sample(range(2000, 9000), 40))
    values = [rng.uniform(-5, 5) for _ in knots]
    asked = [rng.randrange(0, 12_000) for _ in range(150)] + knots[:3]
    at = lambda s: T0 + timedelta(seconds=s)
    points = spark.createDataFrame(
        [("A", at(s), float(s)) for s in asked] + [("B", at(1), 1.0)], "run_id string, timestamp timestamp_ntz, s double"
    )
    dense = spark.createDataFrame(
        [("A", at(s), v) for s, v in zip(knots, values)], "run_id string, timestamp timestamp_ntz, v double"
    )
    rows = interpolate_at(points, dense, "v", width=width).collect()
    assert len(rows) == len(asked) + 1
    for r in rows:
        if r["run_id"] == "B":
            assert r["interpolated"] is None
        else:
            assert r["interpolated"] == pytest.approx(np.interp(r["s"], knots, values))


def test_numbering_and_decimation_across_spans(spark):
    rng = random.Random(3)
    rows = [(k, T0 + timedelta(seconds=rng.randrange(100_000)), i) for i, k in enumerate(["A"] * 500 + ["B"] * 50)]
    df = spark.createDataFrame(rows, "run_id string, timestamp timestamp_ntz, i int")
    want = {}
    for k in ("A", "B"):
        for n, row in enumerate(sorted((t, i) for r, t, i in rows if r == k), start=1):
            want[(k, row[1])] = n
    got = {(r["run_id"], r["i"]): r["position"] for r in numbered(df, ["run_id"], ["timestamp", "i"], width="1h").collect()}
    assert got == want
    kept = {(r["run_id"], r["i"]) for r in every_nth(df, 7, order=("timestamp", "i"), width="20min").collect()}
    assert kept == {key for key, n in want.items() if n % 7 == 1}
    with pytest.raises(ValueError):
        every_nth(df, 0)


def test_gaps_across_spans(spark):
    seconds = [0, 0, 0, 30, 7200, 7230, 90_000]
    df = spark.createDataFrame([("A", T0 + timedelta(seconds=s)) for s in seconds] + [("B", T0)], "run_id string, timestamp timestamp_ntz")
    got = {(r["run_id"], r["gap_s"]): r["readings"] for r in reading_gaps(df, ["run_id"], width="1h").collect()}
    assert got == {("A", 0.0): 2, ("A", 30.0): 2, ("A", 7170.0): 1, ("A", 82770.0): 1}


def test_run_start_and_vessel_table(spark):
    obs = observations(spark)
    starts = {r["run_id"]: r["start_time"] for r in runlake.run_start(obs).collect()}
    assert starts == {"A": T0, "B": T0 + timedelta(seconds=90_000), "C": T0 + timedelta(seconds=5)}
    runs = spark.createDataFrame([("A", "ambr", "V_1"), ("B", "ambr", "V_2")], "run_id string, system string, vessel_id string")
    wide = runlake.vessel_table(obs, runs, "ambr", [("V_1", "DO_pct", "DO"), ("V_2", "pH", "pH")])
    assert wide.columns == ["timestamp", "V_1_DO_pct", "V_2_pH"]
    times = obs.filter("variable in ('DO', 'pH') and run_id in ('A', 'B')").select("timestamp").distinct().count()
    assert wide.count() == times
    assert wide.agg(F.count("V_1_DO_pct")).first()[0] == obs.filter("run_id = 'A' and variable = 'DO'").select("timestamp").distinct().count()
