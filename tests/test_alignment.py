"""Nearest joins and alignment against pandas and against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import runlake
from runlake.operators.nearest import match_nearest, snap_samples
from runlake.operators.pivot import pivot_readings

T0 = datetime(2026, 3, 2, 8)


def series(spark, rows, *names):
    kinds = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"run_id string, timestamp timestamp_ntz, {kinds}")


def random_series(seed, runs, n, horizon_s, unit_s=1):
    rng = random.Random(seed)
    rows = []
    for run in runs:
        for s in sorted(rng.sample(range(horizon_s), n)):
            rows.append((run, T0 + timedelta(seconds=s * unit_s), round(rng.uniform(0, 100), 2)))
    return rows


def pandas_nearest(left, right, tolerance):
    parts = []
    for run, mine in left.groupby("run_id"):
        other = right[right.run_id == run].drop(columns="run_id").assign(matched_time=lambda d: d.timestamp)
        parts.append(
            pd.merge_asof(
                mine.sort_values("timestamp"), other.sort_values("timestamp"), on="timestamp",
                direction="nearest", tolerance=pd.Timedelta(tolerance),
            )
        )
    return pd.concat(parts)


def same(spark_df, expected, columns):
    got = spark_df.toPandas().sort_values(["run_id", "timestamp"])[columns].reset_index(drop=True)
    want = expected.sort_values(["run_id", "timestamp"])[columns].reset_index(drop=True)
    for name in columns:
        if pd.api.types.is_datetime64_any_dtype(want[name]):
            got[name], want[name] = got[name].astype("datetime64[us]"), want[name].astype("datetime64[us]")
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_names=False)


@pytest.mark.parametrize("tolerance", ["2s", "20s", "5min"])
@pytest.mark.parametrize("width", [None, "7s", "1h"])
def test_nearest_equals_pandas(spark, tolerance, width):
    left = random_series(1, ["A", "B"], 300, 1500)
    right = random_series(2, ["A", "C"], 200, 1500, unit_s=1)
    found = match_nearest(series(spark, left, "x"), series(spark, right, "y"), tolerance, width=width)
    names = ["run_id", "timestamp"]
    expected = pandas_nearest(
        pd.DataFrame(left, columns=[*names, "x"]), pd.DataFrame(right, columns=[*names, "y"]), tolerance
    )
    same(found, expected, [*names, "x", "y", "matched_time"])


def test_edges_of_the_tolerance_and_ties(spark):
    left = series(spark, [("A", T0 + timedelta(seconds=s), float(s)) for s in (10, 100, 200, 300)], "x")
    right = series(
        spark,
        [("A", T0 + timedelta(seconds=s), float(s)) for s in (0, 20, 110, 189, 211, 300)],
        "y",
    )
    found = {r["x"]: r["y"] for r in match_nearest(left, right, "10s").collect()}
    assert found == {10.0: 0.0, 100.0: 110.0, 200.0: None, 300.0: 300.0}


def test_sub_second_times_and_tolerance(spark):
    left = series(spark, [("A", T0 + timedelta(microseconds=500), 1.0)], "x")
    right = series(spark, [("A", T0 + timedelta(microseconds=m), float(m)) for m in (0, 1200)], "y")
    assert match_nearest(left, right, "500us").first()["y"] == 0.0
    assert match_nearest(left, right, 499).first()["y"] is None


def test_times_before_1970(spark):
    early = datetime(1969, 12, 31, 23, 59, 58)
    left = series(spark, [("A", early, 1.0)], "x")
    right = series(spark, [("A", early + timedelta(seconds=3), 2.0)], "y")
    assert match_nearest(left, right, "3s").first()["y"] == 2.0


def brute_snap(samples, reference, tolerance_s):
    placed = {}
    for run, t, *values in sorted(samples, key=lambda r: r[1]):
        near = [(abs((t - u).total_seconds()), u) for r, u, *_ in reference if r == run]
        near = [c for c in near if c[0] <= tolerance_s]
        if near:
            placed.setdefault((run, min(near)[1]), values)
    return placed


def test_snap_keeps_the_first_sample_whole(spark):
    reference = random_series(3, ["A", "B"], 80, 4000)
    samples = [(r, t, None if i % 3 == 0 else v, float(i)) for i, (r, t, v) in enumerate(random_series(4, ["A", "B"], 150, 4000))]
    found = snap_samples(series(spark, samples, "p", "q"), series(spark, reference, "x"), "30s", width="45s")
    got = {(r["run_id"], r["timestamp"]): [r["p"], r["q"]] for r in found.collect()}
    assert got == brute_snap(samples, reference, 30)
    assert any(v[0] is None for v in got.values())


@pytest.fixture(scope="module")
def observations(spark):
    rng = random.Random(5)
    rows = []
    for run in ("A", "B", "C"):
        for source, variables, every, n in (
            ("bioreactor", ("DO", "pH"), 60, 240),
            ("offgas", ("offgas_co2",), 30, 400),
            ("capacitance", ("permittivity",), 120, 100),
            ("analytical", ("glucose", "product"), 1500, 9),
            ("offline", ("dcw",), 700, 20),
        ):
            if run == "C" and source in ("capacitance", "bioreactor"):
                continue
            for i in range(n):
                if rng.random() < 0.2:
                    continue
                t = T0 + timedelta(seconds=every * i + rng.randrange(every))
                for v in variables:
                    if rng.random() < 0.8:
                        hours = (t - T0).total_seconds() / 3600
                        for _ in range(1 + (rng.random() < 0.05)):
                            rows.append((run, t, hours, source, v, round(rng.uniform(0, 10), 2), "", "f"))
    return spark.createDataFrame(
        rows,
        "run_id string, timestamp timestamp_ntz, elapsed_h double, source string, variable string, value double, "
        "unit string, source_file string",
    ).cache()


VARIABLES = ["DO", "pH", "offgas_co2", "permittivity", "glucose", "product", "dcw"]


def closest(times, moment, seconds):
    """The time nearest to a moment, the earlier of two equally near ones; None beyond the tolerance."""
    gaps = [(abs((t - moment).total_seconds()), t) for t in times]
    gap, found = min(gaps, default=(None, None))
    return found if gap is not None and gap <= seconds else None


def brute_aligned(rows, reference, near_s, far_s):
    """(run, time) -> values in the order of VARIABLES, by looking at every pair of times."""
    means = {}
    for r in rows:
        means.setdefault((r["run_id"], r["source"], r["timestamp"]), {}).setdefault(r["variable"], []).append(r["value"])
    means = {key: {v: sum(x) / len(x) for v, x in cells.items()} for key, cells in means.items()}
    table = {(run, at): dict(cells) for (run, source, at), cells in means.items() if source == reference}
    for run, at in list(table):
        for source in {"bioreactor", "offgas", "capacitance"} - {reference}:
            hit = closest([t for r, s, t in means if (r, s) == (run, source)], at, near_s)
            if hit is not None:
                table[run, at].update(means[run, source, hit])
    taken = set()
    for run, source, at in sorted((k for k in means if k[1] in ("analytical", "offline")), key=lambda k: k[2]):
        home = closest([t for r, t in table if r == run], at, far_s)
        if home is not None and (run, source, home) not in taken:
            taken.add((run, source, home))
            table[run, home].update(means[run, source, at])
    return {key: [cells.get(v) for v in VARIABLES] for key, cells in table.items()}


@pytest.mark.parametrize(
    ("reference", "near", "far", "width"),
    [("bioreactor", 300, 600, None), ("bioreactor", 40, 90, "3min"), ("offgas", 120, 60, None)],
)
def test_alignment_equals_brute_force(spark, observations, reference, near, far, width):
    found = runlake.align_sources(
        observations, reference=reference, continuous_tolerance=f"{near}s", sample_tolerance=f"{far}s", width=width
    ).collect()
    want = brute_aligned(observations.collect(), reference, near, far)
    assert len(found) == len(want)
    for r in found:
        assert [r[v] for v in VARIABLES] == [x if x is None else pytest.approx(x) for x in want[r["run_id"], r["timestamp"]]]
        assert r["elapsed_h"] == pytest.approx((r["timestamp"] - T0).total_seconds() / 3600)


def test_what_cannot_be_aligned_is_named(spark, observations):
    with pytest.raises(ValueError, match="no bioreactor readings for run C"):
        runlake.align_sources(observations, run_ids=["A", "C"])
    strange = observations.withColumn("variable", F.when(F.col("variable") == "pH", "mood").otherwise(F.col("variable")))
    with pytest.raises(Exception, match="no column for bioreactor/mood"):
        runlake.align_sources(strange).collect()
    with pytest.raises(Exception, match="no column for bioreactor/mood"):
        pivot_readings(strange, "bioreactor").collect()
    assert pivot_readings(strange, "bioreactor", ["DO"]).count() > 0


def test_drop_empty_leaves_out_variables_without_values(spark, observations):
    full = runlake.align_sources(observations)
    slim = runlake.align_sources(observations, drop_empty=True)
    filled = [c for c in full.columns if full.filter(F.col(c).isNotNull()).count()]
    present = {r["variable"] for r in observations.filter("value is not null").select("variable").distinct().collect()}
    assert slim.columns == [c for c in full.columns if c in ("run_id", "timestamp", "elapsed_h") or c in present]
    assert set(filled) <= set(slim.columns) and len(slim.columns) < len(full.columns)
    assert sorted(map(str, slim.collect())) == sorted(map(str, full.select(*slim.columns).collect()))
    wide = pivot_readings(observations, "bioreactor")
    short = pivot_readings(observations, "bioreactor", drop_empty=True)
    assert set(short.columns) == {"run_id", "timestamp", *[v for v in wide.columns if v in present]} != set(wide.columns)
    assert sorted(map(str, short.collect())) == sorted(map(str, wide.select(*short.columns).collect()))
    none = observations.filter("source = 'bioreactor'").withColumn("value", F.lit(None).cast("double"))
    assert pivot_readings(none, "bioreactor", drop_empty=True).columns == ["run_id", "timestamp"]
    assert pivot_readings(none, "bioreactor", drop_empty=True).count() == wide.count()


def test_alignment_schema_and_run_choice(spark, observations):
    found = runlake.align_sources(observations, run_ids=["A"])
    assert found.columns[:4] == ["run_id", "timestamp", "elapsed_h", "DO"]
    assert found.columns[10:13] == ["offgas_co2", "offgas_flow", "offgas_o2"]
    assert {r["run_id"] for r in found.select("run_id").distinct().collect()} == {"A"}
    with pytest.raises(ValueError, match="reference"):
        runlake.align_sources(observations, reference="offline")
    assert [r["run_id"] for r in runlake.runs_without_reference(observations).collect()] == ["C"]


def test_one_shuffle_per_step_and_no_join(spark, observations):
    wide = runlake.align_sources(observations)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    # The only join brings in the constant list of variables.
    assert plan.count("Join") == plan.count("BroadcastHashJoin") == 1 and plan.count("LocalTableScan") == 1
    assert "Python" not in plan and "SortAggregate" not in plan


def test_a_run_with_most_rows_is_spread_over_tasks(spark):
    """Windows are partitioned by (run, span), so one hot run uses many partitions."""
    n = 20_000
    hot = spark.range(n).select(
        F.lit("H").alias("run_id"), (F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0,0,0,id)")).alias("timestamp"),
        F.col("id").cast("double").alias("x"),
    )
    other = hot.filter("x % 7 = 3").withColumnRenamed("x", "y")
    found = match_nearest(hot, other, "10s")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < n / 3
    assert found.filter("abs(x - y) > 3 or y is null").count() <= 4


@pytest.mark.parametrize(("tolerance", "width"), [("30d", "10min"), ("30d", None), ("3h", "1min")])
def test_long_tolerances_equal_pandas(spark, tolerance, width):
    left = random_series(21, ["A", "B", "C"], 200, 90_000) + [("D", T0, 1.0)]
    right = random_series(22, ["A", "B"], 25, 90_000) + [("C", T0 + timedelta(days=29), 3.0), ("D", T0 + timedelta(days=31), 4.0)]
    found = match_nearest(series(spark, left, "x"), series(spark, right, "y"), tolerance, width=width)
    names = ["run_id", "timestamp"]
    expected = pandas_nearest(pd.DataFrame(left, columns=[*names, "x"]), pd.DataFrame(right, columns=[*names, "y"]), tolerance)
    same(found, expected, [*names, "x", "y", "matched_time"])


def test_carried_edges_with_null_keys_and_times(spark):
    left = series(spark, [(None, T0, 1.0), ("A", None, 2.0), ("A", T0 + timedelta(hours=9), 3.0)], "x")
    right = series(spark, [(None, T0 + timedelta(hours=5), 7.0), ("A", T0, 8.0)], "y")
    found = {r["x"]: r["y"] for r in match_nearest(left, right, "2d", width="1h").collect()}
    assert found == {1.0: 7.0, 2.0: None, 3.0: 8.0}


def test_a_long_tolerance_copies_no_rows_and_uses_many_tasks(spark):
    n = 20_000
    hot = spark.range(n).select(
        F.lit("H").alias("run_id"), (F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0,0,0,id)")).alias("timestamp"),
        F.col("id").cast("double").alias("x"),
    )
    other = hot.filter("x % 7 = 3").withColumnRenamed("x", "y")
    found = match_nearest(hot, other, "30d", width="5min")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < n / 3
    assert found.filter("abs(x - y) > 3 or y is null").count() <= 4
    far = match_nearest(hot.limit(1), other.filter("y > 19990"), "30d", width="5min").first()
    assert (far["x"], far["y"]) == (0.0, 19995.0)


def test_alignment_with_a_long_tolerance_equals_brute_force(spark, observations):
    found = runlake.align_sources(observations, continuous_tolerance="2h", sample_tolerance="20h", width="30min").collect()
    want = brute_aligned(observations.collect(), "bioreactor", 7200, 72_000)
    assert len(found) == len(want)
    for r in found:
        assert [r[v] for v in VARIABLES] == [x if x is None else pytest.approx(x) for x in want[r["run_id"], r["timestamp"]]]
