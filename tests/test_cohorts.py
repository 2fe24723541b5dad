"""Exact medians, cohorts, divergence."""

import math
import random
import struct
from datetime import datetime
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

import runlake
from runlake.operators import ranks
from runlake.operators.ranks import exact_median, leave_one_out_median, ordered_bits

T0 = datetime(2026, 3, 2, 8)


def test_buckets_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted(
        [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, float("inf"), float("-inf"), 1.0, 1.0000001, -1.0, 2.0**40, 2.0**-40]
        + [rng.uniform(-1, 1) * 10 ** rng.randrange(-15, 15) for _ in range(2000)]
    )
    values += [5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -5e-324, float("nan")]
    values += [2.0**k * f for k in range(-1022, 1023, 7) for f in (1.0, 1 - 2.0**-53, 1 + 2.0**-52)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = df.withColumn("b", ordered_bits(F.col("v"))).orderBy("v").collect()
    assert [r["b"] for r in found] == sorted(r["b"] for r in found)
    for r in found:
        bits = int.from_bytes(struct.pack(">d", abs(r["v"])), "big")
        assert r["b"] == (bits if not r["v"] < 0 else -bits) or (math.isnan(r["v"]) and r["b"] == (2047 << 52) + 1)


def test_a_median_of_nearly_equal_values_is_spread_over_tasks(spark):
    """1.013 plus or minus 1e-5: all in one coarse prefix, and still in even shares of the last step."""
    n = 40_000
    noise = (F.xxhash64("id") % 1_000_000) * 1e-11
    df = spark.range(n).select(F.lit("H").alias("g"), (1.013 + noise).alias("v"))
    counts = ranks._counts(df, ["g"], "v", F.count(F.lit(1)))
    assert counts.select("_coarse").distinct().count() == 1
    sizes = [r["count"] for r in counts.repartition(8, "g", "_fine").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    assert exact_median(df, ["g"], "v").first()["median"] == median([r["v"] for r in df.collect()])


def test_values_that_share_a_fine_prefix(spark):
    """Neighbouring doubles, equal ones, infinities; medians and leave-one-out medians."""
    rows = [("x", f"m{i % 3}", 1.0 + (i % 40) * 2.0**-52) for i in range(101)]
    rows += [("y", "m0", v) for v in (float("-inf"), -1.0, -1.0, 3.0, float("inf"))] + [("y", "m1", 2.0), ("z", "m0", None), ("z", "m1", 4.0)]
    df = spark.createDataFrame(rows, "g string, m string, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert got == {g: median([v for h, _, v in rows if h == g and v is not None]) for g in "xyz"}
    got = {(r["g"], r["m"]): r["median_of_others"] for r in leave_one_out_median(df, ["g"], "m", "v").collect()}
    pools = {(g, m): [v for h, k, v in rows if h == g and k != m and v is not None] for g, m, v in rows if v is not None}
    assert got == {key: median(pool) for key, pool in pools.items() if pool}


def test_medians_are_lazy(spark):
    """Nothing runs, and nothing is written, before the result is asked for."""
    df = spark.range(10).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("m"), F.raise_error(F.lit("ran")).cast("double").alias("v"))
    leave_one_out_median(df, ["g"], "m", "v")
    exact_median(df, ["g"], "v")


@pytest.mark.parametrize("seed", range(3))
def test_median_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    groups = {g: [round(rng.gauss(0, 3), rng.choice([0, 2, 9])) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 800))}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert got == pytest.approx({g: median(vs) for g, vs in groups.items()})


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 2), ("a", 9.0, 1), ("a", 5.0, 1)], "g string, v double, w bigint")
    assert exact_median(df, ["g"], "v", "w").first()["median"] == median([1, 1, 1, 5, 5, 5, 9])


@pytest.mark.parametrize("seed", range(3))
def test_leave_one_out_equals_brute_force(spark, seed):
    rng = random.Random(10 + seed)
    rows = []
    for g in ("x", "y", "z"):
        for m, n in (("m1", 200), ("m2", 37), ("m3", 1), ("m4", 90)):
            if g == "z" and m != "m1":
                continue
            center = rng.uniform(-5, 5)
            rows += [(g, m, round(rng.gauss(center, 2), rng.choice([0, 1, 6]))) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, m string, v double")
    got = {(r["g"], r["m"]): r["median_of_others"] for r in leave_one_out_median(df, ["g"], "m", "v").collect()}
    want = {}
    for g, m in {(g, m) for g, m, _ in rows}:
        rest = [v for h, k, v in rows if h == g and k != m]
        if rest:
            want[(g, m)] = median(rest)
    assert got == pytest.approx(want)


RUNS = [
    ("R1", "V1", "dasgip", "batch", "K12", 9.8, ""), ("R2", "V2", "dasgip", "batch", "K12", 9.8, ""),
    ("R3", "V3", "dasgip", "batch", "K12", 10.1, "contamination"), ("A1", "W1", "ambr", "fed", "CHO", 8.0, ""),
    ("A2", "W2", "ambr", "fed", "CHO", None, ""), ("N1", "W3", "ambr", "fed", None, 99.0, ""),
    ("S1", "V4", "dasgip", "fed", "K12", 1.0, ""),
]


@pytest.fixture(scope="module")
def runs(spark):
    names = "run_id string, vessel_id string, system string, mode string, strain string, final_biomass_total_gL double, anomaly string"
    df = spark.createDataFrame(RUNS, names)
    return df.withColumns({"duration_h": F.lit(36.0), "final_product_gL": F.lit(1.5), "volume_L": F.lit(0.25)}).cache()


def test_cohorts(spark, runs):
    ranked = runlake.ranked_cohorts(runs).collect()
    assert [(r["strain"], r["mode"], r["n_runs"]) for r in ranked] == [("K12", "batch", 3), ("CHO", "fed", 2), ("K12", "fed", 1)]
    assert ranked[0]["label"] == "K12 · batch (3 runs)"
    assert ranked[0]["held_constant"] == "K12, batch, dasgip control system"
    assert {r["run_id"] for r in runlake.cohort_of(runs, "R2").collect()} == {"R1", "R2", "R3"}
    assert runlake.cohort_members(runs).filter("run_id = 'N1'").isEmpty()
    for unknown in ("N1", "Q"):
        with pytest.raises(KeyError):
            runlake.cohort_of(runs, unknown)


def test_endpoints(spark, runs):
    best = {r["system"] + r["mode"]: (r["run_id"], r["anomaly"]) for r in runlake.endpoint_leaders(runs).collect()}
    assert best == {"dasgipbatch": ("R3", "contamination"), "ambrfed": ("A1", ""), "dasgipfed": ("S1", "")}
    table = runlake.cohort_outcomes(runs, ["R1", "R3"])
    assert table.columns == ["Run", "Vessel", "Duration (h)", "Final biomass (g/L)", "Final product (g/L)", "Recorded note"]
    assert {r["Run"] for r in table.collect()} == {"R1", "R3"}


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(7)
    rows = []
    for run, length, level in (("R1", 30, 5.0), ("R2", 36, 5.1), ("R3", 36, 1.0), ("A1", 90, 7.0), ("A2", 90, 7.2), ("S1", 5, 0.0)):
        for i in range(300):
            rows.append((run, T0, length * i / 299, "bioreactor", "DO", rng.gauss(level, 0.1)))
    rows.append(("R1", T0, 1.0, "offline", "dcw", 4.0))
    rows.append(("R2", T0, 9.0, "offline", "dcw", 5.0))
    return spark.createDataFrame(
        rows, "run_id string, timestamp timestamp_ntz, elapsed_h double, source string, variable string, value double"
    ).cache()


def expected_divergence(rows, run, others, variable):
    mine = [r for r in rows if r["variable"] == variable and r["run_id"] in {run, *others}]
    half = max(r["elapsed_h"] for r in mine) / 2
    focus = [r["value"] for r in mine if r["run_id"] == run and r["elapsed_h"] >= half]
    rest = [r["value"] for r in mine if r["run_id"] in others and r["elapsed_h"] >= half]
    return (mean(focus), median(rest)) if focus and rest else None


def test_divergence_of_one_run(spark, runs, readings):
    found = {r["variable"]: r for r in runlake.divergence(readings, runs, "R3").collect()}
    want = expected_divergence(readings.collect(), "R3", {"R1", "R2"}, "DO")
    assert set(found) == {"DO"}
    assert (found["DO"]["highlighted"], found["DO"]["cohort_median"]) == pytest.approx(want)
    assert found["DO"]["difference"] == pytest.approx(want[0] - want[1]) and found["DO"]["difference"] < -3
    healthy = runlake.divergence(readings, runs, "R1", ["DO"]).first()["difference"]
    usual = expected_divergence(readings.collect(), "R1", {"R2", "R3"}, "DO")
    assert healthy == pytest.approx(usual[0] - usual[1]) and abs(healthy) < abs(found["DO"]["difference"])
    assert runlake.divergence(readings, runs, "S1").isEmpty()
    # R1 has no dcw reading in the late half of the cohort.
    assert runlake.divergence(readings, runs, "R1", ["dcw"]).isEmpty()


def test_divergence_of_many_runs(spark, runs, readings):
    leaders = runlake.endpoint_leaders(runs)
    many = {(r["run_id"], r["variable"]): r["difference"] for r in runlake.divergence(readings, runs, leaders).collect()}
    every = {(r["run_id"], r["variable"]): r["difference"] for r in runlake.divergence_of_all(readings, runs).collect()}
    assert set(every) == {(r, "DO") for r in ("R1", "R2", "R3", "A1", "A2")}
    assert many == pytest.approx({k: v for k, v in every.items() if k[0] in ("R3", "A1")})
    rows = readings.collect()
    for run, others in (("R2", {"R1", "R3"}), ("A2", {"A1"})):
        want = expected_divergence(rows, run, others, "DO")
        assert every[(run, "DO")] == pytest.approx(want[0] - want[1])
    two = spark.createDataFrame([("R1",), ("R2",)], "run_id string")
    with pytest.raises(Exception, match="more than one highlighted run"):
        runlake.divergence(readings, runs, two).collect()
