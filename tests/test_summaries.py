"""Provenance, outcomes, panels, checks and corrections."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import runlake
from runlake.operators.ranks import from_bits, last_value, ordered_bits
from runlake.operators.summaries import end_readings
from runlake.operators.corrections import draw_time_lookup
from runlake.vocabulary import TRACES, UNITS, dimension

T0 = datetime(2026, 3, 2, 8)
SCHEMA = (
    "run_id string, timestamp timestamp_ntz, elapsed_h double, source string, variable string, value double, "
    "unit string, source_file string"
)


def row(run, seconds, source, variable, value, file="f.csv", unit=None):
    return (run, T0 + timedelta(seconds=seconds), seconds / 3600, source, variable, value, unit or UNITS.get(variable, ""), file)


@pytest.fixture(scope="module")
def obs(spark):
    rows = [row("R1", s, "bioreactor", v, float(s)) for s in (0, 60, 120, 180) for v in ("pH", "DO")]
    rows += [row("R1", 90_000, "bioreactor", "pH", 5.0, "g.csv")]
    rows += [row("R1", 7200 * i, "offline", "dcw", 1.0 + i) for i in range(3)] + [row("R1", 5, "analytical", "product", 2.345)]
    rows += [row("R2", 0, "probe", "dcw", 9.0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_provenance(obs):
    found = {(r["run_id"], r["source"]): r for r in runlake.source_provenance(obs).collect()}
    line = found[("R1", "bioreactor")]
    assert (line["label"], line["files"], line["variables"], line["points"]) == ("Bioreactor control system", "f.csv, g.csv", 2, 9)
    # DO is the first variable; the late pH reading does not count.
    assert line["cadence"] == "60 s" and line["last_reading"] == T0 + timedelta(seconds=180)
    assert found[("R1", "offline")]["cadence"] == "2.0 h"
    assert found[("R1", "analytical")]["cadence"] == "single reading"
    assert found[("R2", "probe")]["label"] == "probe"


def test_outcomes_and_table(obs):
    assert {r["run_id"]: r["outcome"] for r in runlake.run_outcomes(obs).collect()} == {
        "R1": "Final biomass **3.00** g/L · Final product **2.34** g/L",
        "R2": "Final biomass **9.00** g/L",
    }
    table = {(r["run_id"], r["source"], r["variable"]): r for r in runlake.data_table(obs).collect()}
    ph = table[("R1", "bioreactor", "pH")]
    assert (ph["points"], ph["minimum"], ph["maximum"], ph["final"]) == (5, 0.0, 180.0, 5.0)
    runs = obs.select("run_id").distinct().withColumns({"final_biomass_total_gL": F.lit(0.0), "final_product_gL": F.lit(0.0)})
    ends = {r["run_id"]: (r["final_biomass_total_gL"], r["final_product_gL"]) for r in runlake.with_end_values(runs, obs).collect()}
    assert ends["R1"] == (3.0, 2.345) and ends["R2"] == (9.0, None)


def test_panels(spark, obs):
    assert len({t[1] for t in TRACES}) == 10 and len(TRACES) == 14
    assert len({t[3] for t in TRACES}) == 14 and {t[3] for t in TRACES} <= set(UNITS)
    shown = runlake.panels_with_data(obs)
    assert {r["panel"] for r in shown.filter("run_id = 'R2'").collect()} == {"Biomass"}
    assert runlake.panels_with_data(obs, ["actuator"]).isEmpty()
    labels = {r["variable"]: (r["label"], r["legend_label"]) for r in runlake.variable_labels(spark).collect()}
    assert labels["dcw"] == ("Dry cell weight", "Dry cell weight (g/L)") and labels["pH"] == ("pH", "pH")
    points = runlake.trend_series(obs, "timestamp").filter("run_id = 'R1' and variable = 'pH'").collect()
    assert [p["x"] for p in points] == sorted(p["x"] for p in points) and len(points) == 5
    with pytest.raises(ValueError):
        runlake.trend_series(obs, "value")


def test_descriptions(spark):
    runs = spark.createDataFrame(
        [("R1", "V1", "dasgip", "batch", "K12", 36.0, 5.0, "spill")],
        "run_id string, vessel_id string, system string, mode string, strain string, duration_h double, volume_L double, anomaly string",
    )
    line = runlake.run_descriptions(runs).first()
    assert line["conditions"] == "K12 · batch · V1 (dasgip) · 5 L · 36 h"
    assert line["option_label"] == "R1 · K12 · batch" and line["note"] == "Recorded note on this run: spill."


def test_report_and_guard(spark, obs):
    runs = spark.createDataFrame([("R1", "V", "s", "m", T0), ("R1", "V", "s", None, T0)], "run_id string, vessel_id string, system string, mode string, start_time timestamp_ntz")
    samples = spark.createDataFrame([("s1", "R1"), ("s1", None), ("s2", "R7")], "sample_id string, run_id string")
    spoiled = obs.unionByName(spark.createDataFrame([row("R1", 1, "bioreactor", "mood", 1.0), row("R1", 1, "offline", "dcw", None, unit="kg")], SCHEMA))
    found = {(r["check"], r["key"]): r["n_bad"] for r in runlake.quality_report(spoiled, runs, samples).collect()}
    assert found == {
        ("unknown source", "probe"): 1, ("unknown variable", "mood"): 1, ("wrong unit", "dcw kg"): 1,
        ("observations: orphan run_id", "R2"): 1, ("observations: null", "value"): 1, ("runs: repeated run_id", "R1"): 2,
        ("runs: null", "mode"): 1, ("samples: null", "run_id"): 1, ("samples: repeated sample_id", "s1"): 2,
        ("samples: orphan run_id", "R7"): 1,
    }
    with pytest.raises(runlake.QualityError, match="unknown variable 'mood'"):
        runlake.assert_clean(runlake.quality_report(spoiled, runs, samples))
    clean = obs.filter("run_id = 'R1'")
    assert runlake.guarded(clean).count() == clean.count() and runlake.guarded(clean).columns == clean.columns
    with pytest.raises(Exception, match="unknown source: probe"):
        runlake.guarded(obs).collect()
    assert runlake.missing_columns(obs.drop("unit")) == ["unit"]
    assert [r["run_id"] for r in runlake.orphan_runs(obs, runs).collect()] == ["R2"]
    bad = {(r["run_id"], r["variable"]): r["n_bad"] for r in runlake.implausible(obs).collect()}
    assert bad == {("R1", "DO"): 2, ("R1", "pH"): 4}


def test_backdating(spark):
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    samples = spark.createDataFrame(
        [("s2", "R1", at(0), at(90)), ("s1", "R1", at(5), at(90)), ("s3", "R1", None, at(200)), ("s4", "R2", at(7), at(90))],
        "sample_id string, run_id string, draw_time timestamp_ntz, injection_time timestamp_ntz",
    )
    rows = [row("R1", 90 * 60, "analytical", "glucose", 1.0), row("R1", 200 * 60, "analytical", "glucose", 2.0), row("R1", 90 * 60, "offline", "dcw", 3.0)]
    obs = spark.createDataFrame(rows, SCHEMA)
    times = {r["value"]: r["timestamp"] for r in runlake.backdate(obs, samples).collect()}
    assert times == {1.0: at(5), 2.0: at(200), 3.0: at(90)}
    counts = runlake.unresolved_injections(obs, samples).first()
    assert (counts["analytical_rows"], counts["unresolved"]) == (2, 1)
    assert draw_time_lookup(samples).count() == 2
    nothing = samples.filter("false")
    assert runlake.backdate(obs, nothing).exceptAll(obs).isEmpty()


def test_elapsed_hours_reject_unknown_runs(spark, obs):
    runs = spark.createDataFrame([("R1", T0 + timedelta(hours=1))], "run_id string, start_time timestamp_ntz")
    timed = runlake.add_elapsed_hours(obs.filter("run_id = 'R1'"), runs)
    assert timed.columns == obs.columns and timed.agg(F.min("elapsed_h")).first()[0] == -1.0
    with pytest.raises(Exception, match="run not in the manifest: R2"):
        runlake.add_elapsed_hours(obs, runs).collect()


def test_constant_rows_are_part_of_the_plan(spark):
    table = dimension(spark, [("a", 1.5, None), ("it's", None, "x")], "name string, size double, note string")
    assert [tuple(r) for r in table.collect()] == [("a", 1.5, None), ("it's", None, "x")]
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()


def test_last_values_are_packed_in_order(spark):
    """Any double comes back from its bits; the last one by time, of equal times the larger, without a sort of the rows."""
    values = [1.5, -2.25, 0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, -1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r["v"] == r["w"] for r in df.withColumn("w", from_bits(ordered_bits(F.col("v")))).collect())
    rows = [("a", t, v) for t in (63_000_000_000_000_000, -5) for v in values if v < 9] + [("b", None, 1.0), ("b", 2, None)]
    rows += [("c", 3, -7.25), ("c", 3, -7.5), ("c", 2, 9.0), ("d", -4, float("-inf")), ("d", -5, 1.0), ("e", 1, float("nan")), ("e", 1, 5.0)]
    found = spark.createDataFrame(rows, "g string, t long, v double").groupBy("g").agg(last_value(F.col("t"), F.col("v")).alias("x"))
    got = {r["g"]: r["x"] for r in found.collect()}
    assert got.pop("e") != got.get("e") and got == {"a": 1.5, "b": None, "c": -7.25, "d": float("-inf")}


def test_tables_of_last_values_sort_no_readings(obs):
    for df in (runlake.data_table(obs), end_readings(obs, ["dcw", "product"]), end_readings(obs, ["dcw"], "timestamp")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        first = plan[plan.rindex("partial_max") :]
        assert "SortAggregate" not in first and "HashAggregate" in plan
    assert "SortAggregate" not in runlake.data_table(obs)._jdf.queryExecution().executedPlan().toString()
