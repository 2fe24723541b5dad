"""Groups of comparable runs, and one run against its group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import exact_median, leave_one_out_median

# Runs are comparable when these agree.
COHORT_KEYS = ("system", "strain", "mode")


def cohorts(runs: DataFrame) -> DataFrame:
    """One row per cohort: keys, size, label and what is held constant. Null keys form none."""
    sized = runs.dropna(subset=list(COHORT_KEYS)).groupBy(*COHORT_KEYS).agg(F.count(F.lit(1)).alias("n_runs"))
    return sized.select(
        *COHORT_KEYS,
        "n_runs",
        F.concat(
            F.concat_ws(" · ", "strain", "mode"), F.lit(" ("), F.col("n_runs").cast("string"), F.lit(" runs)")
        ).alias("label"),
        F.concat(F.concat_ws(", ", "strain", "mode", "system"), F.lit(" control system")).alias("held_constant"),
    )


def ranked_cohorts(runs: DataFrame) -> DataFrame:
    """Cohorts, the largest first, then by label."""
    return cohorts(runs).orderBy(F.desc("n_runs"), "label")


def cohort_members(runs: DataFrame) -> DataFrame:
    """One row per (cohort, run): the run lists of all cohorts as rows, whatever their length."""
    members = runs.dropna(subset=list(COHORT_KEYS)).select("run_id", *COHORT_KEYS)
    return members.join(cohorts(runs), list(COHORT_KEYS))


def cohort_of(runs: DataFrame, run_id: str) -> DataFrame:
    """The members of the cohort a run belongs to; a run in no cohort is an error."""
    keys = runs.dropna(subset=list(COHORT_KEYS)).filter(F.col("run_id") == run_id).select(*COHORT_KEYS)
    if keys.isEmpty():
        raise KeyError(f"run {run_id!r} is in no cohort")
    return cohort_members(runs).join(keys.distinct(), list(COHORT_KEYS), "left_semi")


def cohort_outcomes(runs: DataFrame, run_ids: Sequence[str] | None = None) -> DataFrame:
    """End results of the chosen runs under their display names."""
    chosen = runs.filter(F.col("run_id").isin(list(run_ids))) if run_ids else runs
    return chosen.select(
        F.col("run_id").alias("Run"),
        F.col("vessel_id").alias("Vessel"),
        F.col("duration_h").alias("Duration (h)"),
        F.col("final_biomass_total_gL").alias("Final biomass (g/L)"),
        F.col("final_product_gL").alias("Final product (g/L)"),
        F.col("anomaly").alias("Recorded note"),
    )


def endpoint_leaders(runs: DataFrame) -> DataFrame:
    """Per cohort the run with the highest final biomass, and the note recorded on it.

    Of equal runs the first in manifest order leads, here the lowest run id.
    """
    ended = runs.dropna(subset=[*COHORT_KEYS, "final_biomass_total_gL"])
    best = F.min_by(
        F.struct("run_id", "final_biomass_total_gL", "anomaly"),
        F.struct((-F.col("final_biomass_total_gL")).alias("_down"), F.col("run_id")),
    ).alias("_best")
    return ended.groupBy(*COHORT_KEYS).agg(best).select(*COHORT_KEYS, "_best.*")


_GROUP = [*COHORT_KEYS, "variable"]


def _late_rows(obs: DataFrame, members: DataFrame, variables: Sequence[str] | None) -> DataFrame:
    """Readings of the members from half of the largest elapsed time on.

    That time is taken per variable over the whole cohort, not per run.
    """
    readings = obs.select("run_id", "variable", "elapsed_h", "value")
    if variables:
        readings = readings.filter(F.col("variable").isin(list(variables)))
    # The largest time per run first, so that only one row per (run, variable) meets the manifest.
    longest = readings.groupBy("run_id", "variable").agg(F.max("elapsed_h").alias("_longest"))
    half = longest.join(members, "run_id").groupBy(*_GROUP).agg((F.max("_longest") / 2).alias("_half"))
    pooled = readings.join(members, "run_id")
    return pooled.join(half, _GROUP).filter(F.col("elapsed_h") >= F.col("_half")).drop("elapsed_h", "_half")


def divergence(
    obs: DataFrame, runs: DataFrame, highlighted: str | DataFrame, variables: Sequence[str] | None = None
) -> DataFrame:
    """How far a highlighted run lies from the rest of its cohort over the late half.

    ``highlighted`` is a run id, or a frame with a ``run_id`` column to do this for many
    cohorts at once, at most one run of each. The run's mean stands against the exact median
    of the pooled rows of the other members. Variables without rows on either side, and runs
    that are alone, give nothing.
    """
    chosen = F.col("run_id") == highlighted if isinstance(highlighted, str) else None
    placed = runs.dropna(subset=list(COHORT_KEYS)).select("run_id", *COHORT_KEYS)
    focus = placed.filter(chosen) if chosen is not None else placed.join(highlighted.select("run_id"), "run_id", "left_semi")
    several = F.raise_error(F.concat(F.lit("more than one highlighted run in "), F.concat_ws(", ", *COHORT_KEYS)))
    focus = focus.groupBy(*COHORT_KEYS).agg(F.max("run_id").alias("focus"), F.count(F.lit(1)).alias("_n"))
    focus = focus.withColumn("focus", F.when(F.col("_n") > 1, several).otherwise(F.col("focus"))).drop("_n")
    late = _late_rows(obs, placed.join(focus, list(COHORT_KEYS)), variables)

    is_focus = F.col("run_id") == F.col("focus")
    keys = [*_GROUP, "focus"]
    own = late.filter(is_focus).groupBy(*keys).agg(F.avg("value").alias("highlighted"))
    rest = exact_median(late.filter(~is_focus), keys, "value", name="cohort_median")
    return _difference(own.join(rest, keys).withColumnRenamed("focus", "run_id"))


def divergence_of_all(obs: DataFrame, runs: DataFrame, variables: Sequence[str] | None = None) -> DataFrame:
    """``divergence`` with every run highlighted in turn, as one job that is linear in the rows."""
    members = runs.dropna(subset=list(COHORT_KEYS)).select("run_id", *COHORT_KEYS)
    late = _late_rows(obs, members, variables)
    own = late.groupBy(*_GROUP, "run_id").agg(F.avg("value").alias("highlighted"))
    rest = leave_one_out_median(late, _GROUP, "run_id", "value", "cohort_median")
    return _difference(own.join(rest, [*_GROUP, "run_id"]))


def _difference(both: DataFrame) -> DataFrame:
    return both.select(
        *_GROUP,
        "run_id",
        "highlighted",
        "cohort_median",
        (F.col("highlighted") - F.col("cohort_median")).alias("difference"),
    )
