"""Corrections that need more than one source: sample identity, draw times, elapsed hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas
from ..functions.timing import hours_between
from .registry import known_run, unique_runs


def padded(samples: DataFrame) -> DataFrame:
    """The sample layout, with nulls for the columns that a frame lacks."""
    have = set(samples.columns)
    return samples.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.SAMPLES
        ]
    )


def join_samples(draws: DataFrame, injections: DataFrame) -> DataFrame:
    """One row per physical sample from its manual sheet and its peak table.

    The run is taken from the sheet, so a sample known to the peak table alone has none
    (the quality report shows it). A sample id repeated on either side multiplies.
    """
    both = draws.join(injections.drop("run_id"), "sample_id", "full_outer")
    return padded(both)


def join_if_drawn(draws: DataFrame, injections: DataFrame) -> DataFrame:
    """:func:`join_samples`; if there is not one draw, the samples keep the run of their peak table.

    Whether there is one is found out by the same job.
    """
    theirs = injections.withColumnRenamed("run_id", "_run_id")
    both = draws.join(theirs, "sample_id", "full_outer")
    return padded(both.withColumn("run_id", F.when(draws.exists(), F.col("run_id")).otherwise(F.col("_run_id"))))


def draw_time_lookup(samples: DataFrame) -> DataFrame:
    """(run, injection time) -> draw time, unique; of several samples the first id counts."""
    usable = samples.filter(F.col("injection_time").isNotNull() & F.col("draw_time").isNotNull())
    return usable.groupBy("run_id", "injection_time").agg(
        F.min_by("draw_time", F.struct("sample_id", "draw_time")).alias("draw_time")
    )


def _matched(analytical: DataFrame, samples: DataFrame) -> DataFrame:
    lookup = draw_time_lookup(samples).withColumnRenamed("injection_time", "timestamp")
    return analytical.join(lookup, ["run_id", "timestamp"], "left")


def backdate(obs: DataFrame, samples: DataFrame, watch: Observation | None = None) -> DataFrame:
    """Move analytical rows from injection time to the time the sample was drawn.

    Rows without a known draw time stay as they are. Only analytical rows take part in the
    join; the rest of the table is passed on without a shuffle. ``watch`` counts, in the job that
    computes the result, what :func:`unresolved_injections` counts in one of its own.
    """
    names = obs.columns
    moved = _matched(obs.filter("source = 'analytical'"), samples).withColumn(
        "timestamp", F.coalesce("draw_time", "timestamp")
    )
    # null-safe, so that rows without a source stay for the quality report to show
    others = obs.filter("NOT (source <=> 'analytical')")
    if watch is None:
        return others.unionByName(moved.select(*names))
    # watched above the union, as a branch without rows may be left out of the plan with its counts
    marked = moved.select(*names, F.col("draw_time").isNotNull().alias("_found"))
    both = others.withColumn("_found", F.lit(None).cast("boolean")).unionByName(marked)
    return both.observe(watch, *_unresolved(F.col("_found"))).select(*names)


def _unresolved(found: Column) -> list[Column]:
    """``found`` says whether an analytical row has a draw time; null for other rows."""
    return [F.count(found).alias("analytical_rows"), F.count_if(~found).alias("unresolved")]


def unresolved_injections(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """How many analytical rows there are and how many have no draw time to move to."""
    rows = _matched(obs.filter("source = 'analytical'"), samples)
    return rows.agg(*_unresolved(F.col("draw_time").isNotNull()))


def add_elapsed_hours(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Hours since the start of the run, negative before it. An unknown run stops the job."""
    starts = unique_runs(runs).select("run_id", F.col("start_time").alias("_start"))
    names = [c for c in obs.columns if c != "elapsed_h"]
    joined = obs.select(*names).join(starts, "run_id", "left")
    start = known_run(F.col("run_id"), F.col("_start"))
    filled = joined.withColumn("elapsed_h", hours_between(F.col("timestamp"), start))
    return filled.select(*(obs.columns if "elapsed_h" in obs.columns else [*names, "elapsed_h"]))
