"""All sources of all runs on one reference timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import Duration, to_micros
from ..vocabulary import CONTINUOUS, SPARSE, dimension, variables_of
from .pivot import known_variable, with_values
from .nearest import closer, span_width, with_neighbours

CONTINUOUS_TOLERANCE = "5min"
SAMPLE_TOLERANCE = "10min"


def align_sources(
    obs: DataFrame,
    run_ids: Sequence[str] | None = None,
    reference: str = "bioreactor",
    continuous_tolerance: Duration = CONTINUOUS_TOLERANCE,
    sample_tolerance: Duration = SAMPLE_TOLERANCE,
    width: Duration | None = None,
    drop_empty: bool = False,
) -> DataFrame:
    """Wide rows, one per reference time of every run, with the variables of all sources.

    Each reference row takes the nearest reading of every other continuous source. Sparse
    samples go the other way: each lands on its one nearest reference row, the earliest
    wins a shared row, and nothing is filled forward.

    The long table is read once. It is shuffled three times: to make one row per (run,
    source, time), to search all sources together in (run, span), and to bring samples and
    reference rows together by (run, reference time). ``drop_empty`` leaves out variables
    that have no value in any chosen run; a job looks for them first.
    """
    if reference not in CONTINUOUS:
        raise ValueError(f"the reference must be one of {list(CONTINUOUS)}, not {reference!r}")
    others = [s for s in CONTINUOUS if s != reference]
    columns = {s: variables_of(s) for s in (*CONTINUOUS, *SPARSE)}
    near_us, sample_us = to_micros(continuous_tolerance), to_micros(sample_tolerance)
    width_us = span_width(max(near_us, sample_us), width)

    # Variables share numbered places: a row holds those of its own source only, so seven
    # means serve all nineteen variables. A reading that has no place stops the job.
    places = [(s, v, i) for s, names in columns.items() for i, v in enumerate(names)]
    known = F.broadcast(dimension(obs.sparkSession, places, "source string, variable string, _place int"))
    rows = obs.filter(F.col("run_id").isin(list(run_ids))) if run_ids else obs
    if run_ids:
        there = rows.filter(F.col("source") == reference).select("run_id").distinct().collect()  # as many as asked for
        absent = sorted(set(run_ids) - {r["run_id"] for r in there})
        if absent:
            raise ValueError(f"no {reference} readings for run {', '.join(absent)}")
    offered = {s: set(with_values(rows.filter(F.col("source") == s), names)) if drop_empty else set(names) for s, names in columns.items()}
    placed = rows.join(known, ["source", "variable"], "left")
    moments = (
        placed.withColumn("variable", known_variable(F.col("_place").isNotNull()))
        .filter(F.col("variable").isNotNull())
        .groupBy("run_id", "source", "timestamp")
        .agg(
            F.min("elapsed_h").alias("elapsed_h"),
            *[
                F.avg(F.when(F.col("_place") == i, F.col("value"))).alias(f"_v{i}")
                for i in range(max(map(len, columns.values())))
            ],
        )
    )

    at, source = F.col("timestamp"), F.col("source")

    def readings(name: str, *more: Column) -> list[Column]:
        """What a row of one source holds, under the variables' names."""
        return [*more, *[F.col(f"_v{i}").alias(v) for i, v in enumerate(columns[name])]]

    # Samples look for reference rows, reference rows for the other continuous sources.
    sought = {reference: F.struct(at), **{s: F.struct(*readings(s, at)) for s in others}}
    searched = with_neighbours(
        moments,
        ["run_id"],
        "timestamp",
        {s: F.when(source == s, found) for s, found in sought.items()},
        {s: sample_us if s == reference else near_us for s in sought},
        width_us,
    ).filter(~source.isin(others))

    is_base = source == reference
    landed = closer(at, F.col(f"_back_{reference}"), F.col(f"_ahead_{reference}"), "timestamp", sample_us)
    matches = {s: closer(at, F.col(f"_back_{s}"), F.col(f"_ahead_{s}"), "timestamp", near_us) for s in others}
    placed = searched.select(
        "run_id",
        F.when(is_base, at).otherwise(landed["timestamp"]).alias("_place"),
        F.when(is_base, F.col("elapsed_h")).alias("elapsed_h"),
        *[F.when(is_base, F.col(f"_v{i}")).alias(v) for i, v in enumerate(columns[reference])],
        *[F.when(is_base, m[v]).alias(v) for s, m in matches.items() for v in columns[s]],
        *[F.when(source == s, at).alias(f"_at_{s}") for s in SPARSE],
        *[F.when(source == s, F.col(f"_v{i}")).alias(v) for s in SPARSE for i, v in enumerate(columns[s])],
    ).filter(F.col("_place").isNotNull())

    # Exactly one row of each group is a reference row, so max() only passes it on. The
    # samples of a source have distinct times, so min_by takes all columns of one sample.
    # Flat numeric columns keep this a hash aggregation.
    dense = ["elapsed_h", *columns[reference], *[v for s in others for v in columns[s]]]
    empty = [v for s, names in columns.items() for v in names if v not in offered[s]]
    return placed.groupBy("run_id", F.col("_place").alias("timestamp")).agg(
        *[F.max(c).alias(c) for c in dense],
        *[F.min_by(v, f"_at_{s}").alias(v) for s in SPARSE for v in columns[s]],
    ).drop(*empty)


def runs_without_reference(obs: DataFrame, reference: str = "bioreactor") -> DataFrame:
    """Runs that cannot be aligned because the reference source never reported."""
    has = F.max(F.when(F.col("source") == reference, 1).otherwise(0))
    return obs.groupBy("run_id").agg(has.alias("_has")).filter("_has = 0").select("run_id")
