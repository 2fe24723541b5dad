"""Regular time grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import DAY_US, Duration, hours_between, midnight, origin, slot, slot_start, to_micros
from ..vocabulary import CONTINUOUS, SPARSE, variables_of
from .pivot import mean_of

DEFAULT_STEP = "5min"
_BLOCK = 4096


def _first_reading() -> list[Column]:
    """The earliest row of a group, from which elapsed hours of any other moment follow."""
    return [F.min("timestamp").alias("_t0"), F.min_by("elapsed_h", "timestamp").alias("_e0")]


def _elapsed_at(moment: Column) -> Column:
    return F.col("_e0") + hours_between(moment, F.col("_t0"))


def _anchor(step_us: int) -> Column | None:
    """Bins start at midnight of the first day. Steps that divide a day give the same bins
    from any midnight, which saves looking up the first day of each series."""
    return origin() if DAY_US % step_us == 0 else None


def resample_grid(
    obs: DataFrame,
    variables: Sequence[str] | None = None,
    step: Duration = DEFAULT_STEP,
    run_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Continuous readings averaged onto a regular grid per run, empty bins included.

    Readings at one time are averaged first, then the times within a bin. Bins are
    left-closed and named by their start; the grid of a run reaches from its first to its
    last bin over all chosen variables. The readings are read once (and once more, for the
    first day of each run alone, where the step does not divide a day).
    """
    step_us = to_micros(step)
    names = list(variables) if variables else [v for s in CONTINUOUS for v in variables_of(s)]
    rows = obs.filter(F.col("source").isin(*CONTINUOUS) & F.col("variable").isin(names))
    if run_ids:
        rows = rows.filter(F.col("run_id").isin(list(run_ids)))

    moments = (
        rows.filter(F.col("timestamp").isNotNull())
        .groupBy("run_id", "timestamp")
        .agg(F.min("elapsed_h").alias("elapsed_h"), *[mean_of(v) for v in names])
    )
    anchor, series = _anchor(step_us), ["run_id"]
    if anchor is None:
        firsts = rows.groupBy(F.col("run_id").alias("_run")).agg(midnight(F.min("timestamp")).alias("_anchor"))
        moments = moments.join(firsts, F.col("run_id").eqNullSafe(F.col("_run")))
        anchor, series = F.col("_anchor"), ["run_id", "_anchor"]
    number = slot(F.col("timestamp"), step_us, anchor)
    bins = moments.groupBy(*series, number.alias("_bin")).agg(*_first_reading(), *[F.avg(v).alias(v) for v in names])
    return _filled(bins, names).select(
        "run_id",
        slot_start(F.col("_at"), step_us, anchor).alias("timestamp"),
        _elapsed_at(slot_start(F.col("_at"), step_us, anchor)).alias("elapsed_h"),
        *names,
    )


def _filled(bins: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each bin, and the empty ones up to the next bin of its run, as ``_at``; ``_t0`` and ``_e0`` are those of the run.

    Bins are cut into spans, so that a long run is many tasks. Within a span the next bin is the
    following row; behind its last bin it is the first bin of the next span that has any, from a
    summary of one row per span. Empty bins are made last and are never shuffled.
    """
    bins = bins.withColumn("_span", F.call_function("div", "_bin", F.lit(_BLOCK)))
    # The summary takes first rows whole: it then reads the very shuffle that made the bins.
    row = F.struct("_bin", "_t0", "_e0", *names)
    edges = bins.groupBy(F.col("run_id").alias("_run"), F.col("_span").alias("_of")).agg(F.min(row).alias("_first"))
    along = Window.partitionBy("_run").orderBy("_of")
    edges = edges.select(
        "_run",
        "_of",
        F.lead("_first._bin").over(along).alias("_next"),
        F.first("_first._t0").over(along).alias("_run_t0"),
        F.first("_first._e0").over(along).alias("_run_e0"),
    )
    following = F.lead("_bin").over(Window.partitionBy("run_id", "_span").orderBy("_bin"))
    linked = bins.withColumn("_following", following)
    # an outer join, though every span has its summary: an inner one would filter one reader of the shuffle only
    linked = linked.join(edges, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_span") == F.col("_of")), "left")
    linked = linked.withColumns({"_t0": F.coalesce("_run_t0", "_t0"), "_e0": F.coalesce("_run_e0", "_e0")})
    upto = F.coalesce("_following", "_next", F.col("_bin") + 1) - 1
    # a long gap is laid out block by block, never as one array
    blocks = linked.withColumn("_upto", upto).withColumn(
        "_block", F.explode(F.sequence(F.col("_bin"), F.col("_upto"), F.lit(_BLOCK).cast("bigint")))
    )
    in_block = F.sequence(F.col("_block"), F.least(F.col("_upto"), F.col("_block") + F.lit(_BLOCK - 1)))
    at = blocks.withColumn("_at", F.explode(in_block))
    return at.withColumns({v: F.when(F.col("_at") == F.col("_bin"), F.col(v)) for v in names})


def trace_routes(obs: DataFrame) -> DataFrame:
    """How each (run, variable) is drawn: ``raw`` points or ``grid`` means.

    The source of a variable's first row in (run, source) order decides for all runs. A run
    without continuous readings of a gridded variable keeps its points.
    """
    # Distinct first: text minima would turn the pass over all rows into a sort.
    seen = obs.select("run_id", "variable", "source").distinct()
    per_run = seen.groupBy("run_id", "variable").agg(
        F.min("source").alias("_first_source"),
        F.max(F.col("source").isin(*CONTINUOUS)).alias("_has_continuous"),
    )
    leading = per_run.groupBy("variable").agg(F.min_by("_first_source", "run_id").alias("_leading"))
    raw = F.col("_leading").isin(*SPARSE) | ~F.col("_has_continuous")
    return per_run.join(leading, "variable").select(
        "run_id", "variable", F.when(raw, "raw").otherwise("grid").alias("route")
    )


def comparable_traces(
    obs: DataFrame,
    variables: Sequence[str],
    run_ids: Sequence[str] | None = None,
    step: Duration = DEFAULT_STEP,
) -> DataFrame:
    """Points (run, variable, elapsed hours, value) that can be overlaid run by run.

    Continuous variables come as bin means without the empty bins, sparse ones as recorded.
    """
    step_us = to_micros(step)
    chosen = obs.filter(F.col("variable").isin(list(variables)))
    routed = chosen.join(trace_routes(chosen), ["run_id", "variable"])
    if run_ids:
        routed = routed.filter(F.col("run_id").isin(list(run_ids)))

    raw = routed.filter("route = 'raw'").select("run_id", "variable", "elapsed_h", "value")

    dense = routed.filter((F.col("route") == "grid") & F.col("source").isin(*CONTINUOUS))
    moments = dense.groupBy("run_id", "variable", "timestamp").agg(
        F.avg("value").alias("value"), F.min("elapsed_h").alias("elapsed_h")
    )
    anchor = _anchor(step_us)
    if anchor is None:
        firsts = dense.groupBy("run_id", "variable").agg(midnight(F.min("timestamp")).alias("_anchor"))
        moments = moments.join(firsts, ["run_id", "variable"])
        anchor = F.col("_anchor")
    placed = moments.withColumn("_start", slot_start(slot(F.col("timestamp"), step_us, anchor), step_us, anchor))
    bins = placed.groupBy("run_id", "variable", "_start").agg(F.avg("value").alias("value"), *_first_reading())
    return raw.unionByName(bins.select("run_id", "variable", _elapsed_at(F.col("_start")).alias("elapsed_h"), "value"))
