"""What can be shown for a run: variables, panels, trend series, descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import short_text
from ..vocabulary import SPARSE, TRACES, UNITS, dimension


def trace_dimension(spark: SparkSession) -> DataFrame:
    """The panel registry, one row per trace, numbered in display order."""
    titles = list(dict.fromkeys(title for _, title, *_ in TRACES))
    rows = [(group, titles.index(title) + 1, title, axis, place, variable, source, label, style, UNITS[variable])
            for place, (group, title, axis, variable, source, label, style) in enumerate(TRACES, start=1)]
    return dimension(
        spark,
        rows,
        "panel_group string, panel_no int, panel string, axis_label string, trace_no int, variable string, "
        "trace_source string, trace_label string, style string, unit string",
    )


def labelled(label: str = "trace_label", unit: str = "unit") -> Column:
    """Label with its unit in brackets, where there is one."""
    return F.when(F.col(unit) != "", F.concat(F.col(label), F.lit(" ("), F.col(unit), F.lit(")"))).otherwise(
        F.col(label)
    )


def available_variables(obs: DataFrame) -> DataFrame:
    return obs.select("run_id", "variable").distinct()


def panels_with_data(obs: DataFrame, groups: Sequence[str] = ("main", "actuator")) -> DataFrame:
    """Per run the traces that have data; a panel without any does not appear."""
    traces = trace_dimension(obs.sparkSession).filter(F.col("panel_group").isin(list(groups)))
    return available_variables(obs).join(F.broadcast(traces), "variable")


def variable_labels(spark: SparkSession) -> DataFrame:
    """Variable -> the label and the unit-bearing label used on its trace."""
    return trace_dimension(spark).select(
        "variable", F.col("trace_label").alias("label"), labelled().alias("legend_label")
    )


def variables_with_labels(obs: DataFrame) -> DataFrame:
    """Each recorded variable with its label; a variable without a trace shows its own name."""
    labels = F.broadcast(variable_labels(obs.sparkSession))
    return (
        obs.select("variable")
        .distinct()
        .join(labels, "variable", "left")
        .select(
            "variable",
            F.coalesce("label", "variable").alias("label"),
            F.coalesce("legend_label", "variable").alias("legend_label"),
        )
    )


def trend_series(
    obs: DataFrame,
    x: str = "elapsed_h",
    groups: Sequence[str] = ("main", "actuator"),
    ordered: bool = True,
) -> DataFrame:
    """Plot points (run, panel, trace, x, y), sorted along x unless ``ordered`` is false."""
    if x not in ("elapsed_h", "timestamp"):
        raise ValueError("x must be elapsed_h or timestamp")
    traces = trace_dimension(obs.sparkSession).filter(F.col("panel_group").isin(list(groups)))
    points = obs.join(F.broadcast(traces.drop("unit")), "variable").select(
        "run_id",
        "panel_no",
        "panel",
        "trace_no",
        "variable",
        "trace_label",
        F.col(x).alias("x"),
        F.col("value").alias("y"),
    )
    return points.orderBy("run_id", "panel_no", "trace_no", "x", "y") if ordered else points


def variable_kinds(obs: DataFrame) -> DataFrame:
    """Whether a variable is sparse, by the source of its first row in (run, source) order."""
    seen = obs.select("run_id", "variable", "source").distinct()
    first = seen.groupBy("variable").agg(F.min(F.struct("run_id", "source")).alias("_first"))
    return first.select(
        "variable", F.col("_first.source").alias("source"), F.col("_first.source").isin(*SPARSE).alias("is_sparse")
    )


def run_descriptions(runs: DataFrame) -> DataFrame:
    """What each run was in one line, and its entry in a selection list."""
    return runs.select(
        "run_id",
        F.concat_ws(
            " · ",
            "strain",
            "mode",
            F.concat(F.col("vessel_id"), F.lit(" ("), F.col("system"), F.lit(")")),
            F.concat(short_text(F.col("volume_L")), F.lit(" L")),
            F.concat(short_text(F.col("duration_h")), F.lit(" h")),
        ).alias("conditions"),
        F.concat_ws(" · ", "run_id", "strain", "mode").alias("option_label"),
        F.when(F.col("anomaly") != "", F.concat(F.lit("Recorded note on this run: "), "anomaly", F.lit("."))).alias(
            "note"
        ),
    )


def sample_listing(samples: DataFrame, run_ids: Sequence[str] | None = None) -> DataFrame:
    """The sample table as shown for chosen runs."""
    chosen = samples.filter(F.col("run_id").isin(list(run_ids))) if run_ids else samples
    return chosen.select("run_id", "sample_id", "draw_time", "injection_time", "operator", "notes")
