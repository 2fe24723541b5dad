"""Descriptions of what was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import Duration, slot
from ..functions.values import fixed_text, whole_text
from ..vocabulary import source_label
from .ranks import exact_median, last_value, ordered_bits
from .spans import DEFAULT_SPAN, reading_gaps


def cadence_text(seconds: Column) -> Column:
    """A logging interval in words."""
    return (
        F.when(seconds.isNull(), "single reading")
        .when(seconds < 90, F.concat(whole_text(seconds), F.lit(" s")))
        .when(seconds < 5400, F.concat(whole_text(seconds / 60), F.lit(" min")))
        .otherwise(F.concat(fixed_text(seconds / 3600, 1), F.lit(" h")))
    )


def cadence(obs: DataFrame, width: Duration = DEFAULT_SPAN) -> DataFrame:
    """Median seconds between readings per (run, source), measured on one variable.

    All variables of a source share their times, so only the alphabetically first counts.
    """
    seen = obs.select("run_id", "source", "variable").distinct()
    first = seen.groupBy("run_id", "source").agg(F.min("variable").alias("variable"))
    timeline = obs.select("run_id", "source", "variable", "timestamp").join(
        first, ["run_id", "source", "variable"], "left_semi"
    )
    gaps = reading_gaps(timeline, ["run_id", "source"], width=width)
    return exact_median(gaps, ["run_id", "source"], "gap_s", "readings", "cadence_s")


def source_provenance(obs: DataFrame, width: Duration = DEFAULT_SPAN) -> DataFrame:
    """Per (run, source): files, variables, rows, cadence, and the span of its first variable."""
    per_file = obs.groupBy("run_id", "source", "variable", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    # Sets of distinct file names: as many as a run has export files of the source.
    per_variable = per_file.groupBy("run_id", "source", "variable").agg(
        F.sum("n").alias("n"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.collect_set("source_file").alias("files"),
    )
    counted = per_variable.groupBy("run_id", "source").agg(
        F.count("variable").alias("variables"),
        F.sum("n").alias("points"),
        F.min_by("first", "variable").alias("first_reading"),
        F.min_by("last", "variable").alias("last_reading"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))), ", ").alias("files"),
    )
    joined = counted.join(cadence(obs, width), ["run_id", "source"], "left")
    return joined.select(
        "run_id",
        "source",
        source_label(F.col("source")).alias("label"),
        "files",
        "variables",
        "points",
        "cadence_s",
        cadence_text(F.col("cadence_s")).alias("cadence"),
        "first_reading",
        "last_reading",
    )


def _position(obs: DataFrame, order: str) -> Column:
    """A time or a number as a long that rises with it."""
    timed = obs.schema[order].dataType.typeName() == "timestamp_ntz"
    return slot(F.col(order), 1) if timed else ordered_bits(F.col(order).cast("double"))


def end_readings(obs: DataFrame, variables: list[str], order: str = "elapsed_h") -> DataFrame:
    """Last value and unit of each (run, variable); of equal times the larger value.

    Rows without a value or a time do not count. A variable has one unit but for faulty data,
    so what is left after the first aggregation is about one row per (run, variable).
    """
    at = _position(obs, order)
    rows = obs.filter(F.col("variable").isin(variables) & F.col("value").isNotNull() & F.col(order).isNotNull())
    per_unit = rows.groupBy("run_id", "variable", "unit").agg(F.max(at).alias("_at"), last_value(at, F.col("value")).alias("value"))
    last = F.max_by(F.struct("value", "unit"), F.struct("_at", "value")).alias("_last")
    return per_unit.groupBy("run_id", "variable").agg(last).select("run_id", "variable", "_last.*")


def run_outcomes(obs: DataFrame) -> DataFrame:
    """Final biomass and product of each run, as text; a run with neither has no row."""
    ends = end_readings(obs, ["dcw", "product"])

    def part(variable: str, label: str) -> Column:
        text = F.concat(F.lit(f"{label} **"), fixed_text(F.col("value"), 2), F.lit("** "), F.col("unit"))
        return F.max(F.when(F.col("variable") == variable, text))

    outcome = F.concat_ws(" · ", part("dcw", "Final biomass"), part("product", "Final product"))
    return ends.groupBy("run_id").agg(outcome.alias("outcome"))


def data_table(obs: DataFrame) -> DataFrame:
    """Size, extremes and last value per run, source, variable and unit."""
    return obs.groupBy("run_id", "source", "variable", "unit").agg(
        F.count(F.lit(1)).alias("points"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        last_value(_position(obs, "timestamp"), F.col("value")).alias("final"),
    )


def table_counts(runs: DataFrame, obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of each stored table."""
    sizes = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in (("observations", obs), ("samples", samples), ("runs", runs))
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


def rows_by_source(obs: DataFrame) -> DataFrame:
    """Rows per source, the largest first."""
    return obs.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "source")


def with_end_values(runs: DataFrame, obs: DataFrame, biomass: str = "dcw", product: str = "product") -> DataFrame:
    """The manifest with its two end results taken from the last readings, three decimals."""
    ends = end_readings(obs, [biomass, product], "timestamp")
    wide = ends.groupBy("run_id").agg(
        *[
            F.round(F.max(F.when(F.col("variable") == v, F.col("value"))), 3).alias(name)
            for v, name in ((biomass, "final_biomass_total_gL"), (product, "final_product_gL"))
        ]
    )
    return runs.drop("final_biomass_total_gL", "final_product_gL").join(wide, "run_id", "left")
