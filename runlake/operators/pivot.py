"""Long readings to one column per variable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import variables_of


def mean_of(variable: str) -> Column:
    """Mean over the rows of one variable; null if the group has none."""
    return F.avg(F.when(F.col("variable") == variable, F.col("value"))).alias(variable)


def known_variable(known: Column) -> Column:
    """The variable, or an error that names it if there is no column for it."""
    name = F.concat_ws("/", F.coalesce("source", F.lit("null")), F.coalesce("variable", F.lit("null")))
    return F.when(F.coalesce(known, F.lit(False)), F.col("variable")).otherwise(F.raise_error(F.concat(F.lit("no column for "), name)))


def with_values(rows: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that have a value in the long ``rows``, in the same order (a job of one row per variable)."""
    found = rows.filter(F.col("value").isNotNull() & F.col("variable").isin(list(names))).select("variable").distinct()
    there = {r["variable"] for r in found.collect()}
    return [v for v in names if v in there]


def pivot_readings(
    obs: DataFrame, source: str, variables: Sequence[str] | None = None, drop_empty: bool = False
) -> DataFrame:
    """One row per (run, time) of a source, the mean of repeated readings per variable.

    The columns are named up front rather than looked up in the data, which spares a scan
    and keeps the schema the same for every run. Without ``variables`` a variable that is not
    one of the source's own stops the job; with them, the others are left out as asked.
    ``drop_empty`` leaves out variables without any value, which takes a job to look for them.
    """
    rows = obs.filter(F.col("source") == source)
    if variables:
        names = list(variables)
        rows = rows.filter(F.col("variable").isin(names))
    else:
        names = variables_of(source)
        rows = rows.withColumn("variable", known_variable(F.col("variable").isin(names)))
    if drop_empty:
        # times at which only empty variables were read stay, as they do without it
        kept = with_values(obs.filter(F.col("source") == source), names)
        return rows.groupBy("run_id", "timestamp").agg(F.count("*").alias("_n"), *[mean_of(v) for v in kept]).drop("_n")
    return rows.groupBy("run_id", "timestamp").agg(*[mean_of(v) for v in names])


def run_start(obs: DataFrame) -> DataFrame:
    """Start of each run, recovered from its rows: time minus elapsed hours, to the microsecond."""
    lasted = F.make_dt_interval(secs=(F.col("elapsed_h") * 3600).cast("decimal(18,6)"))
    return obs.groupBy("run_id").agg(F.min(F.col("timestamp") - lasted).alias("start_time"))


def vessel_table(
    obs: DataFrame, runs: DataFrame, system: str, columns: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """One wide row per time with a column ``<vessel>_<measurement>`` for each vessel of a system.

    ``columns`` lists (vessel id, measurement suffix, variable). Times known to one vessel
    only leave the others null.
    """
    vessels = sorted({vessel for vessel, _, _ in columns})
    owned = runs.filter((F.col("system") == system) & F.col("vessel_id").isin(vessels))
    readings = obs.filter(F.col("variable").isin(sorted({v for _, _, v in columns}))).join(
        owned.select("run_id", "vessel_id"), "run_id"
    )
    return readings.groupBy("timestamp").agg(
        *[
            F.avg(
                F.when((F.col("vessel_id") == vessel) & (F.col("variable") == variable), F.col("value"))
            ).alias(f"{vessel}_{suffix}")
            for vessel, suffix, variable in columns
        ]
    )
