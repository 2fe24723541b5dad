"""Which run is meant: lookups in the run manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnknownRunError(KeyError):
    """A run or vessel that the manifest does not list."""


def unique_runs(manifest: DataFrame) -> DataFrame:
    """One row per run id; a repeated id takes its last manifest line (``line_no``), or stops the job if there are no line numbers."""
    if "line_no" not in manifest.columns:
        # without line numbers nothing says which line counts
        rows = manifest.groupBy("run_id").agg(F.any_value(F.struct(*manifest.columns)).alias("_row"), F.count("*").alias("_lines"))
        complaint = F.raise_error(F.concat(F.lit("run listed more than once: "), F.coalesce("run_id", F.lit("null"))))
        return rows.select(F.when(F.col("_lines") == 1, F.col("_row")).otherwise(complaint).alias("_row")).select("_row.*")
    last = F.max_by(F.struct(*manifest.columns), "line_no").alias("_last")
    return manifest.groupBy("run_id").agg(last).select("_last.*")


def vessel_owners(manifest: DataFrame) -> DataFrame:
    """(system, vessel) -> run; for a vessel used twice the last manifest line counts."""
    rank = F.col("line_no") if "line_no" in manifest.columns else F.col("run_id")
    return unique_runs(manifest).groupBy("system", "vessel_id").agg(F.max_by("run_id", rank).alias("run_id"))


def owner_of(manifest: DataFrame, system: str, vessel_id: str) -> str:
    """Run id of one vessel."""
    row = vessel_owners(manifest).filter((F.col("system") == system) & (F.col("vessel_id") == vessel_id)).first()
    if row is None:
        raise UnknownRunError(f"system {system!r} has no run in vessel {vessel_id!r}")
    return row["run_id"]


def run_record(manifest: DataFrame, run_id: str) -> dict:
    """Manifest row of one run."""
    row = unique_runs(manifest).filter(F.col("run_id") == run_id).first()
    if row is None:
        raise UnknownRunError(f"run {run_id!r} is not in the manifest")
    return row.asDict()


def known_run(used: Column, listed: Column) -> Column:
    """``listed`` (from a left join with the manifest), or an error that names the unknown run."""
    given = F.coalesce(used, F.lit("null"))
    return F.coalesce(listed, F.raise_error(F.concat(F.lit("run not in the manifest: "), given)))


def split_vessel_columns(columns: DataFrame, manifest: DataFrame, system: str, keys: list[str]) -> DataFrame:
    """Split ``column`` = ``<vessel>_<measurement>`` at the longest vessel id the system has.

    Both parts may contain underscores. Every prefix that ends before an underscore is
    looked up among the vessels by equality; the longest one found decides. Columns of no
    known vessel drop out. Adds ``run_id`` and ``measurement``.
    """
    owners = vessel_owners(manifest).filter(F.col("system") == system).select("vessel_id", "run_id")
    parts = F.split("column", "_")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    prefixed = columns.select(
        "*",
        F.explode(
            F.transform(
                cuts,
                lambda i: F.struct(
                    F.array_join(F.slice(parts, 1, i), "_").alias("vessel_id"),
                    F.array_join(F.slice(parts, i + 1, F.size(parts)), "_").alias("measurement"),
                ),
            )
        ).alias("_cut"),
    ).select(*columns.columns, "_cut.*")
    longest = F.max_by(F.struct("run_id", "measurement"), F.length("vessel_id")).alias("_best")
    return prefixed.join(owners, "vessel_id").groupBy(*keys, "column").agg(longest).select(*keys, "column", "_best.*")
