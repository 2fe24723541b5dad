"""Peak tables and manual biomass sheets.

Reading (file to named text columns) is kept apart from normalizing (named columns to the
common schema), so the second half works on any table with these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import filled, to_moment, to_number
from ..operators.registry import known_run, unique_runs
from ..vocabulary import PEAK_COLUMNS, VENDOR_COLUMNS, dimension
from .delimited import cell, file_headers, require, row_order, sheet_rows, with_file_facts
from .layouts import location
from .sensors import as_observations

PEAK_FIELDS = ("Run_ID", "Sample_Name", "Injection_DateTime", "Peak_Name", "Method", "Amount", "Area", "RT_min")
SHEET_FIELDS = (
    "Sample_ID", "Run_ID", "Date", "Time", "Operator", "Dilution_Factor", "Notes", "OD600_Corrected", "DCW_g_L",
)
_OPTIONAL = {"Amount", "Area", "RT_min", "OD600_Corrected", "DCW_g_L"}


def _named_rows(rows: DataFrame, marker: str, fields: tuple[str, ...]) -> DataFrame:
    needed = F.array(*[F.lit(f) for f in fields if f not in _OPTIONAL])
    absent = F.array_join(F.array_except(needed, F.col("names")), ", ")
    complaint = F.raise_error(F.concat("file_name", F.lit(": no column "), absent))
    headers = file_headers(rows, marker).withColumn("names", F.when(absent == "", F.col("names")).otherwise(complaint))
    table = with_file_facts(rows, headers)
    body = table.filter(F.col("header_at").isNull() | (row_order() > F.col("header_at"))).select(
        "file_name", "row", "cells", require(F.col("names"), f"no column {marker}").alias("names")
    )
    return body.select("file_name", "row", *[filled(cell(F.col("names"), f)).alias(f) for f in fields])


def read_peak_tables(spark: SparkSession, root: str) -> DataFrame:
    """All peak-table rows, cells as text under their column names."""
    return _named_rows(sheet_rows(spark, location(root, "hplc")), "Sample_Name", PEAK_FIELDS)


def read_biomass_sheets(spark: SparkSession, root: str) -> DataFrame:
    """All manual sheet rows, cells as text under their column names."""
    return _named_rows(sheet_rows(spark, location(root, "biomass")), "Sample_ID", SHEET_FIELDS)


def _of_known_runs(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows with a run id; one that the manifest does not list stops the job."""
    listed = unique_runs(manifest).select(F.col("run_id").alias("Run_ID"), F.col("run_id").alias("_listed"))
    joined = rows.filter(F.col("Run_ID").isNotNull()).join(listed, "Run_ID", "left")
    return joined.withColumn("run_id_", known_run(F.col("Run_ID"), F.col("_listed")))


def peak_observations(peaks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Amount, area and retention time of the known analytes, at injection time."""
    measured = F.array(*[
        F.struct(F.lit(column).alias("column"), F.col(column).cast("string").alias("text"))
        for column in dict.fromkeys(c for _, c, _ in PEAK_COLUMNS)
    ])
    columns = F.broadcast(dimension(peaks.sparkSession, PEAK_COLUMNS, "Peak_Name string, column string, variable string"))
    rows = (
        _of_known_runs(peaks, manifest)
        .select(F.col("run_id_").alias("run_id"), "Injection_DateTime", "Peak_Name", "file_name", F.inline(measured))
        .join(columns, ["Peak_Name", "column"])
        .withColumn("scale", F.lit(1.0))
    )
    return as_observations(rows, to_moment(F.col("Injection_DateTime"), F.col("file_name")), "analytical")


def injection_records(peaks: DataFrame) -> DataFrame:
    """One row per (file, sample): the first filled run id, injection time and method.

    First means lowest ``row``, the position in the file.
    """

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("row")))

    per_sample = peaks.filter(F.col("Sample_Name").isNotNull()).groupBy("file_name", "Sample_Name")
    found = per_sample.agg(
        first("Run_ID").alias("run_id"), first("Injection_DateTime").alias("_time"), first("Method").alias("method")
    )
    return found.select(
        F.col("Sample_Name").alias("sample_id"),
        "run_id",
        to_moment(F.col("_time"), F.col("file_name")).alias("injection_time"),
        "method",
    )


def _draw_time() -> Column:
    """Date and time cells put together; a missing half is an unreadable time."""
    gap = F.lit("?")
    return to_moment(F.concat_ws(" ", F.coalesce("Date", gap), F.coalesce("Time", gap)), F.col("file_name"))


def biomass_observations(sheets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Optical density and dry cell weight at draw time; blank cells are not measurements."""
    measures = [(column, variable, scale) for name, _, column, variable, scale in VENDOR_COLUMNS if name == "biomass"]
    cells = F.array(*[
        F.struct(F.lit(variable).alias("variable"), F.lit(scale).alias("scale"), F.col(column).cast("string").alias("text"))
        for column, variable, scale in measures
    ])
    rows = _of_known_runs(sheets, manifest).select(
        F.col("run_id_").alias("run_id"), _draw_time().alias("_time"), "file_name", F.inline(cells)
    )
    return as_observations(rows, F.col("_time"), "offline")


def draw_records(sheets: DataFrame) -> DataFrame:
    """One row per sheet line: who drew which sample when."""
    return sheets.select(
        F.col("Sample_ID").alias("sample_id"),
        F.col("Run_ID").alias("run_id"),
        _draw_time().alias("draw_time"),
        F.col("Operator").alias("operator"),
        to_number(F.col("Dilution_Factor")).alias("dilution_factor"),
        F.coalesce("Notes", F.lit("")).alias("notes"),
    )
