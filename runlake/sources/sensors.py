"""Sensor exports: control systems, off-gas analyser, capacitance probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import file_stem, stem_without, to_moment, to_number
from ..operators.registry import known_run, split_vessel_columns, unique_runs
from ..vocabulary import VENDOR_COLUMNS, dimension, unit_of
from .delimited import cells, require, row_order, text_lines, with_file_facts
from .layouts import LAYOUTS, location


def split_lines(lines: DataFrame, layout: str) -> DataFrame:
    """Add the cells of each line. ``#`` lines of control-system exports get none."""
    comment = F.col("line").startswith("#") if layout == "dasgip" else F.lit(False)
    return lines.withColumn("cells", F.when(~comment, cells(F.col("line"), LAYOUTS[layout].separator)))


def sensor_lines(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Lines of all files of a layout, split into cells."""
    return split_lines(text_lines(spark, location(root, layout)), layout)


def header_notes(lines: DataFrame) -> DataFrame:
    """(file, key, value) of the ``# key: value`` lines before the first table line.

    Split at the first colon; of a repeated key the last line counts.
    """
    tables = lines.filter(F.col("cells").isNotNull()).groupBy("file_path").agg(F.min(row_order()).alias("_table_at"))
    body = F.trim(F.regexp_replace("line", "^#+", ""))
    notes = (
        lines.filter(F.col("cells").isNull())
        .select("file_path", "file_name", row_order().alias("_at"), body.alias("_body"))
        .filter(F.col("_body").contains(":"))
        .join(tables, "file_path", "left")
        .filter(F.col("_table_at").isNull() | (F.col("_at") < F.col("_table_at")))
        .select(
            "file_path",
            "file_name",
            "_at",
            F.trim(F.substring_index("_body", ":", 1)).alias("key"),
            F.trim(F.regexp_replace("_body", r"^[^:]*:", "")).alias("value"),
        )
    )
    return notes.groupBy("file_path", "file_name", "key").agg(F.max_by("value", "_at").alias("value"))


def header_metadata(lines: DataFrame) -> DataFrame:
    """One map of header notes per file."""
    notes = header_notes(lines).groupBy("file_path", "file_name")
    return notes.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))


def file_facts(lines: DataFrame, layout: str) -> DataFrame:
    """One row per file: column names, place of the header line, and the batch id noted before it.

    Only lines that may be the header or name the batch are looked at more closely.
    """
    kind = LAYOUTS[layout]
    note = F.regexp_extract("line", r"^#+\s*Batch ID\s*:(.*)$", 1)
    is_note = F.col("line").startswith("#") & F.col("line").rlike(r"^#+\s*Batch ID\s*:")
    is_header = F.col("line").contains(kind.time_column) & F.array_contains("cells", kind.time_column)
    marked = lines.filter(is_header | is_note if layout == "dasgip" else is_header)
    at_header = F.when(F.array_contains("cells", kind.time_column), row_order())
    in_file = Window.partitionBy("file_path")
    return (
        marked.withColumn("_header_at", F.min(at_header).over(in_file))
        .groupBy("file_path")
        .agg(
            F.any_value("file_name").alias("file_name"),
            F.any_value("_header_at").alias("header_at"),
            F.min_by("cells", at_header).alias("names"),
            F.max_by(
                F.trim(note), F.when(F.col("cells").isNull() & (row_order() < F.col("_header_at")), row_order())
            ).alias("batch"),
        )
        .filter(F.col("names").isNotNull())
        .withColumn("time_place", (F.array_position("names", kind.time_column) - 1).cast("int"))
    )


_FILE = ["file_path", "file_name", "header_at", "time_place"]


def _vendor_map(spark: SparkSession, layout: str) -> DataFrame:
    rows = [(column, variable, scale) for name, _, column, variable, scale in VENDOR_COLUMNS if name == layout]
    return F.broadcast(dimension(spark, rows, "column string, variable string, scale double"))


def _single_run_columns(facts: DataFrame, manifest: DataFrame, layout: str) -> DataFrame:
    """Measured columns of files that belong to one run each."""
    if layout == "dasgip":
        run_id = F.coalesce("batch", file_stem(F.col("file_name")))
    else:
        suffix = LAYOUTS[layout].suffix
        run_id = require(stem_without(F.col("file_name"), suffix), f"expected <run>{suffix}.csv as file name")
    listed = unique_runs(manifest).select("run_id", F.col("run_id").alias("_listed"))
    owned = facts.withColumn("run_id", run_id).join(listed, "run_id", "left")
    named = owned.select(
        *_FILE, known_run(F.col("run_id"), F.col("_listed")).alias("run_id"), F.posexplode("names").alias("place", "column")
    )
    return named.join(_vendor_map(facts.sparkSession, layout), "column")


def _multi_vessel_columns(facts: DataFrame, manifest: DataFrame, system: str) -> DataFrame:
    """Measured columns of wide files in which each column names its vessel."""
    named = facts.select(*_FILE, F.posexplode("names").alias("place", "column"))
    owned = split_vessel_columns(named, manifest, system, [*_FILE, "place"])
    measures = _vendor_map(facts.sparkSession, "ambr").withColumnRenamed("column", "measurement")
    return owned.join(measures, "measurement")


def _readings(lines: DataFrame, columns: DataFrame, layout: str) -> DataFrame:
    """Cells under mapped columns, one row each."""
    kind = LAYOUTS[layout]
    facts = columns.groupBy("file_path").agg(
        *[F.any_value(c).alias(c) for c in _FILE[1:]],
        F.collect_list(F.struct("run_id", "place", "variable", "scale")).alias("entries"),
    )
    body = lines.filter(~F.col("line").startswith("#")) if layout == "dasgip" else lines
    table = with_file_facts(body, facts)
    # Asked for with the time, which is the first thing that filters look at.
    time_place = require(
        F.col("time_place"),
        f"no header line with {kind.time_column} and a column that the {layout} layout gives to a run",
    )
    rows = table.filter(F.col("header_at").isNull() | (row_order() > F.col("header_at"))).select(
        "file_name",
        F.get("cells", time_place).alias("_time"),
        F.inline(
            F.transform(
                F.col("entries"),
                lambda e: F.struct(
                    e["run_id"].alias("run_id"),
                    e["variable"].alias("variable"),
                    e["scale"].alias("scale"),
                    F.get(F.col("cells"), e["place"]).alias("text"),
                ),
            )
        ),
    )
    return as_observations(rows, to_moment(F.col("_time"), F.col("file_name")), kind.source)


def as_observations(rows: DataFrame, moment: Column, source: str) -> DataFrame:
    """Long rows (run_id, variable, scale, text, file_name) in the stored layout.

    Cells without a number and rows without a time are not measurements and drop out.
    Elapsed hours stay null until the run starts are joined.
    """
    return rows.select(
        "run_id",
        moment.alias("timestamp"),
        F.lit(None).cast("double").alias("elapsed_h"),
        F.lit(source).alias("source"),
        "variable",
        (to_number(F.col("text")) * F.col("scale")).alias("value"),
        unit_of(F.col("variable")).alias("unit"),
        F.col("file_name").alias("source_file"),
    ).filter(F.col("value").isNotNull() & F.col("timestamp").isNotNull())


def parse_single_run(lines: DataFrame, layout: str, manifest: DataFrame) -> DataFrame:
    """Observations from split lines of ``dasgip``, ``offgas`` or ``capacitance`` files."""
    return _readings(lines, _single_run_columns(file_facts(lines, layout), manifest, layout), layout)


def parse_multi_vessel(lines: DataFrame, manifest: DataFrame, system: str = "ambr") -> DataFrame:
    """Observations from split lines of wide files that hold several vessels side by side."""
    return _readings(lines, _multi_vessel_columns(file_facts(lines, "ambr"), manifest, system), "ambr")


def read_single_run(spark: SparkSession, root: str, layout: str, manifest: DataFrame) -> DataFrame:
    return parse_single_run(sensor_lines(spark, root, layout), layout, manifest)


def read_multi_vessel(spark: SparkSession, root: str, manifest: DataFrame, system: str = "ambr") -> DataFrame:
    return parse_multi_vessel(sensor_lines(spark, root, "ambr"), manifest, system)
