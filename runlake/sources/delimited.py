"""Delimited text files whose columns are found by name in each file.

Spark's CSV reader binds columns by position, the same for all files of a scan. Export
files differ in column order and leave columns out, so each line is joined with the header
of its own file instead. The header side has one row per file; it is spread over a few
salts so that the lines of one very large file do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16
BOM = "\ufeff"

# Position of a row in its file: splits by offset, rows of a split as read.
ROW_ORDER = ("block", "row")


def row_order() -> Column:
    return F.struct(*ROW_ORDER)


def _provenance() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ]


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with file and position. Large files are read by many tasks."""
    lines = spark.read.text(path).select(F.ltrim(F.col("value"), F.lit(BOM)).alias("line"), *_provenance())
    return lines.filter(F.trim("line") != "")


def cells(line: Column, separator: str) -> Column:
    """Trimmed cells of a line; separators inside double quotes do not count."""
    plain = F.split(line, separator)
    quoted = F.split(line, f'{separator}(?=(?:[^"]*"[^"]*")*[^"]*$)')
    parts = F.when(line.contains('"'), quoted).otherwise(plain)
    return F.transform(parts, lambda cell: F.trim(F.trim(F.trim(cell), F.lit('"'))))


def sheet_width(spark: SparkSession, path: str) -> int:
    """The most cells that any line of the files has, and so at least as many as any header names."""
    widest = spark.read.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0]
    return max(1, widest or 0)


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of small hand-made or peak-table files as arrays of cells, quoting included.

    The width comes from the files themselves, so no column is cut off.

    Quoted cells may hold line breaks, so each of these files is read by one task, as a
    stream of records.
    """
    width = sheet_width(spark, path)
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.csv(path, schema=schema, multiLine=True, escape='"', mode="PERMISSIVE")
    row = F.expr(f"array({', '.join(f'c{i}' for i in range(width))})")
    return rows.select(F.transform(row, lambda c: F.trim(F.ltrim(c, F.lit(BOM)))).alias("cells"), *_provenance())


def file_headers(rows: DataFrame, marker: str) -> DataFrame:
    """Column names of each file: the cells of its one row that holds ``marker``."""
    named = rows.filter(F.array_contains("cells", marker))
    return named.groupBy("file_path").agg(
        F.any_value("file_name").alias("file_name"),
        F.min_by("cells", row_order()).alias("names"),
        F.min(row_order()).alias("header_at"),
    )


def with_file_facts(rows: DataFrame, facts: DataFrame, salts: int = SALTS) -> DataFrame:
    """Left join of rows with one row of facts per file, salted against very large files."""
    spread = facts.drop("file_name").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["file_path", "_salt"], "left").drop("_salt")


def require(value: Column, message: str) -> Column:
    """``value``, or an error that names the file."""
    return F.coalesce(value, F.raise_error(F.concat("file_name", F.lit(f": {message}"))))


def cell(names: Column, name: str, row: Column | None = None) -> Column:
    """Cell of a row under a column name; null if the file has no such column."""
    return F.get(F.col("cells") if row is None else row, (F.array_position(names, name) - 1).cast("int"))
