"""The run manifest file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.values import filled, to_moment, to_number
from .delimited import BOM
from .layouts import if_present

FILE_NAME = "run_manifest.csv"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Runs in the stored layout plus ``line_no``, the position of the line in the file."""
    path = f"{root.rstrip('/')}/{FILE_NAME}"
    # One task reads the one file, hence rows are numbered as they stand in it.
    rows = if_present(lambda: spark.read.csv(path, header=True, multiLine=True, escape='"'))
    if rows is None:
        raise FileNotFoundError(f"no run manifest at {path}; put a {FILE_NAME} next to the instrument folders")
    rows = rows.toDF(*[name.lstrip(BOM).strip() for name in rows.columns])
    absent = [f.name for f in schemas.RUNS if f.name not in rows.columns]
    if absent:
        raise ValueError(f"{path}: missing columns {absent}")

    def typed(field: T.StructField) -> Column:
        text = filled(F.trim(field.name))
        if isinstance(field.dataType, T.TimestampNTZType):
            return to_moment(text, F.lit(FILE_NAME))
        return to_number(text) if isinstance(field.dataType, T.DoubleType) else text

    columns = {f.name: typed(f) for f in schemas.RUNS}
    columns["anomaly"] = F.coalesce(columns["anomaly"], F.lit(""))
    return rows.select(
        *[column.alias(name) for name, column in columns.items()], F.monotonically_increasing_id().alias("line_no")
    )
