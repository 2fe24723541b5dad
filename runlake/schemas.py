"""Column layouts of the three stored tables and of the run manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_text, _real, _time = T.StringType(), T.DoubleType(), T.TimestampNTZType()

RUNS = T.StructType([
    T.StructField("run_id", _text),
    T.StructField("vessel_id", _text),
    T.StructField("system", _text),
    T.StructField("mode", _text),
    T.StructField("strain", _text),
    T.StructField("start_time", _time),
    T.StructField("duration_h", _real),
    T.StructField("volume_L", _real),
    T.StructField("anomaly", _text),
    T.StructField("final_biomass_total_gL", _real),
    T.StructField("final_product_gL", _real),
])

OBSERVATIONS = T.StructType([
    T.StructField("run_id", _text),
    T.StructField("timestamp", _time),
    T.StructField("elapsed_h", _real),
    T.StructField("source", _text),
    T.StructField("variable", _text),
    T.StructField("value", _real),
    T.StructField("unit", _text),
    T.StructField("source_file", _text),
])

SAMPLES = T.StructType([
    T.StructField("sample_id", _text),
    T.StructField("run_id", _text),
    T.StructField("draw_time", _time),
    T.StructField("injection_time", _time),
    T.StructField("operator", _text),
    T.StructField("dilution_factor", _real),
    T.StructField("method", _text),
    T.StructField("notes", _text),
])

# Columns that may not be null in the stored tables.
REQUIRED = {
    "runs": ("run_id", "vessel_id", "system", "mode", "start_time"),
    "observations": ("run_id", "timestamp", "elapsed_h", "source", "variable", "value", "unit"),
    "samples": ("sample_id", "run_id"),
}


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in their order; a missing column is an error that names it."""
    absent = [f.name for f in schema if f.name not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
