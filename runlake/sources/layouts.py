"""Where each instrument's files lie and how one layout differs from another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """One kind of vendor file."""

    name: str
    source: str
    glob: str
    time_column: str
    separator: str = ","
    suffix: str = ""


# Folder and file pattern, time column, separator and file-name suffix.
LAYOUTS = {
    "dasgip": Layout("dasgip", "bioreactor", "bioreactor/dasgip/*.csv", "Timestamp"),
    "ambr": Layout("ambr", "bioreactor", "bioreactor/ambr/*_ambr.csv", "Timestamp"),
    "hplc": Layout("hplc", "analytical", "analytical/*_hplc.csv", "Injection_DateTime"),
    "biomass": Layout("biomass", "offline", "offline/*_biomass.csv", "Date"),
    "offgas": Layout("offgas", "offgas", "auxiliary/offgas/*_offgas.csv", "Time_stamp", ";", "_offgas"),
    "capacitance": Layout(
        "capacitance", "capacitance", "auxiliary/capacitance/*_capacitance.csv", "Timestamp", ",", "_capacitance"
    ),
}


def location(root: str, layout: str) -> str:
    return f"{root.rstrip('/')}/{LAYOUTS[layout].glob}"


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The frame, or None if its path matches no file."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(layout, file_name, path) of every file the layouts cover. No file is opened."""

    def listed(layout: str) -> DataFrame | None:
        found = if_present(lambda: spark.read.format("binaryFile").load(location(root, layout)))
        if found is None:
            return None
        return found.select(
            F.lit(layout).alias("layout"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "path"
        )

    present = [df for df in map(listed, LAYOUTS) if df is not None]
    if not present:
        return spark.createDataFrame([], "layout string, file_name string, path string")
    return reduce(DataFrame.unionByName, present)
