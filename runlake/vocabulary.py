"""The vocabulary of the common schema: units, vendor columns, sources and plotted traces.

These are the values on which all instruments must agree. They are plain Python constants;
``dimension`` turns any of them into a small DataFrame whose rows are part of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The unit in which each variable is stored ("" = no unit).
UNITS = {
    "pH": "",
    "DO": "%",
    "temperature": "degC",
    "agitation": "rpm",
    "gas_flow": "L/min",
    "pressure": "bar",
    "base_added": "mL",
    "glucose": "g/L",
    "product": "g/L",
    "glucose_peak_area": "counts",
    "product_peak_area": "counts",
    "glucose_rt": "min",
    "product_rt": "min",
    "od600": "",
    "dcw": "g/L",
    "offgas_co2": "%",
    "offgas_o2": "%",
    "offgas_flow": "L/min",
    "permittivity": "pF/cm",
}

# Source, whether it is logged continuously, and its display name.
SOURCES = (
    ("bioreactor", True, "Bioreactor control system"),
    ("offgas", True, "Off-gas analyser"),
    ("capacitance", True, "Capacitance probe"),
    ("analytical", False, "HPLC (analytical)"),
    ("offline", False, "Offline biomass (manual)"),
)

# Layout, source, vendor column, variable, factor into the stored unit.
# The columns of the multi-vessel layout are what follows "<vessel>_".
VENDOR_COLUMNS = (
    ("dasgip", "bioreactor", "PV_pH", "pH", 1.0),
    ("dasgip", "bioreactor", "PV_DO2 [%]", "DO", 1.0),
    ("dasgip", "bioreactor", "PV_Temp [degC]", "temperature", 1.0),
    ("dasgip", "bioreactor", "PV_Stirrer [rpm]", "agitation", 1.0),
    ("dasgip", "bioreactor", "PV_Gasflow [L/h]", "gas_flow", 1.0 / 60.0),
    ("dasgip", "bioreactor", "PV_Pressure [bar]", "pressure", 1.0),
    ("dasgip", "bioreactor", "Base_Total [mL]", "base_added", 1.0),
    ("ambr", "bioreactor", "pH", "pH", 1.0),
    ("ambr", "bioreactor", "DO_pct", "DO", 1.0),
    ("ambr", "bioreactor", "Temp_C", "temperature", 1.0),
    ("ambr", "bioreactor", "Stirrer_rpm", "agitation", 1.0),
    ("ambr", "bioreactor", "Gasflow_Lpm", "gas_flow", 1.0),
    ("ambr", "bioreactor", "Pressure_bar", "pressure", 1.0),
    ("biomass", "offline", "OD600_Corrected", "od600", 1.0),
    ("biomass", "offline", "DCW_g_L", "dcw", 1.0),
    ("offgas", "offgas", "CO2_percent", "offgas_co2", 1.0),
    ("offgas", "offgas", "O2_percent", "offgas_o2", 1.0),
    ("offgas", "offgas", "Flow_In_Lpm", "offgas_flow", 1.0),
    ("capacitance", "capacitance", "Permittivity_pF_cm", "permittivity", 1.0),
)

# Peak name, column of the peak table, variable.
PEAK_COLUMNS = (
    ("Glucose", "Amount", "glucose"),
    ("Glucose", "Area", "glucose_peak_area"),
    ("Glucose", "RT_min", "glucose_rt"),
    ("Product", "Amount", "product"),
    ("Product", "Area", "product_peak_area"),
    ("Product", "RT_min", "product_rt"),
)

# Panel group, panel title, axis label, variable, source, trace label, style.
TRACES = (
    ("main", "Biomass", "OD600 · g/L · pF/cm", "od600", "offline", "OD600", "markers"),
    ("main", "Biomass", "OD600 · g/L · pF/cm", "dcw", "offline", "Dry cell weight", "markers"),
    ("main", "Biomass", "OD600 · g/L · pF/cm", "permittivity", "capacitance", "Permittivity", "lines"),
    ("main", "Substrate and product", "g/L", "glucose", "analytical", "Glucose", "markers"),
    ("main", "Substrate and product", "g/L", "product", "analytical", "Product", "markers"),
    ("main", "Dissolved oxygen", "% saturation", "DO", "bioreactor", "DO", "lines"),
    ("main", "pH", "pH", "pH", "bioreactor", "pH", "lines"),
    ("main", "Base added", "mL (cumulative)", "base_added", "bioreactor", "Base added", "lines"),
    ("main", "Off-gas", "% of gas stream", "offgas_co2", "offgas", "CO2", "lines"),
    ("main", "Off-gas", "% of gas stream", "offgas_o2", "offgas", "O2", "lines"),
    ("actuator", "Agitation", "rpm", "agitation", "bioreactor", "Agitation", "lines"),
    ("actuator", "Gas flow", "L/min", "gas_flow", "bioreactor", "Gas flow", "lines"),
    ("actuator", "Pressure", "bar", "pressure", "bioreactor", "Pressure", "lines"),
    ("actuator", "Temperature", "degC", "temperature", "bioreactor", "Temperature", "lines"),
)

# Variable, lowest and highest plausible reading (None = open).
PLAUSIBLE = (
    ("DO", 0.0, 100.0),
    ("pH", 4.0, 9.0),
    ("glucose", 0.0, None),
    ("product", 0.0, None),
    ("dcw", 0.0, None),
)

CONTINUOUS = tuple(name for name, continuous, _ in SOURCES if continuous)
SPARSE = tuple(name for name, continuous, _ in SOURCES if not continuous)


def variables_of(source: str) -> list[str]:
    """The variables an instrument can report, in alphabetical order."""
    if source == "analytical":
        return sorted(variable for _, _, variable in PEAK_COLUMNS)
    return sorted({v for _, s, _, v, _ in VENDOR_COLUMNS if s == source})


def unit_of(variable: Column) -> Column:
    """Stored unit of a variable column; null for a variable outside the vocabulary."""
    return _lookup(UNITS.items(), variable)


def source_label(source: Column) -> Column:
    """Display name of a source; an unknown source keeps its own name."""
    return F.coalesce(_lookup(((s, label) for s, _, label in SOURCES), source), source)


def _lookup(pairs: Iterable[tuple[str, str]], key: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return F.try_element_at(table, key)


def dimension(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """Constant rows as a DataFrame. ``columns`` is a DDL string such as ``"a string, b double"``.

    The rows are inlined as a VALUES relation: Catalyst knows their exact size, so a
    broadcast of them is bounded by this source file.
    """
    fields = [part.strip().rsplit(" ", 1) for part in columns.split(",")]
    marks = ", ".join("(" + ", ".join(f":p{r}_{c}" for c in range(len(fields))) + ")" for r in range(len(rows)))
    values = {f"p{r}_{c}": cell for r, row in enumerate(rows) for c, cell in enumerate(row)}
    names = ", ".join(f"`{name}`" for name, _ in fields)
    table = spark.sql(f"select * from values {marks} as t({names})", args=values)
    return table.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])
