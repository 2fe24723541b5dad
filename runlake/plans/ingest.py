"""From a tree of vendor files to the three stored tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

from .. import schemas
from ..operators.corrections import add_elapsed_hours, backdate, join_if_drawn, padded, unresolved_injections
from ..operators.quality import assert_clean, quality_report
from ..operators.summaries import rows_by_source, table_counts
from ..sources.layouts import if_present
from ..sources.manifest import read_manifest
from ..sources.sensors import read_multi_vessel, read_single_run
from ..sources.sheets import (
    biomass_observations,
    draw_records,
    injection_records,
    peak_observations,
    read_biomass_sheets,
    read_peak_tables,
)
from ..sources.store import is_ready, stored_counts, write_store


@dataclass(frozen=True)
class Normalized:
    """The three tables, lazy."""

    runs: DataFrame
    observations: DataFrame
    samples: DataFrame
    #: Analytical rows, and those of them without a draw time to move to (one row).
    unresolved: DataFrame | None = None
    #: The observations from given samples (as these are stored, say), with their unresolved injections counted on the way.
    timed: Callable[[DataFrame, Observation], DataFrame] | None = None

    def summary(self) -> tuple[DataFrame, DataFrame]:
        """Rows per table, and observations per source."""
        return table_counts(self.runs, self.observations, self.samples), rows_by_source(self.observations)

    def report(self) -> DataFrame:
        return quality_report(self.observations, self.runs, self.samples)


@dataclass(frozen=True)
class Sheets:
    """The named rows of the two kinds of sheet; None where there are no such files."""

    peaks: DataFrame | None
    biomass: DataFrame | None


def read_sheets(spark: SparkSession, root: str) -> Sheets:
    return Sheets(
        if_present(lambda: read_peak_tables(spark, root)), if_present(lambda: read_biomass_sheets(spark, root))
    )


def read_all_layouts(spark: SparkSession, root: str, manifest: DataFrame, sheets: Sheets) -> DataFrame:
    """Observations of every file, as the instruments timed them."""
    parsed = [
        if_present(lambda: read_single_run(spark, root, "dasgip", manifest)),
        if_present(lambda: read_multi_vessel(spark, root, manifest)),
        None if sheets.peaks is None else peak_observations(sheets.peaks, manifest),
        None if sheets.biomass is None else biomass_observations(sheets.biomass, manifest),
        if_present(lambda: read_single_run(spark, root, "offgas", manifest)),
        if_present(lambda: read_single_run(spark, root, "capacitance", manifest)),
    ]
    present = [df for df in parsed if df is not None]
    return reduce(DataFrame.unionByName, present) if present else schemas.empty(spark, schemas.OBSERVATIONS)


def samples_of(spark: SparkSession, sheets: Sheets) -> DataFrame:
    """The sample table from both kinds of sheet; either kind may be absent, or have headers only."""
    draws = None if sheets.biomass is None else draw_records(sheets.biomass)
    injections = None if sheets.peaks is None else injection_records(sheets.peaks)
    if draws is None and injections is None:
        return schemas.empty(spark, schemas.SAMPLES)
    if draws is not None and injections is not None:
        return join_if_drawn(draws, injections)
    return padded(draws if injections is None else injections)


def normalize(spark: SparkSession, root: str) -> Normalized:
    """Read, correct and time every source below ``root``. Nothing is computed yet."""
    manifest = read_manifest(spark, root)
    sheets = read_sheets(spark, root)
    samples = samples_of(spark, sheets)
    raw = read_all_layouts(spark, root, manifest, sheets)

    def timed(samples: DataFrame, watch: Observation | None = None) -> DataFrame:
        return schemas.conform(add_elapsed_hours(backdate(raw, samples, watch), manifest), schemas.OBSERVATIONS)

    return Normalized(
        schemas.conform(manifest, schemas.RUNS),
        timed(samples),
        schemas.conform(samples, schemas.SAMPLES),
        unresolved_injections(raw, samples),
        timed,
    )


def normalize_checked(spark: SparkSession, root: str) -> Normalized:
    """``normalize`` plus the full quality report; raises if it has rows."""
    data = normalize(spark, root)
    assert_clean(data.report())
    return data


def build_store(spark: SparkSession, raw_root: str, store_root: str, rebuild: bool = True) -> dict[str, int]:
    """Ingest ``raw_root`` into the store and return the rows of each stored table.

    Every file is parsed once for each table that it feeds: samples are read back from the store for the draw
    times, and the unresolved injections are counted while the observations are written.
    """
    data = normalize(spark, raw_root)
    watches: list[Observation] = []

    def observations(samples: DataFrame) -> DataFrame:
        # one for each write: the store may have to lay the rows out again, and an observation serves once
        watches.append(Observation())
        return data.timed(samples, watches[-1])

    write_store(data.runs, observations, data.samples, store_root, rebuild, runs_checked=True)
    warn_of_unresolved(data, _observed(watches[-1]))
    return {r["table_name"]: r["n_rows"] for r in stored_counts(spark, store_root).collect()}


def _observed(watch: Observation) -> Mapping[str, int] | None:
    """What a watched write counted; None where Spark left its node out of the plan, as it does without any rows."""
    try:
        return watch.get
    except Py4JJavaError:
        return None


def warn_of_unresolved(data: Normalized, counts: Mapping[str, int] | None = None) -> None:
    """Warn of analytical rows that stayed at their injection time.

    ``counts`` are those of a watched write; without them they are computed. A watched write that lost
    executors may count a row twice, but misses none.
    """
    found = data.unresolved.first() if counts is None else counts
    if found["unresolved"]:
        total, left = found["analytical_rows"], found["unresolved"]
        what = "no analytical row has a draw time" if total == left else f"{left} of {total} analytical rows have no draw time"
        warnings.warn(f"{what}; they stay at injection time", stacklevel=3)


def ensure_store(spark: SparkSession, raw_root: str, store_root: str) -> str:
    """Build the store unless it is complete already."""
    if not is_ready(spark, store_root):
        build_store(spark, raw_root, store_root)
    return store_root
