"""The registered queries: every operator over the views of the shared tables.

Times leave as text and doubles rounded to eight places, so that results compare across
engines; the operators themselves return ``timestamp_ntz`` and full doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.values import stem_without, to_number
from ..operators import alignment, cohorts, corrections, grid, interpolate, nearest, panels, pivot, quality, registry
from ..operators import spans, summaries
from ..sources import sensors, sheets
from ..sources.store import filter_observations
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DENSE = ["DO", "pH", "offgas_co2", "permittivity"]
VESSELS = [
    (f"Vessel_{k}", suffix, variable)
    for k in (0, 2, 4, 6, 8)
    for suffix, variable in (("pH", "pH"), ("DO_pct", "DO"))
]


def comparable(df: DataFrame) -> DataFrame:
    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampNTZType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return F.round(column, 8).alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            return column.cast("bigint").alias(field.name)
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema])


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.join_samples(views.draws(spark, sf_dir), views.injections(spark, sf_dir))


def _pivot(spark: SparkSession, sf_dir: str, source: str, *variables: str) -> DataFrame:
    return pivot.pivot_readings(views.observations(spark, sf_dir), source, variables)


# --- from vendor files to the common schema ---------------------------------------------


@query
def normalize_unpivot(spark, sf_dir):
    lines = sensors.split_lines(views.control_system_lines(spark, sf_dir), "dasgip")
    return sensors.parse_single_run(lines, "dasgip", views.runs(spark, sf_dir)).drop("elapsed_h")


@query
def normalize_offgas(spark, sf_dir):
    lines = sensors.split_lines(views.offgas_lines(spark, sf_dir), "offgas")
    return sensors.parse_single_run(lines, "offgas", views.runs(spark, sf_dir)).drop("elapsed_h")


@query
def normalize_capacitance(spark, sf_dir):
    lines = sensors.split_lines(views.capacitance_lines(spark, sf_dir), "capacitance")
    return sensors.parse_single_run(lines, "capacitance", views.runs(spark, sf_dir)).drop("elapsed_h")


@query
def normalize_multivessel(spark, sf_dir):
    lines = sensors.split_lines(views.multi_vessel_lines(spark, sf_dir), "ambr")
    manifest = views.runs(spark, sf_dir).withColumn("vessel_id", F.replace("vessel_id", F.lit("_2"), F.lit("_1")))
    return sensors.parse_multi_vessel(
        lines, manifest.withColumn("vessel_id", F.replace("vessel_id", F.lit("_4"), F.lit("_10"))), "ambr"
    ).drop("elapsed_h")


@query
def header_notes(spark, sf_dir):
    lines = sensors.split_lines(views.control_system_lines(spark, sf_dir), "dasgip")
    return sensors.header_notes(lines).drop("file_path")


@query
def normalize_peaks(spark, sf_dir):
    return sheets.peak_observations(views.peak_rows(spark, sf_dir), views.runs(spark, sf_dir)).drop("elapsed_h")


@query
def samples_first(spark, sf_dir):
    return sheets.injection_records(views.peak_rows(spark, sf_dir))


@query
def normalize_biomass(spark, sf_dir):
    return sheets.biomass_observations(views.manual_rows(spark, sf_dir), views.runs(spark, sf_dir)).drop("elapsed_h")


@query
def sample_draws(spark, sf_dir):
    return sheets.draw_records(views.manual_rows(spark, sf_dir))


@query
def numeric_coercion(spark, sf_dir):
    number = to_number(F.col("text"))
    finite = F.abs(number) < F.lit(1e300)
    return views.odd_numbers(spark, sf_dir).select(
        "event_id", F.when(finite, number).alias("number"), (~finite).alias("is_infinite")
    )


@query
def run_from_filename(spark, sf_dir):
    names = views.observations(spark, sf_dir).select("source_file").distinct()
    return names.select("source_file", stem_without(F.col("source_file"), "_offgas").alias("run_id"))


@query
def manifest_lookup(spark, sf_dir):
    return registry.vessel_owners(views.vessel_manifest(spark, sf_dir))


# --- corrections and checks --------------------------------------------------------------


@query
def samples_outer(spark, sf_dir):
    return _samples(spark, sf_dir)


@query
def backdate(spark, sf_dir):
    return corrections.backdate(views.observations(spark, sf_dir), _samples(spark, sf_dir))


@query
def backdate_unresolved(spark, sf_dir):
    return corrections.unresolved_injections(views.observations(spark, sf_dir), _samples(spark, sf_dir))


@query
def elapsed_hours(spark, sf_dir):
    obs = views.observations(spark, sf_dir).drop("elapsed_h")
    return corrections.add_elapsed_hours(obs, views.runs(spark, sf_dir)).select(
        "run_id", "timestamp", "variable", "value", "elapsed_h"
    )


@query
def orphans(spark, sf_dir):
    known = views.runs(spark, sf_dir).filter("system = 'ambr'")
    return quality.orphan_runs(views.observations(spark, sf_dir), known)


def _spoiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with one kind of fault in each source."""
    odd = F.floor(F.col("value")).cast("bigint") % 5 == 0
    return views.observations(spark, sf_dir).select(
        F.when(odd & (F.col("source") == "offline"), "R99").otherwise(F.col("run_id")).alias("run_id"),
        F.when(~(odd & (F.col("source") == "analytical")), F.col("timestamp")).alias("timestamp"),
        "elapsed_h",
        F.when(odd & (F.col("source") == "capacitance"), "probe").otherwise(F.col("source")).alias("source"),
        F.when(odd & (F.col("variable") == "pH"), "acidity").otherwise(F.col("variable")).alias("variable"),
        F.when(~(odd & (F.col("variable") == "DO")), F.col("value")).alias("value"),
        F.when(odd & (F.col("source") == "offgas"), "ppm").otherwise(F.col("unit")).alias("unit"),
        "source_file",
    )


@query
def quality_report(spark, sf_dir):
    runs = views.runs(spark, sf_dir)
    twice = runs.unionByName(runs.filter("system = 'ambr'"))
    return quality.quality_report(_spoiled(spark, sf_dir), twice, _samples(spark, sf_dir))


@query
def range_check(spark, sf_dir):
    return quality.implausible(views.observations(spark, sf_dir))


# --- reads and summaries -------------------------------------------------------------------


@query
def read_filtered(spark, sf_dir):
    obs = views.observations(spark, sf_dir).select(*schemas.OBSERVATIONS.names)
    return filter_observations(obs, ["R1", "R3"], ["bioreactor", "offline"], ["DO", "dcw", "glucose"])


@query
def table_counts(spark, sf_dir):
    return summaries.table_counts(
        views.runs(spark, sf_dir), views.observations(spark, sf_dir), _samples(spark, sf_dir)
    )


@query
def ingest_summary(spark, sf_dir):
    return summaries.rows_by_source(views.observations(spark, sf_dir))


@query
def provenance(spark, sf_dir):
    return summaries.source_provenance(views.observations(spark, sf_dir))


@query
def run_outcomes(spark, sf_dir):
    return summaries.run_outcomes(views.observations(spark, sf_dir))


@query
def data_table(spark, sf_dir):
    return summaries.data_table(views.observations(spark, sf_dir))


@query
def end_values(spark, sf_dir):
    return summaries.with_end_values(views.runs(spark, sf_dir), views.observations(spark, sf_dir))


@query
def available_variables(spark, sf_dir):
    return panels.available_variables(views.observations(spark, sf_dir))


@query
def panel_availability(spark, sf_dir):
    return panels.panels_with_data(views.observations(spark, sf_dir)).select(
        "run_id", "panel_group", "panel_no", "panel", "axis_label", "trace_no", "variable", "trace_label", "style"
    )


@query
def variable_labels(spark, sf_dir):
    return panels.variables_with_labels(views.observations(spark, sf_dir))


@query
def variable_kinds(spark, sf_dir):
    return panels.variable_kinds(views.observations(spark, sf_dir))


@query
def trend_series(spark, sf_dir):
    return panels.trend_series(views.observations(spark, sf_dir), "elapsed_h")


@query
def run_descriptions(spark, sf_dir):
    return panels.run_descriptions(views.runs(spark, sf_dir))


@query
def sample_listing(spark, sf_dir):
    return panels.sample_listing(_samples(spark, sf_dir))


# --- time-series joins and grids -------------------------------------------------------------


@query
def pivot_source(spark, sf_dir):
    return _pivot(spark, sf_dir, "bioreactor", "DO", "pH")


@query
def run_start(spark, sf_dir):
    return pivot.run_start(views.observations(spark, sf_dir))


@query
def asof_nearest(spark, sf_dir):
    base = _pivot(spark, sf_dir, "bioreactor", "DO", "pH")
    other = _pivot(spark, sf_dir, "offgas", "offgas_co2", "offgas_o2")
    return nearest.match_nearest(base, other, "30min")


@query
def snap_samples(spark, sf_dir):
    base = _pivot(spark, sf_dir, "bioreactor", "DO")
    return nearest.snap_samples(_pivot(spark, sf_dir, "offline", "dcw", "od600"), base, "30min")


ALIGNED = ["DO", "pH", "offgas_co2", "offgas_o2", "permittivity", "glucose", "product", "dcw", "od600"]


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every source of every run on the control-system timeline."""
    return alignment.align_sources(
        views.observations(spark, sf_dir), continuous_tolerance="30min", sample_tolerance="30min"
    )


@query
def align_wide(spark, sf_dir):
    return aligned(spark, sf_dir).select("run_id", "timestamp", "elapsed_h", *ALIGNED)


@query
def sensor_correlation(spark, sf_dir):
    wide = alignment.align_sources(
        views.observations(spark, sf_dir), continuous_tolerance="2h", sample_tolerance="2h"
    )
    both = wide.filter(F.col("permittivity").isNotNull() & F.col("dcw").isNotNull())
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.corr("permittivity", "dcw").alias("r"))


@query
def missing_reference(spark, sf_dir):
    obs = views.observations(spark, sf_dir).filter("not (source = 'bioreactor' and run_id in ('R2', 'R5'))")
    return alignment.runs_without_reference(obs)


@query
def resample_grid(spark, sf_dir):
    return grid.resample_grid(views.observations(spark, sf_dir), DENSE, "5min")


@query
def resample_grid_uneven(spark, sf_dir):
    return grid.resample_grid(views.observations(spark, sf_dir), ["DO"], "7min")


@query
def comparable_traces(spark, sf_dir):
    return grid.comparable_traces(views.observations(spark, sf_dir), ["DO", "offgas_co2", "dcw", "glucose"], step="6h")


@query
def interpolate_at(spark, sf_dir):
    samples = _pivot(spark, sf_dir, "offline", "dcw")
    series = _pivot(spark, sf_dir, "bioreactor", "DO")
    return interpolate.interpolate_at(samples, series, "DO")


@query
def decimate(spark, sf_dir):
    return spans.every_nth(_pivot(spark, sf_dir, "bioreactor", "DO", "pH"), 4)


@query
def grid_spacing(spark, sf_dir):
    """Distinct spacings of a grid: one per run if it is regular."""
    dense = grid.resample_grid(views.observations(spark, sf_dir), ["DO"], "15min")
    return spans.reading_gaps(dense, ["run_id"], width="2d")


@query
def export_wide(spark, sf_dir):
    return pivot.vessel_table(views.observations(spark, sf_dir), views.runs(spark, sf_dir), "ambr", VESSELS)


# --- cohorts --------------------------------------------------------------------------------------


@query
def cohort_groups(spark, sf_dir):
    return cohorts.ranked_cohorts(views.runs(spark, sf_dir))


@query
def cohort_members(spark, sf_dir):
    return cohorts.cohort_members(views.runs(spark, sf_dir)).select("run_id", *cohorts.COHORT_KEYS, "n_runs", "label")


@query
def cohort_of(spark, sf_dir):
    return cohorts.cohort_of(views.runs(spark, sf_dir), "R1").select("run_id", *cohorts.COHORT_KEYS, "n_runs", "held_constant")


@query
def cohort_outcomes(spark, sf_dir):
    return cohorts.cohort_outcomes(views.runs(spark, sf_dir))


@query
def endpoint_leader(spark, sf_dir):
    return cohorts.endpoint_leaders(views.runs(spark, sf_dir))


@query
def divergence(spark, sf_dir):
    """The run that leads each cohort on endpoints, against the rest of its cohort."""
    runs = views.runs(spark, sf_dir)
    return cohorts.divergence(views.observations(spark, sf_dir), runs, cohorts.endpoint_leaders(runs))


@query
def divergence_of_all(spark, sf_dir):
    return cohorts.divergence_of_all(views.observations(spark, sf_dir), views.runs(spark, sf_dir))


@query
def columns_absent(spark, sf_dir):
    """What frames lack of the stored layout, with how many of their rows that concerns."""
    frames = {
        "observations": views.observations(spark, sf_dir).drop("unit", "elapsed_h"),
        "runs": views.runs(spark, sf_dir).withColumnRenamed("strain", "Strain_"),
        "samples": _samples(spark, sf_dir),
    }
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(table).alias("table_name"),
            F.explode(F.array(*map(F.lit, quality.missing_columns(df, table))).cast("array<string>")).alias("column_name"),
            "n_rows",
        )
        for table, df in frames.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
