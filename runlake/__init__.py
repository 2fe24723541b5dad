"""Measurements of process runs, from vendor files to comparable tables, on Spark."""

from .operators.alignment import align_sources, runs_without_reference
from .operators.cohorts import (
    cohort_members,
    cohort_of,
    cohort_outcomes,
    cohorts,
    divergence,
    divergence_of_all,
    endpoint_leaders,
    ranked_cohorts,
)
from .operators.corrections import add_elapsed_hours, backdate, join_samples, unresolved_injections
from .operators.grid import comparable_traces, resample_grid
from .operators.interpolate import interpolate_at
from .operators.nearest import match_nearest, snap_samples
from .operators.panels import (
    available_variables,
    panels_with_data,
    run_descriptions,
    sample_listing,
    trend_series,
    variable_kinds,
    variable_labels,
    variables_with_labels,
)
from .operators.pivot import pivot_readings, run_start, vessel_table
from .operators.quality import (
    QualityError,
    assert_clean,
    guarded,
    implausible,
    missing_columns,
    orphan_runs,
    quality_report,
)
from .operators.registry import UnknownRunError, owner_of, run_record, unique_runs, vessel_owners
from .operators.spans import every_nth
from .operators.summaries import (
    data_table,
    rows_by_source,
    run_outcomes,
    source_provenance,
    table_counts,
    with_end_values,
)
from .plans.ingest import build_store, ensure_store, normalize, normalize_checked
from .sources.layouts import list_files
from .sources.manifest import read_manifest
from .sources.store import (
    StoreNotBuiltError,
    is_ready,
    read_observations,
    read_runs,
    read_samples,
    require_store,
    stored_counts,
    vacuum,
    write_store,
)

__all__ = [name for name in dir() if not name.startswith("_")]
