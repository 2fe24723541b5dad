"""Time the headline queries at one scale and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is written to
Spark's no-op sink, so all rows and columns are computed and none pass through the driver.
The times are those of a second pass; the first one, in which the JVM compiles the code, is
given as ``first_pass``. Building the plan counts in both.

``build_store`` is the whole ingest: vendor files, written from the tables beforehand (not timed), are parsed,
corrected, checked and stored in a folder of their own. Its rows are given as ``built_rows``.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from runlake.plans import views  # noqa: E402
from runlake.plans.ingest import build_store  # noqa: E402
from runlake.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = (
    "normalize_unpivot", "normalize_multivessel", "normalize_peaks", "samples_outer", "backdate", "quality_report",
    "pivot_source", "asof_nearest", "snap_samples", "align_wide", "sensor_correlation", "resample_grid",
    "resample_grid_uneven", "comparable_traces", "interpolate_at", "decimate", "export_wide", "provenance",
    "data_table", "trend_series", "divergence", "build_store",
)


def write_vendor_files(spark: SparkSession, sf_dir: str, root: Path) -> None:
    """The views of the shared tables as files of each layout. Every injection has a draw of its sample."""
    peaks = views.peak_rows(spark, sf_dir).withColumn("Sample_Name", F.concat("Run_ID", F.lit("-P"), F.col("row").cast("string")))
    draws = views.manual_rows(spark, sf_dir).fillna("")
    drawn = peaks.select(
        F.replace("file_name", F.lit("_hplc"), F.lit("_biomass")).alias("file_name"), "row", "Run_ID", F.col("Sample_Name").alias("Sample_ID"),
        F.substring("Injection_DateTime", 1, 10).alias("Date"), F.substring("Injection_DateTime", 12, 5).alias("Time"),
        *[F.lit("").alias(c) for c in draws.columns[6:]],
    )

    def sheet(rows):
        names = rows.columns[2:]
        cells = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in names])
        return views._lines(rows.select("file_name", "row", cells.alias("line")), ",".join(names))

    kinds = {
        "bioreactor/dasgip": views.control_system_lines(spark, sf_dir),
        "auxiliary/offgas": views.offgas_lines(spark, sf_dir),
        "auxiliary/capacitance": views.capacitance_lines(spark, sf_dir),
        "analytical": sheet(peaks.fillna("")),
        "offline": sheet(draws.unionByName(drawn)),
    }
    for folder, lines in kinds.items():
        (root / folder).mkdir(parents=True)
        found = lines.select("file_name", "row", "line").toPandas().sort_values(["file_name", "row"])
        for name, rows in found.groupby("file_name"):
            (root / folder / name).write_text("\n".join(rows.line) + "\n")
    manifest = views.runs(spark, sf_dir).withColumn("strain", F.coalesce("strain", F.lit("none")))
    manifest.toPandas().to_csv(root / "run_manifest.csv", index=False)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("runlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = Path(tempfile.mkdtemp(prefix="runlake-bench-"))
    built: dict[str, int] = {}

    def measured(name: str) -> float:
        if name == "build_store":
            raw = scratch / "raw"
            if not raw.exists():
                write_vendor_files(spark, sf_dir, raw)
            began = time.perf_counter()
            built.update(build_store(spark, str(raw), str(scratch / "store")))
            return round(time.perf_counter() - began, 3)
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    chosen = sys.argv[1:] or HEADLINE
    first = {name: measured(name) for name in chosen}
    times = {name: measured(name) for name in chosen}
    spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name,
        "first_pass": round(sum(first.values()), 3),
        "built_rows": built.get("observations"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
