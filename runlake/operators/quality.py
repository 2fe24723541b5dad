"""Data-quality checks: a report of everything that is wrong, and a guard for writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..vocabulary import PLAUSIBLE, SOURCES, UNITS, dimension, unit_of
from .registry import known_run

_KNOWN_SOURCES = [name for name, _, _ in SOURCES]


class QualityError(ValueError):
    """Data that must not be stored."""


def missing_columns(df: DataFrame, table: str = "observations") -> list[str]:
    """Columns of the stored layout that a frame lacks."""
    layout = {"runs": schemas.RUNS, "observations": schemas.OBSERVATIONS, "samples": schemas.SAMPLES}[table]
    return [f.name for f in layout if f.name not in df.columns]


def orphan_runs(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Run ids that a table uses but the manifest does not know; nulls are not counted."""
    used = facts.select("run_id").filter(F.col("run_id").isNotNull()).distinct()
    return used.join(runs.select("run_id"), "run_id", "left_anti")


def reject_orphans(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """The same rows; one whose run the manifest does not list stops the job."""
    listed = runs.select("run_id", F.col("run_id").alias("_listed")).distinct()
    joined = facts.join(listed, "run_id", "left")
    return joined.withColumn("run_id", known_run(F.col("run_id"), F.col("_listed"))).select(*facts.columns)


def _tally(check: str, key: Column, bad: Column | None = None) -> Column:
    count = F.col("n") if bad is None else bad
    return F.struct(F.lit(check).alias("check"), key.cast("string").alias("key"), count.cast("bigint").alias("n_bad"))


def _repeats(df: DataFrame, table: str, key: str) -> DataFrame:
    dupes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return dupes.select(F.lit(f"{table}: repeated {key}").alias("check"), F.col(key).alias("key"), F.col("n").alias("n_bad"))


def _nulls(df: DataFrame, table: str) -> DataFrame:
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in schemas.REQUIRED[table]])
    rows = F.array(*[_tally(f"{table}: null", F.lit(c), F.col(c)) for c in schemas.REQUIRED[table]])
    return counted.select(F.inline(rows)).filter("n_bad > 0")


def quality_report(obs: DataFrame, runs: DataFrame, samples: DataFrame) -> DataFrame:
    """Every violated rule as (check, key, n_bad); no rows means clean data.

    The long table is read once: it is condensed to counts per (run, source, variable, unit),
    and all its checks are answered from these.
    """
    required = [c for c in schemas.REQUIRED["observations"] if c not in ("run_id", "source", "variable", "unit")]
    facts = obs.groupBy("run_id", "source", "variable", "unit").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in required]
    )
    listed = runs.select("run_id").distinct().withColumn("_listed", F.lit(True))
    facts = facts.join(listed, "run_id", "left")
    known = F.col("variable").isin(*UNITS)
    rules = [
        (F.col("source").isNotNull() & ~F.col("source").isin(_KNOWN_SOURCES), _tally("unknown source", F.col("source"))),
        (F.col("variable").isNotNull() & ~known, _tally("unknown variable", F.col("variable"))),
        (
            known & F.col("unit").isNotNull() & (F.col("unit") != unit_of(F.col("variable"))),
            _tally("wrong unit", F.concat_ws(" ", "variable", "unit")),
        ),
        (F.col("run_id").isNotNull() & F.col("_listed").isNull(), _tally("observations: orphan run_id", F.col("run_id"))),
        *[(F.col(c).isNull(), _tally("observations: null", F.lit(c))) for c in ("run_id", "source", "variable", "unit")],
        *[(F.col(f"_null_{c}") > 0, _tally("observations: null", F.lit(c), F.col(f"_null_{c}"))) for c in required],
    ]
    found = (
        facts.select(F.explode(F.array(*[F.when(broken, row) for broken, row in rules])).alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("v.check", "v.key")
        .agg(F.sum("v.n_bad").alias("n_bad"))
    )
    orphan_samples = orphan_runs(samples, runs)
    sample_orphans = (
        samples.join(orphan_samples, "run_id", "left_semi")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("n_bad"))
        .select(F.lit("samples: orphan run_id").alias("check"), F.col("run_id").alias("key"), "n_bad")
    )
    parts = [
        found,
        _nulls(runs, "runs"),
        _nulls(samples, "samples"),
        _repeats(runs, "runs", "run_id"),
        _repeats(samples, "samples", "sample_id"),
        sample_orphans,
    ]
    return reduce(DataFrame.unionByName, parts)


def assert_clean(report: DataFrame, show: int = 20) -> None:
    """Raise with the offending keys if the report has rows."""
    rows = report.orderBy("check", "key").limit(show + 1).collect()
    if rows:
        listed = "; ".join(f"{r['check']} {r['key']!r} ({r['n_bad']} rows)" for r in rows[:show])
        raise QualityError(listed + ("; and more" if len(rows) > show else ""))


def guarded(obs: DataFrame) -> DataFrame:
    """The same rows, but any row that breaks the common schema stops the job.

    Meant for writes: the check rides along in the one pass over the data, and as Spark
    publishes a write only when all its tasks succeed, a bad row leaves nothing behind.
    """
    problem = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in schemas.REQUIRED["observations"]],
        F.when(~F.col("source").isin(_KNOWN_SOURCES), F.concat(F.lit("unknown source: "), "source")),
        F.when(unit_of(F.col("variable")).isNull(), F.concat(F.lit("unknown variable: "), "variable")),
        F.when(
            F.col("unit") != unit_of(F.col("variable")),
            F.concat(F.lit("unit of "), "variable", F.lit(" is '"), "unit", F.lit("'")),
        ),
    )
    checked = obs.withColumn("_problem", problem)
    run_id = F.when(F.col("_problem").isNotNull(), F.raise_error(F.col("_problem"))).otherwise(F.col("run_id"))
    return checked.withColumn("run_id", run_id).drop("_problem")


def implausible(obs: DataFrame) -> DataFrame:
    """Readings outside the plausible range, counted per run and variable, with the extremes."""
    spark = obs.sparkSession
    bounds = F.broadcast(dimension(spark, PLAUSIBLE, "variable string, lowest double, highest double"))
    ranged = obs.join(bounds, "variable")
    outside = (F.col("value") < F.col("lowest")) | (F.col("value") > F.col("highest"))
    return (
        ranged.filter(outside)
        .groupBy("run_id", "variable")
        .agg(F.count(F.lit(1)).alias("n_bad"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    )
