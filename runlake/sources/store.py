"""The three stored tables: writing, checking and filtered reading.

Tables are Parquet folders below one root. Observations lie in subfolders by a hash of the
run id, so a read of few runs lists and opens few files; inside a file they are sorted by
run, source, variable and time, so row-group statistics skip most of the rest. Rows are
brought together by a rebalancing shuffle, which splits the folder of a run that holds much
of the table into several files and joins small ones.

Every build or append writes a version of its own, as a subfolder of each table. The state
folder lists the versions that count, in numbered files; a new one is written when all tables are
there, as the last step. Readers take the highest number, so a write that broke off, at
whatever point, is never read, and what was readable before stays so. A number is given
once: of two writers at the same time one finds it taken, and builds on what the other left.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.timing import Duration, to_micros
from ..operators.quality import assert_clean, guarded, quality_report, reject_orphans
from ..operators.summaries import table_counts as counted

TABLES = {"runs": schemas.RUNS, "samples": schemas.SAMPLES, "observations": schemas.OBSERVATIONS}
MARKER = "store_state"
VERSION = "version"
BUCKET = "run_bucket"
DEFAULT_BUCKETS = 64
_NOT_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class StoreNotBuiltError(FileNotFoundError):
    """The store is missing, empty or only partly built."""


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _load(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    reader = spark.read
    if table == "observations":
        # Named here because a folder without any rows has no file to take it from.
        reader = reader.schema(T.StructType([*schemas.OBSERVATIONS, T.StructField(VERSION, T.StringType()), T.StructField(BUCKET, T.IntegerType())]))
    try:
        return reader.parquet(table_path(root, table))
    except AnalysisException as error:
        if error.getCondition() in _NOT_THERE:
            return None
        raise


def _bucket_of(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, root: str) -> Row | None:
    """The last state of a store: number, versions that count, buckets."""
    state = _load(spark, root, MARKER)
    return None if state is None else state.orderBy(F.col("number").desc()).first()


def _current(spark: SparkSession, root: str, table: str, state: Row | None = None) -> DataFrame:
    """The rows of a table in the versions that count, in the given or else the last state."""
    rows = _load(spark, root, table)
    return rows.filter(F.col(VERSION).isin(list((state or _state(spark, root))["versions"])))


def missing_tables(spark: SparkSession, root: str) -> list[str]:
    """Tables that cannot be read or lack columns; the marker counts as one while a build runs."""
    missing = []
    for name, schema in TABLES.items():
        table = _load(spark, root, name)
        if table is None or set(schema.names) - set(table.columns):
            missing.append(name)
    if _state(spark, root) is None:
        missing.append(MARKER)
    return sorted(missing)


def is_ready(spark: SparkSession, root: str) -> bool:
    return not missing_tables(spark, root)


def require_store(spark: SparkSession, root: str) -> None:
    """Raise unless all tables are complete."""
    missing = missing_tables(spark, root)
    if missing:
        raise StoreNotBuiltError(
            f"the store at {root} lacks {', '.join(missing)}; run runlake.build_store(spark, raw, {root!r}) first"
        )


def _mark(spark: SparkSession, root: str, number: int, versions: list[str], buckets: int) -> bool:
    """Publish a state under its number; False, and nothing changed, if that number is taken.

    The state is drafted in a hidden folder and moved to its name, which the file system
    refuses if the name exists. Where renames are atomic (HDFS and most others, but not every
    object store) just one of several writers gets a number.
    """
    folder = table_path(root, MARKER)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    state = spark.range(1).select(
        F.lit(number).alias("number"), F.array(*map(F.lit, versions)).alias("versions"), F.lit(buckets).alias("buckets")
    )
    state.coalesce(1).write.parquet(draft)
    files = _FileSystem(spark, folder)
    try:
        return files.moved(files.glob(f"{draft}/part-*")[0], f"{folder}/state-{number:012d}.parquet")
    finally:
        files.delete(draft)


class _FileSystem:
    """What a commit needs of Hadoop's file system beyond reading and writing tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(root).getFileSystem(self._conf)

    def glob(self, pattern: str) -> list[str]:
        return [str(found.getPath()) for found in self._files.globStatus(self._path(pattern)) or []]

    def age_us(self, path: str) -> int:
        changed = self._files.getFileStatus(self._path(path)).getModificationTime()
        return (int(time.time() * 1000) - changed) * 1000

    def moved(self, path: str, target: str) -> bool:
        """Move a file unless the target exists."""
        fs = self._jvm.org.apache.hadoop.fs
        full = self._files.makeQualified(self._path(target))
        context = fs.FileContext.getFileContext(full.toUri(), self._conf)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(path), full, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def write_store(
    runs: DataFrame,
    observations: DataFrame | Callable[[DataFrame], DataFrame],
    samples: DataFrame,
    root: str,
    rebuild: bool = True,
    runs_checked: bool = False,
    buckets: int = DEFAULT_BUCKETS,
) -> None:
    """Write the three tables, replacing the store or adding to it.

    Runs and samples are written first, to a version that no state lists yet, and checked as a whole
    from there, together with what is stored already: wherever they come from, they are computed once.
    Observations carry their checks into the write itself: the job fails on the first bad
    row and nothing of it becomes visible. The new state is written last, so a write that broke
    off is never read and changes nothing for readers. If another writer took the number of the
    new state meanwhile, the state it left is read, everything is checked against that, and
    the next number is tried: of two appends at once both stay, or the second is refused.
    ``observations`` may be a function of the written samples instead, for rows that need them.
    ``runs_checked`` says that an earlier join has already rejected observations of unlisted
    runs, which spares doing it again. ``buckets`` is the number of run folders of a new store.
    """
    spark = runs.sparkSession
    nothing = schemas.empty(spark, schemas.OBSERVATIONS)

    def begun(runs: DataFrame, samples: DataFrame) -> tuple[str, DataFrame, DataFrame]:
        """A new version with the two small tables, and these as stored."""
        version = f"v{uuid.uuid4().hex}"
        back = []
        for name, rows in (("runs", runs), ("samples", samples)):
            path = f"{table_path(root, name)}/{VERSION}={version}"
            schemas.conform(rows, TABLES[name]).write.parquet(path)
            back.append(spark.read.schema(TABLES[name]).parquet(path))
        return version, *back

    def checked_against(state: Row | None) -> tuple[list[str], int, DataFrame]:
        """The versions that stay, the folders of the store, and all runs; raises if the tables do not fit together."""
        if rebuild or state is None or not is_ready(spark, root):
            kept, folders, all_runs, all_samples = [], buckets, runs, samples
        else:
            kept, folders = list(state["versions"]), state["buckets"]
            # of this very state: another writer may have published one since
            all_runs = runs.unionByName(_current(spark, root, "runs", state).select(*schemas.RUNS.names))
            all_samples = samples.unionByName(_current(spark, root, "samples", state).select(*schemas.SAMPLES.names))
        assert_clean(quality_report(nothing, all_runs, all_samples))
        return kept, folders, all_runs

    def complete(version: str, folders: int, all_runs: DataFrame) -> None:
        rows = schemas.conform(observations(samples) if callable(observations) else observations, schemas.OBSERVATIONS)
        owned = rows if runs_checked else reject_orphans(rows, all_runs)
        laid_out = (
            guarded(owned)
            .withColumn(BUCKET, _bucket_of(F.col("run_id"), folders))
            .hint("rebalance", BUCKET)
            .sortWithinPartitions(BUCKET, "run_id", "source", "variable", "timestamp")
        )
        laid_out.write.partitionBy(BUCKET).parquet(f"{table_path(root, 'observations')}/{VERSION}={version}")

    version, runs, samples = begun(runs, samples)
    state = _state(spark, root)
    kept, folders, all_runs = checked_against(state)
    complete(version, folders, all_runs)
    laid_out_for = folders
    while not _mark(spark, root, 1 if state is None else state["number"] + 1, [*kept, version], folders):
        state = _state(spark, root)
        kept, folders, all_runs = checked_against(state)
        if folders != laid_out_for:
            version, runs, samples = begun(runs, samples)
            complete(version, folders, all_runs)
            laid_out_for = folders
        elif not rebuild and not runs_checked:
            ours = _load(spark, root, "observations").filter(F.col(VERSION) == version)
            reject_orphans(ours.select(*schemas.OBSERVATIONS.names), all_runs).agg(F.count("run_id")).first()


def vacuum(spark: SparkSession, root: str, older_than: Duration = "7d") -> list[str]:
    """Delete versions that the last state does not list, and return their folders.

    Young ones stay: a write in progress has not listed its version yet, and readers may still
    be at work on one that was replaced. ``older_than`` must exceed the longest of both.
    """
    require_store(spark, root)
    files = _FileSystem(spark, root)
    limit = to_micros(older_than)
    # Folders first: what is listed after this is not among them.
    found = [path for table in TABLES for path in files.glob(f"{table_path(root, table)}/{VERSION}=*")]
    found = [path for path in found if files.age_us(path) >= limit]
    listed = {f"{VERSION}={v}" for v in _state(spark, root)["versions"]}
    dead = [path for path in found if path.rsplit("/", 1)[1] not in listed]
    for path in dead:
        files.delete(path)
    return dead


def read_runs(spark: SparkSession, root: str, ordered: bool = True) -> DataFrame:
    require_store(spark, root)
    runs = _current(spark, root, "runs").select(*schemas.RUNS.names)
    return runs.orderBy("run_id") if ordered else runs


def filter_observations(
    obs: DataFrame,
    run_ids: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Rows that meet all given lists; an empty or missing list does not filter."""
    for column, wanted in (("run_id", run_ids), ("source", sources), ("variable", variables)):
        if wanted:
            obs = obs.filter(F.col(column).isin(list(wanted)))
    return obs.orderBy("run_id", "source", "variable", "timestamp") if ordered else obs


def read_observations(
    spark: SparkSession,
    root: str,
    run_ids: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    variables: Sequence[str] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Stored observations; the lists are pushed into the Parquet scan.

    Operators do not need sorted input: pass ``ordered=False`` when feeding one.
    """
    require_store(spark, root)
    state = _state(spark, root)
    obs = _current(spark, root, "observations", state)
    if run_ids:
        buckets = state["buckets"]
        obs = obs.filter(F.col(BUCKET).isin([_bucket_of(F.lit(r), buckets) for r in set(run_ids)]))
    obs = obs.select(*schemas.OBSERVATIONS.names)
    return filter_observations(obs, run_ids, sources, variables, ordered)


def read_samples(
    spark: SparkSession, root: str, run_ids: Sequence[str] | None = None, ordered: bool = True
) -> DataFrame:
    require_store(spark, root)
    samples = _current(spark, root, "samples").select(*schemas.SAMPLES.names)
    if run_ids:
        samples = samples.filter(F.col("run_id").isin(list(run_ids)))
    return samples.orderBy("run_id", "sample_id") if ordered else samples


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    require_store(spark, root)
    return counted(*(_current(spark, root, t) for t in ("runs", "observations", "samples")))
