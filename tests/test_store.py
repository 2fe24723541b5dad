"""The stored tables."""

from datetime import datetime

import pytest
from conftest import FILES, write_tree
from pyspark.sql import functions as F

import runlake
from runlake import schemas
from runlake.plans.ingest import normalize
from runlake.sources.store import MARKER, missing_tables, table_path


@pytest.fixture(scope="module")
def clean_raw(tmp_path_factory):
    files = dict(FILES)
    lines = files["analytical/R1_hplc.csv"].splitlines(keepends=True)
    files["analytical/R1_hplc.csv"] = "".join(line for line in lines if "S009" not in line)
    return write_tree(tmp_path_factory.mktemp("clean"), files)


@pytest.fixture(scope="module")
def store(spark, clean_raw, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "tables")
    assert runlake.build_store(spark, clean_raw, root) == {"runs": 4, "observations": 52, "samples": 2}
    return root


def test_round_trip(spark, clean_raw, store):
    written = runlake.read_observations(spark, store, ordered=False)
    original = normalize(spark, clean_raw).observations
    assert written.schema.names == original.schema.names
    assert written.exceptAll(original).isEmpty() and original.exceptAll(written).isEmpty()
    sample = runlake.read_samples(spark, store, ["R1"]).first()
    assert sample["draw_time"] < sample["injection_time"]
    assert [r["run_id"] for r in runlake.read_runs(spark, store).collect()] == ["A1", "A2", "R1", "R2"]


def test_filters(spark, store):
    read = runlake.read_observations
    assert {r["run_id"] for r in read(spark, store, run_ids=["R1"]).collect()} == {"R1"}
    both = read(spark, store, run_ids=["R1"], sources=["bioreactor"], variables=["pH", "dcw"]).collect()
    assert {r["variable"] for r in both} == {"pH"}
    assert read(spark, store, run_ids=[], sources=None).count() == 52
    assert read(spark, store, variables=["nothing"]).count() == 0
    rows = [(r["run_id"], r["source"], r["variable"], r["timestamp"]) for r in read(spark, store).collect()]
    assert rows == sorted(rows)


def test_filters_reach_the_scan(spark, store):
    obs = runlake.read_observations(spark, store, run_ids=["R1"], variables=["pH"], ordered=False)
    plan = obs.select("timestamp", "value")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(run_id,R1)" in scan and "EqualTo(variable,pH)" in scan
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "run_bucket" in filters and "version" in filters
    assert "ReadSchema: struct<run_id:string,timestamp:timestamp_ntz,variable:string,value:double>" in plan


def test_a_large_run_is_split_into_files(spark, tmp_path):
    """The rebalancing write neither makes one huge file nor one file per task and folder."""
    start = F.lit(datetime(2026, 3, 2, 8)).cast("timestamp_ntz")
    rows = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("run_id"),
        (start + F.expr("make_dt_interval(0,0,0,id)")).alias("timestamp"),
        (F.col("id") / 3600).alias("elapsed_h"),
        F.lit("bioreactor").alias("source"),
        F.lit("pH").alias("variable"),
        F.rand(1).alias("value"),
        F.lit("").alias("unit"),
        F.lit("f.csv").alias("source_file"),
    )
    runs = rows.select("run_id").distinct()
    for name, value in (("vessel_id", "V"), ("system", "s"), ("mode", "m"), ("strain", "x"), ("anomaly", "")):
        runs = runs.withColumn(name, F.lit(value))
    runs = runs.withColumns(
        {"start_time": start, **{c: F.lit(1.0) for c in ("duration_h", "volume_L", "final_biomass_total_gL", "final_product_gL")}}
    )
    samples = spark.createDataFrame([], schemas.SAMPLES)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    root = str(tmp_path / "s")
    try:
        runlake.write_store(runs, rows, samples, root, buckets=8)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    read = runlake.read_observations(spark, root, run_ids=["hot"], ordered=False)
    assert read.count() == 133_334
    assert read.select(F.input_file_name()).distinct().count() > 1
    assert runlake.read_observations(spark, root, ordered=False).count() == 400_000


def stored(spark, root):
    return (
        runlake.read_runs(spark, root, ordered=False),
        runlake.read_observations(spark, root, ordered=False),
        runlake.read_samples(spark, root, ordered=False),
    )


def counts(spark, root):
    return {r["table_name"]: r["n_rows"] for r in runlake.stored_counts(spark, root).collect()}


def test_rebuild_replaces_and_append_adds(spark, store, tmp_path):
    root = str(tmp_path / "s")
    runs, obs, samples = stored(spark, store)
    for _ in range(2):
        runlake.write_store(runs, obs, samples, root)
        assert counts(spark, root) == {"runs": 4, "observations": 52, "samples": 2}
    with pytest.raises(runlake.QualityError, match="repeated run_id"):
        runlake.write_store(runs, obs, samples, root, rebuild=False)
    assert counts(spark, root) == {"runs": 4, "observations": 52, "samples": 2}

    start = datetime(2026, 5, 2, 8)
    more = spark.createDataFrame([("R8", "V8", "dasgip", "batch", "K12", start, 36.0, 5.0, "", 1.0, 1.0)], schemas.RUNS)
    reading = [("R8", start, 0.0, "bioreactor", "pH", 7.0, "", "R8.csv"), ("R1", start, 9.0, "bioreactor", "pH", 7.0, "", "x.csv")]
    runlake.write_store(
        more, spark.createDataFrame(reading, schemas.OBSERVATIONS), samples.filter("false"), root, rebuild=False
    )
    assert counts(spark, root) == {"runs": 5, "observations": 54, "samples": 2}
    assert runlake.read_observations(spark, root, run_ids=["R8"]).count() == 1


def test_missing_empty_and_partial_stores_are_refused(spark, clean_raw, tmp_path):
    with pytest.raises(runlake.StoreNotBuiltError, match="build_store"):
        runlake.read_runs(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert not runlake.is_ready(spark, str(empty))
    root = str(tmp_path / "part")
    data = normalize(spark, clean_raw)
    data.runs.write.parquet(table_path(root, "runs"))
    assert missing_tables(spark, root) == ["observations", "samples", MARKER]
    with pytest.raises(runlake.StoreNotBuiltError, match="observations, samples"):
        runlake.read_observations(spark, root)
    assert issubclass(runlake.StoreNotBuiltError, FileNotFoundError)


def test_a_bad_row_leaves_nothing_behind(spark, store, tmp_path):
    root = str(tmp_path / "bad")
    runs, obs, samples = stored(spark, store)
    for column, value, message in (
        ("run_id", "R99", "run not in the manifest: R99"),
        ("unit", "ppm", "unit of"),
        ("source", "moon", "unknown source: moon"),
        ("variable", "mood", "unknown variable: mood"),
    ):
        spoiled = obs.withColumn(column, F.lit(value))
        with pytest.raises(Exception, match=message):
            runlake.write_store(runs, spoiled, samples, root)
        assert not runlake.is_ready(spark, root)
    good = str(tmp_path / "good")
    runlake.write_store(runs, obs, samples, good)
    with pytest.raises(Exception, match="unknown variable: mood"):
        runlake.write_store(runs.filter("false"), spoiled, samples.filter("false"), good, rebuild=False)
    assert runlake.is_ready(spark, good) and counts(spark, good)["observations"] == 52


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("broken", ["runs", "samples", MARKER])
def test_a_write_that_breaks_off_changes_nothing(spark, store, tmp_path, monkeypatch, rebuild, broken):
    """The old state stays readable, and writing again doubles no row."""
    from runlake.sources import store as module

    root = str(tmp_path / "s")
    runs, obs, samples = stored(spark, store)
    runlake.write_store(runs, obs, samples, root)
    more = runs.filter("run_id = 'R1'").withColumn("run_id", F.lit("R7"))
    reading = obs.filter("run_id = 'R1'").withColumn("run_id", F.lit("R7"))
    if rebuild:
        more, reading = runs.unionByName(more), obs.unionByName(reading)
    extra = samples if rebuild else samples.filter("false")
    wanted = {"runs": 5, "observations": 52 + obs.filter("run_id = 'R1'").count(), "samples": 2}
    if broken == MARKER:
        monkeypatch.setattr(module, "_mark", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    else:
        # the table cannot be written, though it can be read
        writer = type(runs.write)
        parquet = writer.parquet

        def refusing(self, target, *a, **k):
            if f"/{broken}/" in target:
                raise OSError("lost")
            return parquet(self, target, *a, **k)

        monkeypatch.setattr(writer, "parquet", refusing)
    with pytest.raises(OSError, match="lost"):
        runlake.write_store(more, reading, extra, root, rebuild=rebuild)
    monkeypatch.undo()
    assert runlake.is_ready(spark, root) and counts(spark, root) == {"runs": 4, "observations": 52, "samples": 2}
    runlake.write_store(more, reading, extra, root, rebuild=rebuild)
    assert counts(spark, root) == wanted


def test_build_only_if_missing(spark, clean_raw, tmp_path):
    root = str(tmp_path / "once")
    assert runlake.ensure_store(spark, clean_raw, root) == root
    before = {r["n_rows"] for r in runlake.stored_counts(spark, root).collect()}
    runlake.ensure_store(spark, str(tmp_path / "no raw data here"), root)
    assert {r["n_rows"] for r in runlake.stored_counts(spark, root).collect()} == before


def one_run(spark, name, hour=0):
    start = datetime(2026, 5, 2, 8)
    run = spark.createDataFrame([(name, "V8", "dasgip", "batch", "K12", start, 36.0, 5.0, "", 1.0, 1.0)], schemas.RUNS)
    reading = [(name, start, float(hour), "bioreactor", "pH", 7.0, "", f"{name}.csv")]
    return run, spark.createDataFrame(reading, schemas.OBSERVATIONS)


def racing(monkeypatch, meanwhile):
    """Let ``meanwhile`` happen just before the next state is published."""
    from runlake.sources import store as module

    publish, waiting = module._mark, [meanwhile]

    def late(*args):
        if waiting:
            waiting.pop()()
        return publish(*args)

    monkeypatch.setattr(module, "_mark", late)


@pytest.mark.parametrize("checked", [True, False])
def test_two_appends_at_once_both_stay(spark, store, tmp_path, monkeypatch, checked):
    root = str(tmp_path / "s")
    runs, obs, samples = stored(spark, store)
    runlake.write_store(runs, obs, samples, root)
    none = samples.filter("false")
    racing(monkeypatch, lambda: runlake.write_store(*one_run(spark, "R8"), none, root, rebuild=False))
    runlake.write_store(*one_run(spark, "R9"), none, root, rebuild=False, runs_checked=checked)
    assert counts(spark, root) == {"runs": 6, "observations": 54, "samples": 2}
    for name in ("R8", "R9"):
        assert runlake.read_observations(spark, root, run_ids=[name]).count() == 1


def test_the_second_of_two_appends_is_checked_against_the_first(spark, store, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    runs, obs, samples = stored(spark, store)
    runlake.write_store(runs, obs, samples, root)
    none = samples.filter("false")
    racing(monkeypatch, lambda: runlake.write_store(*one_run(spark, "R8"), none, root, rebuild=False))
    with pytest.raises(runlake.QualityError, match="repeated run_id"):
        runlake.write_store(*one_run(spark, "R8"), none, root, rebuild=False)
    assert counts(spark, root) == {"runs": 5, "observations": 53, "samples": 2}
    # readings of a run that a rebuild took away meanwhile
    _, readings = one_run(spark, "R2")
    racing(monkeypatch, lambda: runlake.write_store(*one_run(spark, "R8"), none, root))
    with pytest.raises(Exception, match="run not in the manifest: R2"):
        runlake.write_store(runs.filter("false"), readings, none, root, rebuild=False)
    assert counts(spark, root) == {"runs": 1, "observations": 1, "samples": 0}


def test_an_append_follows_a_rebuild_with_other_folders(spark, store, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    runs, obs, samples = stored(spark, store)
    runlake.write_store(runs, obs, samples, root)
    racing(monkeypatch, lambda: runlake.write_store(runs, obs, samples, root, buckets=3))
    runlake.write_store(*one_run(spark, "R9"), samples.filter("false"), root, rebuild=False)
    assert counts(spark, root) == {"runs": 5, "observations": 53, "samples": 2}
    assert runlake.read_observations(spark, root, run_ids=["R9"]).count() == 1


def test_a_build_that_appends_follows_a_rebuild_with_other_folders(spark, store, clean_raw, tmp_path, monkeypatch):
    """The rows are laid out, and their unresolved injections counted, a second time."""
    root = str(tmp_path / "s")
    none = runlake.read_samples(spark, store).filter("false")
    runlake.write_store(*one_run(spark, "R8"), none, root)
    racing(monkeypatch, lambda: runlake.write_store(*one_run(spark, "R9"), none, root, buckets=3))
    assert runlake.build_store(spark, clean_raw, root, rebuild=False) == {"runs": 5, "observations": 53, "samples": 2}
    assert runlake.read_observations(spark, root, run_ids=["R1"], ordered=False).count() > 0


def test_vacuum_removes_what_no_state_lists(spark, store, tmp_path, monkeypatch):
    from pathlib import Path

    root = str(tmp_path / "s")
    runs, obs, samples = stored(spark, store)
    for _ in range(3):
        runlake.write_store(runs, obs, samples, root)
    runlake.write_store(*one_run(spark, "R9"), samples.filter("false"), root, rebuild=False)
    assert runlake.vacuum(spark, root) == []
    assert len(runlake.vacuum(spark, root, "0s")) == 6
    assert counts(spark, root) == {"runs": 5, "observations": 53, "samples": 2}
    for table in ("runs", "samples", "observations"):
        assert len(list(Path(root, table).glob("version=*"))) == 2
    assert not list(Path(root, MARKER).glob("_draft-*")) and runlake.vacuum(spark, root, "0s") == []
