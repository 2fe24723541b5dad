"""Vendor files to the common schema."""

import csv
import io
from datetime import datetime

import pytest
from conftest import FILES, write_tree
from pyspark.sql import functions as F

import runlake
from runlake import schemas
from runlake.plans.ingest import normalize, normalize_checked
from runlake.sources.manifest import read_manifest
from runlake.sources.sensors import header_metadata, read_single_run, sensor_lines
from runlake.vocabulary import SOURCES, UNITS


@pytest.fixture(scope="module")
def data(spark, raw):
    found = normalize(spark, raw)
    obs = found.observations.toPandas()
    return found, obs


def picked(obs, **wanted):
    for name, value in wanted.items():
        obs = obs[obs[name] == value]
    return obs.sort_values("timestamp")


def test_schema_and_vocabulary(data):
    found, obs = data
    assert [(f.name, f.dataType) for f in found.observations.schema] == [
        (f.name, f.dataType) for f in schemas.OBSERVATIONS
    ]
    assert set(obs.source) <= {name for name, _, _ in SOURCES}
    assert (obs.unit == obs.variable.map(UNITS)).all()
    assert not obs.isna().any().any()
    assert len(obs) == 55


def test_files_are_listed_by_layout(spark, raw):
    listed = {(r["layout"], r["file_name"]) for r in runlake.list_files(spark, raw).collect()}
    assert ("dasgip", "R1.csv") in listed and ("ambr", "B1_ambr.csv") in listed
    assert len(listed) == len(FILES) - 1


def test_header_notes_stop_at_the_table(spark, tmp_path):
    text = "# Batch ID: R1\n#  Vessel : V1 : left\n# no colon\n# Batch ID: R2\nTimestamp,PV_pH\n2026-03-02T08:00:00,7\n# Batch ID: R9\n"
    root = write_tree(tmp_path, {"bioreactor/dasgip/x.csv": text, "run_manifest.csv": FILES["run_manifest.csv"]})
    lines = sensor_lines(spark, root, "dasgip")
    assert header_metadata(lines).first()["metadata"] == {"Batch ID": "R2", "Vessel": "V1 : left"}
    obs = read_single_run(spark, root, "dasgip", read_manifest(spark, root)).collect()
    assert [(r["run_id"], r["value"]) for r in obs] == [("R2", 7.0)]


def test_gas_flow_is_per_minute_in_both_systems(data):
    _, obs = data
    flow = obs[obs.variable == "gas_flow"]
    assert picked(flow, run_id="R1").value.tolist() == pytest.approx([5.0, 5.1, 5.0])
    assert picked(flow, run_id="A2").value.tolist() == pytest.approx([0.2, 0.3])


def test_columns_are_found_by_name_in_each_file(data):
    _, obs = data
    assert picked(obs, run_id="R2", variable="DO").value.tolist() == [90.0]
    assert picked(obs, run_id="R2", variable="pH").value.tolist() == [7.1, 7.2]
    assert picked(obs, run_id="R2", variable="offgas_co2").value.tolist() == [0.5]
    assert picked(obs, run_id="R2", variable="offgas_o2").value.tolist() == [20.5]


def test_run_comes_from_note_name_or_vessel(data):
    _, obs = data
    files = obs.groupby("source_file").run_id.unique().map(sorted).to_dict()
    assert files["R1.csv"] == ["R1"] and files["R2.csv"] == ["R2"]
    assert files["B1_ambr.csv"] == ["A1", "A2"] and files["R2_offgas.csv"] == ["R2"]
    assert picked(obs, run_id="A2", variable="pH").value.tolist() == [7.3]


def test_peaks_keep_blank_amounts_out(data):
    _, obs = data
    assert picked(obs, variable="glucose").value.tolist() == [18.5, 7.0]
    assert picked(obs, variable="glucose_rt").value.tolist() == [9.7, 9.8, 9.8]
    assert not any("solvent" in v.lower() for v in obs.variable)


def test_peaks_move_to_draw_time(data):
    found, obs = data
    times = picked(obs, variable="glucose_rt").timestamp.tolist()
    assert times[:2] == [datetime(2026, 3, 2, 8, 1), datetime(2026, 3, 2, 12, 0)]
    assert times[2] == datetime(2026, 3, 2, 20, 0)


def test_elapsed_hours(data):
    _, obs = data
    assert obs.elapsed_h.min() == 0.0
    assert picked(obs, variable="od600").elapsed_h.tolist() == pytest.approx([1 / 60, 4.0])


def test_samples_join_both_sheets(spark, raw):
    rows = {r["sample_id"]: r for r in normalize(spark, raw).samples.collect()}
    assert rows["R1-S001"]["notes"] == "foam, a lot\nof it"
    assert rows["R1-S001"]["injection_time"] == datetime(2026, 3, 2, 10, 30)
    assert rows["R1-S002"]["notes"] == "" and rows["R1-S002"]["dilution_factor"] == 10.0
    assert rows["R1-S009"]["run_id"] is None and rows["R1-S009"]["draw_time"] is None


def test_manifest_fills_anomaly_and_keeps_line_order(spark, raw):
    rows = read_manifest(spark, raw).orderBy("line_no").collect()
    assert [r["run_id"] for r in rows] == ["R1", "R2", "A1", "A2"]
    assert [r["anomaly"] for r in rows] == ["", "contamination", "", ""]


def test_missing_manifest_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run_manifest.csv"):
        normalize(spark, str(tmp_path))


def test_no_files_give_empty_tables(spark, tmp_path):
    root = write_tree(tmp_path, {"run_manifest.csv": FILES["run_manifest.csv"]})
    found = normalize(spark, root)
    assert found.observations.count() == 0 and found.samples.count() == 0 and found.runs.count() == 4


@pytest.mark.parametrize(
    ("name", "text", "message"),
    [
        ("bioreactor/dasgip/R9.csv", "Timestamp,PV_pH\n2026-03-02T08:00:00,7\n", "run not in the manifest: R9"),
        ("auxiliary/offgas/Q_offgas.csv", "Time_stamp;CO2_percent\n2026-03-02 08:00:00;1\n", "manifest: Q"),
        ("auxiliary/capacitance/R1_capacitance.csv", "When,Permittivity_pF_cm\n2026-03-02 08:00:00,1\n", "no header line with Timestamp"),
        ("auxiliary/capacitance/R1_capacitance.csv", "Timestamp,Other\n2026-03-02 08:00:00,1\n", "no header line"),
        ("bioreactor/ambr/B_ambr.csv", "Timestamp,Vessel_99_pH\n2026-03-02 08:00:00,1\n", "no header line"),
        ("bioreactor/dasgip/R1.csv", "Timestamp,PV_pH\nyesterday,7\n", "R1.csv: cannot read a time from 'yesterday'"),
        ("offline/R1_biomass.csv", "Date,Time,Run_ID,Sample_ID,Dilution_Factor,OD600_Corrected,DCW_g_L,Operator,Notes\n2026-03-02,,R1,s,1,1,1,K,\n", "cannot read a time"),
        ("analytical/x_hplc.csv", "Sample_Name,Run_ID,Injection_DateTime,Peak_Name,Amount,Method\ns,R9,2026-03-02 08:00:00,Glucose,1,M\n", "manifest: R9"),
        ("analytical/x_hplc.csv", "Sample_Name,Injection_DateTime,Peak_Name,Amount,Method\ns,2026-03-02 08:00:00,Glucose,1,M\n", "no column Run_ID"),
    ],
)
def test_faulty_files_stop_the_job(spark, tmp_path, name, text, message):
    root = write_tree(tmp_path, {"run_manifest.csv": FILES["run_manifest.csv"], name: text})
    with pytest.raises(Exception, match=message):
        normalize(spark, root).observations.collect()


def test_optional_peak_columns_may_be_absent(spark, tmp_path):
    text = "Sample_Name,Run_ID,Injection_DateTime,Peak_Name,Amount,Method\ns,R1,2026-03-02 08:00:00,Glucose,1.5,M\n"
    root = write_tree(tmp_path, {"run_manifest.csv": FILES["run_manifest.csv"], "analytical/x_hplc.csv": text})
    assert [(r["variable"], r["value"]) for r in normalize(spark, root).observations.collect()] == [("glucose", 1.5)]


def test_repeated_vessel_takes_the_last_manifest_line(spark, tmp_path):
    manifest = FILES["run_manifest.csv"] + "A7,Vessel_1,ambr,fed-batch,CHO-K1,2026-04-02 08:00:00,96.0,0.25,,1,1\n"
    root = write_tree(tmp_path, {"run_manifest.csv": manifest})
    runs = read_manifest(spark, root)
    assert runlake.owner_of(runs, "ambr", "Vessel_1") == "A7"
    assert runlake.run_record(runs, "A7")["strain"] == "CHO-K1"
    with pytest.raises(runlake.UnknownRunError):
        runlake.owner_of(runs, "dasgip", "Vessel_1")
    with pytest.raises(runlake.UnknownRunError):
        runlake.run_record(runs, "R99")


def test_large_file_read_in_many_splits(spark, tmp_path):
    """Header and order rules hold when a file is cut into splits."""
    start = datetime(2026, 3, 2, 8)
    body = "".join(f"{(start + i * (datetime(2026, 3, 2, 9) - start) / 60).isoformat()},{i}\n" for i in range(3000))
    root = write_tree(
        tmp_path,
        {
            "run_manifest.csv": FILES["run_manifest.csv"],
            "bioreactor/dasgip/f.csv": "# Batch ID: R1\nTimestamp,PV_pH\n" + body + "# Batch ID: R2\n",
        },
    )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = sensor_lines(spark, root, "dasgip")
        assert lines.rdd.getNumPartitions() > 5
        row = (
            read_single_run(spark, root, "dasgip", read_manifest(spark, root))
            .agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.collect_set("run_id").alias("r"))
            .first()
        )
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (row["n"], row["s"], row["r"]) == (3000, sum(range(3000)), ["R1"])


def test_checked_ingest_reports_the_sample_without_a_run(spark, raw):
    with pytest.raises(runlake.QualityError, match="samples: null 'run_id'"):
        normalize_checked(spark, raw)
    found = normalize(spark, raw)
    sizes, by_source = found.summary()
    assert {r["table_name"]: r["n_rows"] for r in sizes.collect()} == {"runs": 4, "observations": 55, "samples": 3}
    assert by_source.first()["source"] == "bioreactor"


def test_sheets_keep_all_their_columns(spark, tmp_path):
    """A sheet with its measurement in the 69th column."""
    files = dict(FILES)
    name = next(n for n in files if "biomass" in n and n.startswith("offline") or n.endswith("_biomass.csv"))
    table = list(csv.reader(io.StringIO(files[name])))
    head = next(i for i, row in enumerate(table) if "DCW_g_L" in row)
    place = table[head].index("DCW_g_L")
    for k, row in enumerate(table[head:]):
        if len(row) > place:
            value = row.pop(place)
            row += [f"extra{i}" if k == 0 else "" for i in range(68 - len(row))] + [value]
    wide = io.StringIO()
    csv.writer(wide).writerows(table)
    before = normalize(spark, write_tree(tmp_path / "narrow", files)).observations.filter("variable = 'dcw'").count()
    files[name] = wide.getvalue()
    after = normalize(spark, write_tree(tmp_path / "wide", files)).observations.filter("variable = 'dcw'").count()
    assert after == before > 0


def test_header_only_sheets_leave_the_samples_their_runs(spark, tmp_path):
    files = dict(FILES)
    for name in [n for n in files if n.endswith("_biomass.csv")]:
        lines = files[name].splitlines()
        head = next(i for i, line in enumerate(lines) if "Sample_ID" in line)
        files[name] = "\n".join(lines[: head + 1]) + "\n"
    samples = normalize(spark, write_tree(tmp_path, files)).samples
    assert samples.count() > 0 and samples.filter("run_id is null").isEmpty()


def test_rows_without_a_source_survive_backdating(spark):
    from runlake.operators.corrections import backdate

    at = datetime(2026, 3, 2, 8)
    rows = spark.createDataFrame([("R1", at, 0.0, s, "pH", 7.0, "", "f") for s in (None, "analytical", "offgas")], schemas.OBSERVATIONS.simpleString().removeprefix("struct<").removesuffix(">"))
    assert backdate(rows, spark.createDataFrame([], schemas.SAMPLES)).count() == 3


def test_the_build_warns_of_injections_without_a_draw(spark, raw):
    from runlake.plans.ingest import warn_of_unresolved

    with pytest.warns(UserWarning, match="have no draw time"):
        warn_of_unresolved(normalize(spark, raw))


def test_repeated_runs_need_line_numbers(spark):
    from runlake.operators.registry import unique_runs

    rows = spark.createDataFrame([("R1", 1), ("R1", 2)], "run_id string, x int")
    with pytest.raises(Exception, match="run listed more than once: R1"):
        unique_runs(rows).collect()


def test_a_watched_backdating_counts_as_the_query_does(spark, raw):
    """The counts come with the job that computes the rows, and the rows are those of an unwatched one."""
    from pyspark.sql import Observation

    from runlake.operators.corrections import backdate, unresolved_injections

    found = normalize(spark, raw)
    late = found.observations.withColumn("timestamp", F.expr("timestamp + interval 3 hours"))
    watch = Observation()
    rows = backdate(late, found.samples, watch).collect()
    assert watch.get == unresolved_injections(late, found.samples).first().asDict()
    assert sorted(map(str, rows)) == sorted(map(str, backdate(late, found.samples).collect()))


def test_the_build_counts_unresolved_rows_while_it_writes(spark, raw, tmp_path, monkeypatch):
    from runlake.plans import ingest

    seen = []
    monkeypatch.setattr(ingest, "warn_of_unresolved", lambda data, counts: seen.append(counts))
    # draws for all three samples; 3 + 3 + 2 (a blank amount) + 3 cells of the four peaks of tracked analytes
    files = dict(FILES)
    files["offline/R1_biomass.csv"] += "2026-03-02,19:30,R1,R1-S009,0.4,10,4.0,,KL,\n"
    ingest.build_store(spark, write_tree(tmp_path / "raw", files), str(tmp_path / "s"))
    write_tree(tmp_path / "none", {"run_manifest.csv": files["run_manifest.csv"]})
    ingest.build_store(spark, str(tmp_path / "none"), str(tmp_path / "e"))
    assert seen == [{"analytical_rows": 11, "unresolved": 0}, None]
