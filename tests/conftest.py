import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("runlake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


MANIFEST = """run_id,vessel_id,system,mode,strain,start_time,duration_h,volume_L,anomaly,final_biomass_total_gL,final_product_gL
R1,V1,dasgip,batch,E. coli BL21,2026-03-02 08:00:00,36.0,5.0,,9.82,6.44
R2,V2,dasgip,batch,E. coli BL21,2026-03-02 08:00:00,36.0,5.0,contamination,10.08,6.24
A1,Vessel_1,ambr,fed-batch,CHO-K1,2026-03-02 08:00:00,96.0,0.25,,8.1,2.5
A2,Vessel_10,ambr,fed-batch,CHO-K1,2026-03-02 08:00:00,96.0,0.25,,8.2,2.6
"""

FILES = {
    "run_manifest.csv": MANIFEST,
    "bioreactor/dasgip/R1.csv": (
        "# DASGIP Control System Export\r\n# Batch ID: R1\r\n# Vessel: V1\r\n# Export Date: 2026-03-03 20:00:00\r\n"
        "Time [h],Timestamp,PV_pH,PV_DO2 [%],PV_Temp [degC],PV_Stirrer [rpm],PV_Gasflow [L/h],PV_Pressure [bar],Base_Total [mL]\n"
        "0.0,2026-03-02T08:00:00,7.0,95.5,37.0,500,300,1.01,0.0\n"
        "0.0167,2026-03-02T08:01:00,6.99,,37.1,501,306,1.02,0.1\n"
        "0.0333,2026-03-02T08:02:00,6.98,94.0,37.0,502,300,1.01,0.2\n"
    ),
    # No batch id, other column order, some columns absent.
    "bioreactor/dasgip/R2.csv": (
        "# Export\nPV_DO2 [%],Timestamp,PV_Gasflow [L/h],PV_pH\n"
        "90.0,2026-03-02T08:00:00,60,7.1\n"
        "bad,2026-03-02T08:01:00,120,7.2\n"
    ),
    "bioreactor/ambr/B1_ambr.csv": (
        "Timestamp,Vessel_1_pH,Vessel_1_DO_pct,Vessel_10_pH,Vessel_10_Gasflow_Lpm,Vessel_7_pH,Vessel_1_Colour\n"
        "2026-03-02T08:00:00,7.0,50.0,7.3,0.2,1.0,9\n"
        "2026-03-02T08:02:00,7.1,51.0,,0.3,1.0,9\n"
    ),
    "analytical/R1_hplc.csv": (
        "Injection_ID,Sample_Name,Run_ID,Injection_DateTime,Peak_Name,RT_min,Area,Height,Amount,Units,Method\n"
        "1,R1-S001,R1,2026-03-02 10:30:00,Glucose,9.7,1200,55,18.5,g/L,M1\n"
        "1,R1-S001,R1,2026-03-02 10:30:00,Product,12.1,90,5,0.4,g/L,M1\n"
        "1,R1-S001,R1,2026-03-02 10:30:00,Solvent,1.1,9,5,1.0,g/L,M1\n"
        "2,R1-S002,R1,2026-03-02 14:15:00,Glucose,9.8,800,40,,g/L,M1\n"
        "3,R1-S009,R1,2026-03-02 20:00:00,Glucose,9.8,700,40,7.0,g/L,M1\n"
    ),
    "offline/R1_biomass.csv": (
        "Date,Time,Run_ID,Sample_ID,OD600_Raw,Dilution_Factor,OD600_Corrected,DCW_g_L,Operator,Notes\n"
        '2026-03-02,08:01,R1,R1-S001,0.5,1,0.5,0.2,KL,"foam, a lot\nof it"\n'
        "2026-03-02,12:00,R1,R1-S002,0.4,10,4.0,,KL,\n"
    ),
    "auxiliary/offgas/R1_offgas.csv": (
        "Time_stamp;CO2_percent;O2_percent;Flow_In_Lpm\n"
        "2026-03-02 08:00:30;0.1;20.9;5.0\n2026-03-02 08:01:30;0.2;20.8;5.0\n"
    ),
    # Column order differs from the first file.
    "auxiliary/offgas/R2_offgas.csv": (
        "O2_percent;Time_stamp;CO2_percent\n20.5;2026-03-02 08:00:10;0.5\n"
    ),
    "auxiliary/capacitance/R1_capacitance.csv": (
        "Timestamp,Permittivity_pF_cm,Frequency_kHz\n2026-03-02 08:00:45,1.5,1000\n"
    ),
}


def write_tree(root, files):
    for name, text in files.items():
        path = Path(root) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(root)


@pytest.fixture(scope="session")
def raw(tmp_path_factory):
    return write_tree(tmp_path_factory.mktemp("raw"), FILES)
