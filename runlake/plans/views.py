"""Run, reading and sample views over the shared ``events`` table.

The library's own input is instrument files. For checks against another engine at any size,
these views dress ``events`` as such data: five event types stand for the five sources, the
last digit of the user for ten runs. Times are cut to the minute, so repeated times, shared
reference rows and unmatched rows all occur. ``SQL`` holds the same views as plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import hours_between, slot, slot_start
from ..operators.spans import numbered
from ..vocabulary import dimension

_MINUTE_US = 60_000_000

# event type, source, variable, factor, unit
_READINGS = (
    ("view", "bioreactor", "DO", 1.0, "%"),
    ("view", "bioreactor", "pH", 0.1, ""),
    ("click", "offgas", "offgas_co2", 1.0, "%"),
    ("click", "offgas", "offgas_o2", 0.5, "%"),
    ("error", "capacitance", "permittivity", 1.0, "pF/cm"),
    ("purchase", "analytical", "glucose", 1.0, "g/L"),
    ("purchase", "analytical", "product", 0.5, "g/L"),
    ("signup", "offline", "dcw", 1.0, "g/L"),
    ("signup", "offline", "od600", 3.0, ""),
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _run_id() -> Column:
    return F.concat(F.lit("R"), (F.col("user_id") % 10).cast("string"))


def _minute() -> Column:
    return slot_start(slot(F.col("ts"), _MINUTE_US), _MINUTE_US)


def _start() -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = dimension(
        spark, _READINGS, "event_type string, source string, variable string, k double, unit string"
    )
    events = _events(spark, sf_dir).select(
        _run_id().alias("run_id"), _minute().alias("timestamp"), "event_type", F.col("value").alias("raw")
    )
    return events.join(F.broadcast(kinds), "event_type").select(
        "run_id",
        "timestamp",
        hours_between(F.col("timestamp"), _start()).alias("elapsed_h"),
        "source",
        "variable",
        (F.col("raw") * F.col("k")).alias("value"),
        "unit",
        F.concat("run_id", F.lit("_"), "source", F.lit(".csv")).alias("source_file"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    seen = _events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("k"))
    ends = seen.agg(F.max("value").alias("fb"), F.min("value").alias("fp"))
    number = k.cast("string")
    return ends.select(
        F.concat(F.lit("R"), number).alias("run_id"),
        F.when(k == 9, F.lit("Vessel_10")).otherwise(F.concat(F.lit("Vessel_"), number)).alias("vessel_id"),
        F.when(k % 2 == 0, "ambr").otherwise("dasgip").alias("system"),
        F.when(k % 2 == 0, "fed-batch").otherwise("batch").alias("mode"),
        F.when(k == 7, None).when(k % 3 == 0, "CHO-K1").otherwise("E. coli BL21").alias("strain"),
        _start().alias("start_time"),
        F.lit(720.0).alias("duration_h"),
        F.lit(0.25).alias("volume_L"),
        F.when(k == 3, "contamination").otherwise("").alias("anomaly"),
        F.col("fb").alias("final_biomass_total_gL"),
        F.col("fp").alias("final_product_gL"),
    )


def _numbered_samples(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    rows = (
        _events(spark, sf_dir)
        .filter(F.col("event_type") == event_type)
        .select(_run_id().alias("run_id"), _minute().alias("t"), "event_id")
    )
    ranked = numbered(rows, ["run_id"], ["t", "event_id"], "rn", "t")
    return ranked.withColumn("sample_id", F.concat("run_id", F.lit("-S"), F.col("rn").cast("string")))


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the peak tables know of each sample."""
    return _numbered_samples(spark, sf_dir, "purchase").select(
        "sample_id", "run_id", F.col("t").alias("injection_time"), F.lit("M1").alias("method")
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manual sheets know of each sample; every tenth sample is missing."""
    rows = _numbered_samples(spark, sf_dir, "signup").filter(F.col("rn") % 10 != 0)
    return rows.select(
        "sample_id",
        "run_id",
        F.col("t").alias("draw_time"),
        F.concat(F.lit("OP"), (F.col("event_id") % 3).cast("string")).alias("operator"),
        (F.col("event_id") % 5).cast("double").alias("dilution_factor"),
        F.lit("").alias("notes"),
    )


def _lines(body: DataFrame, header: str, notes: Column | None = None) -> DataFrame:
    """Give table lines (file_name, row, line) a header line, and notes, per file."""
    files = body.select("file_name").distinct()
    heads = files.select("file_name", F.lit(-1).cast("bigint").alias("row"), F.lit(header).alias("line"))
    parts = body.select("file_name", "row", "line").unionByName(heads)
    if notes is not None:
        noted = files.select("file_name", F.lit(-2).cast("bigint").alias("row"), notes.alias("line"))
        parts = parts.unionByName(noted.filter(F.col("line").isNotNull()))
    return parts.select("line", F.col("file_name").alias("file_path"), "file_name", F.lit(0).alias("block"), "row")


def control_system_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of one export file per run. Runs 0-4 name their batch in a note, 5-9 in the file name."""
    body = (
        _events(spark, sf_dir)
        .filter("event_type = 'view'")
        .select(
            F.concat(
                F.when(F.col("user_id") % 10 < 5, "export_").otherwise(""), _run_id(), F.lit(".csv")
            ).alias("file_name"),
            F.col("event_id").alias("row"),
            F.concat_ws(
                ",",
                F.col("value").cast("string"),
                F.replace(_minute().cast("string"), F.lit(" "), F.lit("T")),
                F.when(F.col("event_id") % 7 == 0, "").otherwise((F.col("value") * 60).cast("string")),
            ).alias("line"),
        )
    )
    named = F.regexp_extract("file_name", r"^export_(R\d)", 1)
    return _lines(
        body, "PV_DO2 [%],Timestamp,PV_Gasflow [L/h]", F.when(named != "", F.concat(F.lit("# Batch ID: "), named))
    )


def offgas_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of one off-gas export per run, separated by semicolons."""
    body = (
        _events(spark, sf_dir)
        .filter("event_type = 'click'")
        .select(
            F.concat(_run_id(), F.lit("_offgas.csv")).alias("file_name"),
            F.col("event_id").alias("row"),
            F.concat_ws(";", _minute().cast("string"), F.col("value").cast("string"), F.lit("x")).alias("line"),
        )
    )
    return _lines(body, "Time_stamp;CO2_percent;O2_percent")


def capacitance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of one probe export per run, with a column that no variable is read from."""
    body = (
        _events(spark, sf_dir)
        .filter("event_type = 'error'")
        .select(
            F.concat(_run_id(), F.lit("_capacitance.csv")).alias("file_name"),
            F.col("event_id").alias("row"),
            F.concat_ws(",", F.lit("1000"), _minute().cast("string"), F.col("value").cast("string")).alias("line"),
        )
    )
    return _lines(body, "Frequency_kHz,Timestamp,Permittivity_pF_cm")


def multi_vessel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of one wide file that holds a vessel 1 and a vessel 10 next to an unknown one."""
    value = F.col("value").cast("string")
    vessel = F.col("user_id") % 3
    body = (
        _events(spark, sf_dir)
        .filter("event_type = 'view'")
        .select(
            F.lit("B1_ambr.csv").alias("file_name"),
            F.col("event_id").alias("row"),
            F.concat_ws(
                ",", _minute().cast("string"), *[F.when(vessel == k, value).otherwise("") for k in (0, 1, 2)], value
            ).alias("line"),
        )
    )
    return _lines(body, "Timestamp,Vessel_1_DO_pct,Vessel_10_pH,Vessel_77_pH,Vessel_10_Colour")


def vessel_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with one line per user, in which vessels are used again and again."""
    users = _events(spark, sf_dir).groupBy("user_id").agg(F.max("value").alias("top"))
    return users.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("run_id"),
        F.concat(F.lit("Vessel_"), (F.col("user_id") % 13).cast("string")).alias("vessel_id"),
        F.when(F.col("user_id") % 2 == 0, "ambr").otherwise("dasgip").alias("system"),
        F.col("user_id").alias("line_no"),
    )


def peak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak-table rows as text cells, with an untracked analyte and blank amounts."""
    kind = F.col("event_id") % 3
    text = F.col("value").cast("string")
    return (
        _events(spark, sf_dir)
        .filter("event_type = 'purchase'")
        .select(
            F.concat(_run_id(), F.lit("_hplc.csv")).alias("file_name"),
            F.col("event_id").alias("row"),
            _run_id().alias("Run_ID"),
            F.concat(_run_id(), F.lit("-"), (F.col("event_id") % 40).cast("string")).alias("Sample_Name"),
            _minute().cast("string").alias("Injection_DateTime"),
            F.when(kind == 0, "Glucose").when(kind == 1, "Product").otherwise("Solvent").alias("Peak_Name"),
            F.when(F.col("event_id") % 4 != 0, "M1").alias("Method"),
            F.when(F.col("event_id") % 5 == 0, "").otherwise(text).alias("Amount"),
            text.alias("Area"),
            F.when(F.col("event_id") % 7 == 0, "n.d.").otherwise(text).alias("RT_min"),
        )
    )


def manual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual sheet rows as text cells, with blank dry cell weights."""
    minute = _minute().cast("string")
    return (
        _events(spark, sf_dir)
        .filter("event_type = 'signup'")
        .select(
            F.concat(_run_id(), F.lit("_biomass.csv")).alias("file_name"),
            F.col("event_id").alias("row"),
            _run_id().alias("Run_ID"),
            F.concat(_run_id(), F.lit("-"), F.col("event_id").cast("string")).alias("Sample_ID"),
            F.substring(minute, 1, 10).alias("Date"),
            F.substring(minute, 12, 5).alias("Time"),
            F.lit("KL").alias("Operator"),
            F.when(F.col("event_id") % 6 == 0, "1:10").otherwise("10").alias("Dilution_Factor"),
            F.when(F.col("event_id") % 4 == 0, "foam").alias("Notes"),
            F.col("value").cast("string").alias("OD600_Corrected"),
            F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string")).alias("DCW_g_L"),
        )
    )


def odd_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell texts of which some are numbers, some only look like it."""
    value = F.col("value").cast("string")
    forms = {1: F.concat(value, F.lit("d")), 2: F.lit("NaN"), 3: F.lit(""), 4: F.concat(F.lit(" "), value, F.lit(" ")),
             5: F.concat(F.lit("-"), value, F.lit("e2")), 6: F.concat(value, F.lit(" mg")), 7: F.lit("-inf")}
    text = value
    for rest, form in forms.items():
        text = F.when(F.col("event_id") % 9 == rest, form).otherwise(text)
    return _events(spark, sf_dir).select("event_id", text.alias("text"))


SQL = """
obs as (
  select e.run_id, e.timestamp, cast(e.us as double) / 3.6e9 as elapsed_h, m.source, m.variable,
         e.value * m.k as value, m.unit, concat(e.run_id, '_', m.source, '.csv') as source_file
  from (select concat('R', cast(user_id % 10 as varchar)) as run_id, event_type, value,
               date_trunc('minute', ts) as timestamp,
               epoch_us(date_trunc('minute', ts)) - 1704067200000000 as us from events) e
  join (values
    ('view',     'bioreactor',  'DO',           cast(1.0 as double), '%'),
    ('view',     'bioreactor',  'pH',           cast(0.1 as double), ''),
    ('click',    'offgas',      'offgas_co2',   cast(1.0 as double), '%'),
    ('click',    'offgas',      'offgas_o2',    cast(0.5 as double), '%'),
    ('error',    'capacitance', 'permittivity', cast(1.0 as double), 'pF/cm'),
    ('purchase', 'analytical',  'glucose',      cast(1.0 as double), 'g/L'),
    ('purchase', 'analytical',  'product',      cast(0.5 as double), 'g/L'),
    ('signup',   'offline',     'dcw',          cast(1.0 as double), 'g/L'),
    ('signup',   'offline',     'od600',        cast(3.0 as double), '')
  ) m(event_type, source, variable, k, unit) on e.event_type = m.event_type),
runs as (
  select concat('R', cast(k as varchar)) as run_id,
         case when k = 9 then 'Vessel_10' else concat('Vessel_', cast(k as varchar)) end as vessel_id,
         case when k % 2 = 0 then 'ambr' else 'dasgip' end as system,
         case when k % 2 = 0 then 'fed-batch' else 'batch' end as mode,
         case when k = 7 then null when k % 3 = 0 then 'CHO-K1' else 'E. coli BL21' end as strain,
         cast('2024-01-01 00:00:00' as timestamp) as start_time,
         cast(720.0 as double) as duration_h, cast(0.25 as double) as volume_L,
         case when k = 3 then 'contamination' else '' end as anomaly,
         fb as final_biomass_total_gL, fp as final_product_gL
  from (select user_id % 10 as k, max(value) as fb, min(value) as fp from events group by user_id % 10) t),
injections as (
  select concat(run_id, '-S', cast(rn as varchar)) as sample_id, run_id, t as injection_time, 'M1' as method
  from (select run_id, t, row_number() over (partition by run_id order by t, event_id) as rn
        from (select concat('R', cast(user_id % 10 as varchar)) as run_id,
                     date_trunc('minute', ts) as t, event_id
              from events where event_type = 'purchase') a) b),
draws as (
  select concat(run_id, '-S', cast(rn as varchar)) as sample_id, run_id, t as draw_time,
         concat('OP', cast(event_id % 3 as varchar)) as operator,
         cast(event_id % 5 as double) as dilution_factor, '' as notes
  from (select run_id, t, event_id, row_number() over (partition by run_id order by t, event_id) as rn
        from (select concat('R', cast(user_id % 10 as varchar)) as run_id,
                     date_trunc('minute', ts) as t, event_id
              from events where event_type = 'signup') a) b
  where rn % 10 <> 0)
"""
