"""Plain SQL for every registered query, over the same tables."""

from __future__ import annotations

import re

from ..vocabulary import PLAUSIBLE, SOURCES, TRACES, UNITS
from .views import SQL as VIEWS

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], *columns: str) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "cast(null as double)"
        return _text(v) if isinstance(v, str) else f"cast({v} as {'double' if isinstance(v, float) else 'bigint'})"

    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"(values {body}) v({', '.join(columns)})"


def oracle(name: str, body: str, *ctes: str) -> None:
    parts = ",\n".join([VIEWS.strip(), SAMPLES.strip(), *[c.strip() for c in ctes]])
    # DO is a keyword in SQL and a variable here.
    ORACLES[name] = re.sub(r"""(?<![\w'"])DO(?![\w'"])""", '"DO"', f"with {parts}\n{body.strip()}")


def ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {name or column.split('.')[-1]}"


SAMPLES = """
samples as (
  select sample_id, d.run_id, d.draw_time, i.injection_time, d.operator, d.dilution_factor, i.method, d.notes
  from draws d full join injections i using (sample_id))
"""
_titles = list(dict.fromkeys(t[1] for t in TRACES))
TRACE_VALUES = _values(
    [(g, _titles.index(t) + 1, t, a, n, v, s, lab, st, UNITS[v]) for n, (g, t, a, v, s, lab, st) in enumerate(TRACES, 1)],
    "panel_group", "panel_no", "panel", "axis_label", "trace_no", "variable", "trace_source", "trace_label", "style", "unit",
)
UNIT_VALUES = _values(list(UNITS.items()), "variable", "unit")
LABEL_VALUES = _values([(s, label) for s, _, label in SOURCES], "source", "label")
MINUTE = "date_trunc('minute', ts)"
RUN = "concat('R', cast(user_id % 10 as varchar))"

# --- from vendor files to the common schema -------------------------------------------------

_DASGIP_FILE = f"case when user_id % 10 < 5 then concat('export_', {RUN}, '.csv') else concat({RUN}, '.csv') end"
oracle(
    "normalize_unpivot",
    f"""
select {RUN} as run_id, {ts(MINUTE, "timestamp")}, 'bioreactor' as source, variable, round(v, 8) as value, unit,
       {_DASGIP_FILE} as source_file
from (select *, 'DO' as variable, '%' as unit, value as v from events where event_type = 'view'
      union all
      select *, 'gas_flow', 'L/min', value * 60 / 60 from events where event_type = 'view' and event_id % 7 <> 0) e
""",
)
oracle(
    "normalize_offgas",
    f"""
select {RUN} as run_id, {ts(MINUTE, "timestamp")}, 'offgas' as source, 'offgas_co2' as variable,
       round(value, 8) as value, '%' as unit, concat({RUN}, '_offgas.csv') as source_file
from events where event_type = 'click'
""",
)
oracle(
    "normalize_capacitance",
    f"""
select {RUN} as run_id, {ts(MINUTE, "timestamp")}, 'capacitance' as source, 'permittivity' as variable,
       round(value, 8) as value, 'pF/cm' as unit, concat({RUN}, '_capacitance.csv') as source_file
from events where event_type = 'error'
""",
)
oracle(
    "normalize_multivessel",
    f"""
select case user_id % 3 when 0 then 'R2' else 'R4' end as run_id, {ts(MINUTE, "timestamp")}, 'bioreactor' as source,
       case user_id % 3 when 0 then 'DO' else 'pH' end as variable, round(value, 8) as value,
       case user_id % 3 when 0 then '%' else '' end as unit, 'B1_ambr.csv' as source_file
from events where event_type = 'view' and user_id % 3 < 2
""",
)
oracle(
    "header_notes",
    f"""
select distinct {_DASGIP_FILE} as file_name, 'Batch ID' as key, {RUN} as value
from events where event_type = 'view' and user_id % 10 < 5
""",
)
_PEAKS = f"""
peaks as (
  select {RUN} as run_id, {MINUTE} as t, concat({RUN}, '-', cast(event_id % 40 as varchar)) as sample_id, event_id, value,
         case event_id % 3 when 0 then 'glucose' when 1 then 'product' end as analyte,
         case when event_id % 4 <> 0 then 'M1' end as method
  from events where event_type = 'purchase')
"""
oracle(
    "normalize_peaks",
    f"""
select run_id, {ts("t", "timestamp")}, 'analytical' as source, concat(analyte, suffix) as variable,
       round(value, 8) as value, unit, concat(run_id, '_hplc.csv') as source_file
from peaks cross join (values ('', 5, 'g/L'), ('_peak_area', 0, 'counts'), ('_rt', 7, 'min')) m(suffix, gap, unit)
where analyte is not null and (gap = 0 or event_id % gap <> 0)
""",
    _PEAKS,
)
oracle(
    "samples_first",
    f"""
select sample_id, arg_min(run_id, event_id) as run_id, {ts("arg_min(t, event_id)", "injection_time")},
       arg_min(method, event_id) filter (where method is not null) as method
from peaks group by sample_id
""",
    _PEAKS,
)
oracle(
    "normalize_biomass",
    f"""
select {RUN} as run_id, {ts(MINUTE, "timestamp")}, 'offline' as source, variable, round(value, 8) as value, unit,
       concat({RUN}, '_biomass.csv') as source_file
from events cross join (values ('od600', ''), ('dcw', 'g/L')) m(variable, unit)
where event_type = 'signup' and (variable = 'od600' or event_id % 5 <> 0)
""",
)
oracle(
    "sample_draws",
    f"""
select concat({RUN}, '-', cast(event_id as varchar)) as sample_id, {RUN} as run_id, {ts(MINUTE, "draw_time")},
       'KL' as operator, case when event_id % 6 = 0 then null else cast(10 as double) end as dilution_factor,
       case when event_id % 4 = 0 then 'foam' else '' end as notes
from events where event_type = 'signup'
""",
)
oracle(
    "numeric_coercion",
    """
select event_id,
       round(case event_id % 9 when 0 then value when 4 then value when 5 then 0 - value * 100 when 8 then value end, 8)
         as number,
       case event_id % 9 when 0 then false when 4 then false when 5 then false when 8 then false when 7 then true end
         as is_infinite
from events
""",
)
oracle(
    "run_from_filename",
    r"""
select source_file, nullif(regexp_extract(source_file, '^(.*)_offgas\.csv$', 1), '') as run_id
from (select distinct source_file from obs) f
""",
)
oracle(
    "manifest_lookup",
    """
select case when user_id % 2 = 0 then 'ambr' else 'dasgip' end as system,
       concat('Vessel_', cast(user_id % 13 as varchar)) as vessel_id,
       concat('U', cast(max(user_id) as varchar)) as run_id
from events group by 1, 2
""",
)

# --- corrections and checks ------------------------------------------------------------------

_SAMPLE_COLUMNS = (
    f"sample_id, run_id, {ts('draw_time')}, {ts('injection_time')}, operator, dilution_factor, method, notes"
)
oracle("samples_outer", f"select {_SAMPLE_COLUMNS} from samples")
_LOOKUP = """
lookup as (
  select run_id, injection_time, draw_time
  from (select *, row_number() over (partition by run_id, injection_time order by sample_id) as rn
        from samples where injection_time is not null and draw_time is not null) s
  where rn = 1)
"""
_BACKDATED = """
from obs o left join lookup l on o.source = 'analytical' and o.run_id = l.run_id and o.timestamp = l.injection_time
"""
oracle(
    "backdate",
    f"""
select o.run_id, {ts("coalesce(l.draw_time, o.timestamp)", "timestamp")}, round(o.elapsed_h, 8) as elapsed_h,
       o.source, o.variable, round(o.value, 8) as value, o.unit, o.source_file {_BACKDATED}
""",
    _LOOKUP,
)
oracle(
    "backdate_unresolved",
    f"""
select count(*) as analytical_rows, count(*) filter (where l.draw_time is null) as unresolved {_BACKDATED}
where o.source = 'analytical'
""",
    _LOOKUP,
)
oracle(
    "elapsed_hours",
    f"""
select o.run_id, {ts("o.timestamp")}, o.variable, round(o.value, 8) as value,
       round((epoch_us(o.timestamp) - epoch_us(r.start_time)) / 3.6e9, 8) as elapsed_h
from obs o join runs r using (run_id)
""",
)
oracle(
    "orphans",
    "select distinct run_id from obs where run_id not in (select run_id from runs where system = 'ambr')",
)
_SPOILED = """
bad as (
  select case when odd and source = 'offline' then 'R99' else run_id end as run_id,
         case when not (odd and source = 'analytical') then timestamp end as timestamp,
         case when odd and source = 'capacitance' then 'probe' else source end as source,
         case when odd and variable = 'pH' then 'acidity' else variable end as variable,
         case when not (odd and variable = 'DO') then value end as value,
         case when odd and source = 'offgas' then 'ppm' else unit end as unit
  from (select *, cast(floor(value) as bigint) % 5 = 0 as odd from obs) o)
"""
oracle(
    "quality_report",
    f"""
select 'unknown source' as "check", source as key, count(*) as n_bad from bad
where source not in ({", ".join(_text(s) for s, _, _ in SOURCES)}) group by 2
union all
select 'unknown variable', variable, count(*) from bad
where variable not in (select variable from {UNIT_VALUES}) group by 2
union all
select 'wrong unit', concat(b.variable, ' ', b.unit), count(*) from bad b join {UNIT_VALUES} using (variable)
where b.unit <> v.unit group by 2
union all
select 'observations: orphan run_id', run_id, count(*) from bad where run_id not in (select run_id from runs) group by 2
union all
select 'observations: null', 'timestamp', count(*) from bad where timestamp is null having count(*) > 0
union all
select 'observations: null', 'value', count(*) from bad where value is null having count(*) > 0
union all
select 'samples: null', 'run_id', count(*) from samples where run_id is null having count(*) > 0
union all
select 'runs: repeated run_id', run_id, 2 from runs where system = 'ambr'
union all
select 'samples: repeated sample_id', sample_id, count(*) from samples group by 2 having count(*) > 1
""",
    _SPOILED,
)
oracle(
    "range_check",
    f"""
select o.run_id, o.variable, count(*) as n_bad, round(min(value), 8) as minimum, round(max(value), 8) as maximum
from obs o join {_values(list(PLAUSIBLE), "variable", "lo", "hi")} using (variable)
where value < lo or value > hi group by 1, 2
""",
)

# --- reads and summaries ---------------------------------------------------------------------

oracle(
    "read_filtered",
    f"""
select run_id, {ts("timestamp")}, round(elapsed_h, 8) as elapsed_h, source, variable, round(value, 8) as value, unit,
       source_file
from obs where run_id in ('R1', 'R3') and source in ('bioreactor', 'offline') and variable in ('DO', 'dcw', 'glucose')
order by run_id, source, variable, obs.timestamp
""",
)
oracle(
    "table_counts",
    """
select 'observations' as table_name, count(*) as n_rows from obs
union all select 'samples', count(*) from samples
union all select 'runs', count(*) from runs
""",
)
oracle("ingest_summary", "select source, count(*) as n_rows from obs group by source order by n_rows desc, source")
oracle(
    "provenance",
    f"""
select b.run_id, b.source, l.label, b.files, b.variables, b.points, round(c.cadence_s, 8) as cadence_s,
       case when c.cadence_s is null then 'single reading'
            when c.cadence_s < 90 then concat(cast(cast(round_even(c.cadence_s, 0) as bigint) as varchar), ' s')
            when c.cadence_s < 5400 then concat(cast(cast(round_even(c.cadence_s / 60, 0) as bigint) as varchar), ' min')
            else concat(printf('%.1f', round_even(c.cadence_s / 3600, 1)), ' h') end as cadence,
       {ts("f.first_reading")}, {ts("f.last_reading")}
from (select run_id, source, string_agg(distinct source_file, ', ' order by source_file) as files,
             count(distinct variable) as variables, count(*) as points
      from obs group by run_id, source) b
join (select run_id, source, min(timestamp) as first_reading, max(timestamp) as last_reading
      from led group by run_id, source) f using (run_id, source)
left join (select run_id, source, median(gap) as cadence_s
           from (select run_id, source,
                        (epoch_us(timestamp) - lag(epoch_us(timestamp)) over (partition by run_id, source order by timestamp))
                          / 1e6 as gap from led) g
           group by run_id, source) c using (run_id, source)
join {LABEL_VALUES.replace(") v(", ") l(")} using (source)
""",
    """
led as (select o.* from obs o
        join (select run_id, source, min(variable) as variable from obs group by 1, 2) m using (run_id, source, variable))
""",
)
oracle(
    "run_outcomes",
    """
select run_id, concat_ws(' · ',
         max(case when variable = 'dcw' then concat('Final biomass **', printf('%.2f', round_even(final, 2)), '** ', unit) end),
         max(case when variable = 'product' then concat('Final product **', printf('%.2f', round_even(final, 2)), '** ', unit) end)
       ) as outcome
from (select run_id, variable, unit, value as final,
             row_number() over (partition by run_id, variable order by elapsed_h desc, value desc) as rn
      from obs where variable in ('dcw', 'product')) l
where rn = 1 group by run_id
""",
)
oracle(
    "data_table",
    """
select run_id, source, variable, unit, count(*) as points, round(min(value), 8) as minimum,
       round(max(value), 8) as maximum, round(max(case when rn = 1 then value end), 8) as final
from (select *, row_number() over (partition by run_id, source, variable, unit order by timestamp desc, value desc) as rn
      from obs) o
group by 1, 2, 3, 4
""",
)
oracle(
    "end_values",
    f"""
select r.run_id, vessel_id, system, mode, strain, {ts("start_time")}, duration_h, volume_L, anomaly,
       round(b.v, 3) as final_biomass_total_gL, round(p.v, 3) as final_product_gL
from runs r
left join (select run_id, value as v, row_number() over (partition by run_id order by timestamp desc, value desc) as rn
           from obs where variable = 'dcw') b on b.run_id = r.run_id and b.rn = 1
left join (select run_id, value as v, row_number() over (partition by run_id order by timestamp desc, value desc) as rn
           from obs where variable = 'product') p on p.run_id = r.run_id and p.rn = 1
""",
)
oracle("available_variables", "select distinct run_id, variable from obs")
oracle(
    "panel_availability",
    f"""
select a.run_id, panel_group, panel_no, panel, axis_label, trace_no, variable, trace_label, style
from (select distinct run_id, variable from obs) a join {TRACE_VALUES} using (variable)
""",
)
oracle(
    "variable_labels",
    f"""
select a.variable, coalesce(trace_label, a.variable) as label,
       coalesce(case when unit <> '' then concat(trace_label, ' (', unit, ')') else trace_label end, a.variable)
         as legend_label
from (select distinct variable from obs) a left join {TRACE_VALUES} using (variable)
""",
)
oracle(
    "variable_kinds",
    """
select variable, source, source in ('analytical', 'offline') as is_sparse
from (select variable, source, row_number() over (partition by variable order by run_id, source) as rn from obs) o
where rn = 1
""",
)
oracle(
    "trend_series",
    f"""
select o.run_id, panel_no, panel, trace_no, o.variable, trace_label, round(o.elapsed_h, 8) as x, round(o.value, 8) as y
from obs o join {TRACE_VALUES} on o.variable = v.variable order by 1, 2, 4, 7, 8
""",
)
oracle(
    "run_descriptions",
    """
select run_id, concat_ws(' · ', strain, mode, concat(vessel_id, ' (', system, ')'),
                         concat(format('{:g}', volume_L), ' L'), concat(format('{:g}', duration_h), ' h')) as conditions,
       concat_ws(' · ', run_id, strain, mode) as option_label,
       case when anomaly <> '' then concat('Recorded note on this run: ', anomaly, '.') end as note
from runs
""",
)
oracle(
    "sample_listing",
    f"select run_id, sample_id, {ts('draw_time')}, {ts('injection_time')}, operator, notes from samples",
)

# --- time-series joins and grids ---------------------------------------------------------------


def _wide(source: str, *variables: str) -> str:
    means = ", ".join(f"avg(value) filter (where variable = '{v}') as {v}" for v in variables)
    return f"(select run_id, timestamp, min(elapsed_h) as elapsed_h, {means} from obs where source = '{source}' group by 1, 2)"


WIDE = ",\n".join(
    f"{name} as {_wide(source, *variables)}"
    for name, source, variables in (
        ("base", "bioreactor", ("DO", "pH")),
        ("offgas", "offgas", ("offgas_co2", "offgas_o2")),
        ("probe", "capacitance", ("permittivity",)),
        ("peaks", "analytical", ("glucose", "product")),
        ("manual", "offline", ("dcw", "od600")),
    )
)


def _near(name: str, left: str, right: str, columns: str, minutes: int) -> str:
    return f"""
{name} as (
  select run_id, timestamp, matched_time, {columns}
  from (select l.run_id, l.timestamp, r.timestamp as matched_time, {", ".join("r." + c.strip() for c in columns.split(","))},
               row_number() over (partition by l.run_id, l.timestamp
                                  order by abs(epoch_us(l.timestamp) - epoch_us(r.timestamp)), r.timestamp) as rn
        from {left} l join {right} r on l.run_id = r.run_id
         and r.timestamp between l.timestamp - interval {minutes} minute and l.timestamp + interval {minutes} minute) m
  where rn = 1)"""


def _snapped(name: str, samples: str, columns: str, minutes: int) -> str:
    rows = ", ".join("s." + c.strip() for c in columns.split(","))
    return f"""{_near(name + "_place", samples, "base", "timestamp", minutes).replace("matched_time, timestamp", "matched_time", 1).replace("matched_time, r.timestamp,", "matched_time,", 1)},
{name} as (
  select run_id, timestamp, {columns}
  from (select s.run_id, p.matched_time as timestamp, {rows},
               row_number() over (partition by s.run_id, p.matched_time order by s.timestamp) as rn
        from {samples} s join {name}_place p on s.run_id = p.run_id and s.timestamp = p.timestamp) m
  where rn = 1)"""


oracle("pivot_source", f"select run_id, {ts('timestamp')}, round(DO, 8) as DO, round(pH, 8) as pH from base", WIDE)
oracle("run_start", f"select distinct run_id, {ts('start_time')} from obs join runs using (run_id)")
oracle(
    "asof_nearest",
    f"""
select b.run_id, {ts("b.timestamp")}, round(DO, 8) as DO, round(pH, 8) as pH, {ts("matched_time")},
       round(offgas_co2, 8) as offgas_co2, round(offgas_o2, 8) as offgas_o2
from base b left join near using (run_id, timestamp)
""",
    WIDE,
    _near("near", "base", "offgas", "offgas_co2, offgas_o2", 30),
)
oracle(
    "snap_samples",
    f"select run_id, {ts('timestamp')}, round(dcw, 8) as dcw, round(od600, 8) as od600 from snapped",
    WIDE,
    _snapped("snapped", "manual", "dcw, od600", 30),
)


def _aligned(minutes: int) -> list[str]:
    return [
        WIDE,
        _near("near_offgas", "base", "offgas", "offgas_co2, offgas_o2", minutes),
        _near("near_probe", "base", "probe", "permittivity", minutes),
        _snapped("snap_peaks", "peaks", "glucose, product", minutes),
        _snapped("snap_manual", "manual", "dcw, od600", minutes),
        """
aligned as (
  select b.run_id, b.timestamp, b.elapsed_h, DO, pH, offgas_co2, offgas_o2, permittivity, glucose, product, dcw, od600
  from base b left join near_offgas using (run_id, timestamp) left join near_probe using (run_id, timestamp)
       left join snap_peaks using (run_id, timestamp) left join snap_manual using (run_id, timestamp))""",
    ]


_ROUNDED = ", ".join(
    f"round({c}, 8) as {c}"
    for c in ("elapsed_h", "DO", "pH", "offgas_co2", "offgas_o2", "permittivity", "glucose", "product", "dcw", "od600")
)
oracle("align_wide", f"select run_id, {ts('timestamp')}, {_ROUNDED} from aligned", *_aligned(30))
oracle(
    "sensor_correlation",
    """
select run_id, count(*) as n, case when count(*) > 1 then round(corr(permittivity, dcw), 8) end as r
from aligned where permittivity is not null and dcw is not null group by run_id
""",
    *_aligned(120),
)
oracle(
    "missing_reference",
    "select distinct run_id from obs where run_id in ('R2', 'R5')",
)


def _grid(minutes: int, *variables: str) -> list[str]:
    step = minutes * 60
    means = ", ".join(f"avg(value) filter (where variable = '{v}') as {v}" for v in variables)
    again = ", ".join(f"avg({v}) as {v}" for v in variables)
    return [
        f"""
rows_ as (select * from obs where source in ('bioreactor', 'offgas', 'capacitance')
          and variable in ({", ".join(_text(v) for v in variables)})),
ends as (select run_id, epoch(date_trunc('day', min(timestamp)))::bigint as o, epoch(min(timestamp))::bigint as a,
                epoch(max(timestamp))::bigint as z from rows_ group by run_id),
moments as (select run_id, epoch(timestamp)::bigint as s, {means} from rows_ group by 1, 2),
bins as (select run_id, o + (s - o) // {step} * {step} as s, {again}
         from moments join ends using (run_id) group by 1, 2),
grid as (select run_id, unnest(generate_series(o + (a - o) // {step} * {step}, z, {step})) as s from ends)"""
    ]


def _grid_select(*variables: str) -> str:
    return f"""
select g.run_id, strftime(make_timestamp(g.s * 1000000), '%Y-%m-%d %H:%M:%S') as timestamp,
       round((g.s * 1000000 - epoch_us(r.start_time)) / 3.6e9, 8) as elapsed_h,
       {", ".join(f"round({v}, 8) as {v}" for v in variables)}
from grid g join runs r using (run_id) left join bins b on g.run_id = b.run_id and g.s = b.s
"""


_DENSE = ("DO", "pH", "offgas_co2", "permittivity")
oracle("resample_grid", _grid_select(*_DENSE), *_grid(5, *_DENSE))
oracle("resample_grid_uneven", _grid_select("DO"), *_grid(7, "DO"))
oracle(
    "grid_spacing",
    "select run_id, cast(900 as double) as gap_s, count(*) - 1 as readings from grid group by run_id having count(*) > 1",
    *_grid(15, "DO"),
)
oracle(
    "comparable_traces",
    """
select run_id, variable, round(elapsed_h, 8) as elapsed_h, round(value, 8) as value from obs
where variable in ('dcw', 'glucose')
union all
select m.run_id, variable, round((s * 1000000 - epoch_us(start_time)) / 3.6e9, 8), round(avg(value), 8)
from (select run_id, variable, epoch(timestamp)::bigint // 21600 * 21600 as s, avg(value) as value
      from obs where variable in ('DO', 'offgas_co2') group by run_id, variable, timestamp) m
join runs using (run_id) group by run_id, variable, s, start_time
""",
)
oracle(
    "interpolate_at",
    f"""
select m.run_id, {ts("m.timestamp")}, round(dcw, 8) as dcw,
       round(case when b.t is null then a.v when a.t is null or a.t = b.t then b.v
                  else b.v + (a.v - b.v) * ((m.s - b.t) / (a.t - b.t)) end, 8) as interpolated
from (select *, epoch_us(timestamp) / 1e6 as s from manual where dcw is not null) m
asof left join (select run_id, epoch_us(timestamp) / 1e6 as t, DO as v from base) b on m.run_id = b.run_id and m.s >= b.t
asof left join (select run_id, epoch_us(timestamp) / 1e6 as t, DO as v from base) a on m.run_id = a.run_id and m.s <= a.t
""",
    WIDE,
)
oracle(
    "decimate",
    f"""
select run_id, {ts("timestamp")}, round(DO, 8) as DO, round(pH, 8) as pH
from (select *, row_number() over (partition by run_id order by timestamp) as rn from base) b where (rn - 1) % 4 = 0
""",
    WIDE,
)
oracle(
    "export_wide",
    "select "
    + ts("timestamp")
    + ", "
    + ", ".join(
        f"round(avg(value) filter (where vessel_id = 'Vessel_{k}' and variable = '{v}'), 8) as Vessel_{k}_{suffix}"
        for k in (0, 2, 4, 6, 8)
        for suffix, v in (("pH", "pH"), ("DO_pct", "DO"))
    )
    + " from obs join runs using (run_id) where system = 'ambr' and variable in ('pH', 'DO') group by obs.timestamp",
)

# --- cohorts ---------------------------------------------------------------------------------------

COHORTS = """
groups as (
  select system, strain, mode, count(*) as n_runs,
         concat(strain, ' · ', mode, ' (', cast(count(*) as varchar), ' runs)') as label,
         concat(strain, ', ', mode, ', ', system, ' control system') as held_constant
  from runs where strain is not null group by 1, 2, 3)
"""
oracle("cohort_groups", "select * from groups order by n_runs desc, label", COHORTS)
oracle(
    "cohort_members",
    "select run_id, system, strain, mode, n_runs, label from runs join groups using (system, strain, mode)",
    COHORTS,
)
oracle(
    "cohort_of",
    """
select run_id, system, strain, mode, n_runs, held_constant from runs join groups using (system, strain, mode)
where (system, strain, mode) in (select (system, strain, mode) from runs where run_id = 'R1')
""",
    COHORTS,
)
oracle(
    "cohort_outcomes",
    """
select run_id as "Run", vessel_id as "Vessel", duration_h as "Duration (h)",
       round(final_biomass_total_gL, 8) as "Final biomass (g/L)", round(final_product_gL, 8) as "Final product (g/L)",
       anomaly as "Recorded note" from runs
""",
)
oracle(
    "endpoint_leader",
    """
select system, strain, mode, run_id, round(final_biomass_total_gL, 8) as final_biomass_total_gL, anomaly
from (select *, row_number() over (partition by system, strain, mode order by final_biomass_total_gL desc, run_id) as rn
      from runs where strain is not null) r where rn = 1
""",
)
_LATE = """
late as (
  select * from (select o.run_id, o.variable, o.elapsed_h, o.value, r.system, r.strain, r.mode,
                        max(o.elapsed_h) over (partition by r.system, r.strain, r.mode, o.variable) as top
                 from obs o join runs r using (run_id) where r.strain is not null) p
  where elapsed_h >= top / 2),
apart as (
  select a.system, a.strain, a.mode, a.variable, a.run_id, a.mean as highlighted, median(o.value) as cohort_median
  from (select system, strain, mode, variable, run_id, avg(value) as mean from late group by 1, 2, 3, 4, 5) a
  join late o on a.system = o.system and a.strain = o.strain and a.mode = o.mode and a.variable = o.variable
             and a.run_id <> o.run_id
  group by 1, 2, 3, 4, 5, 6)
"""
_APART = """
select system, strain, mode, variable, run_id, round(highlighted, 8) as highlighted,
       round(cohort_median, 8) as cohort_median, round(highlighted - cohort_median, 8) as difference from apart
"""
_LEADERS = """
leaders as (
  select run_id from (select run_id, row_number() over (partition by system, strain, mode
                                                        order by final_biomass_total_gL desc, run_id) as rn
                      from runs where strain is not null) r where rn = 1)
"""
oracle("divergence", f"{_APART} where run_id in (select run_id from leaders)", _LATE, _LEADERS)
oracle("divergence_of_all", _APART, _LATE)

oracle(
    "columns_absent",
    """
select 'observations' as table_name, unnest(['elapsed_h', 'unit']) as column_name, count(*) as n_rows from obs
union all select 'runs', 'strain', count(*) from runs
""",
)
