"""Independent SQL for the queries over texts and numbers of many kinds."""

from __future__ import annotations

REPEATED = "0000-4000-8000-0000000000ab"


def choice(number: str, *values: str) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_RUN = f"lpad(printf('%x', event_id * 2654435761 % 4294967296), 8, '0') || '-{REPEATED}'"
_READINGS = f"""SELECT event_id AS device_id, {choice('event_id', _RUN, _RUN, 'NULL', _RUN, _RUN)} AS run,
 {choice('event_id', "'Well ' || event_id", "'North-Sea b'", 'NULL', "''", "'-- '", "'Ω7é'", "'w' || event_id || ')'")} AS well_name,
 event_id % 5 AS operation, event_id % 4 AS mode,
 {choice('event_id', '0.0', '-0.04', '0.25', '-0.25', 'event_id * 100 + 1234.56', 'event_id * -1000.25', '0.05', '0.0',
         'event_id::DECIMAL(18,4) / 20', '999.95', '-999.94')}::DECIMAL(18,4) AS rate, event_id % 11 = 7 AS minus_zero FROM events"""
_RATE = """CASE WHEN minus_zero OR (rate < 0 AND round(rate, 1) = 0) THEN '-0.0'
 ELSE CASE WHEN rate > 0 THEN '+' ELSE '' END || format('{:,.1f}', round(rate, 1)::DOUBLE) END"""

_SECOND = "date_trunc('second', ts)"
_V = "(event_id % 100000 / 100)::DECIMAL(12,2)::DOUBLE"
_UNITS = f"""SELECT event_id, {choice('event_id', "'m'", "'ft'", "'km'", "'M'", "''", "'ft'", "'m'")} AS depth,
 {choice('event_id // 7', "'gAPI'", "'gAPI'", "'gAPI'", "'GAPI'", "'api'")} AS gr,
 {choice('event_id // 5', "'psi'", "'psi'", "'kPa'", "'psi'")} AS spp, {choice('event_id // 3', "'degC'", "'degC'", "'degF'")} AS temp FROM events"""

VARIED: dict[str, str] = {
    "e7_varied_run_labels": f"SELECT device_id, upper(left(run, 8)) AS run_label FROM ({_READINGS})",
    "d12_varied_status_labels": f"""SELECT device_id, coalesce(upper(left(run, 8)), '—') AS run_label,
 CASE WHEN coalesce(well_name, '') = '' THEN '—' ELSE upper(right(regexp_replace(well_name, '[^a-zA-Z0-9]', '', 'g'), 2)) END AS well_monogram,
 CASE operation WHEN 0 THEN 'Stationary' WHEN 1 THEN 'Drilling ahead' WHEN 2 THEN 'Tripping out' ELSE '—' END AS operation_label,
 CASE mode WHEN 1 THEN 'Historical import' ELSE 'Real-time' END AS acquisition_label,
 CASE mode WHEN 1 THEN 'Imported reading' WHEN 2 THEN 'No data' ELSE 'Live reading' END AS origin_label, {_RATE} AS rate_label FROM ({_READINGS})""",
    "d13_varied_rate_labels": f"SELECT device_id, {_RATE} AS rate_label FROM ({_READINGS})",
    "l9_varied_units": f"""SELECT CAST(event_id AS VARCHAR) AS path, CASE
 WHEN depth NOT IN ('m', 'ft') THEN 'curve DEPT has unsupported unit ''' || depth || ''''
 WHEN gr <> 'gAPI' THEN 'curve GR has unsupported unit ''' || gr || ''''
 WHEN spp <> 'psi' THEN 'curve SPP has unsupported unit ''' || spp || ''''
 WHEN temp <> 'degC' THEN 'curve TEMP has unsupported unit ''' || temp || '''' END AS curve_reason FROM ({_UNITS})""",
    "l11_varied_numbers": f"""SELECT event_id, {choice(
        'event_id', _V, _V, f'-{_V}', f'-{_V}', _V, 'NULL', 'NULL', "('0.' || event_id % 1000)::DOUBLE", '(event_id % 1000)::DOUBLE',
        *['NULL'] * 8)} AS number FROM events""",
    "l14_varied_times": f"""SELECT event_id, {choice(
        'event_id', _SECOND, _SECOND, _SECOND, 'NULL', 'NULL', "date_trunc('minute', ts)", f'{_SECOND} + INTERVAL 500 MILLISECOND',
        _SECOND, *['NULL'] * 5, f'{_SECOND} + INTERVAL 250 MILLISECOND')} AS time FROM events""",
}
