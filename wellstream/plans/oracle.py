"""Independent SQL for the registered queries, in the dialect of DuckDB.

Written from the definitions with plain windows over whole streams; none of the slicing of the Spark
operators appears here.
"""

from __future__ import annotations

from wellstream.plans.oracle_varied import VARIED

CONTENT = """well_id, well_name, wellbore_id, wellbore_name, measured_depth_metres, drilling_operation,
 depth_change_rate_metres_per_hour, pressure_psi, temperature_celsius, gamma_ray_api, timestamp_utc, acquisition_mode"""
READING = f"device_id, acquisition_session_id, sequence_number, {CONTENT}"
ARRIVAL = f"{READING}, received_at_utc, arrival_no"
EVENT = """event_id, event_type, severity, device_id, acquisition_session_id, sequence_number,
 previous_sequence_number, gap_size, message, occurred_at_utc"""
RANGE_OK = "isfinite({0}) AND {0} >= 0"
BLANK = "trim(coalesce({0}, ''), ' ' || chr(9) || chr(160)) = ''"
RATE_OK = """(isfinite(depth_change_rate_metres_per_hour) AND CASE drilling_operation
   WHEN 'Stationary' THEN depth_change_rate_metres_per_hour = 0
   WHEN 'DrillingAhead' THEN depth_change_rate_metres_per_hour > 0
   WHEN 'TrippingOut' THEN depth_change_rate_metres_per_hour < 0 ELSE false END)"""
REASON = f"""CASE WHEN {BLANK.format('device_id')} THEN 'device identifier is empty'
 WHEN {BLANK.format('acquisition_session_id')} OR acquisition_session_id = '00000000-0000-0000-0000-000000000000'
  THEN 'acquisition session is empty'
 WHEN sequence_number <= 0 THEN 'sequence number must be greater than zero'
 WHEN {BLANK.format('well_id')} THEN 'well identifier is empty' WHEN {BLANK.format('well_name')} THEN 'well name is empty'
 WHEN {BLANK.format('wellbore_id')} THEN 'wellbore identifier is empty'
 WHEN {BLANK.format('wellbore_name')} THEN 'wellbore name is empty'
 WHEN NOT ({RANGE_OK.format('measured_depth_metres')}) THEN 'measured depth must be finite and not negative'
 WHEN drilling_operation NOT IN ('Stationary', 'DrillingAhead', 'TrippingOut') THEN 'drilling operation is invalid'
 WHEN NOT {RATE_OK} THEN 'drilling operation and depth-change rate are inconsistent'
 WHEN NOT ({RANGE_OK.format('gamma_ray_api')}) THEN 'gamma ray must be finite and not negative'
 WHEN acquisition_mode NOT IN ('RealTime', 'HistoricalImport') THEN 'acquisition mode is invalid' END"""
SINCE = "TIMESTAMP '2024-01-10 00:00:00'"


def _uuid(text: str) -> str:
    d = f"sha256({text})"
    return "concat_ws('-', " + ", ".join(
        f"substr({d}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    ) + ")"


def _conflict_ctes(name: str, source: str, seconds: int) -> dict[str, tuple[list[str], str]]:
    """Conflicts of all readings in ``source``, each compared with the newest other session of its device."""
    window = seconds * 1_000_000
    return {
        f"{name}observed": ([source], f"""
SELECT device_id, acquisition_session_id AS s, epoch_us(received_at_utc) AS t, arrival_no, received_at_utc,
 lag(epoch_us(received_at_utc)) OVER (PARTITION BY device_id, acquisition_session_id
  ORDER BY received_at_utc, arrival_no) AS own_prev FROM {source}"""),
        f"{name}episodes": ([f"{name}observed"], f"""
SELECT *, sum(CASE WHEN own_prev IS NULL OR t - own_prev > {window} THEN 1 ELSE 0 END)
 OVER (PARTITION BY device_id, s ORDER BY t, arrival_no) AS episode FROM {name}observed"""),
        f"{name}neighbours": ([f"{name}episodes"], f"""
SELECT *, lag(s) OVER d AS ps, lag(t) OVER d AS pt, lag(episode) OVER d AS pe FROM {name}episodes
WINDOW d AS (PARTITION BY device_id ORDER BY t, arrival_no)"""),
        f"{name}others": ([f"{name}neighbours"], f"""
SELECT *, last_value(CASE WHEN ps <> s THEN row(ps, pt, pe) END IGNORE NULLS) OVER (PARTITION BY device_id
 ORDER BY t, arrival_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM {name}neighbours"""),
        f"{name}other_parts": ([f"{name}others"], f"""
SELECT *, struct_extract(o, 1) AS os, struct_extract(o, 2) AS ot, struct_extract(o, 3) AS oe FROM {name}others WHERE o IS NOT NULL"""),
        f"{name}candidates": ([f"{name}other_parts"], f"""
SELECT *, row_number() OVER (PARTITION BY device_id, least(s, os), greatest(s, os),
 CASE WHEN s < os THEN episode ELSE oe END, CASE WHEN s < os THEN oe ELSE episode END ORDER BY t, arrival_no) AS nth
FROM {name}other_parts WHERE t - ot <= {window}"""),
        f"{name}conflicts": ([f"{name}candidates"], f"""
SELECT device_id, os AS existing_session_id, s AS observed_session_id, arrival_no, received_at_utc
FROM {name}candidates WHERE nth = 1"""),
    }


CTES: dict[str, tuple[list[str], str]] = {
    "keyed": ([], """
SELECT event_id, ts, user_id, value, 'DRILL-' || CASE WHEN user_id < 100 THEN lpad(CAST(user_id AS VARCHAR), 3, '0') ELSE CAST(user_id AS VARCHAR) END AS device_id,
 CASE WHEN event_id % 5 < 3 THEN '11111111-1111-4111-8111-111111111111'
      ELSE '22222222-2222-4222-8222-222222222222' END AS acquisition_session_id
FROM events"""),
    "numbered": (["keyed"], """
SELECT *, row_number() OVER (PARTITION BY device_id, acquisition_session_id ORDER BY ts, event_id) AS rn FROM keyed"""),
    "base": (["numbered"], """
SELECT event_id, device_id, acquisition_session_id, rn + rn // 10 AS sequence_number,
 'WELL-' || CAST(user_id % 4 AS VARCHAR) AS well_id, 'Well ' || CAST(user_id % 4 AS VARCHAR) AS well_name,
 'WELL-' || CAST(user_id % 4 AS VARCHAR) || '-MAIN' AS wellbore_id, 'Main' AS wellbore_name,
 CASE WHEN event_id % 29 = 0 THEN -1.0e0 ELSE 1000.0e0 + rn * 0.5e0 END AS measured_depth_metres,
 CASE event_id % 3 WHEN 0 THEN 'Stationary' WHEN 1 THEN 'DrillingAhead' ELSE 'TrippingOut' END AS drilling_operation,
 CASE WHEN event_id % 31 = 0 THEN 7.0e0 WHEN event_id % 3 = 0 THEN 0.0e0 WHEN event_id % 3 = 1 THEN 18.0e0
      ELSE -18.0e0 END AS depth_change_rate_metres_per_hour,
 8000.0e0 + value AS pressure_psi, 100.0e0 + (event_id % 40) * 0.5e0 AS temperature_celsius, value AS gamma_ray_api,
 ts AS timestamp_utc, CASE WHEN event_id % 5 < 3 THEN 'RealTime' ELSE 'HistoricalImport' END AS acquisition_mode,
 ts + (event_id % 90 - 5) * INTERVAL 1 SECOND AS received_at_utc,
 event_id * 10 + CASE WHEN event_id % 11 = 0 THEN 5003 ELSE 0 END AS arrival_no
FROM numbered"""),
    "arrivals": (["base"], f"""
SELECT {ARRIVAL} FROM base
UNION ALL SELECT {ARRIVAL} FROM (SELECT * REPLACE (received_at_utc + INTERVAL 1 HOUR AS received_at_utc,
 arrival_no + 20001 AS arrival_no) FROM base WHERE event_id % 17 = 0)
UNION ALL SELECT {ARRIVAL} FROM (SELECT * REPLACE (received_at_utc + INTERVAL 1 HOUR AS received_at_utc,
 arrival_no + 30002 AS arrival_no, gamma_ray_api + 1 AS gamma_ray_api) FROM base WHERE event_id % 23 = 0)"""),
    "validated": (["arrivals"], f"""
SELECT *, CASE
 WHEN trim(device_id) = '' THEN 'device identifier is empty'
 WHEN acquisition_session_id = '00000000-0000-0000-0000-000000000000' THEN 'acquisition session is empty'
 WHEN sequence_number <= 0 THEN 'sequence number must be greater than zero'
 WHEN trim(well_id) = '' THEN 'well identifier is empty'
 WHEN trim(well_name) = '' THEN 'well name is empty'
 WHEN trim(wellbore_id) = '' THEN 'wellbore identifier is empty'
 WHEN trim(wellbore_name) = '' THEN 'wellbore name is empty'
 WHEN NOT ({RANGE_OK.format('measured_depth_metres')}) THEN 'measured depth must be finite and not negative'
 WHEN drilling_operation NOT IN ('Stationary', 'DrillingAhead', 'TrippingOut') THEN 'drilling operation is invalid'
 WHEN NOT {RATE_OK} THEN 'drilling operation and depth-change rate are inconsistent'
 WHEN NOT ({RANGE_OK.format('gamma_ray_api')}) THEN 'gamma ray must be finite and not negative'
 WHEN acquisition_mode NOT IN ('RealTime', 'HistoricalImport') THEN 'acquisition mode is invalid' END AS reject_reason
FROM arrivals"""),
    "broken": (["arrivals"], """
SELECT * REPLACE (CASE k WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE device_id END AS device_id,
 CASE k WHEN 3 THEN '00000000-0000-0000-0000-000000000000' WHEN 4 THEN '' ELSE acquisition_session_id END AS acquisition_session_id,
 CASE k WHEN 5 THEN 0 WHEN 6 THEN -5 ELSE sequence_number END AS sequence_number,
 CASE k WHEN 7 THEN '' ELSE well_id END AS well_id, CASE k WHEN 8 THEN chr(160) ELSE well_name END AS well_name,
 CASE k WHEN 9 THEN chr(9) ELSE wellbore_id END AS wellbore_id, CASE k WHEN 10 THEN NULL ELSE wellbore_name END AS wellbore_name,
 CASE k WHEN 11 THEN 'NaN'::DOUBLE WHEN 12 THEN 'Infinity'::DOUBLE ELSE measured_depth_metres END AS measured_depth_metres,
 CASE k WHEN 13 THEN 'Sideways' ELSE drilling_operation END AS drilling_operation,
 CASE k WHEN 14 THEN 'NaN'::DOUBLE ELSE depth_change_rate_metres_per_hour END AS depth_change_rate_metres_per_hour,
 CASE k WHEN 15 THEN -1.0e0 WHEN 16 THEN 'NaN'::DOUBLE ELSE gamma_ray_api END AS gamma_ray_api,
 CASE k WHEN 17 THEN 'Sometimes' ELSE acquisition_mode END AS acquisition_mode)
FROM (SELECT *, arrival_no // 10 % 41 AS k FROM arrivals)"""),
    "broken_validated": (["broken"], f"""
SELECT *, {REASON} AS reject_reason
FROM broken"""),
    "readings": (["validated"], f"SELECT {ARRIVAL} FROM validated WHERE reject_reason IS NULL"),
    "rejected": (["validated"], """
SELECT received_at_utc, arrival_no, reject_reason FROM validated WHERE reject_reason IS NOT NULL"""),
    "messages": (["validated"], """
SELECT * REPLACE (
 CASE WHEN arrival_no % 37 = 0 THEN 'invalid json' ELSE reject_reason END AS reject_reason,
 CASE WHEN arrival_no % 13 = 0 THEN 'RealTime' ELSE acquisition_mode END AS acquisition_mode) FROM validated"""),
    "copies": (["readings"], f"""
SELECT *, row_number() OVER k AS copy_no, first_value(row({CONTENT})) OVER k AS first_content FROM readings
WINDOW k AS (PARTITION BY device_id, acquisition_session_id, sequence_number ORDER BY arrival_no)"""),
    "statused": (["copies"], f"""
SELECT {ARRIVAL}, CASE WHEN copy_no = 1 THEN 'Stored' WHEN row({CONTENT}) = first_content THEN 'Duplicate'
 ELSE 'Conflict' END AS store_status FROM copies"""),
    "stored": (["statused"], f"SELECT {ARRIVAL} FROM statused WHERE store_status = 'Stored'"),
    "sequenced": (["stored"], """
SELECT *, max(sequence_number) OVER (PARTITION BY device_id, acquisition_session_id ORDER BY arrival_no
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_sequence FROM stored"""),
    "processed": (["statused", "sequenced"], f"""
SELECT {', '.join('s.' + c.strip() for c in ARRIVAL.split(','))}, s.store_status, q.previous_sequence,
 CASE WHEN s.store_status <> 'Stored' THEN NULL WHEN q.previous_sequence IS NULL THEN 'Baseline'
  WHEN s.sequence_number = q.previous_sequence + 1 THEN 'InOrder' WHEN s.sequence_number > q.previous_sequence THEN 'Gap'
  WHEN s.sequence_number < q.previous_sequence THEN 'OutOfOrder' ELSE 'Duplicate' END AS sequence_status,
 CASE WHEN s.sequence_number > q.previous_sequence + 1 THEN s.sequence_number - q.previous_sequence - 1 END AS gap_size,
 CASE WHEN s.store_status <> 'Stored' THEN s.store_status WHEN s.sequence_number < q.previous_sequence THEN 'LateArrival'
  ELSE 'Published' END AS outcome
FROM statused s LEFT JOIN sequenced q ON s.arrival_no = q.arrival_no"""),
    "published": (["processed"], """
SELECT *, CASE WHEN epoch_us(received_at_utc) >= epoch_us(timestamp_utc)
 THEN epoch_us(received_at_utc) - epoch_us(timestamp_utc) END AS latency_us FROM processed WHERE outcome = 'Published'"""),
    "bursts": (["keyed"], """
SELECT device_id, lpad(CAST(user_id AS VARCHAR), 8, '0') || '-0000-4000-8000-00000000000' || (event_id * 7 // 3) % 4 AS acquisition_session_id,
 make_timestamp(1704067200000000 + ((rn - CASE WHEN rn % 13 = 0 THEN 1 ELSE 0 END) * 11 + rn // 9 * 40 + rn // 40 * 25) * 1000000) AS received_at_utc,
 event_id AS arrival_no FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS rn FROM keyed)"""),
    **_conflict_ctes("", "stored", 12 * 3600),
    **_conflict_ctes("burst_", "bursts", 30),
    "event_rows": (["processed", "rejected", "conflicts"], """
SELECT CASE outcome WHEN 'Duplicate' THEN 'DuplicateReading' WHEN 'Conflict' THEN 'ConflictingReading'
  ELSE CASE sequence_status WHEN 'Gap' THEN 'SequenceGap' ELSE 'OutOfOrderReading' END END AS event_type,
 CASE outcome WHEN 'Conflict' THEN 'Critical' ELSE 'Warning' END AS severity,
 device_id, acquisition_session_id, sequence_number,
 CASE outcome WHEN 'Duplicate' THEN sequence_number WHEN 'Conflict' THEN NULL ELSE previous_sequence END
  AS previous_sequence_number, gap_size,
 CASE outcome WHEN 'Duplicate' THEN 'An identical reading was ignored.'
  WHEN 'Conflict' THEN 'The sequence identity was reused with different telemetry content.'
  ELSE CASE sequence_status WHEN 'Gap' THEN printf('%d sequence positions were skipped after %d.', gap_size, previous_sequence)
   ELSE printf('Sequence %d arrived after sequence %d had already been observed.', sequence_number, previous_sequence) END END
  AS message, received_at_utc AS occurred_at_utc, arrival_no, 1 AS event_rank
FROM processed WHERE outcome IN ('Duplicate', 'Conflict') OR sequence_status IN ('Gap', 'OutOfOrder')
UNION ALL SELECT 'InvalidMessage', 'Warning', NULL, NULL, NULL, NULL, NULL,
 'An invalid telemetry message was rejected and sent to the dead-letter queue.', received_at_utc, arrival_no, 1 FROM rejected
UNION ALL SELECT 'ConcurrentAcquisitionSessions', 'Warning', device_id, observed_session_id, NULL, NULL, NULL,
 device_id || ' is receiving telemetry from two active acquisition runs. Existing run '
  || upper(substr(existing_session_id, 1, 8)) || ', newly observed run ' || upper(substr(observed_session_id, 1, 8)) || '.',
 received_at_utc, arrival_no, 0 FROM conflicts"""),
    "event_stream": (["event_rows"], f"""
SELECT {_uuid("event_type || '|' || CAST(arrival_no AS VARCHAR)")} AS event_id, * FROM event_rows"""),
    "baseline": (["readings"], "SELECT * FROM readings WHERE arrival_no % 10 IN (0, 3)"),
    "incoming": (["readings"], "SELECT * FROM readings WHERE arrival_no % 10 NOT IN (0, 3)"),
    "table_before": (["baseline"], f"""
SELECT {ARRIVAL} FROM (SELECT *, row_number() OVER (PARTITION BY device_id, acquisition_session_id, sequence_number
 ORDER BY arrival_no) AS k FROM baseline) WHERE k = 1 AND sequence_number % 4 <> 0"""),
    "merged": (["baseline", "incoming"], f"""
SELECT {ARRIVAL} FROM (SELECT *, row_number() OVER (PARTITION BY device_id, acquisition_session_id, sequence_number
 ORDER BY source DESC, arrival_no DESC) AS k FROM (SELECT *, 0 AS source FROM baseline UNION ALL SELECT *, 1 FROM incoming))
WHERE k = 1"""),
    "pinned": (["numbered"], """
SELECT device_id, CASE WHEN CAST(substr(device_id, 7) AS BIGINT) % 10 = 3 THEN '33333333-3333-4333-8333-333333333333'
 ELSE acquisition_session_id END AS pinned_session_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id
 ORDER BY ts, event_id) AS k FROM numbered) WHERE k = 1"""),
    "ranked": (["merged"], """
SELECT *, epoch_us(timestamp_utc) // 1000 AS ms, row_number() OVER (PARTITION BY device_id ORDER BY epoch_us(timestamp_utc) // 1000 DESC,
  sequence_number DESC, acquisition_session_id DESC) AS newest,
 row_number() OVER (PARTITION BY device_id, acquisition_session_id ORDER BY epoch_us(timestamp_utc) // 1000 DESC,
  sequence_number DESC) AS newest_in_session FROM merged"""),
    "active": (["ranked", "pinned"], """
SELECT l.device_id, CASE WHEN p.ms IS NULL OR l.ms - p.ms > 30000 THEN l.acquisition_session_id
 ELSE p.acquisition_session_id END AS acquisition_session_id
FROM (SELECT * FROM ranked WHERE newest = 1) l LEFT JOIN (SELECT r.* FROM ranked r JOIN pinned n ON r.device_id = n.device_id
 AND r.acquisition_session_id = n.pinned_session_id WHERE newest_in_session = 1) p ON l.device_id = p.device_id"""),
    "displayed": (["ranked", "active"], """
SELECT r.* FROM ranked r JOIN active a ON r.device_id = a.device_id AND r.acquisition_session_id = a.acquisition_session_id
WHERE r.newest_in_session <= 100"""),
    "latest": (["displayed"], "SELECT * FROM displayed WHERE newest_in_session = 1"),
    "events_merged": (["event_stream"], f"""
SELECT {EVENT} FROM (SELECT * FROM event_stream ORDER BY epoch_us(occurred_at_utc) // 1000 DESC, event_id DESC LIMIT 20)"""),
    "docs": (["keyed"], """
SELECT path, device_id, d, malformed, CASE WHEN NOT malformed THEN xmlns END AS xmlns, CASE WHEN NOT malformed THEN version END AS version, known,
 CASE WHEN malformed OR other THEN 0 ELSE log_count END AS log_count, CASE WHEN known THEN 'W-' || d END AS uid_well,
 CASE WHEN known THEN 'Well & ' || d END AS name_well, CASE WHEN known THEN CASE WHEN d % 71 = 9 THEN '' ELSE 'WB-1' END END AS uid_wellbore,
 CASE WHEN known AND d % 71 <> 13 THEN 'Main  bore' END AS name_wellbore, CASE WHEN known THEN 'LOG-' || d END AS uid,
 CASE WHEN known THEN '' END AS name,
 CASE WHEN known THEN CASE WHEN d % 53 = 1 THEN 'date time' ELSE 'measured depth' END END AS index_type,
 CASE WHEN known THEN 'DEPT' END AS index_curve, CASE WHEN known THEN d % 89 <> 35 OR d % 3 = 0 END AS has_log_data,
 CASE WHEN d % 37 = 5 THEN 'km' WHEN d % 5 = 1 THEN 'ft' ELSE 'm' END AS unit,
 CASE WHEN known AND d % 89 <> 35 AND d % 79 <> 30 THEN CASE WHEN d % 43 = 3 THEN 'DEPT, DTIM, GR, SPP' WHEN d % 61 = 6 THEN 'DEPT,DTIM,GR,SPP,TEMP,GR'
  WHEN d % 3 = 1 THEN 'GR,SPP,TEMP,DEPT,DTIM' ELSE 'DEPT,DTIM,GR,SPP,TEMP' END END AS mnemonic_list,
 CASE WHEN known AND d % 89 <> 35 THEN CASE WHEN d % 43 = 3 THEN unit || ',,gAPI,psi' WHEN d % 61 = 6 THEN unit || ',,gAPI,psi,degC,gAPI'
  WHEN d % 47 = 2 THEN 'm,,gAPI' WHEN d % 3 = 1 THEN 'gAPI, psi, degC,' || unit || ','
  ELSE unit || ',,gAPI,psi,degC' END END AS unit_list
FROM (SELECT *, NOT malformed AND NOT other AND log_count > 0 AS known FROM (
 SELECT 'logs/' || device_id || '.xml' AS path, device_id, d, d % 61 = 12 AS malformed, d % 73 = 20 AS other,
 CASE WHEN d % 73 = 20 THEN 'http://www.witsml.org/schemas/131' ELSE 'http://www.witsml.org/schemas/1series' END AS xmlns,
 CASE WHEN d % 59 = 4 THEN '1.3.1.1' ELSE '1.4.1.1' END AS version,
 CASE WHEN d % 67 = 25 THEN 0 ELSE 1 END + CASE WHEN d % 67 = 8 THEN 1 ELSE 0 END AS log_count
 FROM (SELECT device_id, CAST(substr(device_id, 7) AS BIGINT) AS d FROM (SELECT DISTINCT device_id FROM keyed))))"""),
    "doc_lists": (["docs"], """
SELECT *, list_transform(string_split(mnemonic_list, ','), lambda x: trim(x)) AS mnemonics,
 list_transform(string_split(unit_list, ','), lambda x: trim(x)) AS units FROM docs"""),
    "known_docs": (["docs"], "SELECT * FROM docs WHERE known"),
    "doc_curves": (["known_docs"], """
SELECT path, 'DEPT' AS mnemonic, unit, '-999.25' AS null_value FROM known_docs
UNION ALL SELECT path, 'DTIM', '', '' FROM known_docs UNION ALL SELECT path, 'GR', 'gAPI', '-999.25' FROM known_docs
UNION ALL SELECT path, 'SPP', 'psi', '' FROM known_docs WHERE d % 41 <> 7 UNION ALL SELECT path, 'TEMP', 'degC', '' FROM known_docs"""),
    "doc_places": (["doc_lists"], "SELECT *, " + ", ".join(
        f"len(mnemonics) + 1 - nullif(coalesce(list_position(list_reverse(mnemonics), '{c}'), 0), 0) AS {n}_at"
        for n, c in (("depth", "DEPT"), ("dtim", "DTIM"), ("gr", "GR"), ("spp", "SPP"), ("temp", "TEMP"))
    ) + " FROM doc_lists"),
    "doc_structure": (["doc_places"], """
SELECT *, CASE WHEN malformed THEN 'invalid XML' WHEN d % 73 = 20 THEN 'root element is not in the log namespace'
 WHEN version <> '1.4.1.1' THEN 'unsupported version, expected 1.4.1.1, found ' || version
 WHEN log_count = 0 THEN 'no log element' WHEN log_count > 1 THEN 'only one log per document, found ' || log_count
 WHEN uid_wellbore = '' THEN 'required attribute ''uidWellbore'' is missing'
 WHEN name_wellbore IS NULL THEN 'required element ''nameWellbore'' is missing'
 WHEN index_type <> 'measured depth' THEN 'unsupported index type ''' || index_type || ''''
 WHEN NOT has_log_data THEN 'required element ''logData'' is missing'
 WHEN mnemonic_list IS NULL THEN 'required element ''mnemonicList'' is missing'
 WHEN len(mnemonics) <> len(units) THEN len(mnemonics) || ' columns in the mnemonic list but ' || len(units) ||
  ' in the unit list' END AS structure_reason FROM doc_places"""),
    "resolved": (["doc_structure"], """
SELECT *, units[depth_at] AS depth_unit, CASE WHEN structure_reason IS NOT NULL THEN NULL
 WHEN depth_at IS NULL THEN 'index curve DEPT is not in the mnemonic list'
 WHEN dtim_at IS NULL THEN 'required mnemonic DTIM is not in the mnemonic list'
 WHEN gr_at IS NULL THEN 'required mnemonic GR is not in the mnemonic list'
 WHEN spp_at IS NULL THEN 'required mnemonic SPP is not in the mnemonic list'
 WHEN temp_at IS NULL THEN 'required mnemonic TEMP is not in the mnemonic list'
 WHEN d % 41 = 7 THEN 'required mnemonic SPP has no curve info'
 WHEN units[depth_at] NOT IN ('m', 'ft') THEN 'curve DEPT has unsupported unit ''' || units[depth_at] || ''''
 WHEN units[gr_at] <> 'gAPI' THEN 'curve GR has unsupported unit ''' || units[gr_at] || ''''
 WHEN units[spp_at] <> 'psi' THEN 'curve SPP has unsupported unit ''' || units[spp_at] || ''''
 WHEN units[temp_at] <> 'degC' THEN 'curve TEMP has unsupported unit ''' || units[temp_at] || '''' END AS curve_reason
FROM doc_structure"""),
    "raw_lines": (["keyed"], """
SELECT 'logs/' || device_id || '.xml' AS path, line_no, CASE
 WHEN d % 43 = 3 THEN concat_ws(',', depth, tm, gamma, pressure)
 WHEN d % 61 = 6 THEN concat_ws(',', depth, tm, gamma, pressure, temp, CAST(CAST(value AS DECIMAL(12,2)) + 1 AS VARCHAR))
 WHEN d % 3 = 1 THEN concat_ws(',', gamma, pressure, temp, depth, tm)
 ELSE concat_ws(',', depth, tm, gamma, pressure, temp) END || CASE WHEN event_id % 797 = 0 THEN ',1' ELSE '' END AS line
FROM (SELECT *, CASE WHEN event_id % 499 = 0 THEN '-999.25'
  ELSE CAST(1000.0e0 + line_no * 0.5e0 - (event_id % 7) * 0.25e0 AS VARCHAR) END AS depth,
 CASE WHEN event_id % 401 = 0 THEN '' WHEN event_id % 907 = 0 THEN '2023-12-01T00:00:00Z'
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS tm,
 CASE WHEN event_id % 601 = 0 THEN '12e3' WHEN event_id % 701 = 0 THEN '-0.5'
  ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS gamma,
 CAST(8000 + event_id % 500 AS VARCHAR) || CASE WHEN event_id % 13 = 0 THEN ' ' ELSE '' END AS pressure,
 CAST(100.0e0 + (event_id % 40) * 0.5e0 AS VARCHAR) AS temp
 FROM (SELECT *, CAST(substr(device_id, 7) AS BIGINT) AS d,
  row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id) AS line_no FROM keyed))"""),
    "lines": (["resolved", "raw_lines"], """
SELECT l.*, r.device_id, r.uid_well, r.name_well, r.uid_wellbore, r.name_wellbore, r.depth_unit, r.curve_reason,
 len(r.mnemonics) AS columns, f, f[depth_at] AS depth_text, f[dtim_at] AS dtim_text, f[gr_at] AS gr_text,
 f[spp_at] AS spp_text, f[temp_at] AS temp_text
FROM (SELECT *, list_transform(string_split(line, ','), lambda x: trim(x)) AS f FROM raw_lines) l
JOIN resolved r ON l.path = r.path WHERE r.structure_reason IS NULL"""),
    "parsed": (["lines"], "SELECT *, " + ", ".join(
        rf"CASE WHEN regexp_matches({n}_text, '^([+-]?(\d+\.?\d*|\.\d+))$') THEN TRY_CAST({n}_text AS DOUBLE) END AS {n}"
        for n in ("depth", "gr", "spp", "temp")
    ) + ", TRY_CAST(rtrim(dtim_text, 'Z') AS TIMESTAMP) AS dtim FROM lines"),
    "metred": (["parsed"], """
SELECT *, CASE WHEN depth_unit = 'ft' THEN depth * 0.3048e0 ELSE depth END AS depth_metres FROM parsed"""),
    "chained": (["metred"], """
SELECT *, lag(depth_metres) OVER p AS previous_depth, lag(dtim) OVER p AS previous_time FROM metred
WINDOW p AS (PARTITION BY path ORDER BY line_no)"""),
    "mapped": (["chained"], """
SELECT *, CASE WHEN len(f) <> columns THEN 2 WHEN curve_reason IS NOT NULL THEN 3 WHEN value_reason IS NOT NULL THEN 4 END AS stage,
 CASE WHEN len(f) <> columns THEN len(f) || ' fields but ' || columns || ' columns'
  WHEN curve_reason IS NOT NULL THEN curve_reason ELSE value_reason END AS reason
FROM (SELECT *, coalesce((depth_metres - previous_depth) / ((epoch_us(dtim) - epoch_us(previous_time)) / 3.6e9), 0.0e0) AS rate,
 CASE WHEN depth_text = '' THEN 'DEPT has an empty value' WHEN depth_text = '-999.25' THEN 'DEPT uses the null value ''-999.25'''
  WHEN depth IS NULL THEN 'DEPT is not a valid number' WHEN depth < 0 THEN 'DEPT is negative'
  WHEN dtim_text = '' THEN 'DTIM has an empty value' WHEN dtim IS NULL THEN 'DTIM is not an ISO 8601 time with offset'
  WHEN gr_text = '' THEN 'GR has an empty value' WHEN gr_text = '-999.25' THEN 'GR uses the null value ''-999.25'''
  WHEN gr IS NULL THEN 'GR is not a valid number' WHEN gr < 0 THEN 'GR is negative'
  WHEN spp_text = '' THEN 'SPP has an empty value' WHEN spp IS NULL THEN 'SPP is not a valid number'
  WHEN temp_text = '' THEN 'TEMP has an empty value' WHEN temp IS NULL THEN 'TEMP is not a valid number'
  WHEN dtim <= previous_time THEN 'time is not later than that of the previous line' END AS value_reason FROM chained)"""),
    "import_rejects": (["mapped", "resolved"], """
SELECT path, line_no, reason FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, stage, line_no) AS nth FROM (
 SELECT path, 0 AS rank, stage, CASE WHEN stage <> 3 THEN line_no END AS line_no,
  CASE WHEN stage = 3 THEN reason ELSE 'Data line ' || line_no || ': ' || reason END AS reason FROM mapped WHERE stage IS NOT NULL
 UNION ALL SELECT path, 1, 1, NULL, coalesce(structure_reason, curve_reason) FROM resolved
  WHERE structure_reason IS NOT NULL OR curve_reason IS NOT NULL)) WHERE nth = 1"""),
}


def sql(body: str, *needs: str) -> str:
    """``body`` behind the common table expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in CTES[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in ordered) + "\n" + body


def _events_of(event_type: str) -> str:
    return sql(f"SELECT {EVENT} FROM event_stream WHERE event_type = '{event_type}'", "event_stream")


TIME_PARTS = "epoch_us(received_at_utc)"
_PUBLIC = READING
_MAPPED = "path, line_no"

LABELS = """
SELECT device_id, upper(substr(replace(acquisition_session_id, '-', ''), 1, 8)) AS run_label,
 upper(right(regexp_replace(well_name, '[^a-zA-Z0-9]', '', 'g'), 2)) AS well_monogram,
 CASE drilling_operation WHEN 'Stationary' THEN 'Stationary' WHEN 'DrillingAhead' THEN 'Drilling ahead'
  WHEN 'TrippingOut' THEN 'Tripping out' ELSE '—' END AS operation_label,
 CASE acquisition_mode WHEN 'HistoricalImport' THEN 'Historical import' ELSE 'Real-time' END AS acquisition_label,
 CASE acquisition_mode WHEN 'HistoricalImport' THEN 'Imported reading' ELSE 'Latest reading' END AS origin_label,
 CASE WHEN depth_change_rate_metres_per_hour > 0 THEN '+' ELSE '' END
  || printf('%.1f', depth_change_rate_metres_per_hour) AS rate_label FROM latest"""

CARDS = """
SELECT event_id, CASE event_type WHEN 'DuplicateReading' THEN 'Duplicate reading ignored'
  WHEN 'ConflictingReading' THEN 'Conflicting telemetry detected' WHEN 'SequenceGap' THEN 'Sequence gap detected'
  WHEN 'OutOfOrderReading' THEN 'Out-of-order reading received' WHEN 'InvalidMessage' THEN 'Invalid message rejected'
  ELSE 'Concurrent acquisition sessions detected' END AS title,
 CASE WHEN event_type = 'ConcurrentAcquisitionSessions' OR device_id IS NULL THEN message
  ELSE device_id || ' · sequence ' || CAST(sequence_number AS VARCHAR) || ' · ' || message END AS description,
 CASE severity WHEN 'Critical' THEN '×' ELSE '!' END AS icon FROM event_stream"""

LEGACY = {
    1: ["pressure_psi", "temperature_celsius", "timestamp_utc"],
    2: ["well_id", "wellbore_id", "measured_depth_metres"],
    3: ["drilling_operation", "depth_change_rate_metres_per_hour"],
    4: ["gamma_ray_api"],
    5: ["well_name", "wellbore_name"],
}
FILLED = {
    "well_id": "'LEGACY-WELL'", "wellbore_id": "'LEGACY-WELLBORE'", "measured_depth_metres": "0.0e0",
    "drilling_operation": "'Stationary'", "depth_change_rate_metres_per_hour": "0.0e0", "gamma_ray_api": "0.0e0",
    "acquisition_mode": "'RealTime'",
}


def _upgraded(version: int) -> str:
    """Readings as they look after the upgrade of a table of the given version."""
    kept = {c for v, cs in LEGACY.items() if v <= version for c in cs}
    values = {c.strip(): c.strip() for c in ARRIVAL.split(",")}
    for column, value in FILLED.items():
        if column not in kept:
            values[column] = value
    if "well_name" not in kept:
        well = "well_id" if "well_id" in kept else FILLED["well_id"]
        bore = "wellbore_id" if "wellbore_id" in kept else FILLED["wellbore_id"]
        values["well_name"] = f"'Legacy well (' || {well} || ')'"
        values["wellbore_name"] = f"'Legacy wellbore (' || {bore} || ')'"
    columns = ", ".join(f"{v} AS {c}" for c, v in values.items())
    return sql(f"SELECT {columns}, {values['gamma_ray_api']} AS payload_gamma_ray_api, "
               f"{values['well_name']} AS payload_well_name, {values['acquisition_mode']} AS payload_acquisition_mode "
               "FROM stored", "stored")


def _mixed() -> str:
    """Broken readings as files of six versions hold them, upgraded."""
    parts = []
    for version in range(1, 7):
        kept = {c for v, cs in LEGACY.items() if v <= version for c in cs} | ({"acquisition_mode"} if version == 6 else set())
        values = {c.strip(): c.strip() for c in ARRIVAL.split(",")}
        for column, value in FILLED.items():
            values[column] = f"coalesce({column}, {value})" if column in kept else value
        for name in ("well", "wellbore"):
            legacy = f"'Legacy {name} (' || {values[f'{name}_id']} || ')'"
            values[f"{name}_name"] = f"coalesce(nullif({name}_name, ''), {legacy})" if f"{name}_name" in kept else legacy
        parts.append(f"SELECT {', '.join(f'{v} AS {c}' for c, v in values.items())}, {version} AS from_version "
                     f"FROM broken WHERE arrival_no // 10 % 6 = {version - 1}")
    return f"SELECT *, {REASON} AS reject_reason FROM ({' UNION ALL '.join(parts)})"


def _audit(table: str, source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{name}' AS constraint_name, count(*) AS rows, "
        f"count(*) FILTER (WHERE NOT ({ok})) AS violations FROM {source}" for name, ok in rules.items()
    )


READING_RULES = {
    "sequence_number": "sequence_number > 0",
    "measured_depth": RANGE_OK.format("measured_depth_metres"),
    "drilling_operation": "drilling_operation IN ('Stationary', 'DrillingAhead', 'TrippingOut')",
    "depth_change_rate": RATE_OK,
    "gamma_ray_api": RANGE_OK.format("gamma_ray_api"),
    "acquisition_mode": "acquisition_mode IN ('RealTime', 'HistoricalImport')",
}
BROKEN_RULES = {name: f"coalesce({ok}, false)" for name, ok in READING_RULES.items()}
EVENT_RULES = {c: f"{c} IS NULL OR {c} > 0" for c in ("sequence_number", "gap_size")}

ORACLES: dict[str, str] = {
    "s1_ingest_messages": sql(f"SELECT {ARRIVAL} FROM messages WHERE reject_reason IS NULL", "messages"),
    "s2_dead_letters": sql("SELECT arrival_no, received_at_utc, reject_reason FROM messages WHERE reject_reason IS NOT NULL",
                           "messages"),
    "s3_store_status": sql(f"""SELECT i.device_id, i.acquisition_session_id, i.sequence_number, i.arrival_no,
 CASE WHEN t.device_id IS NOT NULL THEN CASE WHEN row({', '.join('i.' + c.strip() for c in CONTENT.split(','))}) =
  row({', '.join('t.' + c.strip() for c in CONTENT.split(','))}) THEN 'Duplicate' ELSE 'Conflict' END
 WHEN k = 1 THEN 'Stored' WHEN row({', '.join('i.' + c.strip() for c in CONTENT.split(','))}) = first_content THEN 'Duplicate'
 ELSE 'Conflict' END AS store_status
FROM (SELECT *, row_number() OVER w AS k, first_value(row({CONTENT})) OVER w AS first_content FROM incoming
 WINDOW w AS (PARTITION BY device_id, acquisition_session_id, sequence_number ORDER BY arrival_no)) i
LEFT JOIN table_before t ON i.device_id = t.device_id AND i.acquisition_session_id = t.acquisition_session_id
 AND i.sequence_number = t.sequence_number""", "incoming", "table_before"),
    "s3_insert_if_absent": sql(f"""SELECT {ARRIVAL} FROM (SELECT *, row_number() OVER (PARTITION BY device_id,
 acquisition_session_id, sequence_number ORDER BY arrival_no) AS k FROM incoming i) i WHERE k = 1 AND NOT EXISTS
 (SELECT 1 FROM table_before t WHERE i.device_id = t.device_id AND i.acquisition_session_id = t.acquisition_session_id
 AND i.sequence_number = t.sequence_number)""", "incoming", "table_before"),
    "s5_published_readings": sql(f"SELECT {ARRIVAL} FROM published", "published"),
    "s6_readings_scan": sql(f"SELECT {ARRIVAL} FROM arrivals", "arrivals"),
    "s8_reading_response": sql(f"SELECT {_PUBLIC} FROM stored", "stored"),
    "s8_event_response": sql(f"SELECT {EVENT} FROM event_stream", "event_stream"),
    "v1_validate": sql("SELECT arrival_no, reject_reason FROM validated", "validated"),
    "s4_insert_events": sql(f"""SELECT {EVENT} FROM event_stream WHERE arrival_no % 3 <> 0
 AND event_type IN ('DuplicateReading', 'ConflictingReading', 'SequenceGap', 'OutOfOrderReading')""", "event_stream"),
    "v1_broken_readings": sql("SELECT arrival_no, reject_reason FROM broken_validated", "broken_validated"),
    "v1_reason_counts": sql("SELECT reject_reason, count(*) AS readings FROM validated GROUP BY reject_reason", "validated"),
    "v2_rate_consistency": sql(f"SELECT arrival_no, drilling_operation, {RATE_OK} AS consistent FROM arrivals", "arrivals"),
    "v3_constraint_report": sql(_audit("readings", "arrivals", READING_RULES) + " UNION ALL " +
                                _audit("events", "event_stream", EVENT_RULES), "arrivals", "event_stream"),
    "v3_violations": sql("SELECT arrival_no, broken FROM (SELECT arrival_no, concat_ws(',', " + ", ".join(
        f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in READING_RULES.items()) +
        ") AS broken FROM arrivals) WHERE broken <> ''", "arrivals"),
    "v3_broken_report": sql(_audit("readings", "broken", BROKEN_RULES) + " UNION ALL " + _audit("events", """(SELECT
 CASE WHEN event_id % 5 <> 0 THEN event_id % 7 - 1 END AS sequence_number, CASE WHEN event_id % 3 = 0 THEN event_id % 4 END AS gap_size
 FROM events)""", EVENT_RULES), "broken"),
    "v3_broken_violations": sql("SELECT arrival_no, broken FROM (SELECT arrival_no, concat_ws(',', " + ", ".join(
        f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in BROKEN_RULES.items()) +
        ") AS broken FROM broken) WHERE broken <> ''", "broken"),
    "v3_repeated_keys": sql("""SELECT device_id, acquisition_session_id, sequence_number, count(*) AS rows FROM readings
GROUP BY ALL HAVING count(*) > 1""", "readings"),
    "v4_defaults": sql("SELECT arrival_no, acquisition_mode FROM messages WHERE arrival_no % 37 <> 0", "messages"),
    "o1_stream_partitions": sql("""SELECT device_id, acquisition_session_id, count(*) AS readings, 1 AS partitions_used
FROM readings GROUP BY ALL""", "readings"),
    "o2_store_status": sql("SELECT arrival_no, store_status FROM statused", "statused"),
    "o3_same_content": sql("""SELECT device_id, acquisition_session_id, sequence_number,
 count(*) FILTER (WHERE store_status = 'Duplicate') AS equal_copies,
 count(*) FILTER (WHERE store_status = 'Conflict') AS different_copies FROM statused GROUP BY ALL HAVING count(*) > 1""",
                           "statused"),
    "o4_sequence_status": sql("""SELECT arrival_no, previous_sequence, sequence_status, gap_size FROM processed
WHERE store_status = 'Stored'""", "processed"),
    # every arrival, copies too: the running maximum of the stream before it
    "o4_sequence_status_in_slices": sql("""SELECT arrival_no, previous_sequence, CASE WHEN previous_sequence IS NULL THEN 'Baseline'
 WHEN sequence_number = previous_sequence + 1 THEN 'InOrder' WHEN sequence_number > previous_sequence THEN 'Gap'
 WHEN sequence_number < previous_sequence THEN 'OutOfOrder' ELSE 'Duplicate' END AS sequence_status,
 CASE WHEN sequence_number > previous_sequence + 1 THEN sequence_number - previous_sequence - 1 END AS gap_size
FROM (SELECT *, max(sequence_number) OVER (PARTITION BY device_id, acquisition_session_id ORDER BY arrival_no
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_sequence FROM validated WHERE reject_reason IS NULL)""", "validated"),
    "o5_outcome": sql(f"""SELECT {ARRIVAL}, store_status, previous_sequence, sequence_status, gap_size, outcome
FROM processed""", "processed"),
    "o10_micro_batches": sql(f"""SELECT {ARRIVAL}, store_status, previous_sequence, sequence_status, gap_size, outcome
FROM processed""", "processed"),
    "o6_live_stream": sql(f"SELECT {ARRIVAL} FROM published", "published"),
    "o7_session_conflicts": sql("SELECT * FROM conflicts", "conflicts"),
    "o7_conflicts_at_30_seconds": sql("SELECT * FROM burst_conflicts", "burst_conflicts"),
    "o8_pairs_at_30_seconds": sql("""SELECT device_id, least(existing_session_id, observed_session_id) AS first,
 greatest(existing_session_id, observed_session_id) AS second, count(*) AS conflicts FROM burst_conflicts GROUP BY ALL""", "burst_conflicts"),
    "o8_session_pairs": sql("""SELECT device_id, least(existing_session_id, observed_session_id) AS first,
 greatest(existing_session_id, observed_session_id) AS second, count(*) AS conflicts FROM conflicts GROUP BY ALL""", "conflicts"),
    "o9_late_arrivals": sql("""SELECT arrival_no, sequence_number, previous_sequence - sequence_number AS sequences_late
FROM processed WHERE outcome = 'LateArrival'""", "processed"),
    "e1_duplicate_events": _events_of("DuplicateReading"),
    "e2_conflict_events": _events_of("ConflictingReading"),
    "e3_gap_events": _events_of("SequenceGap"),
    "e4_out_of_order_events": _events_of("OutOfOrderReading"),
    "e5_invalid_message_events": _events_of("InvalidMessage"),
    "e6_concurrent_session_events": _events_of("ConcurrentAcquisitionSessions"),
    "e7_run_labels": sql("""SELECT acquisition_session_id, upper(substr(replace(acquisition_session_id, '-', ''), 1, 8)) AS run_label,
 count(*) AS readings FROM stored GROUP BY ALL""", "stored"),
    "e8_event_stream": sql(f"SELECT {EVENT}, arrival_no, event_rank FROM event_stream", "event_stream"),
    "m1_counters": sql("""SELECT count(*) FILTER (WHERE outcome = 'Published') AS processed,
 count(*) FILTER (WHERE sequence_status = 'Gap') AS gaps, count(*) FILTER (WHERE outcome = 'Duplicate') AS duplicates,
 count(*) FILTER (WHERE outcome = 'Conflict') AS conflicts, count(*) FILTER (WHERE outcome = 'LateArrival') AS out_of_order,
 (SELECT count(*) FROM rejected) AS invalid FROM processed""", "processed", "rejected"),
    "m1_outcome_counts": sql("""SELECT outcome, sequence_status, count(*) AS readings FROM processed
GROUP BY outcome, sequence_status""", "processed"),
    "m2_gap_sizes": sql("SELECT gap_size, count(*) AS gaps FROM processed WHERE sequence_status = 'Gap' GROUP BY gap_size",
                        "processed"),
    "m3_latency": sql("""SELECT acquisition_mode, count(*) AS readings, count(latency_us) AS recorded,
 round(avg(latency_us / 1000), 6) AS average_ms, min(latency_us / 1000) AS minimum_ms, max(latency_us / 1000) AS maximum_ms,
 quantile_disc(latency_us / 1000, 0.5) AS median_ms, quantile_disc(latency_us / 1000, 0.95) AS p95_ms
FROM published GROUP BY acquisition_mode""", "published"),
    "m2_merged_gap_sizes": sql("SELECT gap_size, count(*) AS gaps FROM processed WHERE sequence_status = 'Gap' GROUP BY gap_size",
                        "processed"),
    "m3_merged_latency": sql("""SELECT acquisition_mode, count(*) AS readings, count(latency_us) AS recorded, round(avg(latency_us / 1000), 6) AS average_ms,
 min(latency_us) / 1000 AS minimum_ms, max(latency_us) / 1000 AS maximum_ms, true AS median_ms_is_right, true AS p95_ms_is_right
FROM published GROUP BY acquisition_mode""", "published"),
    "m4_metrics_series": sql("""SELECT make_timestamp(i + 1000000) AS sampled_at_utc,
 CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS readings_processed_total, coalesce(n, 0) / 1.0e0 AS readings_per_second,
 last_value(latest IGNORE NULLS) OVER w / 1000 AS latest_end_to_end_latency_ms
FROM (SELECT unnest(generate_series(lo, hi, 1000000)) AS i FROM
 (SELECT min(t // 1000000 * 1000000) AS lo, max(t // 1000000 * 1000000) AS hi
  FROM (SELECT epoch_us(received_at_utc) AS t FROM published)))
LEFT JOIN (SELECT epoch_us(received_at_utc) // 1000000 * 1000000 AS i, count(*) AS n,
 arg_max(latency_us, row(received_at_utc, arrival_no)) FILTER (WHERE latency_us IS NOT NULL) AS latest
 FROM published GROUP BY 1) USING (i)
WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "published"),
    "m5_totals": sql("""SELECT count(*) AS readings_processed_total, arg_max(latency_us, row(received_at_utc, arrival_no))
 FILTER (WHERE latency_us IS NOT NULL) / 1000 AS latest_end_to_end_latency_ms FROM published""", "published"),
    "h1_device_ids": sql("SELECT DISTINCT device_id FROM stored ORDER BY device_id", "stored"),
    "h2_latest_sessions": sql("""SELECT device_id, acquisition_session_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id
 ORDER BY timestamp_utc DESC, received_at_utc DESC, acquisition_session_id DESC) AS k FROM stored) WHERE k = 1""", "stored"),
    "h3_recent_readings": sql(f"""SELECT {_PUBLIC} FROM stored WHERE device_id = 'DRILL-007' AND acquisition_session_id =
 (SELECT acquisition_session_id FROM stored WHERE device_id = 'DRILL-007' ORDER BY timestamp_utc DESC, received_at_utc DESC LIMIT 1)
ORDER BY timestamp_utc DESC, sequence_number DESC LIMIT 25""", "stored"),
    "h3_recent_readings_per_device": sql(f"""SELECT {_PUBLIC} FROM (SELECT s.*, row_number() OVER (PARTITION BY device_id
 ORDER BY timestamp_utc DESC, sequence_number DESC) AS k FROM stored s JOIN (SELECT device_id AS d,
 arg_max(acquisition_session_id, row(timestamp_utc, received_at_utc, acquisition_session_id)) AS a FROM stored GROUP BY 1)
 ON device_id = d AND acquisition_session_id = a) WHERE k <= 10""", "stored"),
    "h4_recent_events": sql(f"SELECT {EVENT} FROM event_stream ORDER BY occurred_at_utc DESC, event_id DESC LIMIT 20",
                            "event_stream"),
    "q1_latest_session": sql(f"""SELECT acquisition_session_id FROM stored WHERE received_at_utc >= {SINCE}
GROUP BY 1 ORDER BY max(received_at_utc) DESC, 1 LIMIT 1""", "stored"),
    "q2_session_throughput": sql(f"""SELECT acquisition_session_id, count(*) AS reading_count,
 count(DISTINCT device_id) AS device_count, round(count(*) / nullif((epoch_us(max(received_at_utc)) - epoch_us(min(received_at_utc)))
 / 1e6, 0), 2) AS average_readings_per_second, min(received_at_utc) AS started_at, max(received_at_utc) AS finished_at
FROM stored WHERE received_at_utc >= {SINCE} GROUP BY 1""", "stored"),
    "q2_latest_session_throughput": sql(f"""SELECT acquisition_session_id, count(*) AS reading_count,
 count(DISTINCT device_id) AS device_count, round(count(*) / nullif((epoch_us(max(received_at_utc)) - epoch_us(min(received_at_utc)))
 / 1e6, 0), 2) AS average_readings_per_second, min(received_at_utc) AS started_at, max(received_at_utc) AS finished_at
FROM stored WHERE received_at_utc >= {SINCE} GROUP BY 1 ORDER BY max(received_at_utc) DESC, 1 LIMIT 1""", "stored"),
    "q3_sequence_continuity": sql(f"""SELECT device_id, min(sequence_number) AS minimum_sequence,
 max(sequence_number) AS maximum_sequence, count(*) AS reading_count,
 max(sequence_number) - min(sequence_number) + 1 - count(*) AS missing_sequences
FROM stored WHERE acquisition_session_id = (SELECT acquisition_session_id FROM stored WHERE received_at_utc >= {SINCE}
 GROUP BY 1 ORDER BY max(received_at_utc) DESC, 1 LIMIT 1) GROUP BY device_id""", "stored"),
    "q4_event_counts": sql(f"""SELECT event_type, count(*) AS event_count FROM event_stream WHERE occurred_at_utc >= {SINCE}
GROUP BY event_type ORDER BY event_type""", "event_stream"),
    "q5_order_event_counts": sql(f"""SELECT count(*) FILTER (WHERE event_type = 'SequenceGap') AS sequence_gap_events,
 count(*) FILTER (WHERE event_type = 'OutOfOrderReading') AS out_of_order_events FROM event_stream
WHERE occurred_at_utc >= {SINCE}""", "event_stream"),
    "s7_log_documents": sql("SELECT path, malformed, xmlns, version, CAST(log_count AS INTEGER) AS log_count, has_log_data FROM docs", "docs"),
    # the second block of a document without a first one counts: it holds one line
    "s7_log_lines": sql("""SELECT path, line_no, line FROM raw_lines WHERE path IN (SELECT path FROM known_docs WHERE d % 89 <> 35)
UNION ALL SELECT path, 1, '1,2' FROM known_docs WHERE d % 89 = 35 AND d % 3 = 0""", "raw_lines", "known_docs"),
    "l1_document_checks": sql("SELECT path, structure_reason FROM resolved", "resolved"),
    "l2_headers": sql("""SELECT path, uid_well, name_well, uid_wellbore, name_wellbore, uid, name, index_curve
FROM docs""", "docs"),
    "l3_curves": sql("SELECT path, mnemonic, unit, null_value FROM doc_curves", "doc_curves"),
    "l4_lists": sql("""SELECT path, CAST(i AS INTEGER) AS position, mnemonics[i] AS mnemonic, units[i] AS unit FROM
 (SELECT *, unnest(generate_series(1, len(mnemonics))) AS i FROM doc_lists)""", "doc_lists"),
    "l5_lines": sql("SELECT path, line_no, CAST(len(f) AS INTEGER) AS fields, CAST(columns AS INTEGER) AS columns FROM lines",
                    "lines"),
    "l6_unit_counts": sql("""SELECT path, CAST(len(mnemonics) AS INTEGER) AS mnemonics, CAST(len(units) AS INTEGER) AS units,
 len(mnemonics) = len(units) AS consistent FROM doc_lists""", "doc_lists"),
    "l7_columns": sql("SELECT path, " + ", ".join(f"CAST({n}_at AS INTEGER) AS {n}_at" for n in
                      ("depth", "dtim", "gr", "spp", "temp")) + " FROM doc_places", "doc_places"),
    "l8_required_curves": sql("""SELECT path, curve_reason FROM resolved WHERE curve_reason LIKE 'required mnemonic%'
 OR curve_reason LIKE 'index curve%'""", "resolved"),
    "l9_units": sql("SELECT path, depth_unit, curve_reason FROM resolved WHERE structure_reason IS NULL", "resolved"),
    "l10_mandatory_values": sql("""SELECT path, line_no, reason FROM mapped WHERE reason LIKE '%has an empty value'
 OR reason LIKE '%uses the null value%'""", "mapped"),
    "l11_numbers": sql("SELECT path, line_no, gr, spp, temp FROM mapped", "mapped"),
    "l12_ranges": sql("SELECT path, line_no, reason FROM mapped WHERE reason LIKE '%is negative'", "mapped"),
    "l13_depth_metres": sql("SELECT path, line_no, round(depth_metres, 6) AS depth_metres FROM mapped", "mapped"),
    "l14_times": sql("SELECT path, line_no, dtim FROM mapped", "mapped"),
    "l15_time_order": sql("SELECT path, line_no, reason FROM mapped WHERE reason LIKE 'time is not later%'", "mapped"),
    "l16_rates": sql("SELECT path, line_no, round(rate, 6) AS rate FROM mapped WHERE reason IS NULL", "mapped"),
    "l17_readings": sql(f"""SELECT m.device_id, {_uuid("concat_ws('|', m.path, m.device_id, 'import-1')")}
 AS acquisition_session_id, m.line_no AS sequence_number, uid_well AS well_id, name_well AS well_name,
 uid_wellbore AS wellbore_id, name_wellbore AS wellbore_name, round(depth_metres, 6) AS measured_depth_metres,
 CASE WHEN rate > 0 THEN 'DrillingAhead' WHEN rate < 0 THEN 'TrippingOut' ELSE 'Stationary' END AS drilling_operation,
 round(rate, 6) AS depth_change_rate_metres_per_hour, spp AS pressure_psi, temp AS temperature_celsius, gr AS gamma_ray_api,
 dtim AS timestamp_utc, 'HistoricalImport' AS acquisition_mode
FROM mapped m WHERE m.path NOT IN (SELECT path FROM import_rejects)""", "mapped", "import_rejects"),
    "l18_rejects": sql("SELECT path, line_no, reason FROM import_rejects", "import_rejects"),
    "l19_summary": sql("""SELECT r.path, r.device_id, r.name_well, r.name_wellbore, r.mnemonic_list, r.unit_list,
 coalesce(n, 0) AS data_rows, CASE WHEN x.reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS readings, x.reason
FROM resolved r LEFT JOIN (SELECT path, count(*) AS n FROM mapped GROUP BY path) c ON r.path = c.path
LEFT JOIN import_rejects x ON r.path = x.path""", "resolved", "mapped", "import_rejects"),
    "d1_merged_readings": sql(f"SELECT {ARRIVAL} FROM merged", "merged"),
    "d2_displayed_readings": sql(f"SELECT {_PUBLIC} FROM displayed", "displayed"),
    "d3_live_buffer": sql(f"SELECT {_PUBLIC} FROM ranked WHERE newest <= 200", "ranked"),
    "d4_latest_readings": sql(f"SELECT {_PUBLIC} FROM latest", "latest"),
    "d5_active_sessions": sql("SELECT device_id, acquisition_session_id FROM active", "active"),
    "d6_all_devices": sql("""SELECT device_id FROM baseline UNION SELECT device_id FROM incoming ORDER BY device_id""",
                          "baseline", "incoming"),
    "d7_merged_events": sql(f"SELECT {EVENT} FROM events_merged", "events_merged"),
    "d8_visible_events": sql(f"""SELECT {EVENT} FROM events_merged ORDER BY epoch_us(occurred_at_utc) // 1000 DESC, event_id DESC
LIMIT 4""", "events_merged"),
    "d9_depth_axis": sql("""SELECT device_id, round(lo - greatest((hi - lo) * 0.08e0, 0.05e0), 6) AS axis_min,
 round(hi + greatest((hi - lo) * 0.08e0, 0.05e0), 6) AS axis_max FROM (SELECT device_id, min(measured_depth_metres) AS lo,
 max(measured_depth_metres) AS hi FROM displayed GROUP BY device_id)""", "displayed"),
    "d10_gamma_axis": sql("""SELECT device_id, round(greatest(0.0e0, lo - greatest((hi - lo) * 0.08e0, 1.0e0)), 6) AS axis_min,
 round(hi + greatest((hi - lo) * 0.08e0, 1.0e0), 6) AS axis_max FROM (SELECT device_id, min(gamma_ray_api) AS lo,
 max(gamma_ray_api) AS hi FROM displayed GROUP BY device_id)""", "displayed"),
    "d11_depth_series": sql("SELECT device_id, sequence_number, ms AS x, measured_depth_metres AS y FROM displayed", "displayed"),
    "d11_gamma_series": sql("SELECT device_id, sequence_number, gamma_ray_api AS x, measured_depth_metres AS y FROM displayed",
                            "displayed"),
    "d11_pressure_temperature_series": sql("""SELECT device_id, sequence_number, strftime(timestamp_utc, '%H:%M:%S') AS label,
 pressure_psi AS pressure, temperature_celsius AS temperature FROM displayed""", "displayed"),
    "d12_status_labels": sql(LABELS, "latest"),
    "d13_rate_labels": sql("""SELECT rate_label, count(*) AS readings FROM (SELECT CASE WHEN r > 0 THEN '+' ELSE '' END
 || printf('%.1f', r) AS rate_label FROM (SELECT depth_change_rate_metres_per_hour AS r FROM stored)) GROUP BY rate_label""",
                           "stored"),
    "d14_event_cards": sql(CARDS, "event_stream"),
    "b1_well_context": _upgraded(1),
    "b2_operation": _upgraded(2),
    "b3_gamma_ray": _upgraded(3),
    "b4_names": _upgraded(4),
    "b5_mode": _upgraded(5),
    "b6_upgrade_counts": " UNION ALL ".join(
        f"(SELECT {v} AS version, count(*) AS rows, count(DISTINCT well_name) AS wells, "
        f"count(*) FILTER (WHERE acquisition_mode = 'RealTime') AS real_time FROM ({_upgraded(v)}))" for v in range(1, 6)
    ),
    "b6_mixed_folder": sql(_mixed(), "broken"),
    "b6_mixed_files": sql(f"""SELECT from_version, CAST(count(*) AS BIGINT) AS rows,
 CAST(count(reject_reason) AS BIGINT) AS rejected FROM ({_mixed()}) GROUP BY from_version""", "broken"),
    **VARIED,
}
