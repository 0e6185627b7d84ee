"""SQL forms of the named queries, for DuckDB over the driver's tables.

Written from the meaning of each operator, with plain joins and windows. Named parts are
common table expressions; a statement pulls in the parts it needs.
"""

from __future__ import annotations

import re

EPOCH = 1704067200

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def _events(name: str, ts: str) -> None:
    part(name, f"""
    SELECT user_id AS vehicle, sec // 86400 AS session, event_id AS msg, {ts} AS ts,
           'PT' || CAST((sec % 86400) // 60 // 60 AS VARCHAR) || 'M' || CAST((sec % 86400) // 60 % 60 AS VARCHAR) || 'S' AS session_clock,
           CAST((sec % 86400) // 60 AS DOUBLE) AS rts,
           CASE WHEN user_id % 3 = 0 THEN 26 ELSE 25 END AS vtype,
           CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS status,
           event_id % 4 AS charge_mode, value, event_id,
           CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collector
    FROM (SELECT *, epoch_us(ts) // 1000000 AS sec FROM events)""")


_events("ev", f"make_timestamp(({EPOCH} + (sec - {EPOCH}) // 60) * 1000000)")
_events("evu", "ts")

for u in ("", "u"):
    part(f"remote{u}", f"""
    SELECT vehicle, session, msg, ts, rts, vtype, charge_mode, status,
           CASE WHEN event_id % 17 = 0 THEN 127 WHEN event_id % 23 <> 0 THEN CAST(floor(value) AS BIGINT) % 101 END AS load_level
    FROM ev{u} WHERE event_id % 2 = 0""")
    part(f"summary{u}", f"""
    SELECT vehicle, session, msg, ts, rts, vtype, charge_mode, status,
           CASE WHEN event_id % 17 = 0 THEN CAST(102.2 AS DOUBLE) WHEN event_id % 23 <> 0 THEN value - 101 * floor(value / 101) END AS summary_soc
    FROM ev{u} WHERE event_id % 2 <> 0""")
    part(f"remote_clean{u}", f"""
    SELECT *, CASE WHEN load_level = 127 OR (vtype = 26 AND load_level = 66) THEN 999 ELSE load_level END AS cleaned FROM remote{u}""")
    part(f"summary_clean{u}", f"""
    SELECT *, CASE WHEN summary_soc IN (CAST(102.2 AS DOUBLE), CAST(102.3 AS DOUBLE)) OR (vtype = 25 AND summary_soc = 0) THEN 999 ELSE summary_soc END AS cleaned
    FROM summary{u}""")
    part(f"summary_soc{u}", f"""
    SELECT *, CAST(CASE WHEN cleaned IS NULL OR cleaned = 999 THEN 999
                        WHEN vtype = 25 THEN trunc(cleaned)
                        WHEN vtype = 26 THEN round_even(least(100.0, greatest(0.0, (cleaned - CAST(21.897 AS DOUBLE)) / CAST(0.7246 AS DOUBLE))), 0)
                        ELSE 999 END AS BIGINT) AS soc
    FROM summary_clean{u}""")
    part(f"battery{u}", f"""
    SELECT vtype, vehicle, session, 68 AS msg_type, msg, ts, rts, load_level, CAST(NULL AS DOUBLE) AS summary_soc,
           cleaned AS soc, charge_mode, status FROM remote_clean{u}
    UNION ALL
    SELECT vtype, vehicle, session, 79, msg, ts, rts, NULL, summary_soc, soc, charge_mode, status FROM summary_soc{u}""")

SIDE = "session msg_type msg ts rts load_level summary_soc soc charge_mode status".split()


def _side(alias: str, suffix: str) -> str:
    return ", ".join(f"{alias}.{c} AS {c}_{suffix}" for c in SIDE)


def _power(grouped: str) -> str:
    return f"""
    SELECT *, CASE WHEN power IS NULL OR power < 0 THEN '6-not classified' WHEN power < CAST(1.2 AS DOUBLE) THEN '0-Uncertain <1.2kW'
                   WHEN power < CAST(2.7 AS DOUBLE) THEN '1-Standard 1.8kW(<2.7)' WHEN power < CAST(5.5 AS DOUBLE) THEN '2-GreenUp 3.7kW(<5.5)'
                   WHEN power < CAST(9.2 AS DOUBLE) THEN '3-WallBox 7kW(<9.2)' WHEN power < 20 THEN '4-WallBox 11kW(<20)'
                   WHEN power < 80 THEN '5-DCcharger<80kW' ELSE '6-not classified' END AS power_class
    FROM (SELECT *, CAST(CAST(CASE vtype WHEN 25 THEN CAST(0.56 AS DOUBLE) * speed WHEN 26 THEN CAST(0.12 AS DOUBLE) * speed END AS FLOAT) AS DOUBLE) AS power
          FROM (SELECT *, CAST(CAST(CASE WHEN duration > 0 THEN trunc(36000.0::DOUBLE * soc_gain / duration) / 10 END AS FLOAT) AS DOUBLE) AS speed
                FROM (SELECT *, CAST(trunc((epoch_us(ts_stop) - epoch_us(ts_start)) / 1e6) AS BIGINT) AS duration FROM {grouped})))"""


def _status_chain(p: str, source: str, keys: str, day: str) -> None:
    """Method S over ``source``; ``keys`` name one series, ``day`` the first day of its window."""
    first_key = keys.split(",")[0].strip()
    part(f"{p}settle_lists", f"""
    SELECT {', '.join('h.' + k.strip() for k in keys.split(','))}, h.session, h.msg,
           list(x.soc ORDER BY x.rts, x.msg) FILTER (WHERE x.soc IS NOT NULL) AS known, count(*) FILTER (WHERE x.rts <= 60) AS inside
    FROM {source} h JOIN {source} x USING ({keys}, session)
    WHERE h.rts <= 60 AND x.rts BETWEEN h.rts AND h.rts + 60 GROUP BY ALL""")
    part(f"{p}settled", f"""
    SELECT b.* EXCLUDE (soc), CASE WHEN b.rts > 60 OR coalesce(len(known), 0) <= 1 THEN b.soc
                                   ELSE known[least(inside, len(known))] END AS soc
    FROM {source} b LEFT JOIN {p}settle_lists USING ({keys}, session, msg)""")
    part(f"{p}placed", f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY msg) AS rn FROM {p}settled")
    part(f"{p}ahead", f"""
    SELECT {', '.join('i.' + k.strip() for k in keys.split(','))}, i.msg, x.soc, x.rn - i.rn + 1 AS pos,
           CASE WHEN x.soc IS NOT NULL THEN count(x.soc) OVER (PARTITION BY {', '.join('i.' + k.strip() for k in keys.split(','))}, i.msg ORDER BY x.rn) END AS nn,
           epoch_us(x.ts) - epoch_us(i.ts) > 300000000 AS far
    FROM {p}placed i JOIN {p}placed x USING ({keys}) WHERE i.soc = 999 AND x.rn BETWEEN i.rn AND i.rn + 10""")
    part(f"{p}found", f"""
    SELECT {keys}, msg, arg_min(soc, nn) FILTER (WHERE soc <> 999) AS soc, min(nn) FILTER (WHERE soc <> 999) AS valid, min(pos) FILTER (WHERE far) AS stop
    FROM {p}ahead GROUP BY ALL""")
    part(f"{p}recovered", f"""
    SELECT s.* EXCLUDE (soc), CASE WHEN s.soc = 999 THEN CASE WHEN f.stop IS NULL OR f.valid < f.stop THEN f.soc END ELSE s.soc END AS soc
    FROM {p}settled s LEFT JOIN {p}found f USING ({keys}, msg)""")
    part(f"{p}edges", f"""
    SELECT * FROM (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN before <> 1 AND status = 1 THEN 'plug'
                                  WHEN before = 1 AND status IS DISTINCT FROM 1 THEN 'unplug' END AS event
                   FROM (SELECT *, lag(status) OVER (PARTITION BY {keys} ORDER BY msg) AS before FROM {p}recovered))
    WHERE event IS NOT NULL""")
    part(f"{p}clean", f"""
    SELECT * FROM (SELECT *, lag(event) OVER s AS pe, lead(event) OVER s AS ne FROM {p}edges WINDOW s AS (PARTITION BY {keys} ORDER BY msg))
    WHERE (event = 'plug' AND coalesce(ne, 'unplug') = 'unplug') OR (event = 'unplug' AND coalesce(pe, 'plug') = 'plug')""")
    part(f"{p}starts", f"""
    SELECT *, lead(msg) OVER (PARTITION BY {keys} ORDER BY msg) AS next_msg_start FROM {p}clean WHERE event = 'plug'""")
    part(f"{p}raw", f"""
    SELECT {', '.join(f'coalesce(a.{k.strip()}, b.{k.strip()}) AS {k.strip()}' for k in keys.split(','))}, a.vtype, {_side('a', 'start')}, a.next_msg_start, {_side('b', 'stop')}
    FROM {p}starts a FULL JOIN (SELECT * FROM {p}clean WHERE event = 'unplug') b
      ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))}
     AND b.msg > a.msg AND (a.next_msg_start IS NULL OR b.msg < a.next_msg_start)""")
    part(f"{p}sane", f"""
    SELECT * FROM {p}raw WHERE ts_start BETWEEN {day} - INTERVAL 30 DAY AND {day} + INTERVAL 2 DAY
                           AND ts_stop BETWEEN {day} - INTERVAL 30 DAY AND {day} + INTERVAL 2 DAY""")
    part(f"{p}gaps", f"""
    SELECT *, CAST(trunc((epoch_us(ts_start) - epoch_us(previous_ts_stop)) / 1e6) AS BIGINT) AS gap_before,
              CAST(trunc((epoch_us(following_ts_start) - epoch_us(ts_stop)) / 1e6) AS BIGINT) AS gap_after
    FROM (SELECT *, lag(msg_stop) OVER s AS previous_msg_stop, lag(ts_stop) OVER s AS previous_ts_stop,
                 lead(msg_start) OVER s AS following_msg_start, lead(ts_start) OVER s AS following_ts_start
          FROM {p}sane WINDOW s AS (PARTITION BY {keys} ORDER BY msg_start, msg_stop))""")
    starts = ", ".join(f"a.{c}_start" for c in SIDE)
    stops = ", ".join(f"b.{c}_stop" for c in SIDE)
    for name, gap in (("grouped", "gap_before"), ("merged", "gap_after")):
        part(f"{p}{name}", f"""
    SELECT *, soc_stop - soc_start AS soc_gain FROM (
      SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.vtype, {starts}, a.nxt AS next_msg_start, {stops}
      FROM (SELECT *, lead(msg_start) OVER (PARTITION BY {keys} ORDER BY msg_start) AS nxt FROM {p}gaps WHERE gap_before IS NULL OR gap_before > 60) a
      JOIN (SELECT * FROM {p}gaps WHERE {gap} IS NULL OR {gap} > 60) b
        ON {' AND '.join(f'a.{k.strip()} = b.{k.strip()}' for k in keys.split(','))}
       AND a.msg_start < b.msg_stop AND (a.nxt IS NULL OR a.nxt > b.msg_stop))
    WHERE soc_stop - soc_start >= 0 AND vtype IN (25, 26)""")
    part(f"{p}power", _power(f"{p}grouped"))
    part(f"{p}final", f"SELECT * FROM {p}power WHERE duration > 300 AND duration < 172800")


_STRETCH = "CASE msg_start % 5 WHEN 0 THEN 60 WHEN 1 THEN 45 WHEN 2 THEN 12 ELSE 0 END"
_status_chain("s_", "battery", "vehicle", "TIMESTAMP '2024-01-01'")
part("long_grouped", f"SELECT * REPLACE (ts_stop + to_hours({_STRETCH}) AS ts_stop) FROM s_grouped")
part("long_power", _power("long_grouped"))
_status_chain("u_", "batteryu", "vehicle", "TIMESTAMP '2024-01-29'")
part("windowed", """
    SELECT * FROM (SELECT *, CAST(ts AS DATE) AS win FROM batteryu UNION ALL SELECT *, CAST(CAST(ts AS DATE) - INTERVAL 1 DAY AS DATE) FROM batteryu)
    WHERE win >= DATE '2024-01-01' AND win < DATE '2024-01-31'""")
_status_chain("w_", "windowed", "win, vehicle", "CAST(win AS TIMESTAMP)")
part("w_all", """
    SELECT win, vehicle, msg_start, msg_stop FROM w_final
    UNION ALL SELECT CAST(d AS DATE), NULL, NULL, NULL FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d)""")
part("w_new", """
    SELECT * FROM w_all WHERE win = DATE '2024-01-01'
    UNION ALL
    SELECT c.win, c.vehicle, c.msg_start, c.msg_stop
    FROM (SELECT win FROM w_new WHERE vehicle IS NULL) d JOIN w_all c ON c.win = CAST(d.win + INTERVAL 1 DAY AS DATE)
    LEFT JOIN w_new e ON e.vehicle = c.vehicle AND (c.msg_start BETWEEN e.msg_start AND e.msg_stop OR c.msg_stop = e.msg_stop)
    WHERE e.vehicle IS NULL""")

part("m74", """
    SELECT vehicle, session, msg, ts, (event_id % 40) * CAST(0.5 AS DOUBLE) AS km,
           CASE WHEN event_id % 17 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) % 101 AS DOUBLE) END AS soc,
           value - 40 * floor(value / 40) AS temperature, value - 300 * floor(value / 300) AS range_km FROM ev""")
part("trips", """
    SELECT vehicle, min(msg) AS msg_first, max(msg) AS msg_last, min(ts) AS trip_start, max(ts) AS trip_stop
    FROM ev WHERE session % 3 = 0 GROUP BY vehicle, session""")
part("tripped", """
    SELECT *, CASE WHEN ts >= trip_start_inner AND ts <= trip_stop_inner THEN 1 ELSE 0 END AS in_trip
    FROM (SELECT m.*, t.trip_start + INTERVAL 10 SECOND AS trip_start_inner, t.trip_stop - INTERVAL 10 SECOND AS trip_stop_inner
          FROM m74 m LEFT JOIN trips t ON m.vehicle = t.vehicle AND m.msg BETWEEN t.msg_first AND t.msg_last)""")
ORDERED = "WINDOW s AS (PARTITION BY vehicle ORDER BY ts, msg)"
part("slope1", f"""
    SELECT *, soc - lead(soc) OVER s AS soc_drop, CASE WHEN km - lag(km) OVER s BETWEEN 0.01 AND 50 THEN 1 ELSE 0 END AS moving FROM tripped {ORDERED}""")
part("slope2", "SELECT *, CASE WHEN soc_drop < 0 THEN 1 ELSE 0 END AS rising FROM slope1")
part("slope3", f"""
    SELECT *, CASE WHEN coalesce(lag(rising) OVER s, 0) = 1 OR rising = 1 THEN 1 ELSE 0 END AS rising_pair, in_trip * moving AS driving FROM slope2 {ORDERED}""")
part("slope4", "SELECT *, CASE WHEN rising_pair = 1 AND driving = 0 THEN 1 ELSE 0 END AS charging FROM slope3")
_terms = " OR ".join("(lag(charging, {0}) OVER s = 1 AND epoch(ts) - epoch(lag(ts, {0}) OVER s) < 600)".format(k) for k in range(1, 11))
_after = _terms.replace("lag(charging", "lead(charging")
_after = re.sub(r"epoch\(ts\) - epoch\(lag\(ts, (\d+)\) OVER s\) < 600", r"epoch(lead(ts, \1) OVER s) - epoch(ts) < 600", _after)
part("slope5", f"SELECT *, CASE WHEN charging = 1 OR (({_terms}) AND ({_after})) THEN 1 ELSE 0 END AS filled FROM slope4 {ORDERED}")
part("slope6", f"SELECT *, CASE WHEN lead(filled) OVER s = 0 AND lag(filled) OVER s = 0 THEN 0 ELSE filled END AS kept FROM slope5 {ORDERED}")
part("slope7", f"""
    SELECT *, CASE WHEN ts <> min(ts) OVER (PARTITION BY vehicle) AND kept - lag(kept) OVER s = 1 THEN 1 ELSE 0 END AS begins FROM slope6 {ORDERED}""")
part("slope8", """
    SELECT *, CASE WHEN kept = 0 THEN 0 ELSE sum(begins) OVER (PARTITION BY vehicle ORDER BY ts, msg ROWS UNBOUNDED PRECEDING) END AS charge_no FROM slope7""")
part("l_sessions", """
    SELECT *, soc_stop - soc_start AS soc_gain, 1 AS charging FROM (
      SELECT vehicle, CAST(charge_no AS BIGINT) AS charge_no, min(ts) AS charge_start, max(ts) AS charge_stop,
             list(soc ORDER BY ts, msg)[1] AS soc_start, list(soc ORDER BY ts DESC, msg DESC)[1] AS soc_stop
      FROM slope8 WHERE charge_no > 0 GROUP BY vehicle, charge_no)""")
part("l_charges", "SELECT * FROM l_sessions WHERE soc_gain > 1")

STATUSES = ("no_charging", "ongoing", "failure", "remote", "finished")
part("l_inside", """
    SELECT c.vehicle, c.charge_start, c.charge_stop, m.msg, m.ts, m.status
    FROM l_charges c JOIN ev m ON m.vehicle = c.vehicle AND m.ts BETWEEN c.charge_start AND c.charge_stop""")
for code, name in enumerate(STATUSES):
    part(f"l_{name}", f"""
    SELECT a.*, f.ts AS {name}_first_ts, l.ts AS {name}_last_ts
    FROM (SELECT vehicle, charge_start, charge_stop, min(msg) AS {name}_first, max(msg) AS {name}_last
          FROM l_inside WHERE status = {code} GROUP BY ALL) a
    LEFT JOIN ev f ON f.vehicle = a.vehicle AND f.msg = a.{name}_first
    LEFT JOIN ev l ON l.vehicle = a.vehicle AND l.msg = a.{name}_last""")
part("l_spans", "SELECT *, coalesce(ongoing_first_ts, charge_start) AS start, coalesce(finished_first_ts, charge_stop) AS stop FROM l_charges "
     + " ".join(f"LEFT JOIN l_{name} USING (vehicle, charge_start, charge_stop)" for name in STATUSES))
part("l_begun", "SELECT * FROM l_spans QUALIFY row_number() OVER (PARTITION BY vehicle, start ORDER BY charge_start DESC) = 1")
part("l_open", """
    SELECT m.vehicle, m.ts, m.msg, m.status, c.charge_start, c.start, c.stop
    FROM ev m ASOF LEFT JOIN l_begun c ON m.vehicle = c.vehicle AND m.ts >= c.start""")
part("l_asof", """
    SELECT *, lead(status) OVER (PARTITION BY vehicle, charge_start ORDER BY ts, msg) AS next_status FROM l_open""")
part("l_late", """
    SELECT vehicle, charge_start,
           min(msg) FILTER (WHERE status = 1 AND next_status = 0) AS late_ongoing, arg_min(ts, msg) FILTER (WHERE status = 1 AND next_status = 0) AS late_ongoing_ts,
           min(msg) FILTER (WHERE status = 4) AS late_finished, arg_min(ts, msg) FILTER (WHERE status = 4) AS late_finished_ts
    FROM l_asof WHERE ts > stop AND ((status = 1 AND next_status = 0) OR status = 4) GROUP BY ALL""")
part("l_moved", """
    SELECT *, (epoch(late_finished_ts) - epoch(stop)) / 3600 AS late_finished_hours, (epoch(late_ongoing_ts) - epoch(stop)) / 3600 AS late_ongoing_hours,
           (epoch(late_stop) - epoch(stop)) / 3600 AS late_stop_hours
    FROM (SELECT *, least(late_finished_ts, late_ongoing_ts) AS late_stop FROM l_spans LEFT JOIN l_late USING (vehicle, charge_start))""")
part("l_refined", """
    SELECT * REPLACE (CASE WHEN finished_first_ts IS NULL AND late_stop IS NOT NULL AND late_stop_hours < 2 THEN late_stop ELSE stop END AS stop) FROM l_moved""")
part("l_held", """
    SELECT c.vehicle, c.start, m.session, m.msg, m.temperature, m.range_km, m.soc
    FROM (SELECT DISTINCT vehicle, start, stop FROM l_refined) c JOIN m74 m ON m.vehicle = c.vehicle AND m.ts BETWEEN c.start AND c.stop""")
_reads = lambda end: (f"{end}.session AS session_{end}, {end}.msg AS msg_{end}, {end}.temperature AS temperature_{end}, "
                      f"{end}.range_km AS range_{end}, {end}.soc AS soc_{end}")
part("l_ends", f"""
    SELECT first.vehicle, first.start, {_reads('first')}, {_reads('last')}
    FROM (SELECT * FROM l_held QUALIFY row_number() OVER (PARTITION BY vehicle, start ORDER BY session, msg) = 1) first
    JOIN (SELECT * FROM l_held QUALIFY row_number() OVER (PARTITION BY vehicle, start ORDER BY session DESC, msg DESC) = 1) last
      ON first.vehicle = last.vehicle AND first.start = last.start""")
part("l_enriched", """
    SELECT DISTINCT vehicle, session_first, session_last, msg_first, msg_last, start, stop, soc_start, soc_stop, soc_first, soc_last,
           temperature_first, temperature_last, range_first, range_last
    FROM l_refined LEFT JOIN l_ends USING (vehicle, start)""")

_measures = "(epoch(stop) - epoch(start)) / 3600 AS hours, soc_stop - soc_start AS soc_gain"
part("common_s", f"""
    SELECT *, {_measures} FROM (SELECT vehicle, session_start, session_stop, msg_start, msg_stop, ts_start AS start, ts_stop AS stop,
                                       CAST(soc_start AS DOUBLE) AS soc_start, CAST(soc_stop AS DOUBLE) AS soc_stop FROM s_final)""")
part("common_l", f"""
    SELECT *, {_measures} FROM (SELECT vehicle, coalesce(session_first, 0) AS session_start, coalesce(session_last, 0) AS session_stop,
                                       coalesce(msg_first, 0) AS msg_start, coalesce(msg_last, 0) AS msg_stop, start, stop, soc_start, soc_stop FROM l_enriched)""")


def _pairs(slope: str) -> str:
    return f"""
    SELECT s.vehicle, s.msg_start AS msg_start_s, s.start AS start_s, s.stop AS stop_s, l.msg_start AS msg_start_l, l.start AS start_l, l.stop AS stop_l,
           s.hours AS hours_s, l.hours AS hours_l, abs(s.hours - l.hours) AS abs_diff
    FROM common_s s JOIN {slope} l ON s.vehicle = l.vehicle
     AND (s.start BETWEEN l.start AND l.stop OR s.stop BETWEEN l.start AND l.stop OR l.start BETWEEN s.start AND s.stop OR l.stop BETWEEN s.start AND s.stop)"""


part("pairs", _pairs("common_l"))
part("long_l", f"SELECT * REPLACE (stop + to_hours({_STRETCH}) AS stop, hours + {_STRETCH} AS hours) FROM common_l")
part("long_pairs", _pairs("long_l"))
part("pairs50", _pairs("(SELECT * FROM long_l WHERE hours <= 50)"))
part("long_stacked", "SELECT *, 'status' AS method FROM common_s UNION ALL SELECT *, 'slope' FROM long_l")
part("stacked", "SELECT *, 'status' AS method FROM common_s UNION ALL SELECT *, 'slope' FROM common_l")


def _series(source: str, names: tuple[str, str, str, str, str, str], extra: str = "") -> str:
    a, b, c, d, e, f = names
    return f"""
    SELECT DISTINCT * FROM (
      SELECT vehicle, {extra} {a} AS session, {b} AS msg, {c} AS time, 'plug' AS event FROM {source}
      UNION ALL SELECT vehicle, {extra} {d}, {e}, {f}, 'unplug' FROM {source})"""


_common_names = ("session_start", "msg_start", "start", "session_stop", "msg_stop", "stop")
part("series_s", _series("common_s", _common_names))
part("series_l", _series("common_l", _common_names))
part("series_gain", _series("common_s", _common_names, "soc_gain, hours,"))
part("run1", _series("u_final", ("session_start", "msg_start", "ts_start", "session_stop", "msg_stop", "ts_stop")))
part("run2", """
    SELECT * REPLACE (make_timestamp((epoch_us(time) // 1000000 + CASE WHEN vehicle % 5 = 0 THEN 3600 ELSE 0 END) * 1000000) AS time)
    FROM run1 WHERE msg % 29 <> 0""")
part("run_joined", """
    SELECT a.vehicle, a.session, a.msg, a.event, a.time AS time_first, b.time AS time_second,
           epoch_us(a.time) // 1000000 - epoch_us(b.time) // 1000000 AS diff
    FROM run1 a LEFT JOIN run2 b USING (vehicle, session, msg, event)""")
part("resent", """
    SELECT vehicle, session, msg, ts, vtype, summary_soc FROM summary
    UNION ALL SELECT vehicle, session, msg, ts, vtype, summary_soc + 1 FROM summary WHERE msg % 7 = 0""")
part("resent_once", "SELECT vehicle, session, msg, ts, vtype, min(summary_soc) AS summary_soc FROM resent GROUP BY ALL")
part("calm", f"""
    SELECT * FROM (SELECT *, soc - lead(soc) OVER s AS soc_drop FROM m74 {ORDERED}) WHERE abs(soc_drop) < 10""")
part("equipped", """
    SELECT c_custkey AS vehicle, c_mktsegment AS family, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS value,
           substring(c_mktsegment, 1, 1) AS index FROM customer WHERE c_nationkey = 4""")

_uses = {}


def _needs(sql: str) -> list[str]:
    """Names of the parts a statement mentions, directly or not, in order of definition."""
    seen: set[str] = set()
    open_ = [sql]
    while open_:
        text = open_.pop()
        for word in set(re.findall(r"[a-z_0-9]+", text)):
            if word in PARTS and word not in seen:
                seen.add(word)
                open_.append(PARTS[word])
    return [name for name in PARTS if name in seen]


HEAVY = {"battery", "batteryu", "s_final", "u_final", "w_final", "l_charges", "l_inside", "l_spans", "l_refined", "l_enriched", "run1"}


def _statement(sql: str) -> str:
    used = _needs(sql)
    if not used:
        return sql
    recursive = "RECURSIVE " if "w_new" in used else ""
    body = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in HEAVY else ''}({PARTS[n]})" for n in used)
    return f"WITH {recursive}{body}\n{sql}"


def r(column: str, digits: int = 4) -> str:
    return f"round(CAST({column} AS DOUBLE), {digits}) + 0.0 AS {column.split('.')[-1]}"


GROUPED = "vehicle, vtype, msg_start, next_msg_start, msg_stop, ts_start, ts_stop, soc_gain"
PAIR = f"vehicle, msg_start_s, start_s, stop_s, msg_start_l, start_l, stop_l, {r('hours_s')}, {r('hours_l')}, {r('abs_diff')}"
COMMON = (f"vehicle, session_start, session_stop, msg_start, msg_stop, start, stop, {r('soc_start')}, {r('soc_stop')}, {r('hours')}, {r('soc_gain')}")


def _hist(value: str, bins: int | str, table: str = "stacked", group: str = "method", amount: str = "count(*)", digits: int = 4) -> str:
    return f"""
    SELECT {group}, bin, {amount} AS n, round(CAST(min(lo + bin * w) AS DOUBLE), {digits}) + 0.0 AS bin_start
    FROM (SELECT *, CAST(CASE WHEN hi = lo THEN 0 ELSE least(bins - 1, floor(({value} - lo) / w)) END AS BIGINT) AS bin
          FROM {table}, (SELECT min({value}) AS lo, max({value}) AS hi, (max({value}) - min({value})) / {bins} AS w, {bins} AS bins FROM {table}) WHERE {value} IS NOT NULL)
    GROUP BY {group}, bin"""


def _describe(columns: tuple[str, ...] = ("hours", "soc_start", "soc_stop", "soc_gain"), table: str = "stacked", group: str = "method") -> str:
    one = """SELECT method, '{0}' AS "column", count({0}) AS n, round(avg({0}), 4) + 0.0 AS mean, round(stddev_samp({0}), 4) + 0.0 AS std,
             round(min({0}), 4) + 0.0 AS least, round(max({0}), 4) + 0.0 AS greatest, round(quantile_cont({0}, 0.25), 4) + 0.0 AS q25,
             round(quantile_cont({0}, 0.5), 4) + 0.0 AS q50, round(quantile_cont({0}, 0.75), 4) + 0.0 AS q75 FROM stacked GROUP BY method"""
    one = one.replace("SELECT method", f"SELECT {group}").replace("FROM stacked GROUP BY method", f"FROM {table} GROUP BY {group}")
    return " UNION ALL ".join(one.format(c) for c in columns)


STATEMENTS = {
    "scan_messages": """SELECT vehicle, session, msg, ts, status FROM evu
        WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-16' AND collector = 'odd'
          AND vehicle IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
    "scan_raw_vs_clean": """SELECT vehicle, raw_rows, clean_rows, invalid_rows FROM (SELECT vehicle, count(*) AS raw_rows FROM resent GROUP BY vehicle)
        JOIN (SELECT vehicle, count(*) AS clean_rows, count(*) FILTER (WHERE summary_soc IN (CAST(102.2 AS DOUBLE), CAST(102.3 AS DOUBLE))
              OR (vtype = 25 AND summary_soc = 0)) AS invalid_rows FROM resent_once GROUP BY vehicle) USING (vehicle)""",
    "code_map": "SELECT c_name AS standard_name, c_mktsegment || ';' || CAST(c_custkey AS VARCHAR) AS short_code FROM customer",
    "vehicle_subset": "SELECT vehicle, msg, ts FROM ev WHERE vehicle IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "renamed_messages": 'SELECT event_id AS "EVID", user_id AS "USID", event_type AS "EVTY", value FROM events',
    "equipment_vehicles": """SELECT vehicle, family, value, index, n_name AS designation FROM equipped JOIN nation ON n_nationkey = CAST(value AS INTEGER)""",
    "charges_month": """SELECT vehicle, msg_start, msg_stop, ts_start, ts_stop, duration, 2024 AS year, 1 AS month FROM u_final
        WHERE year(ts_start) = 2024 AND month(ts_start) = 1""",
    "session_seconds": "SELECT vehicle, session, msg, rts FROM ev",
    "soc_cleaned": f"""SELECT vehicle, msg, vtype, round(CAST(cleaned AS DOUBLE), 4) + 0.0 AS soc FROM summary_clean
        UNION ALL SELECT vehicle, msg, vtype, CAST(cleaned AS DOUBLE) FROM remote_clean""",
    "soc_estimated": "SELECT vehicle, msg, vtype, soc FROM summary_soc",
    "battery_unified": f"SELECT * REPLACE ({r('summary_soc')}) FROM battery",
    "messages_dedup": f"SELECT vehicle, session, msg, ts, {r('summary_soc')} FROM resent_once",
    "soc_settled": "SELECT vehicle, session, msg, rts, soc FROM s_settled",
    "soc_recovered": "SELECT vehicle, msg, ts, soc FROM s_recovered",
    "plug_events": "SELECT vehicle, msg, ts, status, soc, event FROM s_edges",
    "plug_events_clean": "SELECT vehicle, msg, ts, status, soc, event FROM s_clean",
    "charges_raw": "SELECT vehicle, vtype, msg_start, ts_start, soc_start, next_msg_start, msg_stop, ts_stop, soc_stop FROM s_raw",
    "charges_sane": """SELECT vehicle, msg_start, msg_stop, ts_start, ts_stop FROM u_raw
        WHERE ts_start BETWEEN TIMESTAMP '2023-12-11' AND TIMESTAMP '2024-01-12' AND ts_stop BETWEEN TIMESTAMP '2023-12-11' AND TIMESTAMP '2024-01-12'""",
    "charge_gaps": "SELECT vehicle, msg_start, msg_stop, previous_msg_stop, following_msg_start, gap_before, gap_after FROM s_gaps",
    "charges_grouped": f"SELECT {GROUPED} FROM s_grouped",
    "charges_merged": f"SELECT {GROUPED} FROM s_merged",
    "charge_power": f"SELECT vehicle, msg_start, soc_gain, duration, {r('speed')}, {r('power')} FROM s_power",
    "power_class": "SELECT vehicle, msg_start, vtype, power_class FROM s_power",
    "charges_final": "SELECT vtype, vehicle, " + ", ".join(f"{c}_start" for c in SIDE if c != "summary_soc") + f", {r('summary_soc_start')}, next_msg_start, "
        + ", ".join(f"{c}_stop" for c in SIDE if c != "summary_soc") + f", {r('summary_soc_stop')}, soc_gain, duration, {r('speed')}, {r('power')}, power_class FROM s_final",
    "charges_plausible": f"SELECT vehicle, msg_start, msg_stop, ts_stop, duration, {r('power')} FROM long_power WHERE duration > 300 AND duration < 172800",
    "rolling_new_charges": f"""SELECT win AS "window", vehicle, msg_start, msg_stop, ts_start, ts_stop, soc_gain, {r('power')}
        FROM w_final SEMI JOIN w_new USING (win, vehicle, msg_start, msg_stop)""",
    "clock_corrected": """SELECT e.vehicle, e.session, e.msg, e.event,
            c.close_ts - to_seconds(CAST(round_even(c.close_rts - e.rts, 0) AS BIGINT)) AS ts
        FROM s_clean e JOIN (SELECT vehicle, session, max(ts) AS close_ts, max(rts) AS close_rts FROM ev GROUP BY ALL) c USING (vehicle, session)""",
    "anonymised": "SELECT md5(CAST(vehicle AS VARCHAR) || 'not-a-real-secret') AS pseudonym, msg_start, msg_stop, soc_gain FROM s_final",
    "trip_flags": """SELECT vehicle, session, msg, ts, trip_start_inner, trip_stop_inner, in_trip FROM tripped
        UNION ALL SELECT vehicle, CASE WHEN msg % 2 = 0 THEN session END, msg, ts, trip_start_inner, trip_stop_inner, in_trip FROM tripped WHERE msg % 9 = 0""",
    "slope_flags": f"SELECT vehicle, msg, {r('soc_drop')}, rising, rising_pair, moving, driving, charging FROM slope4",
    "slope_filled": "SELECT vehicle, msg, charging, filled, kept FROM slope6",
    "slope_sessions": f"SELECT vehicle, charge_no, charge_start, charge_stop, {r('soc_start')}, {r('soc_stop')}, {r('soc_gain')}, charging FROM l_sessions",
    "slope_charges": f"SELECT vehicle, charge_no, charge_start, charge_stop, {r('soc_start')}, {r('soc_stop')}, {r('soc_gain')}, charging FROM l_charges",
    "charge_status_spans": f"SELECT * REPLACE ({r('soc_start')}, {r('soc_stop')}, {r('soc_gain')}) FROM l_spans",
    "charge_ids": "SELECT vehicle, start, stop, charge_start, row_number() OVER (ORDER BY vehicle, start, charge_start) AS charge_id FROM l_spans",
    "charge_asof": "SELECT vehicle, ts, msg, status, next_status, charge_start, start, stop FROM l_asof",
    "late_status": "SELECT * FROM l_late",
    "refined_charges": f"""SELECT vehicle, charge_no, charge_start, charge_stop, {r('soc_start')}, {r('soc_stop')}, {r('soc_gain')}, start, stop,
        late_ongoing, late_finished, late_stop, {r('late_finished_hours')}, {r('late_ongoing_hours')}, {r('late_stop_hours')} FROM l_refined""",
    "charge_endpoints": "SELECT * REPLACE (" + ", ".join(r(f"{c}_{e}") for c in ("temperature", "range", "soc") for e in ("first", "last")) + ") FROM l_ends",
    "charges_enriched": "SELECT * REPLACE (" + ", ".join(r(c) for c in ("soc_start", "soc_stop", "soc_first", "soc_last", "temperature_first",
        "temperature_last", "range_first", "range_last")) + ") FROM l_enriched",
    "charges_common_s": f"SELECT {COMMON} FROM common_s",
    "charges_common_l": f"SELECT {COMMON} FROM common_l",
    "overlap_pairs": f"SELECT {PAIR} FROM pairs",
    "overlap_pairs_any": """SELECT s.vehicle, s.start, s.stop, count(l.vehicle) AS overlaps FROM common_s s
        LEFT JOIN common_l l ON s.start BETWEEN l.start AND l.stop OR s.stop BETWEEN l.start AND l.stop
            OR l.start BETWEEN s.start AND s.stop OR l.stop BETWEEN s.start AND s.stop GROUP BY s.vehicle, s.start, s.stop, s.msg_start""",
    "overlap_best": f"SELECT {PAIR} FROM (SELECT * FROM pairs50 QUALIFY row_number() OVER (PARTITION BY vehicle, start_s, stop_s ORDER BY start_l, stop_l, msg_start_l) = 1)",
    "overlap_mean_diff": "SELECT count(*) AS pairs, round(avg(abs_diff), 4) + 0.0 AS mean_abs_diff FROM pairs",
    "session_coverage": """SELECT l_rows, s_rows, matched_rows, matched_vehicles, round(100.0 * matched_rows / l_rows, 4) + 0.0 AS l_percent, round(100.0 * matched_rows / s_rows, 4) + 0.0 AS s_percent
        FROM (SELECT count(*) AS matched_rows, count(DISTINCT l.vehicle) AS matched_vehicles FROM common_l l JOIN common_s s USING (vehicle, session_start) WHERE s.session_stop IS NOT NULL),
             (SELECT count(*) AS l_rows FROM common_l), (SELECT count(*) AS s_rows FROM common_s)""",
    "vehicles_not_common": """SELECT vehicle, 'first' AS only_in FROM (SELECT DISTINCT vehicle FROM common_s) WHERE vehicle NOT IN (SELECT vehicle FROM common_l)
        UNION ALL SELECT vehicle, 'second' FROM (SELECT DISTINCT vehicle FROM common_l) WHERE vehicle NOT IN (SELECT vehicle FROM common_s)""",
    "charges_stacked": f"SELECT {COMMON}, method FROM stacked",
    "charge_date_range": "SELECT method, min(start) AS first_start, max(start) AS last_start, min(stop) AS first_stop, max(stop) AS last_stop FROM stacked GROUP BY method",
    "vehicle_counts": "SELECT method, count(*) AS rows, count(DISTINCT vehicle) AS vehicles FROM stacked GROUP BY method",
    "charge_describe": _describe(),
    "duration_histogram": _hist("hours", 100),
    "soc_gain_histogram": _hist("soc_gain", 10),
    "duration_box": """SELECT method, round(q25, 4) + 0.0 AS q25, round(q50, 4) + 0.0 AS q50, round(q75, 4) + 0.0 AS q75,
            round(min(hours) FILTER (WHERE hours BETWEEN lo AND hi), 4) + 0.0 AS whisker_low, round(max(hours) FILTER (WHERE hours BETWEEN lo AND hi), 4) + 0.0 AS whisker_high,
            count(*) FILTER (WHERE hours NOT BETWEEN lo AND hi) AS fliers, count(*) AS n
        FROM (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM (SELECT * FROM long_stacked WHERE hours <= 10)
              JOIN (SELECT method, quantile_cont(hours, 0.25) AS q25, quantile_cont(hours, 0.5) AS q50, quantile_cont(hours, 0.75) AS q75
                    FROM long_stacked WHERE hours <= 10 GROUP BY method) USING (method))
        GROUP BY method, q25, q50, q75""",
    "duration_outliers": f"SELECT {PAIR}, hours_l < 0 AS negative_l FROM long_pairs WHERE abs_diff >= 40",
    "iqr_outliers": """SELECT method, vehicle, msg_start, start, round(hours, 4) + 0.0 AS hours, hours = max(hours) OVER (PARTITION BY method) AS is_largest
        FROM stacked JOIN (SELECT method, quantile_cont(hours, 0.25) AS q25, quantile_cont(hours, 0.75) AS q75 FROM stacked GROUP BY method) USING (method)
        WHERE hours < q25 OR hours > q75""",
    "start_probability": """SELECT method, vehicle, msg_start, start, round(count(*) OVER (PARTITION BY method, start) / count(*) OVER (PARTITION BY method), 8) + 0.0 AS probability FROM stacked""",
    "longest_charges": f"SELECT method, {COMMON} FROM (SELECT * FROM stacked QUALIFY rank() OVER (PARTITION BY method ORDER BY hours DESC) = 1)",
    "event_series": """SELECT 'slope' AS method, vehicle, session, msg, time, event FROM series_l
        UNION ALL SELECT 'status', vehicle, session, msg, time, event FROM series_s""",
    "second_run_csv": "SELECT * FROM run_joined",
    "catalog_charges": "SELECT vehicle, msg_start, msg_stop, ts_start, ts_stop FROM s_final",
    "charges_overwritten": "SELECT vehicle, msg_start, msg_stop, soc_gain FROM s_final WHERE soc_gain > 10",
    "raw_landed": """SELECT vehicle, session, msg, ts, status FROM summaryu WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
    "run_record": "SELECT '1,2' AS vehicles, CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date, 'run' AS folder_name FROM events",
    "window_rows": """SELECT CAST(ts_start AS DATE) AS "window", count(*) AS rows, count(*) AS read_rows FROM u_final GROUP BY 1""",
    "events_in_order": "SELECT vehicle, session, msg, event, time, row_number() OVER (ORDER BY vehicle, time, msg, event) AS place FROM run1",
    "family_labels": "SELECT c_custkey AS vehicle, c_mktsegment AS family, 'family ' || lower(c_mktsegment) AS label FROM customer",
    "run_difference_density": f"""SELECT run, bin, round(n / (sum(n) OVER (PARTITION BY run) * width), 8) + 0.0 AS n, bin_start
        FROM (SELECT *, (SELECT (max(diff) - min(diff)) / 100 FROM run_joined) AS width FROM ({_hist("diff", 100, "(SELECT 'both' AS run, diff FROM run_joined)", "run", digits=8)}))""",
    "run_time_histogram": _hist("second", 20, """(SELECT 'first' AS run, epoch_us(time) // 1000000 AS second FROM run1
        UNION ALL SELECT 'second', epoch_us(time) // 1000000 FROM run2)""", "run"),
    "start_weighted_histogram": _hist("second", "(SELECT count(DISTINCT vehicle) FROM stacked)", """(SELECT method, epoch_us(start) // 1000000 AS second,
        count(*) OVER (PARTITION BY method, start) / count(*) OVER (PARTITION BY method) AS probability FROM stacked)""", amount="round(sum(probability), 4) + 0.0"),
    "vehicles_described": """SELECT method, sum(n)::BIGINT AS n, count(vehicle) AS "unique", arg_max(vehicle, n * 1000000000 - vehicle) AS top, max(n) AS freq, min(a) AS first, max(b) AS last
        FROM (SELECT method, vehicle, count(vehicle) AS n, min(start) AS a, max(start) AS b FROM stacked GROUP BY ALL) GROUP BY method""",
    "run_difference_described": _describe(("diff", "first_second"), "(SELECT 'both' AS run, diff, epoch_us(time_first) // 1000000 AS first_second FROM run_joined)", "run"),
    "event_series_numbered": "SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY time, msg, event) AS row_no FROM series_s",
    "event_series_soc": """SELECT vehicle, round(CASE WHEN soc_gain = lag(soc_gain) OVER (PARTITION BY vehicle ORDER BY session, time, msg, event) THEN 0 ELSE soc_gain END, 4) + 0.0 AS soc_gain,
        round(hours, 4) + 0.0 AS hours, session, msg, time, event FROM series_gain""",
    "soc_jump_filtered": f"SELECT vehicle, msg, ts, {r('soc')}, {r('soc_drop')} FROM calm",
    "soc_trace": f"""SELECT DISTINCT vehicle, ts, {r('soc')} FROM calm WHERE ts >= TIMESTAMP '2024-01-01 02:00:00' AND ts < TIMESTAMP '2024-01-01 09:00:00'
        AND vehicle IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')""",
    "charges_lookup": """SELECT DISTINCT vehicle, session, msg, time, event FROM run1 WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-01-09'
        AND vehicle IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')""",
    "run_diff": "SELECT * FROM run_joined",
    "run_diff_summary": "SELECT min(diff) AS least, max(diff) AS greatest, count(*) FILTER (WHERE diff IS NULL) AS missing, count(*) AS n FROM run_joined",
    "run_drift": """SELECT vehicle, round(avg(d), 4) + 0.0 AS mean_diff, count(*) AS pairs, abs(avg(d)) > 86400 AS drifts
        FROM (SELECT vehicle, epoch_us(a.time) // 1000000 - epoch_us(b.time) // 1000000 AS d
              FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY time, msg, event) AS k FROM run1) a
              JOIN (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY time, msg, event) AS k FROM run2) b USING (vehicle, k))
        GROUP BY vehicle""",
    "run_clock_diff": """SELECT * FROM (
            SELECT vehicle, session, msg, -shift AS diff_ts, -shift AS diff_received, -shift AS diff_satellite
            FROM (SELECT vehicle, session, msg, CASE WHEN msg % 29 <> 0 THEN CASE vehicle % 5 WHEN 0 THEN 3600 WHEN 1 THEN -7200 ELSE 0 END END AS shift FROM ev))
        WHERE diff_ts < 3600 OR diff_received < 3600 OR diff_satellite < 3600""",
    "near_midnight": """SELECT * FROM run_joined WHERE (hour(time_first) = 23 AND minute(time_first) >= 30) OR (hour(time_first) = 0 AND minute(time_first) <= 30)""",
    "near_midnight_asym": """SELECT * FROM run_joined WHERE (hour(time_first) = 23 AND minute(time_first) >= 30)
        OR epoch_us(time_first) - epoch_us(date_trunc('day', time_first)) <= 600000000""",
    "vehicle_sample": "SELECT vehicle FROM (SELECT DISTINCT vehicle FROM ev) ORDER BY md5('7:' || CAST(vehicle AS VARCHAR)), vehicle LIMIT 30",
}


def statements() -> dict[str, str]:
    return {name: _statement(sql) for name, sql in STATEMENTS.items()}
