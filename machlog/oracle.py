"""DuckDB oracle: the adapter views as SQL text plus helpers to assemble
self-contained queries.  Every view mirrors a function of
``machlog.sources.adapters`` row for row.

Conventions shared with the Spark side (see ``machlog.catalog``): doubles are
rounded to 6 places, counts are BIGINT, durations are seconds or hours (no
interval columns), epoch ms is ``epoch_us(ts) // 1000``.
"""

from __future__ import annotations

import re

from machlog.config import A7_SENSORS
from machlog.sources.adapters import MSG_VAR_OFFSET, LOAD_VAR_OFFSET, SPECIAL_VARS

K = "CAST(split_part(split_part(props, ': ', 2), '}', 1) AS INTEGER)"
MS = "(epoch_us(ts) // 1000)"
TICK = "((epoch_us(ts) // 600000000) * 600000)"


def sec_ts(seconds_expr: str) -> str:
    """TIMESTAMP from a whole-second epoch expression."""
    return f"make_timestamp(CAST(({seconds_expr}) AS BIGINT) * 1000000)"


def ms_ts(ms_expr: str) -> str:
    return f"make_timestamp(CAST(({ms_expr}) AS BIGINT) * 1000)"


def bucket_ts(date: str = "date", bucket_s: int = 1) -> str:
    if bucket_s == 1:
        return sec_ts(f"{date} // 1000")
    return sec_ts(f"(({date} // 1000) // {bucket_s}) * {bucket_s}")


_special = ", ".join(f"({i}, '{n}', '{t}')" for i, n, t in SPECIAL_VARS)
_special_ids = ", ".join(str(v[0]) for v in SPECIAL_VARS)
_sensors = ", ".join(str(s) for s in A7_SENSORS)

VIEWS: dict[str, str] = {
    "fl": f"""SELECT {MS} AS date, CAST(user_id AS INTEGER) AS id_var,
        CAST(value AS DOUBLE) AS value, event_id AS seq FROM events""",
    "fl16": f"""SELECT {MS} AS date, [{_sensors}][CAST(user_id % 16 AS INTEGER) + 1] AS id_var,
        CAST(value AS DOUBLE) AS value, event_id AS seq FROM events""",
    "sl": f"""SELECT {MS} AS date,
        CASE WHEN event_id % 3 <> 0 THEN 447 ELSE 557 END AS id_var,
        CASE WHEN event_type = 'view' THEN '[]'
             WHEN event_id % 97 = 0 THEN NULL
             ELSE '[' || '["PLC000' || lpad(CAST({K} AS VARCHAR), 2, '0') || '","' || event_type
                  || '",3,3,' || CAST(event_id AS VARCHAR) || ']'
                  || CASE WHEN event_id % 2 = 0
                          THEN ',["PLC00100","shared",3,1,' || CAST(event_id AS VARCHAR) || ']'
                          ELSE '' END
                  || ']' END AS value,
        event_id AS seq FROM events""",
    "loadlog": f"""SELECT {MS} AS date,
        CASE WHEN event_type = 'view' THEN 630 WHEN event_type = 'click' THEN 260
             ELSE CAST(user_id AS INTEGER) + {LOAD_VAR_OFFSET} END AS id_var,
        CAST(value AS DOUBLE) AS value, event_id AS seq FROM events""",
    "prog": f"""SELECT {TICK} AS date,
        CASE WHEN event_type = 'click' THEN 828 ELSE 575 END AS id_var,
        CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END AS value, event_id AS seq
        FROM events WHERE event_type IN ('click', 'purchase')""",
    "msgs": f"""SELECT {TICK} AS date,
        CASE WHEN event_type = 'error' THEN 9001 WHEN event_type = 'signup' THEN 9002
             ELSE CAST(user_id AS INTEGER) + {MSG_VAR_OFFSET} END AS id_var,
        CASE WHEN {K} % 6 = 0 THEN 'Spindle overheat detected ZONE_' || CAST({K} % 5 AS VARCHAR)
             WHEN {K} % 6 = 1 THEN 'Puerta abierta - seguridad EJE ' || chr(88 + {K} % 3)
             WHEN {K} % 6 = 2 THEN 'Power supply voltage low CONVEYOR ' || CAST({K} % 4 AS VARCHAR)
             WHEN {K} % 6 = 3 THEN 'Parada de emergencia MANDRINO ' || CAST({K} % 2 AS VARCHAR)
             WHEN {K} % 6 = 4 THEN 'Axis encoder fault AXIS_' || CAST({K} % 3 AS VARCHAR)
             ELSE 'info: zone_' || CAST({K} % 9 AS VARCHAR) || ' cycle complete' END AS value,
        event_id AS seq FROM events""",
    "vars": f"""SELECT * FROM (VALUES {_special}) t(id, name, datatype)
        UNION ALL
        SELECT u AS id,
          CASE WHEN u % 4 = 0 THEN 'ENERGY_METER_' || CAST(u AS VARCHAR)
               WHEN u % 4 = 1 THEN 'SPINDLE_POWER_KW_' || CAST(u AS VARCHAR)
               WHEN u % 4 = 2 THEN 'AXIS_TEMP_' || CAST(u AS VARCHAR)
               ELSE 'CYCLE_COUNTER_' || CAST(u AS VARCHAR) END AS name,
          'Float' AS datatype
        FROM (SELECT DISTINCT CAST(user_id AS INTEGER) AS u FROM events) WHERE u NOT IN ({_special_ids})
        UNION ALL
        SELECT u + {MSG_VAR_OFFSET} AS id,
          CASE WHEN u % 6 = 0 THEN 'ZONE_' || CAST(u % 10 AS VARCHAR) || '_ALARM'
               WHEN u % 6 = 1 THEN 'CONVEYOR ' || CAST(u % 7 AS VARCHAR) || ' FAULT'
               WHEN u % 6 = 2 THEN 'SPINDLE' || CAST(u % 3 AS VARCHAR) || '_ALERT'
               WHEN u % 6 = 3 THEN 'AXIS_' || chr(65 + u % 3) || '_ERROR_CODE'
               WHEN u % 6 = 4 THEN 'OPERATOR_NOTE_' || CAST(u AS VARCHAR)
               ELSE 'zone_' || CAST(u % 4 AS VARCHAR) || '_alarm' END AS name,
          'String' AS datatype
        FROM (SELECT DISTINCT CAST(user_id AS INTEGER) AS u FROM events)""",
    "units": """SELECT
          CASE WHEN id % 2 = 0 THEN name ELSE 'U_' || CAST(id AS VARCHAR) END AS name,
          CASE WHEN id % 2 = 1 THEN lower(name) ELSE 'Pretty ' || name END AS prettyname,
          CASE WHEN contains(name, 'KW') THEN 'kW' WHEN contains(name, 'ENERGY') THEN 'kWh'
               WHEN contains(name, 'TEMP') THEN 'C'
               WHEN contains(name, 'CONSUMO') OR contains(name, 'PCT') THEN '%' END AS units
        FROM vars WHERE id % 3 <> 2 AND datatype = 'Float'""",
    "elog": """SELECT ts AS energy_timestamp, CAST(value AS DOUBLE) AS kwh_value FROM events""",
    "prog_runs": """SELECT CAST(ts AS DATE) AS date, 'M' || CAST(user_id % 3 AS VARCHAR) AS machine,
        event_type AS program, CAST(value AS DOUBLE) AS duration_min FROM events""",
    "operating": """SELECT date, machine, SUM(duration_min) / 60.0 AS "Operating",
        greatest(24.0 - SUM(duration_min) / 60.0, 0.0) AS "Standby"
        FROM prog_runs GROUP BY date, machine""",
}

_DEPS = {"units": ["vars"], "operating": ["prog_runs"]}


def with_views(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the adapter views (and ``extra`` CTEs, in order)
    it references."""
    extra = extra or []
    text = body + " ".join(sql for _, sql in extra)
    needed: list[str] = []

    def need(name: str) -> None:
        for dep in _DEPS.get(name, []):
            need(dep)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            need(name)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in needed] + [f"{n} AS ({sql})" for n, sql in extra]
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + stripped[15:]
    if stripped[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + stripped[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
