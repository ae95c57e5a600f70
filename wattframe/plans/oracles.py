"""The registered queries as plain SQL for the check engine, written from the rules, not from the
Spark plans."""

from __future__ import annotations

from wattframe import schema as S
from wattframe.plans import tables

_D = "duckdb"
READINGS = f"readings AS ({tables.sql_select(tables.reading_columns(_D), 'events')})"
BATCH = f"batch AS ({tables.sql_select(tables.raw_batch_columns(_D), 'events')})"
FEED = f"feed AS ({tables.sql_select(tables.raw_feed_columns(_D), 'events')})"
SCORING = f"scoring AS ({tables.sql_select(tables.raw_scoring_columns(_D), 'events')})"
ENTITIES = (
    "entity AS (SELECT n_name AS casa_id, l_shipdate AS ts, l_quantity AS consumo_kwh, l_extendedprice AS costo "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
)
REPORTS = """reports AS (
  SELECT cast(o_orderkey AS varchar) AS id,
    strftime(CASE WHEN o_orderpriority = '5-LOW' THEN TIMESTAMP '2002-01-01 12:00:00' ELSE o_orderdate END, '%Y-%m-%d') AS fecha,
    o_orderpriority AS tipo, cast(o_custkey AS varchar) AS usuario,
    CASE WHEN o_orderstatus = 'P' THEN '—' ELSE 'PDF' END AS formato,
    CASE o_orderstatus WHEN 'F' THEN 'Listo' ELSE 'Pendiente' END AS estado
  FROM orders)"""
USERS = """users AS (
  SELECT c_name AS nombre, lower(replace(c_name, '#', '.')) || '@example.com' AS correo,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Administrador' ELSE 'Usuario' END AS rol,
    CASE WHEN c_acctbal > 0 THEN 'Activo' ELSE 'Suspendido' END AS estado
  FROM customer)"""
HISTORY = """history AS (
  SELECT id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fecha, cast(device_id AS varchar) AS dispositivo,
    '—' AS usuario, consumo_kwh AS consumo, round(cast(costo AS DECIMAL(38,8)), 2)::DOUBLE AS costo, estado
  FROM readings)"""
HISTORY_COLUMNS = "id, fecha, dispositivo, usuario, consumo, costo, estado"


def total(value: str, digits: int = 3) -> str:
    return f"coalesce(round(sum(cast({value} AS DECIMAL(18,6))), {digits})::DOUBLE, 0.0)"


def six(expr: str) -> str:
    return f"round({expr}, 6)"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


DAY_LABELS = _sql_list(d.capitalize() for d in S.WEEKDAYS)
DAYS = _sql_list(S.WEEKDAYS)


def weekday_of(ts: str) -> str:
    return f"list_extract([{DAYS}], isodow({ts})::INT)"


def by_hour(source: str, ts: str = "ts", value: str = "consumo_kwh") -> str:
    return (
        f"SELECT h::INT AS ord, lpad(h::varchar, 2, '0') AS label, coalesce(value, 0.0) AS value FROM range(24) r(h) "
        f"LEFT JOIN (SELECT hour({ts}) AS k, {total(value)} AS value FROM {source} GROUP BY 1) t ON t.k = h"
    )


def by_weekday(source: str, position: str, value: str = "consumo_kwh") -> str:
    return (
        f"SELECT d::INT AS ord, list_extract([{DAY_LABELS}], d::INT + 1) AS label, coalesce(value, 0.0) AS value "
        f"FROM range(7) r(d) LEFT JOIN (SELECT {position} AS k, {total(value)} AS value FROM {source} GROUP BY 1) t ON t.k = d"
    )


def series(source: str, label: str, k: int) -> str:
    return (
        f"SELECT {label} AS label, {total('consumo_kwh', 2)} AS value FROM {source} GROUP BY 1 "
        f"ORDER BY 1 DESC LIMIT {k}"
    )


# Number in a text; java-only suffixes never occur in the tables.
def number(c: str, finite: bool = True) -> str:
    value = f"try_cast({c} AS DOUBLE)"
    bad = f"isnan({value})" + (f" OR isinf({value})" if finite else "")
    return f"(CASE WHEN NOT ({bad}) THEN {value} END)"


def _digits(text: str) -> str:
    """The one or two digits a text starts with, as a number; null without any."""
    two = f"substr({text}, 1, 2)"
    return f"(CASE WHEN {two} SIMILAR TO '[0-9][0-9]' THEN {two}::INT WHEN {two} SIMILAR TO '[0-9].?' THEN {two}[1]::INT END)"


def clock(c: str) -> str:
    """Digits before the first colon are hours; those right after it, if it follows them, minutes."""
    text = f"ltrim({c})"
    hours = _digits(text)
    after = f"(CASE WHEN {text}[2] SIMILAR TO '[0-9]' THEN substr({text}, 3) ELSE substr({text}, 2) END)"
    minutes = f"(CASE WHEN {after}[1] = ':' THEN coalesce({_digits(f'substr({after}, 2)')}, 0) ELSE 0 END)"
    return (
        f"(CASE WHEN {hours} <= 23 AND {minutes} <= 59 "
        f"THEN lpad({hours}::varchar, 2, '0') || ':' || lpad({minutes}::varchar, 2, '0') END)"
    )


def moment(c: str) -> str:
    return f"try_cast(replace({c}, '/', '-') AS TIMESTAMP)"


def joined(day: str, hhmm: str) -> str:
    return moment(f"(trim({day}) || ' ' || {hhmm} || ':00')")


def weekday_label(c: str, ts: str) -> str:
    plain = f"lower(strip_accents(trim({c})))"
    names = [d.translate(str.maketrans("áéíóúü", "aeiouu")) for d in S.WEEKDAYS]
    cases = " ".join(
        f"WHEN {plain} IN ('{a}', '{b}') THEN '{d}'" for a, b, d in zip(names, S.WEEKDAYS_EN, S.WEEKDAYS)
    )
    return f"(CASE {cases} ELSE {weekday_of(ts)} END)"


# Feed rules.
_N = f"try_cast(nullif(timestamp, '') AS DOUBLE)"
_EPOCH = (
    f"(CASE WHEN abs({_N}) < 1e10 THEN make_timestamp(({_N} * 1000000)::BIGINT) "
    f"WHEN abs({_N}) / 1000 <= 253402300799 THEN make_timestamp(({_N} * 1000)::BIGINT) END)"
)
_PAIR = (
    "(CASE WHEN regexp_matches(hora[1:5], '^\\d{2}:\\d{2}$') THEN try_cast(nullif(fecha, '') || ' ' || hora[1:5] || ':00' AS TIMESTAMP) END)"
)
EVENT_TIME = f"coalesce({_EPOCH}, try_cast(replace(nullif(datetime, ''), 'Z', '') AS TIMESTAMP), {_PAIR})"
SHORT_TIME = f"coalesce({_EPOCH}, try_cast(replace(nullif(datetime, ''), 'Z', '') AS TIMESTAMP))"
POWER = f"coalesce({number('active_power')}, 0)"
_KWH = f"coalesce({number('consumo_kwh')}, 0)"
_PROXY = f"coalesce({number('''coalesce(nullif(active_power, ''), consumo)''')}, 0)"
CONSUMPTION = f"(CASE WHEN {_KWH} <> 0 THEN {_KWH} ELSE abs({_PROXY}) END)"
REVERSED = f"(coalesce({number('current')}, 0) < 0)"
DASH_STATUS = f"lower(CASE WHEN {REVERSED} THEN 'inverso' ELSE coalesce(nullif(estado, ''), 'activo') END)"
DEVICE_STATUS = f"coalesce(nullif(lower(estado), ''), CASE WHEN {REVERSED} THEN 'inactivo' ELSE 'activo' END)"
HISTORY_STATUS = f"(CASE WHEN {REVERSED} THEN '{S.HISTORY_REVERSE}' ELSE '{S.HISTORY_NORMAL}' END)"
DEVICE = "coalesce(nullif(device_id, ''), nullif(dispositivo, ''), 'Smart Plug')"
OK_STATUS = "('activo', 'normal', 'ok')"

# Batch rules: three time sources per row, the best one per batch, dated rows.
_TS = moment("timestamp")
_HD = joined("fecha", f"{clock('hora_dia')}[1:2] || ':00'")
_HO = joined("fecha", f"{clock('hora')}[1:2] || ':00'")
SOURCES = f"""timed AS (SELECT *, {_TS} AS t0, {_HD} AS t1, {_HO} AS t2 FROM batch),
choice AS (
  SELECT batch_id, unnest([
    {{'ord': 0, 'name': 'timestamp', 'n': count(t0), 'p': avg((hour(t0) = 0)::INT)}},
    {{'ord': 1, 'name': 'fecha+hora_dia', 'n': count(t1), 'p': avg((hour(t1) = 0)::INT)}},
    {{'ord': 2, 'name': 'fecha+hora', 'n': count(t2), 'p': avg((hour(t2) = 0)::INT)}}]) AS c
  FROM timed GROUP BY batch_id),
best AS (
  SELECT batch_id, c.name AS source, c.n AS n_valid, c.p AS share_midnight FROM choice WHERE c.n > 0
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY c.p, c.ord) = 1),
dated AS (
  SELECT * FROM (
    SELECT timed.*, source, CASE source WHEN 'timestamp' THEN t0 WHEN 'fecha+hora_dia' THEN t1 ELSE t2 END AS ts
    FROM timed JOIN best USING (batch_id)) WHERE ts IS NOT NULL),
mined AS (
  SELECT id, batch_id, ts, {weekday_label('dia_semana', 'ts')} AS dia, casa_id,
    coalesce({number('consumo_kwh', False)}, 0.0) AS consumo_kwh,
    coalesce({number('costo_estimado', False)}, {number('costo_mx', False)}, 0.0) AS costo
  FROM dated)"""
MINED = f"WITH {BATCH}, {SOURCES} "
DAY_POSITION = f"list_position([{DAYS}], dia) - 1"

# The same file as one batch.
WHOLE = MINED.replace(f"({tables.sql_select(tables.raw_batch_columns(_D), 'events')})", (
    "(SELECT * REPLACE ('all' AS batch_id) FROM (" + tables.sql_select(tables.raw_batch_columns(_D), "events") + "))"))

# The same rows as four files in order of id, cut into chunks that are numbered through the files.
_RAW = tables.sql_select(tables.raw_batch_columns(_D), "events")
CHUNKED = MINED.replace(f"({_RAW})", f"""(
  SELECT t.* REPLACE ((e.earlier + (row_number() OVER (PARTITION BY t.id % 4 ORDER BY t.id) - 1) // {{k}})::BIGINT AS batch_id)
  FROM ({_RAW}) t JOIN (
    SELECT p, (sum(c) OVER (ORDER BY p) - c)::BIGINT AS earlier
    FROM (SELECT event_id % 4 AS p, ceil(count(*) / {{k}})::BIGINT AS c FROM events GROUP BY 1)) e ON e.p = t.id % 4)""")
CHUNKED = CHUNKED.replace("{k}", "300")

SHOWN = f"""shown AS (
  SELECT id, {moment('timestamp')} AS fecha, 'Smart Plug' AS dispositivo, casa_id AS usuario,
    coalesce({number('consumo_kwh', False)}, 0.0) AS consumo_kwh, coalesce({number('costo_mx', False)}, 0.0) AS costo_mx,
    coalesce(lower(trim(upper(dia_semana))), 'activo') AS estado
  FROM batch WHERE timestamp IS NOT NULL AND consumo_kwh IS NOT NULL AND {moment('timestamp')} IS NOT NULL)"""

def _read(c: str) -> str:
    """A field as a CSV file gives it, where the usual texts for a missing one are null."""
    return f"CASE WHEN {c} NOT IN ({_sql_list(S.MISSING_TEXTS)}) THEN {c} END"


# The same rows out of a CSV file, where the usual texts for a missing field are null.
_FIELDS = ("timestamp", "consumo_kwh", "costo_mx", "dia_semana", "casa_id")
SHOWN_CSV = (
    "file AS (SELECT id, " + ", ".join(f"CASE WHEN {c} NOT IN ({_sql_list(S.MISSING_TEXTS)}) THEN {c} END AS {c}" for c in _FIELDS)
    + " FROM batch), " + SHOWN.replace("FROM batch", "FROM file")
)

R = f"WITH {READINGS} "
F_ = f"WITH {FEED} "
# The live feed's last copy per key: every 20th record came again with a new value, every 40th earlier.
L_ = f"""WITH sent AS ({tables.sql_select(tables.reading_columns(_D), 'events')}),
readings AS (SELECT id, CASE WHEN id % 40 = 0 THEN ts - INTERVAL 20 DAY ELSE ts END AS ts, device_id, estado,
  CASE WHEN id % 20 = 0 THEN consumo_kwh + 1 ELSE consumo_kwh END AS consumo_kwh, costo FROM sent) """
ANCHOR = "(SELECT max(ts) FROM readings)"
MONTH = f"date_trunc('month', ts) = date_trunc('month', {ANCHOR})"
NEWEST = "ORDER BY ts DESC, id DESC"
STATS = "s AS (SELECT count(consumo_kwh) AS n, avg(consumo_kwh) AS mean, stddev_pop(consumo_kwh) AS sd FROM {})"
LATEST = "latest AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, id DESC) = 1)"
SPLIT = (
    "SELECT count(*) FILTER (estado IN ('activo', 'normal', 'ok') AND ts >= {a} - INTERVAL 6 HOUR) AS activos, "
    "count(*) - count(*) FILTER (estado IN ('activo', 'normal', 'ok') AND ts >= {a} - INTERVAL 6 HOUR) AS inactivos FROM latest {w}"
)
SAMPLE = (
    "hashed AS (SELECT *, strftime(ts, '%Y-%m-%d') AS batch_id, md5(id::varchar || ':42') AS h FROM readings), "
    "pool AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY h, id) <= {n} ORDER BY h, id LIMIT 5000)"
)

_CLEAN = f"""clean AS (
  SELECT id, {', '.join(f"{number(c)} AS {c}" for c in S.SCORING_NUMERIC)},
    coalesce(estado, 'activo') AS estado, coalesce(hora_dia, '00:00') AS hora_dia,
    coalesce(dia_semana, 'lunes') AS dia_semana, coalesce(casa_id, 'Puebla') AS casa_id,
    coalesce(try_cast(try_cast(modo_ecologico_activado AS DOUBLE) AS INT), 0) AS modo_ecologico_activado
  FROM scoring
  WHERE {' AND '.join(f"{number(c)} IS NOT NULL" for c in S.SCORING_NUMERIC)})"""


def _feature_sql() -> str:
    estado = f"CASE WHEN estado IN ({_sql_list(S.STATUSES)}) THEN estado ELSE 'activo' END"
    dia = f"CASE WHEN lower(trim(dia_semana)) IN ({DAYS}) THEN lower(trim(dia_semana)) ELSE 'lunes' END"
    casa = f"CASE WHEN casa_id IN ({_sql_list(S.MUNICIPALITIES)}) THEN casa_id ELSE 'Puebla' END"
    coded = (
        f"coded AS (SELECT id, {', '.join(S.SCORING_NUMERIC)}, modo_ecologico_activado, {estado} AS estado, "
        f"hora_dia[1:5] AS hora_dia, {dia} AS dia_semana, {casa} AS casa_id FROM clean)"
    )
    vocabulary = {
        "estado": S.STATUSES,
        "hora_dia": [f"{h:02d}:00" for h in range(24)],
        "dia_semana": S.WEEKDAYS,
        "casa_id": S.MUNICIPALITIES,
    }
    dummies = ", ".join(
        f"({name} = '{level}')::INT AS \"{name}_{level}\""
        for name, values in vocabulary.items()
        for level in sorted(values)[1:]
    )
    return (
        f"WITH {SCORING}, {_CLEAN}, {coded} SELECT id, {', '.join(S.SCORING_NUMERIC)}, "
        f"modo_ecologico_activado, {dummies} FROM coded"
    )


_TOTAL_BY_ENTITY = f"SELECT casa_id, {total('consumo_kwh')} AS total FROM entity GROUP BY 1"
_HOURLY = by_hour("readings")

ORACLES: dict[str, str] = {
    "energy_by_hour": R + _HOURLY,
    "energy_by_weekday": R + by_weekday("readings", "isodow(ts) - 1"),
    "energy_by_labelled_weekday": MINED + by_weekday("mined", DAY_POSITION),
    "energy_by_entity": f"WITH {ENTITIES} {_TOTAL_BY_ENTITY}",
    "energy_by_device": R + f"SELECT device_id, {total('consumo_kwh')} AS total FROM readings GROUP BY 1",
    "top_entities": f"WITH {ENTITIES} {_TOTAL_BY_ENTITY} ORDER BY total DESC, casa_id LIMIT 10",
    "monthly_series": f"WITH {ENTITIES} " + series("entity", "strftime(ts, '%Y-%m')", 7),
    "monthly_series_live": f"WITH {ENTITIES} " + series("entity", "strftime(ts, '%Y-%m')", 6),
    "daily_series": R + series("readings", "strftime(ts, '%Y-%m-%d')", 7),
    "cumulative_hour_share": R + f", t AS ({_HOURLY}) SELECT ord, label, "
    + six("sum(value) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) / sum(value) OVER () * 100") + " AS share FROM t",
    "record_counts": R + "SELECT count(*) AS n_registros, count(DISTINCT device_id) AS n_municipios FROM readings",
    "month_card": R + f"SELECT {total('consumo_kwh', 2)} AS consumo FROM readings WHERE {MONTH}",
    "quantile_value": R + f"SELECT {six('quantile_cont(consumo_kwh, 0.95)')} AS quantile FROM readings",
    "alert_card": R + f", m AS (SELECT * FROM readings WHERE {MONTH}) SELECT count(*) AS alertas FROM m "
    "WHERE consumo_kwh > (SELECT quantile_cont(consumo_kwh, 0.95) FROM m)",
    "above_p95_rows": R + "SELECT id, consumo_kwh FROM readings WHERE consumo_kwh > (SELECT quantile_cont(consumo_kwh, 0.95) FROM readings)",
    "active_rows_card": R + f"SELECT count(*) AS activos FROM readings WHERE estado = 'activo' AND ts >= {ANCHOR} - INTERVAL 7 DAY",
    "card_bundle": R + f", m AS (SELECT * FROM readings WHERE {MONTH}) SELECT "
    f"(SELECT {total('consumo_kwh', 2)} FROM m) AS consumo, "
    "(SELECT count(*) FROM m WHERE consumo_kwh > (SELECT quantile_cont(consumo_kwh, 0.95) FROM m)) AS alertas, "
    f"(SELECT count(*) FROM readings WHERE estado = 'activo' AND ts >= {ANCHOR} - INTERVAL 7 DAY) AS activos",
    "live_card_bundle": R + f", p AS (SELECT * FROM readings {NEWEST} LIMIT 500), {STATS.format('p')} SELECT "
    f"(SELECT {total('consumo_kwh', 2)} FROM readings WHERE {MONTH}) AS consumo, "
    "(SELECT count(*) FROM p, s WHERE abs((consumo_kwh - mean) / sd) >= 3) AS alertas, "
    f"(SELECT count(DISTINCT device_id) FROM readings WHERE ts >= {ANCHOR} - INTERVAL 6 HOUR) AS activos",
    "value_spread": R + f", {STATS.format('readings')} SELECT n, {six('mean')} AS mean, {six('sd')} AS sd FROM s",
    "zscore_count": R + f", {STATS.format('readings')} SELECT count(*) AS n_anomalias FROM readings, s WHERE abs((consumo_kwh - mean) / sd) >= 3 AND n >= 30",
    "zscore_newest": R + f", p AS (SELECT * FROM readings {NEWEST} LIMIT 500), {STATS.format('p')} "
    "SELECT count(*) AS n_anomalias FROM p, s WHERE abs((consumo_kwh - mean) / sd) >= 3",
    "zscore_labels": R + f", {STATS.format('readings')} SELECT id, consumo_kwh, {six('abs((consumo_kwh - mean) / sd)')} AS z, "
    "CASE WHEN abs((consumo_kwh - mean) / sd) >= 3 THEN 'anomalo' ELSE 'normal' END AS etiqueta FROM readings, s",
    "zscore_pool": R + f", p AS (SELECT * FROM readings {NEWEST} LIMIT 800), {STATS.format('p')} "
    f"SELECT (row_number() OVER ({NEWEST}) - 1)::INT AS position, id, consumo_kwh, "
    "CASE WHEN abs((consumo_kwh - mean) / sd) >= 3 THEN 'anomalo' ELSE 'normal' END AS etiqueta FROM p, s",
    "value_histogram": R + ", e AS (SELECT min(consumo_kwh) AS lo, greatest(8, least(40, floor(sqrt(count(*)))))::INT AS bins, "
    "greatest(max(consumo_kwh) - min(consumo_kwh), 1e-9) AS span FROM readings), "
    "c AS (SELECT greatest(0, least(floor((consumo_kwh - lo) / (span / bins))::INT, bins - 1)) AS bin, count(*) AS n "
    "FROM readings, e GROUP BY 1), "
    "a AS (SELECT unnest(range(bins))::INT AS bin, lo, span / bins AS step FROM e) "
    f"SELECT a.bin, {six('lo + a.bin * step')} AS lower, {six('lo + a.bin * step + step')} AS upper, "
    "printf('%.1f', lo + a.bin * step) || ' – ' || printf('%.1f', lo + a.bin * step + step) AS label, coalesce(n, 0) AS n "
    "FROM a LEFT JOIN c ON a.bin = c.bin",
    "mining_summary": R + f", {STATS.format('readings')} SELECT (SELECT count(*) FROM readings) AS n_registros, "
    "(SELECT count(DISTINCT device_id) FROM readings) AS n_municipios, "
    "(SELECT count(*) FROM readings, s WHERE abs((consumo_kwh - mean) / sd) >= 3) AS n_anomalias, 3.0::DOUBLE AS z_threshold",
    "last_seen": R + f"SELECT device_id, {stamp('max(ts)')} AS last_seen FROM readings GROUP BY 1",
    "active_devices": R + f"SELECT count(DISTINCT device_id) AS activos FROM readings WHERE ts >= {ANCHOR} - INTERVAL 6 HOUR",
    "active_split": R + f", {LATEST} " + SPLIT.format(a=ANCHOR, w=""),
    "active_split_searched": R + f", {LATEST} " + SPLIT.format(a=ANCHOR, w="WHERE contains(device_id::varchar, '1')"),
    "latest_per_device": R + f", {LATEST} SELECT * REPLACE ({stamp('ts')} AS ts) FROM latest",
    "latest_history": R + f", {HISTORY} SELECT {HISTORY_COLUMNS} FROM history {NEWEST} LIMIT 500",
    "history_limited": R + f", {HISTORY} SELECT {HISTORY_COLUMNS} FROM history {NEWEST} LIMIT 1",
    "history_search": R + f", {HISTORY} SELECT {HISTORY_COLUMNS} FROM history WHERE contains(lower(estado), 'conexi') "
    "OR contains(fecha, 'conexi') OR contains(dispositivo, 'conexi')",
    "history_page": R + f", {HISTORY}, f AS (SELECT * FROM history WHERE contains(estado, 'activo')) "
    f"SELECT {HISTORY_COLUMNS}, 3 AS page, (SELECT ceil(count(*) / 7.0)::INT FROM f) AS pages FROM f ORDER BY ts DESC, id LIMIT 7 OFFSET 14",
    "history_last_page": R + f", {HISTORY}, f AS (SELECT * FROM history {NEWEST} LIMIT 30) "
    f"SELECT {HISTORY_COLUMNS}, 5 AS page, 5 AS pages FROM f ORDER BY ts DESC, id LIMIT 7 OFFSET 28",
    "history_page_after": R + f", {HISTORY} SELECT {HISTORY_COLUMNS} FROM history WHERE ts < TIMESTAMP '2024-01-15 00:00:00' {NEWEST} LIMIT 7",
    "formatted_values": R + "SELECT id, format('{:,.2f}', consumo_kwh * 1000) AS miles, "
    "round(cast(consumo_kwh / 7 AS DECIMAL(38,9)), 3)::DOUBLE AS tres, "
    "upper(estado[1:1]) || estado[2:] AS estado, strftime(ts, '%Y-%m-%d %H:%M:%S') AS momento FROM readings",
    "batch_sample": R + f", {SAMPLE.format(n=400)} SELECT id, batch_id, consumo_kwh, costo FROM pool",
    "batch_sample_emitted": R + f", {SAMPLE.format(n=100)} SELECT consumo_kwh AS x, costo AS y FROM pool ORDER BY h, id LIMIT 1200",
    "next_reading_target": R + "SELECT id, device_id, consumo_kwh, lead(consumo_kwh) OVER w AS consumo_next, lead(costo) OVER w AS costo_next "
    "FROM readings WINDOW w AS (PARTITION BY device_id ORDER BY ts, id)",
    "last_n_scan": F_ + "SELECT id, timestamp, estado FROM feed ORDER BY id DESC LIMIT 2000",
    "batch_capped": f"WITH {BATCH} SELECT batch_id, count(*) AS n FROM batch GROUP BY 1 ORDER BY 1 LIMIT 7",
    "report_list": f"WITH {REPORTS} SELECT *, CASE WHEN lower(estado) = 'listo' THEN 'ok' ELSE 'alert' END AS clase FROM reports",
    "report_page": f"WITH {REPORTS} SELECT * FROM reports ORDER BY fecha DESC, id LIMIT 5 OFFSET 5",
    "report_search": f"WITH {REPORTS} SELECT * FROM reports WHERE contains(lower(tipo), 'urgent')",
    "report_count": "SELECT count(*) AS total FROM orders",
    "user_search": f"WITH {USERS} SELECT * FROM users WHERE contains(lower(rol), 'admin') OR contains(lower(nombre), 'admin') OR contains(correo, 'admin')",
    "user_status_counts": f"WITH {USERS} SELECT count(*) FILTER (estado = 'Activo') AS activos, count(*) FILTER (estado <> 'Activo') AS suspendidos FROM users",
    "role_class": f"WITH {USERS} SELECT nombre, CASE WHEN contains(lower(rol), 'admin') THEN 'admin' ELSE 'user' END AS clase, "
    "nombre[1:1] AS inicial, CASE WHEN estado = 'Activo' THEN 'ok' ELSE 'alert' END AS estado FROM users",
    "clean_numeric": f"WITH {BATCH} SELECT id, coalesce({number('consumo_kwh', False)}, 0.0) AS consumo_kwh FROM batch",
    "clean_cost": f"WITH {BATCH} SELECT id, coalesce({number('costo_estimado', False)}, {number('costo_mx', False)}, 0.0) AS costo FROM batch",
    "clean_time": f"WITH {BATCH} SELECT id, {clock('hora_dia')} AS hhmm FROM batch",
    "clean_date": f"WITH {BATCH} SELECT id, strftime({moment('timestamp')}, '%Y-%m-%d %H:%M:%S') AS momento, "
    f"strftime({moment('fecha')}, '%Y-%m-%d') AS dia, strftime({joined('fecha', clock('hora_dia'))}, '%Y-%m-%d %H:%M:%S') AS junto FROM batch",
    "clean_weekday": f"WITH {BATCH} SELECT id, {weekday_label('dia_semana', 'batch_id::TIMESTAMP')} AS dia FROM batch",
    "clean_event_time": F_ + f"SELECT id, strftime({EVENT_TIME}, '%Y-%m-%d %H:%M:%S') AS momento FROM feed",
    "calendar_parts": R + "SELECT id, hour(ts)::INT AS hora, strftime(ts, '%H') AS hora_texto, strftime(ts, '%Y-%m-%d') AS dia, "
    f"strftime(ts, '%Y-%m') AS mes, {weekday_of('ts')} AS dia_semana FROM readings",
    "clean_consumption": F_ + f"SELECT id, {CONSUMPTION} AS consumo, {six(f'{CONSUMPTION} * CAST(0.0015 AS DOUBLE)')} AS costo, "
    f"{six(f'abs({POWER}) / 1000')} AS kwh, {POWER} AS watts FROM feed",
    "clean_domain": f"WITH {SCORING} SELECT id, CASE WHEN estado IN ({_sql_list(S.STATUSES)}) THEN estado ELSE 'activo' END AS estado, "
    f"CASE WHEN casa_id IN ({_sql_list(S.MUNICIPALITIES)}) THEN casa_id ELSE 'Puebla' END AS casa_id FROM scoring",
    "clean_status": F_ + f"SELECT id, {DASH_STATUS} AS tablero, {DEVICE_STATUS} AS equipo, {HISTORY_STATUS} AS historia, "
    "coalesce(lower(trim(estado)), 'activo') AS lote FROM feed",
    "clean_text": F_ + f"SELECT id, {DEVICE} AS equipo, coalesce(nullif(device_id, ''), '—') AS historia, "
    "coalesce(nullif(usuario, ''), '—') AS usuario, coalesce(nullif(tipo, ''), '—') AS tipo, hora[1:5] AS hora FROM feed",
    "status_class": F_ + f"SELECT id, CASE WHEN lower(estado) IN {OK_STATUS} THEN 'ok' ELSE 'alert' END AS lectura, "
    f"CASE WHEN {REVERSED} THEN 'alert' ELSE 'ok' END AS historia FROM feed",
    "json_fields": "SELECT event_id AS id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "json_feed": F_ + "SELECT id::varchar AS id, timestamp, estado, usuario FROM feed",
    "complete_rows": f"WITH {BATCH} SELECT id, fecha, casa_id FROM batch WHERE fecha IS NOT NULL AND consumo_kwh IS NOT NULL AND casa_id IS NOT NULL",
    "standardised_readings": F_ + f", t AS (SELECT *, {EVENT_TIME} AS ts FROM feed) SELECT id, {stamp('ts')} AS ts, "
    f"strftime(ts, '%Y-%m-%d') AS fecha, strftime(ts, '%Y-%m') AS yyyymm, {DEVICE} AS device_id, {CONSUMPTION} AS consumo, "
    f"{six(f'{CONSUMPTION} * CAST(0.0015 AS DOUBLE)')} AS costo, {DASH_STATUS} AS estado FROM t WHERE ts > TIMESTAMP '1970-01-01'",
    "untimed_dropped": F_ + f"SELECT id FROM feed WHERE {SHORT_TIME} > TIMESTAMP '1970-01-01'",
    "device_list": F_ + f", t AS (SELECT *, {EVENT_TIME} AS ts FROM feed), u AS (SELECT id, ts, {DEVICE} AS device_id, "
    f"coalesce(nullif(usuario, ''), '—') AS usuario, coalesce(nullif(tipo, ''), '—') AS tipo, {POWER} AS consumo_w, "
    f"{DEVICE_STATUS} AS estado FROM t WHERE ts > TIMESTAMP '1970-01-01') SELECT * REPLACE ({stamp('ts')} AS ts) FROM u "
    "QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY u.ts DESC, id DESC) = 1",
    "history_rows": F_ + f"SELECT id, coalesce(nullif(device_id, ''), '—') AS dispositivo, '—' AS usuario, "
    f"coalesce(round(try_cast(abs({POWER}) / 1000 AS DECIMAL(38,9)), 3)::DOUBLE, abs({POWER}) / 1000) AS consumo, "
    f"coalesce(round(try_cast(abs({POWER}) / 1000 * CAST(3.2 AS DOUBLE) AS DECIMAL(38,8)), 2)::DOUBLE, abs({POWER}) / 1000 * CAST(3.2 AS DOUBLE)) AS costo, {HISTORY_STATUS} AS estado, "
    f"coalesce(strftime({SHORT_TIME}, '%Y-%m-%d'), '—') AS fecha FROM feed",
    "current_month_rows": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS dia, l_quantity AS consumo_kwh, l_extendedprice AS costo FROM lineitem "
    "WHERE date_trunc('month', l_shipdate) = (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem)",
    "last_week_rows": R + f"SELECT id, consumo_kwh FROM readings WHERE ts >= {ANCHOR} - INTERVAL 7 DAY",
    "renamed_history": f"WITH {BATCH} SELECT strftime({moment('fecha')}, '%Y-%m-%d %H:%M:%S') AS fecha, 'Smart Plug' AS dispositivo, "
    f"'—' AS usuario, coalesce({number('consumo_kwh', False)}, 0.0) AS consumo, coalesce({number('costo_mx', False)}, 0.0) AS costo, "
    f"'activo' AS estado FROM batch WHERE {moment('fecha')} IS NOT NULL AND consumo_kwh IS NOT NULL",
    "best_hour_source": f"WITH {BATCH}, {SOURCES} SELECT batch_id, source, n_valid, {six('share_midnight')} AS share_midnight FROM best",
    "hour_profile": MINED + ", c AS (SELECT batch_id, source AS hour_source, hour(ts)::INT AS hour, count(*) AS n FROM dated GROUP BY ALL) "
    f"SELECT *, {six('n / sum(n) OVER (PARTITION BY batch_id)')} AS share FROM c",
    "mining_readings": MINED + f"SELECT * REPLACE ({stamp('ts')} AS ts) FROM mined",
    "mined_hours": MINED + by_hour("mined"),
    "mined_weekdays": MINED + by_weekday("mined", DAY_POSITION),
    "mined_top": MINED + f"SELECT casa_id AS municipio, {total('consumo_kwh')} AS total FROM mined WHERE casa_id IS NOT NULL "
    "GROUP BY 1 ORDER BY total DESC, municipio LIMIT 10",
    "mined_summary": MINED + f", {STATS.format('mined')} SELECT (SELECT count(*) FROM mined) AS n_registros, "
    "(SELECT count(DISTINCT casa_id) FROM mined) AS n_municipios, "
    "(SELECT count(*) FROM mined, s WHERE abs((consumo_kwh - mean) / sd) >= 3) AS n_anomalias, 3.0::DOUBLE AS z_threshold",
    "mined_scatter": MINED + ", h AS (SELECT *, md5(id::varchar || ':42') AS h FROM mined), "
    "p AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY h, id) <= 400 ORDER BY h, id LIMIT 5000) "
    "SELECT consumo_kwh AS x, costo AS y FROM p ORDER BY h, id LIMIT 1200",
    "mining_bundle": WHOLE + f", {STATS.format('mined')}, r AS (SELECT count(*) AS n, count(DISTINCT casa_id) AS m FROM mined) "
    f"SELECT 'consumo_hora' AS result, label, value FROM ({by_hour('mined')}) "
    f"UNION ALL SELECT 'consumo_dia', label, value FROM ({by_weekday('mined', DAY_POSITION)}) "
    f"UNION ALL SELECT 'top_dispositivos', casa_id, total FROM (SELECT casa_id, {total('consumo_kwh')} AS total FROM mined "
    "WHERE casa_id IS NOT NULL GROUP BY 1 ORDER BY total DESC, casa_id LIMIT 10) "
    "UNION ALL SELECT 'resumen', 'n_registros', n::DOUBLE FROM r UNION ALL SELECT 'resumen', 'n_municipios', m::DOUBLE FROM r "
    "UNION ALL SELECT 'resumen', 'n_anomalias', (SELECT count(*) FROM mined, s WHERE abs((consumo_kwh - mean) / sd) >= 3)::DOUBLE "
    "UNION ALL SELECT 'resumen', 'z_threshold', 3.0::DOUBLE UNION ALL SELECT 'consumo_vs_costo', 'n', least(n, 400)::DOUBLE FROM r",
    "mining_bundle_points": WHOLE + ", h AS (SELECT *, md5(id::varchar || ':42') AS h FROM mined) "
    "SELECT consumo_kwh AS x, costo AS y FROM h ORDER BY h, id::varchar LIMIT 400",
    "dashboard_bundle_history": f"WITH {BATCH}, {SHOWN_CSV} SELECT strftime(fecha, '%Y-%m-%d %H:%M:%S') AS fecha, dispositivo, usuario, "
    "consumo_kwh AS consumo, costo_mx AS costo, estado FROM (SELECT * FROM shown ORDER BY fecha DESC, id::varchar DESC LIMIT 500)",
    "dashboard_bundle": f"WITH {BATCH}, {SHOWN_CSV}, m AS (SELECT * FROM shown WHERE date_trunc('month', fecha) = (SELECT date_trunc('month', max(fecha)) FROM shown)) "
    f"SELECT 'cards' AS result, 'consumo' AS label, (SELECT {total('consumo_kwh', 2)} FROM m) AS value "
    "UNION ALL SELECT 'cards', 'alertas', (SELECT count(*) FROM m WHERE consumo_kwh > (SELECT quantile_cont(consumo_kwh, 0.95) FROM m))::DOUBLE "
    "UNION ALL SELECT 'cards', 'activos', (SELECT count(*) FROM shown WHERE estado = 'activo' AND fecha >= (SELECT max(fecha) FROM shown) - INTERVAL 7 DAY)::DOUBLE "
    f"UNION ALL SELECT 'semanal', label, value FROM (SELECT strftime(fecha, '%Y-%m-%d') AS label, {total('consumo_kwh', 2)} AS value FROM shown GROUP BY 1 ORDER BY 1 DESC LIMIT 7) "
    f"UNION ALL SELECT 'mensual', label, value FROM (SELECT strftime(fecha, '%Y-%m') AS label, {total('consumo_kwh', 2)} AS value FROM shown GROUP BY 1 ORDER BY 1 DESC LIMIT 7) "
    "UNION ALL SELECT 'historico', 'n', least(count(*), 500)::DOUBLE FROM shown",
    "dashboard_cards": f"WITH {BATCH}, {SHOWN}, m AS (SELECT * FROM shown WHERE date_trunc('month', fecha) = (SELECT date_trunc('month', max(fecha)) FROM shown)) "
    f"SELECT (SELECT {total('consumo_kwh', 2)} FROM m) AS consumo, "
    "(SELECT count(*) FROM m WHERE consumo_kwh > (SELECT quantile_cont(consumo_kwh, 0.95) FROM m)) AS alertas, "
    "(SELECT count(*) FROM shown WHERE estado = 'activo' AND fecha >= (SELECT max(fecha) FROM shown) - INTERVAL 7 DAY) AS activos",
    "dashboard_daily": f"WITH {BATCH}, {SHOWN} SELECT strftime(fecha, '%Y-%m-%d') AS label, {total('consumo_kwh', 2)} AS value "
    "FROM shown GROUP BY 1 ORDER BY 1 DESC LIMIT 7",
    "dashboard_monthly": f"WITH {BATCH}, {SHOWN} SELECT strftime(fecha, '%Y-%m') AS label, {total('consumo_kwh', 2)} AS value "
    "FROM shown GROUP BY 1 ORDER BY 1 DESC LIMIT 7",
    "scoring_records": f"WITH {SCORING}, {_CLEAN} SELECT * FROM clean",
    "scoring_rejects": f"WITH {SCORING} SELECT id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {number(c)} IS NULL THEN '{c}' END" for c in S.SCORING_NUMERIC)
    + f") AS faltan FROM scoring WHERE {' OR '.join(f'{number(c)} IS NULL' for c in S.SCORING_NUMERIC)}",
    "scoring_json": f"WITH {SCORING}, {_CLEAN} SELECT * FROM clean WHERE id % 37 <> 0",
    "scoring_json_rejects": f"WITH {SCORING} SELECT CASE WHEN id % 37 = 0 THEN 'registro' ELSE concat_ws(',', "
    + ", ".join(f"CASE WHEN {number(c)} IS NULL THEN '{c}' END" for c in S.SCORING_NUMERIC)
    + ") END AS faltan, count(*) AS n, count(*) FILTER (id % 37 = 0) AS ilegibles FROM scoring WHERE id % 37 = 0 OR "
    + " OR ".join(f"{number(c)} IS NULL" for c in S.SCORING_NUMERIC) + " GROUP BY 1",
    "feature_matrix": _feature_sql(),
    "model_scores": f"WITH {SCORING}, {_CLEAN} SELECT id, true AS consumo_kwh_next, true AS costo_mx_next FROM clean",
    "score_count": f"WITH {SCORING}, {_CLEAN} SELECT count(*) AS n FROM clean",
    "tiny_and_huge_totals": R + "SELECT device_id, round(fsum(consumo_kwh * 1e-8), 12) AS tiny, "
    "sum(cast(round(consumo_kwh * 1e13) AS DECIMAL(38,0)))::DOUBLE AS huge FROM readings GROUP BY 1",
    "infinite_reading_flags_nobody": R + "SELECT 0::BIGINT AS n_anomalias, count(*) FILTER (id <> 1)::BIGINT AS en_barras FROM readings",
    "csv_scan": f"WITH {BATCH} SELECT casa_id, timestamp, coalesce({number('consumo_kwh', False)}, 0.0) AS consumo_kwh FROM batch",
    "csv_chunks": CHUNKED + f"SELECT batch_id, n, source, n_valid, {six('share_midnight')} AS share_midnight FROM best "
    "JOIN (SELECT batch_id, count(*) AS n FROM batch GROUP BY 1) USING (batch_id)",
    "csv_chunks_capped": CHUNKED + "SELECT id, batch_id FROM batch WHERE batch_id < 7",
    "csv_chunk_sample": CHUNKED + ", h AS (SELECT *, md5(id::varchar || ':42') AS h FROM mined) SELECT id, batch_id, consumo_kwh, costo "
    "FROM h QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY h, id) <= 40 ORDER BY h, id LIMIT 5000",
    "csv_mixed_headers": f"WITH {BATCH} SELECT id, CASE id % 3 WHEN 0 THEN casa_id END AS casa_id, "
    f"CASE WHEN id % 3 <> 1 THEN {_read('timestamp')} END AS timestamp, CASE id % 3 WHEN 1 THEN {_read('fecha')} END AS fecha, "
    f"CASE id % 3 WHEN 1 THEN {_read('hora_dia')} END AS hora_dia, CASE id % 3 WHEN 0 THEN {_read('costo_mx')} END AS costo_mx, "
    f"CASE id % 3 WHEN 2 THEN {_read('dia_semana')} END AS dia_semana, coalesce({number('consumo_kwh', False)}, 0.0) AS consumo_kwh FROM batch",
    "parquet_scan": f"WITH {BATCH} SELECT fecha, consumo_kwh, 0.0::DOUBLE AS costo_mx, 'activo' AS estado, 'Smart Plug' AS dispositivo, '—' AS usuario FROM batch",
    "csv_roundtrip": R + f", {HISTORY} SELECT fecha, dispositivo, usuario, consumo::varchar AS consumo_kwh, printf('%.2f', costo) AS costo_mxn, estado FROM history",
    "json_cache_roundtrip": R + _HOURLY,
    "report_append": "WITH l AS (SELECT o_orderpriority AS tipo, CASE o_orderstatus WHEN 'F' THEN 'Listo' WHEN 'O' THEN 'Pendiente' END AS estado FROM orders "
    "UNION ALL SELECT 'Consumo mensual', 'Pendiente') SELECT tipo, estado, count(*) AS n FROM l GROUP BY ALL",
    "report_compacted": "WITH l AS (SELECT o_orderpriority AS tipo, CASE o_orderstatus WHEN 'F' THEN 'Listo' WHEN 'O' THEN 'Pendiente' END AS estado FROM orders "
    "UNION ALL SELECT 'Consumo mensual', 'Pendiente' FROM range(3)) SELECT tipo, estado, count(*) AS n FROM l GROUP BY ALL",
    "live_windowed_daily": f"WITH readings AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN ts - INTERVAL 40 DAY ELSE ts END AS ts, "
    f"value AS consumo_kwh FROM events) SELECT strftime(ts, '%Y-%m-%d') AS label, {total('consumo_kwh', 2)} AS value FROM readings GROUP BY 1",
    "live_late_rows": "SELECT event_id % 4 = 3 AS ultimo, count(*) AS n, event_id % 4 = 3 AS todo_tarde FROM events GROUP BY 1",
    "rollup_months": f"SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS n, {total('l_quantity', 2)} AS energy, "
    "true AS rank_ok, true AS entities_ok FROM lineitem GROUP BY 1",
    "live_last_n": L_ + f"SELECT id, device_id, estado, consumo_kwh FROM readings {NEWEST} LIMIT 2000",
    "live_alerts": L_ + f", p AS (SELECT * FROM readings {NEWEST} LIMIT 500), {STATS.format('p')} "
    "SELECT count(*) AS n_anomalias FROM p, s WHERE abs((consumo_kwh - mean) / sd) >= 3",
    "live_latest_per_device": L_ + f", {LATEST} SELECT * REPLACE ({stamp('ts')} AS ts) FROM latest",
    "live_active_split": L_ + f", {LATEST} " + SPLIT.format(a=ANCHOR, w=""),
    "live_daily": L_ + f"SELECT strftime(ts, '%Y-%m-%d') AS label, {total('consumo_kwh', 2)} AS value FROM readings GROUP BY 1",
    "live_monthly": L_ + f"SELECT strftime(ts, '%Y-%m') AS label, {total('consumo_kwh', 2)} AS value FROM readings GROUP BY 1",
    "live_dedup": L_ + "SELECT id, device_id, consumo_kwh FROM readings",
    "live_state_per_device": R + f", {LATEST} SELECT * REPLACE ({stamp('ts')} AS ts) FROM latest",
    "live_state_daily": R + f"SELECT strftime(ts, '%Y-%m-%d') AS label, {total('consumo_kwh', 2)} AS value FROM readings GROUP BY 1",
    "live_state_monthly": R + series("readings", "strftime(ts, '%Y-%m')", 6),
}
# The same answers by other ways to them.
ORACLES |= {
    "history_page_indexed": ORACLES["history_page"],
    "latest_history_by_day": ORACLES["latest_history"],
    "zscore_pool_by_day": ORACLES["zscore_pool"],
}
