"""The driver's tables as readings, entity readings, report log, users and raw records.

The raw tables carry every row of ``events`` with faults written over some fields, by rules on the
event id, so that the cleaning operators have work to do. Their rules are SQL text shared by Spark
and the check engine; only the spelling of date functions differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe import schema as S

_FUNCTIONS = {
    "spark": {
        "day": "date_format(ts, 'yyyy-MM-dd')",
        "hms": "date_format(ts, 'HH:mm:ss')",
        "hm": "date_format(ts, 'HH:mm')",
        "h": "cast(hour(ts) AS string)",
        "seconds": "cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS string)",
        "millis": "cast(timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS string)",
        "str": "string",
        "list": "array({})",
        "at": "element_at({}, cast({} AS int))",
    },
    "duckdb": {
        "day": "strftime(ts, '%Y-%m-%d')",
        "hms": "strftime(ts, '%H:%M:%S')",
        "hm": "strftime(ts, '%H:%M')",
        "h": "cast(hour(ts) AS varchar)",
        "seconds": "cast(date_diff('second', TIMESTAMP '1970-01-01', ts) AS varchar)",
        "millis": "cast(date_diff('millisecond', TIMESTAMP '1970-01-01', ts) AS varchar)",
        "str": "varchar",
        "list": "[{}]",
        "at": "list_extract({}, cast({} AS int))",
    },
}


def _spelling(dialect: str) -> dict[str, str]:
    f = dict(_FUNCTIONS[dialect])
    towns = f["list"].format(", ".join(f"'{m}'" for m in S.MUNICIPALITIES))
    f["town"] = f["at"].format(towns, "user_id % 13 + 1")
    f["v"] = f"cast(value AS {f['str']})"
    return f


def reading_columns(dialect: str = "spark") -> dict[str, str]:
    return {
        "id": "event_id",
        "ts": "ts",
        "device_id": "user_id",
        "estado": "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'activo' "
        "WHEN event_type = 'signup' THEN 'inactivo' ELSE 'sin conexión' END",
        "consumo_kwh": "value",
        "costo": f"value * {S.HISTORY_TARIFF}D" if dialect == "spark" else f"value * CAST({S.HISTORY_TARIFF} AS DOUBLE)",
    }


def raw_batch_columns(dialect: str = "spark") -> dict[str, str]:
    """A messy batch file with one batch per day."""
    f = _spelling(dialect)
    rules = {
        "id": "event_id",
        "batch_id": "{day}",
        "casa_id": "CASE WHEN event_id % 17 = 5 THEN NULL ELSE {town} END",
        "timestamp": "CASE WHEN event_id % 11 = 3 THEN NULL WHEN event_id % 23 = 7 THEN 'no time' "
        "WHEN day(ts) % 3 = 0 THEN concat({day}, ' 00:00:00') ELSE concat({day}, ' ', {hms}) END",
        "fecha": "CASE WHEN event_id % 29 = 4 THEN NULL WHEN event_id % 29 = 5 THEN '' "
        "WHEN event_id % 29 = 6 THEN replace({day}, '-', '/') ELSE {day} END",
        "hora_dia": "CASE event_id % 7 WHEN 0 THEN {hm} WHEN 1 THEN concat(' ', {h}, ':5') WHEN 2 THEN {h} "
        "WHEN 3 THEN concat({hm}, 'h') WHEN 4 THEN '24:00' WHEN 5 THEN '12:60' ELSE 'x' END",
        "hora": "CASE WHEN day(ts) % 6 = 0 THEN {h} ELSE '0' END",
        "consumo_kwh": "CASE event_id % 13 WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'NaN' "
        "WHEN 5 THEN concat(' ', {v}, ' ') ELSE {v} END",
        "costo_estimado": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE cast(value * 2 AS {str}) END",
        "costo_mx": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE {v} END",
        "dia_semana": "CASE event_id % 9 WHEN 0 THEN 'Sunday' WHEN 1 THEN ' MIERCOLES ' WHEN 2 THEN '??' "
        "WHEN 3 THEN NULL WHEN 4 THEN 'sábado' WHEN 5 THEN 'friday' WHEN 6 THEN 'Lunes' WHEN 7 THEN '' "
        "ELSE 'domingo' END",
    }
    return {name: rule.format(**f) for name, rule in rules.items()}


def raw_feed_columns(dialect: str = "spark") -> dict[str, str]:
    """Messy live records: every field text, with alternates."""
    f = _spelling(dialect)
    rules = {
        "id": "event_id",
        "timestamp": "CASE event_id % 8 WHEN 2 THEN {millis} WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'abc' "
        "WHEN 6 THEN '99999999999999999' WHEN 7 THEN '0' ELSE {seconds} END",
        "datetime": "CASE event_id % 8 WHEN 3 THEN concat({day}, ' ', {hms}) WHEN 4 THEN concat({day}, 'T', {hms}, 'Z') "
        "WHEN 6 THEN 'bad' ELSE NULL END",
        "fecha": "CASE WHEN event_id % 16 = 6 THEN NULL ELSE {day} END",
        "hora": "CASE WHEN event_id % 5 = 4 THEN '7:5' ELSE {hms} END",
        "consumo_kwh": "CASE event_id % 6 WHEN 0 THEN '0' WHEN 1 THEN NULL WHEN 2 THEN 'Infinity' WHEN 3 THEN 'x' "
        "ELSE {v} END",
        "active_power": "CASE WHEN event_id % 97 = 13 THEN '1e300' ELSE CASE event_id % 4 WHEN 0 THEN concat('-', {v}) WHEN 1 THEN '' WHEN 2 THEN NULL ELSE {v} END END",
        "consumo": "CASE WHEN event_id % 10 = 9 THEN NULL ELSE {v} END",
        "device_id": "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('dev-', cast(user_id AS {str})) END",
        "dispositivo": "CASE event_id % 10 WHEN 0 THEN concat('plug-', cast(user_id AS {str})) WHEN 5 THEN '' ELSE NULL END",
        "current": "CASE event_id % 9 WHEN 0 THEN '-1.5' WHEN 1 THEN NULL WHEN 2 THEN 'x' ELSE '1' END",
        "estado": "CASE event_id % 7 WHEN 0 THEN 'Activo' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'ok' WHEN 3 THEN '' "
        "WHEN 4 THEN NULL WHEN 5 THEN 'Suministro cortado' ELSE event_type END",
        "usuario": "CASE WHEN event_id % 4 = 1 THEN NULL ELSE concat('user ', cast(user_id AS {str})) END",
        "tipo": "CASE WHEN event_id % 4 = 2 THEN '' ELSE event_type END",
    }
    return {name: rule.format(**f) for name, rule in rules.items()}


def raw_scoring_columns(dialect: str = "spark") -> dict[str, str]:
    """Scoring records as text, some without a required number, some outside the vocabularies."""
    f = _spelling(dialect)
    f["hour"] = "lpad({}, 2, '0')".format(f["h"])
    f["weekday"] = f["at"].format(
        f["list"].format("'lunes', ' MARTES ', 'sábado', 'no day', NULL"), "event_id % 5 + 1"
    )
    rules = {
        "id": "event_id",
        "consumo_kwh": "CASE WHEN event_id % 19 = 3 THEN NULL ELSE {v} END",
        "consumo_pico": "CASE WHEN event_id % 19 = 4 THEN 'x' ELSE cast(value * 2 AS {str}) END",
        "promedio_hora": "cast(value / 2 AS {str})",
        "costo_estimado": "CASE WHEN event_id % 19 = 5 THEN '' ELSE cast(value * 4 AS {str}) END",
        "estado": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'sin conexión' WHEN 2 THEN 'inactivo' "
        "WHEN 3 THEN 'suministro cortado' WHEN 4 THEN 'roto' ELSE 'activo' END",
        "hora_dia": "CASE WHEN event_id % 7 = 2 THEN NULL ELSE concat({hour}, ':00:00') END",
        "dia_semana": "{weekday}",
        "casa_id": "CASE WHEN event_id % 17 = 5 THEN NULL WHEN event_id % 17 = 6 THEN 'Otra' ELSE {town} END",
        "modo_ecologico_activado": "CASE WHEN event_id % 31 = 8 THEN '99999999999' "
        "ELSE CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '0' END END",
    }
    return {name: rule.format(**f) for name, rule in rules.items()}


def sql_select(columns: dict[str, str], table: str) -> str:
    fields = ", ".join(f'{rule} AS "{name}"' for name, rule in columns.items())
    return f"SELECT {fields} FROM {table}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from_events(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.selectExpr(*[f"{rule} AS `{name}`" for name, rule in columns.items()])


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, reading_columns())


def raw_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, raw_batch_columns())


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, raw_feed_columns())


def raw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_events(spark, sf_dir, raw_scoring_columns())


def line_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as readings of a supplier: quantity as energy, price as cost."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("consumo_kwh"),
        F.col("l_extendedprice").alias("costo"),
    )


def supplier_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to entity: the supplier's nation stands in for the municipality."""
    nations = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("casa_id"))
    suppliers = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return suppliers.join(nations, "n_nationkey").select("s_suppkey", "casa_id")


def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as report requests; one priority class carries no request time."""
    epoch = "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)"
    return load(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey AS string) AS id",
        f"CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE {epoch} END AS fecha_ts",
        "o_orderpriority AS tipo",
        "cast(o_custkey AS string) AS usuario",
        "CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'PDF' END AS formato",
        "CASE o_orderstatus WHEN 'F' THEN 'Listo' WHEN 'O' THEN 'Pendiente' ELSE NULL END AS estado",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").selectExpr(
        "c_name AS nombre",
        "concat(lower(replace(c_name, '#', '.')), '@example.com') AS correo",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Administrador' ELSE 'Usuario' END AS rol",
        "CASE WHEN c_acctbal > 0 THEN 'Activo' ELSE 'Suspendido' END AS estado",
    )
