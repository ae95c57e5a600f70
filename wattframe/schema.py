"""Vocabularies, column contracts and record schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Statuses, weekdays, municipalities, labels, tariffs and limits of the data.
STATUSES = ["activo", "inactivo", "sin conexión", "suministro cortado"]
WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
WEEKDAYS_EN = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MUNICIPALITIES = [
    "Puebla", "Tehuacán", "San Martín Texmelucan", "San Pedro Cholula", "San Andrés Cholula",
    "Atlixco", "Cuautlancingo", "Huejotzingo", "Amozoc", "Tecamachalco", "Xicotepec", "Zacatlán",
    "Huauchinango",
]
NO_TEXT = "—"
DEFAULT_DEVICE = "Smart Plug"
DEFAULT_STATUS = "activo"
REVERSE_STATUS = "inverso"
HISTORY_NORMAL = "Normal ✅"
HISTORY_REVERSE = "Inverso ⚠️"
REPORT_PENDING = "Pendiente"
LIVE_TARIFF = 0.0015
HISTORY_TARIFF = 3.2
Z_THRESHOLD = 3.0
Z_MIN_POINTS = 30
ALERT_QUANTILE = 0.95
ACTIVE_WINDOW = "10 minutes"
SAMPLE_PER_BATCH = 400
SAMPLE_CAP = 5000
SAMPLE_EMIT = 1200
HISTORY_ROWS = 500
FEED_DASHBOARD, FEED_DEVICES, FEED_HISTORY = 2000, 3000, 5000
TABLE_ROWS, ALERT_POOL, LABEL_POOL = 30, 500, 800


@dataclass(frozen=True)
class Contract:
    """Columns a readings file may carry, what it must carry, and fills for the rest."""

    name: str
    candidates: tuple[str, ...]
    any_of: tuple[frozenset[str], ...]
    defaults: dict[str, object] = field(default_factory=dict)


# The columns of the two readings files, of feed records, reports and scoring records.
MINING = Contract(
    "mining",
    ("casa_id", "timestamp", "fecha", "hora", "hora_dia", "consumo_kwh", "costo_mx",
     "costo_estimado", "dia_semana"),
    (
        frozenset({"consumo_kwh", "timestamp"}),
        frozenset({"consumo_kwh", "fecha", "hora_dia"}),
        frozenset({"consumo_kwh", "fecha", "hora"}),
    ),
)

DASHBOARD = Contract(
    "dashboard",
    ("fecha", "consumo_kwh", "costo_mx", "estado", "dispositivo", "usuario"),
    (frozenset({"fecha", "consumo_kwh"}),),
    {"dispositivo": DEFAULT_DEVICE, "usuario": NO_TEXT, "estado": DEFAULT_STATUS, "costo_mx": 0.0},
)


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Texts that stand for a missing field in a CSV file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


# Field names. Live records are schemaless JSON: every field optional, every field text until coerced.
FEED = _strings(
    "id", "timestamp", "datetime", "fecha", "hora", "consumo_kwh", "active_power", "consumo",
    "device_id", "dispositivo", "current", "estado", "usuario", "tipo",
)

# Field names of a report request.
REPORT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("fecha_ts", T.LongType()),
    T.StructField("tipo", T.StringType()),
    T.StructField("usuario", T.StringType()),
    T.StructField("formato", T.StringType()),
    T.StructField("estado", T.StringType()),
])

# Scoring records, four required numbers, then optional fields and their defaults.
SCORING_NUMERIC = ["consumo_kwh", "consumo_pico", "promedio_hora", "costo_estimado"]
SCORING_FLAG = "modo_ecologico_activado"
SCORING_DEFAULTS = {
    "estado": "activo", "hora_dia": "00:00", "dia_semana": "lunes", "casa_id": "Puebla",
}
#: Where Spark's JSON reader puts a record that it cannot read.
CORRUPT = "_corrupt_record"
SCORING_RECORD = _strings(*SCORING_NUMERIC, *SCORING_DEFAULTS, SCORING_FLAG)
