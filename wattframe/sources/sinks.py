"""Named results, the served bundle and the history export."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wattframe.session import file_system, listed

SERIES_SCHEMA = T.StructType([
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("data", T.ArrayType(T.DoubleType())),
])

# Schemas of the published results, by name.
RESULTS = {
    "cards": "consumo double, alertas bigint, activos bigint",
    "mensual": SERIES_SCHEMA,
    "semanal": SERIES_SCHEMA,
    "historico": "fecha string, dispositivo string, usuario string, consumo double, costo double, estado string",
    "resumen": "n_registros bigint, n_municipios bigint, n_anomalias bigint, z_threshold double",
    "consumo_hora": SERIES_SCHEMA,
    "consumo_dia": SERIES_SCHEMA,
    "top_dispositivos": "municipio string, total double",
    "consumo_vs_costo": "x double, y double",
}
MINING_BUNDLE = ["resumen", "consumo_hora", "consumo_dia", "top_dispositivos", "consumo_vs_costo"]
DASHBOARD_BUNDLE = ["cards", "mensual", "semanal", "historico"]


def as_series(long: DataFrame, order: str = "label") -> DataFrame:
    """A short series (a few dozen points) as one row of parallel ``labels`` and ``data``."""
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "label", "value")))
    return long.agg(points.alias("p")).select(
        F.col("p.label").alias("labels"), F.col("p.value").alias("data")
    )


def from_series(wide: DataFrame) -> DataFrame:
    """The long form ``ord, label, value`` of a stored series."""
    pairs = wide.select(F.posexplode(F.arrays_zip("labels", "data")).alias("ord", "p"))
    return pairs.select("ord", F.col("p.labels").alias("label"), F.col("p.data").alias("value"))


def write_result(df: DataFrame, folder: str, name: str) -> None:
    """Replaces the named result. The published results are small, so each is one file."""
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Replaces a working table of a build and continues from what was written."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


#: A build writes into a folder of its own; the mark, made last, lets readers see it.
_PUBLISHED = "_PUBLISHED"
KEEP_BUILDS = 2


def _builds(spark: SparkSession, folder: str) -> list[str]:
    """Folders of published builds, in order."""
    names = [n for n in listed(spark, folder) if n.startswith("build=")]
    return [f"{folder}/{n}" for n in names if _PUBLISHED in listed(spark, f"{folder}/{n}")]


def current_build(spark: SparkSession, folder: str) -> str:
    """The folder of the last published build; ``folder`` itself where results are written without builds."""
    done = _builds(spark, folder)
    return done[-1] if done else folder


@contextmanager
def publishing(spark: SparkSession, folder: str, keep: int = KEEP_BUILDS) -> Iterator[str]:
    """A fresh folder for all results of one build, which readers see together once the block has ended.

    Results of a block that fails are never seen. Builds are numbered; the last ``keep`` published ones
    stay, so that a reader that began before the switch can finish. One build at a time may run per folder.
    """
    numbers = [int(n.split("=")[1]) for n in listed(spark, folder) if n.startswith("build=")]
    own = f"{folder}/build={max(numbers, default=-1) + 1:09d}"
    yield own
    mark, files = file_system(spark, f"{own}/{_PUBLISHED}")
    files.create(mark, False).close()
    done = _builds(spark, folder)
    for name in listed(spark, folder):
        # Also what a failed build has left.
        if name.startswith("build=") and f"{folder}/{name}" not in done[-keep:]:
            files.delete(file_system(spark, f"{folder}/{name}")[0], True)


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named result of the last published build; ``FileNotFoundError`` if it was never written."""
    return _result(spark, current_build(spark, folder), name)


def _result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(RESULTS[name]).json(f"{folder}/{name}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no result {name} in {folder}") from None
        raise


def read_bundle(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All results of a bundle, the mining one by default, all from one build."""
    build = current_build(spark, folder)
    return {name: _result(spark, build, name) for name in names or MINING_BUNDLE}


CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def export_csv(history: DataFrame, folder: str, day: date | str | None = None) -> str:
    """Writes exactly the given history rows as ``historico_<day>`` and returns that path.

    Cost has two decimals. Fields holding a comma, quote or newline are quoted, quotes doubled.
    """
    path = f"{folder}/historico_{day or date.today()}"
    history.select(
        "fecha",
        "dispositivo",
        "usuario",
        F.col("consumo").alias("consumo_kwh"),
        F.format_string("%.2f", F.col("costo")).alias("costo_mxn"),
        "estado",
    ).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS, multiLine=True).csv(path)
