"""The mining build: a readings file to its five published results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe import schema as S
from wattframe.functions import sums, times
from wattframe.operators.alerts import zscore_count
from wattframe.operators.energy import DAYS, HOURS, dense, weekday_position
from wattframe.operators.hours import with_best_time
from wattframe.operators.ranking import sample_per_batch, sample_rank, top_k
from wattframe.operators.standardise import as_number
from wattframe.sources.readings import apply_contract, read_readings
from wattframe.sources.sinks import as_series, kept, publishing, write_result

def mining_readings(df: DataFrame, batch: str | None = "batch_id") -> DataFrame:
    """Contract rows as dated readings: ``ts, dia, casa_id, consumo_kwh, costo`` and the batch.

    ``id`` is a hash of the raw row unless the table brings one; it only orders the sample.
    """
    raw = df.columns
    keep = [c for c in ("id", "batch_id") if c in raw]
    narrow = apply_contract(df, S.MINING, keep=tuple(keep))

    def money(name: str):
        return as_number(narrow, name, None) if name in raw else F.lit(None).cast("double")

    clocks = [c for c in ("timestamp", "fecha", "hora_dia", "hora") if c in raw]
    typed = narrow.select(
        *([] if "id" in raw else [F.xxhash64(*[F.col(c) for c in narrow.columns]).alias("id")]),
        *keep,
        *clocks,
        *(["dia_semana"] if "dia_semana" in raw else []),
        (F.col("casa_id") if "casa_id" in raw else F.lit(None).cast("string")).alias("casa_id"),
        as_number(narrow, "consumo_kwh").alias("consumo_kwh"),
        F.coalesce(money("costo_estimado"), money("costo_mx"), F.lit(0.0)).alias("costo"),
    )
    label = F.col("dia_semana") if "dia_semana" in raw else None
    return with_best_time(typed, batch).select(
        "id", *[c for c in keep if c != "id"], "ts", times.weekday_label(label, F.col("ts")).alias("dia"),
        "casa_id", "consumo_kwh", "costo",
    )


def energy_cube(readings: DataFrame) -> DataFrame:
    """Rows and partial energy sums per hour, weekday and entity.

    Every published total folds from this table, and so do mean and deviation, so the readings
    are scanned once for all of them. It has at most 168 rows per entity.
    """
    return readings.groupBy(
        F.hour("ts").alias("hour"), weekday_position(F.col("dia")).alias("weekday"), "casa_id"
    ).agg(
        F.count("*").alias("n"),
        *sums.partial(F.col("consumo_kwh")),
        F.avg("consumo_kwh").alias("mean"),
        F.stddev_pop("consumo_kwh").alias("sd"),
    )


def cube_spread(cube: DataFrame) -> DataFrame:
    """``n, mean, sd`` of all readings from the groups' own: a group adds its inner variance and
    its mean's distance from the overall mean."""
    centre = cube.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")).scalar()
    known = cube.select("n", "mean", "sd", centre.alias("centre"))
    distance = F.col("mean") - F.col("centre")
    variance = F.sum(F.col("n") * (F.col("sd") * F.col("sd") + distance * distance)) / F.sum("n")
    return known.agg(
        F.sum("n").alias("n"),
        F.coalesce(F.max("centre"), F.lit(0.0)).alias("mean"),
        F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1e-9)).alias("sd"),
    )


def by_hour(cube: DataFrame) -> DataFrame:
    return dense(cube.groupBy(F.col("hour").alias("ord")).agg(sums.refold().alias("value")), HOURS)


def by_weekday(cube: DataFrame) -> DataFrame:
    return dense(cube.groupBy(F.col("weekday").alias("ord")).agg(sums.refold().alias("value")), DAYS)


def by_entity(cube: DataFrame) -> DataFrame:
    known = cube.filter(F.col("casa_id").isNotNull())
    return known.groupBy("casa_id").agg(sums.refold().alias("total"))


def top_entities(cube: DataFrame, k: int = 10) -> DataFrame:
    return top_k(by_entity(cube), k).select(F.col("casa_id").alias("municipio"), "total")


def sample_pool(readings: DataFrame, batch: str = "batch_id", seed: int = 42) -> DataFrame:
    return sample_per_batch(
        readings.select("id", batch, "consumo_kwh", "costo"), batch, "id", seed=seed
    )


def scatter(pool: DataFrame, emit: int = S.SAMPLE_EMIT, seed: int = 42) -> DataFrame:
    """The published points: energy as ``x``, cost as ``y``, in sample order."""
    cut = pool.orderBy(sample_rank(F.col("id"), seed), "id").limit(emit)
    return cut.select(F.col("consumo_kwh").alias("x"), F.col("costo").alias("y"))


def summary(cube: DataFrame, readings: DataFrame, threshold: float = S.Z_THRESHOLD) -> DataFrame:
    """Counts and spread from the cube; one pass over the readings counts the anomalies."""
    anomalies = zscore_count(
        readings, "consumo_kwh", threshold, S.Z_MIN_POINTS, stats=cube_spread(cube)
    )
    return _summary(cube, anomalies, threshold)


def sampled_summary(cube: DataFrame, pool: DataFrame, threshold: float = S.Z_THRESHOLD) -> DataFrame:
    """As ``summary``, with the anomalies of the sample pool only."""
    return _summary(cube, zscore_count(pool, "consumo_kwh", threshold, S.Z_MIN_POINTS), threshold)


def _summary(cube: DataFrame, anomalies: DataFrame, threshold: float) -> DataFrame:
    return cube.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_registros"),
        F.count_distinct("casa_id").alias("n_municipios"),
    ).select("*", anomalies.scalar().alias("n_anomalias"), F.lit(float(threshold)).alias("z_threshold"))


def build(
    spark: SparkSession,
    path: str,
    out: str,
    max_batches: int = 0,
    threshold: float = S.Z_THRESHOLD,
    sampled_anomalies: bool = False,
    seed: int = 42,
    batch_folders: bool = False,
    chunk_rows: int = 0,
) -> None:
    """Reads the file at ``path`` and replaces the five results under ``out``.

    A batch is a file, with ``batch_folders`` all files of a folder, with ``chunk_rows`` so many rows of a
    file (with both, of a folder). An ``id`` in the file orders the sample; else a hash of the row does.

    The results become visible together, when all are written. The cleaned readings, the cube and the
    sample pool are written there too and read back: the
    raw text is parsed once, later passes read narrow columns, and a lost executor repeats only
    its own part. Anomalies are counted over all readings; ``sampled_anomalies`` counts them over
    the sample pool, as the published figure was.
    """
    raw = read_readings(
        spark, path, S.MINING, max_batches, batch_folders=batch_folders, chunk_rows=chunk_rows, keep=("id",))
    with publishing(spark, out) as folder:
        readings = kept(mining_readings(raw), folder, "_readings")
        cube = kept(energy_cube(readings), folder, "_cube")
        pool = kept(sample_pool(readings, seed=seed), folder, "_sample")

        counted = sampled_summary(cube, pool, threshold) if sampled_anomalies else summary(cube, readings, threshold)
        write_result(counted, folder, "resumen")
        write_result(as_series(by_hour(cube), "ord"), folder, "consumo_hora")
        write_result(as_series(by_weekday(cube), "ord"), folder, "consumo_dia")
        write_result(top_entities(cube), folder, "top_dispositivos")
        write_result(scatter(pool, seed=seed), folder, "consumo_vs_costo")
