"""Feature assembly, model fitting and batch scoring of next-period consumption and cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wattframe import schema as S
from wattframe.functions.coerce import clamp, flag, number
from wattframe.functions.times import time_of_day

OUTPUTS = {"consumo_next": "consumo_kwh_next", "costo_next": "costo_mx_next"}
HOURS_OF_DAY = [f"{h:02d}:00" for h in range(24)]


def hour_level(raw: Column) -> Column:
    """Time of day as the vocabulary holds it: HH:MM where readable (``7:05`` is ``07:05``)."""
    return F.coalesce(time_of_day(raw), F.substring(raw, 1, 5), F.lit("00:00"))


def coerced(df: DataFrame) -> DataFrame:
    """Scoring inputs with every field present and valid, row by row."""
    def raw(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    def measure(name: str) -> Column:
        text = name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
        return number(raw(name), text=text)

    known = set(S.SCORING_NUMERIC) | set(S.SCORING_DEFAULTS) | {S.SCORING_FLAG}
    weekday = F.lower(F.trim(raw("dia_semana")))
    return df.select(
        *[c for c in df.columns if c not in known],
        *[measure(c).alias(c) for c in S.SCORING_NUMERIC],
        flag(measure(S.SCORING_FLAG)).alias(S.SCORING_FLAG),
        clamp(raw("estado"), S.STATUSES, "activo").alias("estado"),
        hour_level(raw("hora_dia")).alias("hora_dia"),
        clamp(weekday, S.WEEKDAYS, "lunes").alias("dia_semana"),
        clamp(raw("casa_id"), S.MUNICIPALITIES, "Puebla").alias("casa_id"),
    )


def levels(hours: list[str] | None = None) -> dict[str, list[str]]:
    """Indicator levels per categorical: the vocabulary without its alphabetically first entry."""
    vocabulary = {
        "estado": S.STATUSES,
        "hora_dia": hours or HOURS_OF_DAY,
        "dia_semana": S.WEEKDAYS,
        "casa_id": S.MUNICIPALITIES,
    }
    return {name: sorted(values)[1:] for name, values in vocabulary.items()}


def feature_names(by_level: dict[str, list[str]] | None = None) -> list[str]:
    by_level = by_level or levels()
    dummies = [f"{name}_{level}" for name, values in by_level.items() for level in values]
    return [*S.SCORING_NUMERIC, S.SCORING_FLAG, *dummies]


def feature_matrix(df: DataFrame, by_level: dict[str, list[str]] | None = None) -> DataFrame:
    """Numbers, flag and 0/1 indicators, one column each, the same for 1 row or many.

    A value outside the fitted vocabulary leaves all its indicators 0.
    """
    by_level = by_level or levels()
    clean = coerced(df)
    carried = [c for c in clean.columns if c not in {*S.SCORING_NUMERIC, S.SCORING_FLAG, *by_level}]
    dummies = [
        (F.col(name) == level).cast("int").alias(f"{name}_{level}")
        for name, values in by_level.items()
        for level in values
    ]
    return clean.select(*carried, *S.SCORING_NUMERIC, S.SCORING_FLAG, *dummies)


def hours_present(df: DataFrame) -> list[str]:
    """Distinct valid times of day in training data, at most 1,440."""
    known = df.filter(time_of_day(F.col("hora_dia")).isNotNull()) if "hora_dia" in df.columns else df.limit(0)
    found = known.select(hour_level(F.col("hora_dia") if "hora_dia" in df.columns else F.lit(None)).alias("h")).distinct()
    return [row.h for row in found.orderBy("h").collect()]


@dataclass(frozen=True)
class Scorer:
    """A fitted model per output and the levels its features were built with."""

    model: PipelineModel
    by_level: dict[str, list[str]]

    def score(self, records: DataFrame) -> DataFrame:
        """The carried columns and both predictions, computed where the rows are."""
        features = feature_matrix(records, self.by_level)
        inputs = feature_names(self.by_level)
        scored = self.model.transform(features)
        carried = [c for c in features.columns if c not in inputs and c not in OUTPUTS]
        return scored.select(*carried, *OUTPUTS.values())

    def save(self, folder: str) -> None:
        self.model.write().overwrite().save(f"{folder}/model")
        rows = [(name, values) for name, values in self.by_level.items()]
        spark = SparkSession.getActiveSession()
        table = spark.createDataFrame(rows, "name string, levels array<string>")
        table.coalesce(1).write.mode("overwrite").json(f"{folder}/levels")


def load(spark: SparkSession, folder: str) -> Scorer:
    rows = spark.read.schema("name string, levels array<string>").json(f"{folder}/levels").collect()
    stored = {row.name: list(row.levels) for row in rows}
    return Scorer(PipelineModel.load(f"{folder}/model"), {name: stored[name] for name in levels()})


def fit(
    training: DataFrame,
    by_level: dict[str, list[str]] | None = None,
    trees: int = 20,
    depth: int = 5,
    seed: int = 42,
) -> Scorer:
    """One random forest per output over the same features.

    ``training`` holds scoring records plus the targets ``consumo_next`` and ``costo_next``; rows
    without a next reading are left out. The times of day of the vocabulary are those of the
    training rows, minutes included, unless ``by_level`` gives them.
    """
    labelled = training.dropna(subset=list(OUTPUTS))
    by_level = by_level or levels(hours_present(labelled))
    features = feature_matrix(labelled, by_level)
    assembler = VectorAssembler(inputCols=feature_names(by_level), outputCol="features")
    forests = [
        RandomForestRegressor(
            featuresCol="features", labelCol=target, predictionCol=output,
            numTrees=trees, maxDepth=depth, seed=seed,
        )
        for target, output in OUTPUTS.items()
    ]
    return Scorer(Pipeline(stages=[assembler, *forests]).fit(features), by_level)


def score_one(spark: SparkSession, scorer: Scorer, record: dict) -> DataFrame:
    """One record by the same path as a batch."""
    row = {name: None if record.get(name) is None else str(record[name]) for name in S.SCORING_RECORD.names}
    return scorer.score(spark.createDataFrame([row], S.SCORING_RECORD))
