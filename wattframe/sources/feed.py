"""The live feed and scoring records as JSON, and the report log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wattframe import schema as S
from wattframe.functions.coerce import flag, number
from wattframe.session import file_system, listed, sizes


def parse_feed(df: DataFrame, raw: str = "value") -> DataFrame:
    """JSON text to feed records; a field that is absent, or a record that is no JSON, is null.

    ``inline`` keeps later filters above the parsing, so each record is parsed once and not once
    per field a filter looks at.
    """
    keep = [c for c in df.columns if c != raw and c not in S.FEED.names]
    return df.select(*keep, F.inline(F.array(F.from_json(raw, S.FEED))))


def json_field(raw: str, name: str):
    """One ad-hoc field of a schemaless record, as text."""
    return F.get_json_object(F.col(raw), f"$.{name}")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed snapshot from JSON lines."""
    return spark.read.schema(S.FEED).json(path)


def last_n(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The last ``n`` records by feed key."""
    return df.orderBy(F.desc(key)).limit(n)


#: Bytes of a compacted file, about; each is written by a task of its own.
FILE_BYTES = 1 << 27


def _compactions(spark: SparkSession, path: str) -> list[str]:
    """Finished compactions of a log, oldest first."""
    names = [n for n in listed(spark, f"{path}/_compacted") if n.startswith("v=")]
    return [n for n in names if "_SUCCESS" in listed(spark, f"{path}/_compacted/{n}")]


def _loose(spark: SparkSession, path: str, done: list[str]) -> list[str]:
    """Request files that the last compaction does not hold."""
    names = [n for n in listed(spark, path) if not n.startswith(("_", "."))]
    if done:
        folded = {r.value for r in spark.read.text(f"{path}/_manifest/{done[-1]}").collect()}
        names = [n for n in names if n not in folded]
    return names


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The report log: what the last compaction holds and the requests since."""
    done = _compactions(spark, path)
    loose = _loose(spark, path, done)
    read = spark.read.schema(S.REPORT)
    parts = [read.json(f"{path}/_compacted/{done[-1]}")] if done else []
    if loose or not parts:
        parts.append(read.json([f"{path}/{n}" for n in loose] or path))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def compact_reports(spark: SparkSession, path: str, least: int = 100, files: int | None = None) -> bool:
    """Folds the log's request files into ``files`` files if there are ``least`` of them; whether it did.

    Without ``files`` there are as many as the log has bytes for, so that no task reads or writes the whole log.

    Appends may go on meanwhile. The manifest, which names the files folded in, is written before the
    compaction, and readers take both from the moment the compaction is finished, so every request counts
    once throughout; a run that breaks off leaves the log as it was. The folded files go last, and those of
    a run that broke off there go with the next. One compaction at a time may run per log.
    """
    done = _compactions(spark, path)
    loose = _loose(spark, path, done)
    if len(loose) < max(1, least):
        return False
    used = [int(n.split("=")[1]) for n in listed(spark, f"{path}/_compacted") if n.startswith("v=")]
    name = f"v={max(used, default=-1) + 1:09d}"
    folded = [n for n in listed(spark, path) if not n.startswith(("_", ".")) and n not in loose] + loose
    if files is None:
        own = sizes(spark, path)
        held = sum(sizes(spark, f"{path}/_compacted/{done[-1]}").values()) if done else 0
        files = max(1, -(-(held + sum(own[n] for n in loose)) // FILE_BYTES))
    spark.createDataFrame([(n,) for n in folded], "value string").coalesce(1).write.text(f"{path}/_manifest/{name}")
    whole = spark.read.schema(S.REPORT).json([f"{path}/{n}" for n in loose])
    if done:
        whole = whole.unionAll(spark.read.schema(S.REPORT).json(f"{path}/_compacted/{done[-1]}"))
    whole.coalesce(files).write.json(f"{path}/_compacted/{name}")
    for old in [f"{path}/{n}" for n in folded]:
        at, fs = file_system(spark, old)
        fs.delete(at, False)
    # The compaction before stays for readers that began with it.
    for kind in ("_compacted", "_manifest"):
        for n in listed(spark, f"{path}/{kind}"):
            if n.startswith("v=") and n not in (name, *done[-1:]):
                at, fs = file_system(spark, f"{path}/{kind}/{n}")
                fs.delete(at, True)
    return True


def append_report(
    spark: SparkSession,
    path: str,
    tipo: str = "Consumo mensual",
    usuario: str = "Sistema",
    formato: str = "PDF",
    at: datetime | None = None,
) -> None:
    """Appends one pending report request to the log, at the current time unless given."""
    moment = F.unix_millis(F.current_timestamp() if at is None else F.lit(at))
    record = spark.range(0, 1, 1, 1).select(
        F.expr("uuid()").alias("id"),
        moment.alias("fecha_ts"),
        F.lit(tipo).alias("tipo"),
        F.lit(usuario).alias("usuario"),
        F.lit(formato).alias("formato"),
        F.lit(S.REPORT_PENDING).alias("estado"),
    )
    record.write.mode("append").json(path)


def read_scoring_records(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scoring records from JSON lines, a record or a list of records on each, and ``keep`` of their other fields.

    What cannot be read stays as a row whose text is in ``_corrupt_record``; see ``scoring_rejects``.
    """
    fields = [T.StructField(c, T.StringType()) for c in (*keep, *S.SCORING_RECORD.names, S.CORRUPT)]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}
    return spark.read.schema(T.StructType(fields)).options(**options).json(path)


def _complete(df: DataFrame):
    checks = [number(F.col(c), None).isNotNull() for c in S.SCORING_NUMERIC]
    whole = checks[0]
    for c in checks[1:]:
        whole = whole & c
    return whole


def scoring_records(df: DataFrame) -> DataFrame:
    """Records whose four required numbers are readable; absent optional fields defaulted.

    The numbers are read once, in the projection below the filter. A flag that is no INT counts as
    absent. A record that could not be read is left out whatever its fields say.
    """
    if S.CORRUPT in df.columns:
        df = df.where(F.col(S.CORRUPT).isNull()).drop(S.CORRUPT)
    good = df.withColumns({c: number(F.col(c), None) for c in S.SCORING_NUMERIC}).dropna(subset=S.SCORING_NUMERIC)
    return good.select(
        *_carried(df),
        *S.SCORING_NUMERIC,
        *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in S.SCORING_DEFAULTS.items()],
        flag(number(F.col(S.SCORING_FLAG))).alias(S.SCORING_FLAG),
    )


def scoring_rejects(df: DataFrame) -> DataFrame:
    """Records that lack a required number, as they came, with the fields at fault; of a record that could
    not be read, the whole (``registro``)."""
    faults = F.concat_ws(",", *[F.when(number(F.col(c), None).isNull(), F.lit(c)) for c in S.SCORING_NUMERIC])
    bad = ~_complete(df)
    if S.CORRUPT in df.columns:
        corrupt = F.col(S.CORRUPT).isNotNull()
        bad, faults = bad | corrupt, F.when(corrupt, F.lit("registro")).otherwise(faults)
    return df.filter(bad).withColumn("faltan", faults)


def _carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in S.SCORING_RECORD.names]
