"""Readings at rest: format resolution, header-driven projection, contract and defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.schema import MISSING_TEXTS, Contract
from wattframe.sources.chunks import with_chunks
from wattframe.sources.headers import by_header


def _read(spark: SparkSession, paths: str | list[str], fmt: str, multi_line: bool = False) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    # All text, no inference pass: typing is lenient and happens in the cleaning step. Among the files of one
    # read a header that differs from the first one's raises instead of being read by position.
    options = {"header": True, "escape": '"', "enforceSchema": False, "multiLine": multi_line}
    return spark.read.options(**options).csv(paths)


def _locations(path: str) -> list[tuple[str, str]]:
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    own = "parquet" if path.lower().endswith(".parquet") else "csv"
    tries = [(path, own), (stem, "csv"), (stem + ".parquet", "parquet")]
    return list(dict.fromkeys(tries))


def scan(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, str]:
    """Table at ``path``, or at the path without extension, or as ``.parquet``; with its format."""
    for location, fmt in _locations(path):
        try:
            return _read(spark, location, fmt, multi_line), fmt
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no readings at {path}")


def check(columns: list[str], contract: Contract) -> None:
    """Raises ``ValueError`` unless the columns meet one of the contract's alternatives."""
    present = set(columns)
    if not any(need <= present for need in contract.any_of):
        wanted = " or ".join("+".join(sorted(need)) for need in contract.any_of)
        raise ValueError(f"{contract.name} readings need {wanted}; found {sorted(present)[:10]}")


def apply_contract(df: DataFrame, contract: Contract, keep: tuple[str, ...] = ()) -> DataFrame:
    """Checks the columns, keeps the known ones and fills absent optional ones."""
    names = {c.strip(): c for c in df.columns}
    check(list(names), contract)
    wanted = [c for c in contract.candidates if c in names] + [c for c in keep if c in names]
    kept = df.select(*[F.col(f"`{names[c]}`").alias(c) for c in wanted])
    absent = {c: F.lit(v) for c, v in contract.defaults.items() if c not in names}
    return kept.withColumns(absent) if absent else kept


def read_readings(
    spark: SparkSession, path: str, contract: Contract, max_batches: int = 0, multi_line: bool = False,
    batch_folders: bool = False, chunk_rows: int = 0, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Readings under a contract, each row tagged with its ``batch_id``: the file it is in, or with
    ``batch_folders`` the folder, so that a batch may be written and read as many files, or with
    ``chunk_rows`` the number of its run of so many rows, counted through all files in name order. With both,
    the files of a folder are parts of one and runs go on from part to part.

    ``max_batches`` reads only the first so many batches in that order; 0 reads all. ``keep`` names
    further columns to keep if present. Files whose headers differ are read by name, each header under the
    contract, and what only some of them have is null in the others. In CSV files
    the usual texts for a missing field (empty, NA, NaN, null ...) become null. ``multi_line``
    takes line breaks inside quotes as part of a field; such a file is read by one task.
    """
    df, fmt = scan(spark, path, multi_line)
    files = sorted(df.inputFiles())
    if max_batches > 0:
        # Each file or folder has a batch of its own at least, so the first batches are in the first files.
        of = {f: f.rsplit("/", 1)[0] if batch_folders else f for f in files}
        first = sorted(set(of.values()))[:max_batches]
        files = [f for f in files if of[f] in first]
    groups = by_header(spark, files) if fmt == "csv" else []
    if len(groups) > 1:
        tables = [_read(spark, group, fmt, multi_line) for group in groups]
    else:
        tables = [_read(spark, files, fmt, multi_line) if max_batches > 0 else df]
    if chunk_rows:
        tagged = with_chunks(tables, fmt, chunk_rows, folders=batch_folders)
        if max_batches > 0:
            tagged = [t.where(F.col("batch_id") < max_batches) for t in tagged]
    else:
        source = F.col("_metadata.file_path")
        batch = F.regexp_replace(source, "/[^/]*$", "") if batch_folders else source
        tagged = [t.select("*", batch.alias("batch_id")) for t in tables]
    parts = [_under_contract(t, u.columns, contract, keep, fmt) for t, u in zip(tagged, tables)]
    if len(parts) == 1:
        return parts[0]
    # Files are text; a default that another group reads from its files is text there too.
    texts = [p.select(*[F.col(c) if c == "batch_id" else F.col(c).cast("string") for c in p.columns]) for p in parts]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), texts)


def _under_contract(
    tagged: DataFrame, columns: list[str], contract: Contract, keep: tuple[str, ...], fmt: str
) -> DataFrame:
    """The contract's columns of one table; in CSV files the usual texts for a missing field become null."""
    rows = apply_contract(tagged, contract, keep=("batch_id", *keep))
    if fmt != "csv":
        return rows
    read = [c for c in rows.columns if c in {name.strip() for name in columns}]
    return rows.withColumns({c: F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)) for c in read})
