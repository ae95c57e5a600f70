"""The live feed as Structured Streaming queries.

Records carry a key; a key that is sent again replaces its record, and a late record simply sorts into
place: nothing is dropped. Micro-batches write versioned folders: batch ``k`` writes ``batch=k`` in
overwrite mode, so a batch that is repeated after a failure replaces itself. The keyed store is split into
buckets by a hash of the key; each bucket's changes are folded into its snapshot at batches of its own, so a
micro-batch rewrites a small part of the table at most, and the newest-N view is carried from batch to
batch without the table. All paths must be reachable by every executor.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wattframe import schema as S
from wattframe.functions import sums, times
from wattframe.operators.alerts import zscore_count
from wattframe.operators.ranking import newest, positions
from wattframe.session import file_system, listed


#: Batches after which a bucket's changes are folded into its snapshot.
COMPACT = 20
#: Parts of a keyed store; each should fit the memory of a task or two.
BUCKETS = 16


def feed_stream(
    spark: SparkSession, path: str, schema: T.StructType = S.FEED, fmt: str = "json", **options
) -> DataFrame:
    """Files arriving under ``path`` as a stream; ``maxFilesPerTrigger`` sets the batch size.

    A stream from elsewhere (a message queue's text, say) goes through ``feed.parse_feed`` instead.
    """
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def _version(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id}"


def _read_version(spark: SparkSession, folder: str, batch_id: int, like: DataFrame) -> DataFrame:
    """The stored view after a batch; empty before the first."""
    if batch_id < 0:
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(_version(folder, batch_id))


def _drop_version(spark: SparkSession, folder: str, batch_id: int) -> None:
    """Removes a version that no batch needs any more; a repeated batch ``k`` reads ``k - 1`` at most."""
    if batch_id >= 0:
        at, files = file_system(spark, _version(folder, batch_id))
        files.delete(at, True)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches with a finished version, in order."""
    found = sorted(int(n.split("=")[1]) for n in listed(spark, folder) if n.startswith("batch="))
    return [k for k in found if "_SUCCESS" in listed(spark, _version(folder, k))]


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, mode: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode)
    writer = writer.option("checkpointLocation", f"{folder}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def _last_copies(batch: DataFrame, key: str, ts: str) -> DataFrame:
    """One record per key of a batch: the one with the newest time, the larger record on ties."""
    rest = [c for c in batch.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(F.col(ts), *[F.col(c) for c in rest if c != ts]))
    return batch.groupBy(key).agg(last.alias("_row")).select(*[key if c == key else F.col(f"_row.{c}") for c in batch.columns])


def keyed_table(
    stream: DataFrame, folder: str, key: str = "id", ts: str = "ts", compact: int = COMPACT, buckets: int = BUCKETS,
    once: bool = True,
) -> StreamingQuery:
    """Keeps the last copy of every key, as bucketed changes and snapshots under ``folder``.

    A later batch replaces what earlier ones hold, whatever its records' times; inside a batch the
    newest time wins. Read it with ``read_changes(spark, folder, [key])``.
    """
    keep = _changes(folder, [key], compact, buckets)
    return _start(stream, lambda batch, k: keep(_last_copies(batch, key, ts), k), folder, "append", once)


def _newer(ts: str, tie: str, edge: dict) -> Column:
    """Whether a row comes before ``edge`` in the order of ``newest``; rows without a time come last."""
    kind = lambda name: F.lit(edge[name])
    tied = F.col(tie).isNotNull() if edge[tie] is None else F.coalesce(F.col(tie) > kind(tie), F.lit(False))
    if edge[ts] is None:
        return F.col(ts).isNotNull() | tied
    return F.coalesce((F.col(ts) > kind(ts)) | ((F.col(ts) == kind(ts)) & tied), F.lit(False))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Keys agree; a null key is a key of its own."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def _carried(
    before: DataFrame | None, copies: DataFrame, size: int, key: str, ts: str, tie: str
) -> DataFrame:
    """The newest ``size`` rows from those of the batch before and the batch's own copies.

    Rows flagged ``_edge`` are not among them: the newest row that was ever left out bounds what the rows
    are known to hold. Everything newer than it in the whole table is here; what is not newer is left to
    the table.
    """
    edge = None
    kept = copies
    if before is not None:
        edge = newest(before.where("_edge"), 1, ts, tie).collect()
        kept = copies.where(_newer(ts, tie, edge[0].asDict())) if edge else copies
        stay = before.where("NOT _edge").drop("_edge")
        kept = stay.join(copies, _same(stay, copies, [key]), "left_anti").unionByName(kept)
    # One row more than kept, from which the next edge is known.
    order = [F.desc_nulls_last(ts), F.desc(tie)]
    out = positions(newest(kept, size + 1, ts, tie), order).withColumn("_edge", F.col("position") >= size).drop("position")
    if edge:
        out = out.unionByName(newest(before.where("_edge"), 1, ts, tie))
    return out


def last_n_view(
    stream: DataFrame,
    folder: str,
    n: int = S.FEED_DASHBOARD,
    ts: str = "ts",
    tie: str = "id",
    value: str | None = None,
    pool: int = S.ALERT_POOL,
    threshold: float = S.Z_THRESHOLD,
    key: str = "id",
    compact: int = COMPACT,
    buckets: int = BUCKETS,
    reserve: int | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Keeps the newest ``n`` records of the stream under ``folder/view``.

    A key that is sent again counts once, and one that moves back in time lets the next record in. For
    that the newest ``n`` and ``reserve`` more (as many again by default) are carried from batch to batch;
    a batch reads itself and these, and the keyed table only when so many keys have moved back that fewer
    than ``n`` are left. The last two versions stay. With ``value`` the z-score alerts among the newest
    ``pool`` of the view are kept under ``folder/alerts``.
    """
    view, alerts, top = f"{folder}/view", f"{folder}/alerts", f"{folder}/top"
    keep = _changes(folder, [key], compact, buckets)
    size = n + (n if reserve is None else reserve)

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        copies = keep(_last_copies(batch, key, ts), batch_id)
        done = [k for k in _versions(spark, top) if k < batch_id]
        before = spark.read.parquet(_version(top, done[-1])) if done else None
        _carried(before, copies, size, key, ts, tie).coalesce(1).write.mode("overwrite").parquet(_version(top, batch_id))
        carried = spark.read.parquet(_version(top, batch_id))
        known, edges = (carried.agg(F.count_if(c)).first()[0] for c in (~F.col("_edge"), F.col("_edge")))
        if known < n and edges:
            refill(spark, batch_id, copies.columns)
            carried = spark.read.parquet(_version(top, batch_id))
        rows = carried.where("NOT _edge").drop("_edge")
        newest(rows, n, ts, tie).coalesce(1).write.mode("overwrite").parquet(_version(view, batch_id))
        if value is not None:
            kept = _read_version(spark, view, batch_id, batch)
            counted = zscore_count(kept, value, threshold, 0, pool, ts, tie)
            counted.write.mode("overwrite").parquet(_version(alerts, batch_id))
            _drop_version(spark, alerts, batch_id - 2)
        _drop_version(spark, view, batch_id - 2)
        _drop_version(spark, top, batch_id - 2)

    def refill(spark: SparkSession, batch_id: int, columns: list[str]) -> None:
        whole = read_changes(spark, folder, [key]).select(*columns)
        _carried(None, whole, size, key, ts, tie).coalesce(1).write.mode("overwrite").parquet(_version(top, batch_id))

    return _start(stream, merge, folder, "append", once)


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The result of the last finished batch."""
    done = _versions(spark, folder)
    if not done:
        raise FileNotFoundError(f"no finished batch under {folder}")
    return spark.read.parquet(_version(folder, done[-1]))


def _parts(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """Per bucket the finished batches that hold a part of it, in order."""
    at, files = file_system(spark, f"{folder}/batch=*/bucket=*")
    done, found = set(_versions(spark, folder)), defaultdict(list)
    for status in files.globStatus(at) or []:
        path = status.getPath()
        batch = int(path.getParent().getName().split("=")[1])
        if batch in done:
            found[int(path.getName().split("=")[1])].append(batch)
    return {bucket: sorted(batches) for bucket, batches in found.items()}


def _part(folder: str, batch_id: int, bucket: int) -> str:
    return f"{_version(folder, batch_id)}/bucket={bucket}"


def _drop_part(spark: SparkSession, folder: str, batch_id: int, bucket: int) -> None:
    """Removes a bucket's part of a batch, and the batch when that was its last."""
    at, files = file_system(spark, _part(folder, batch_id, bucket))
    files.delete(at, True)
    rest, _ = file_system(spark, f"{_version(folder, batch_id)}/bucket=*")
    if not files.globStatus(rest):
        _drop_version(spark, folder, batch_id)


def _changes(
    folder: str, keys: list[str], compact: int = COMPACT, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], DataFrame]:
    """Writes a batch's changes by bucket and returns them as written.

    Every ``compact`` batches, at batches of its own, a bucket that has changes gets a new snapshot, and its
    older changes and snapshots go. A snapshot is finished before anything goes, and a batch repeated after
    its snapshot leaves it.
    """
    log, snapshots = f"{folder}/changes", f"{folder}/snapshots"

    def keep(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        dealt.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_version(log, batch_id))
        if compact:
            fold(spark, batch_id)
        return spark.read.schema(dealt.schema).parquet(_version(log, batch_id)).select(*batch.columns)

    def fold(spark: SparkSession, batch_id: int) -> None:
        changed, kept = _parts(spark, log), _parts(spark, snapshots)
        after = {b: kept[b][-1] if b in kept else -1 for b in changed}
        due = [b for b in changed if (batch_id + 1 + b) % compact == 0 and changed[b][-1] > after[b]]
        if due and batch_id not in _versions(spark, snapshots):
            current = _current(spark, folder, keys, due)
            current.repartition(len(due), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_version(snapshots, batch_id))
        if due:
            kept = _parts(spark, snapshots)
        for b, batches in kept.items():
            for old in batches[:-1]:
                _drop_part(spark, snapshots, old, b)
            for old in changed.get(b, []):
                # The newest batch may be repeated and is kept whole.
                if old <= batches[-1] and old < batch_id:
                    _drop_part(spark, log, old, b)

    return keep


def _current(spark: SparkSession, folder: str, keys: list[str], buckets: list[int] | None = None) -> DataFrame:
    """Rows and ``bucket`` of the current state: the snapshots' rows that no later change replaces, and of the
    changes each key's last (a batch holds a key at most once)."""
    log, snapshots = f"{folder}/changes", f"{folder}/snapshots"
    changed, kept = _parts(spark, log), _parts(spark, snapshots)
    chosen = sorted({*changed, *kept} if buckets is None else buckets)
    old = [_part(snapshots, kept[b][-1], b) for b in chosen if b in kept]
    new = [_part(log, k, b) for b in chosen for k in changed.get(b, []) if k > (kept[b][-1] if b in kept else -1)]
    if not old and not new:
        raise FileNotFoundError(f"no finished batch under {folder}")
    state = spark.read.option("basePath", snapshots).parquet(*old).drop("batch") if old else None
    if new:
        latest = spark.read.option("basePath", log).parquet(*new)
        if len({p.rsplit("/", 2)[1] for p in new}) > 1:
            rest = [c for c in latest.columns if c not in keys and c != "batch"]
            last = latest.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
            latest = last.select(*keys, "_row.*")
        latest = latest.drop("batch")
        if state is not None:
            latest = state.join(latest, _same(state, latest, keys), "left_anti").unionByName(latest)
        state = latest
    return state


def read_changes(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Current state per key: for every key its row of the last batch that changed it."""
    state = _current(spark, folder, keys)
    return state.select(*keys, *[c for c in state.columns if c not in keys and c != "bucket"])


def newest_per_device(
    stream: DataFrame,
    folder: str,
    device: str = "device_id",
    ts: str = "ts",
    tie: str = "id",
    once: bool = True,
) -> StreamingQuery:
    """Keeps each device's newest record as a change log under ``folder/changes``.

    For streams that send a record once. State is one record per device; a batch writes only the devices it touched. Read it with
    ``read_changes(spark, folder, [device])`` and judge activity at reading time.
    """
    rest = [c for c in stream.columns if c not in (device, ts, tie)]
    record = F.struct(F.col(ts), F.col(tie), *[F.col(c) for c in rest])
    latest = stream.groupBy(device).agg(F.max(record).alias("_row")).select(device, "_row.*")
    return _start(latest, _changes(folder, [device]), folder, "update", once)


def daily_energy(
    stream: DataFrame, folder: str, ts: str = "ts", value: str = "consumo_kwh", once: bool = True
) -> StreamingQuery:
    """Keeps the energy of each day as a change log under ``folder/changes``.

    For streams that send a record once (else total the keyed table). State is one row per calendar
    day, so it needs no watermark and no reading is ever too late.
    """
    timed = stream.filter(F.col(ts).isNotNull())
    days = timed.groupBy(F.to_date(ts).alias("day")).agg(*sums.partial(F.col(value)))
    return _start(days, _changes(folder, ["day"], buckets=1), folder, "update", once)


def read_daily(spark: SparkSession, folder: str) -> DataFrame:
    days = read_changes(spark, folder, ["day"])
    return days.groupBy(times.day_label(F.col("day")).alias("label")).agg(sums.refold(2).alias("value"))


def read_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly energy rolled up from the daily partial sums."""
    days = read_changes(spark, folder, ["day"])
    return days.groupBy(times.month_label(F.col("day")).alias("label")).agg(sums.refold(2).alias("value"))


def on_time(
    stream: DataFrame, folder: str, delay: str = "2 days", key: str = "id", ts: str = "ts", value: str = "consumo_kwh",
    compact: int = COMPACT, once: bool = True,
) -> StreamingQuery:
    """Keeps the records that come within ``delay`` of the newest, each once, and their energy per day.

    For feeds without an end: the state, the keys seen, is bounded by the watermark. What comes later than
    that is not in ``folder/accepted`` and not in the days; ``late_rows`` finds it among the arrived records,
    so that nothing vanishes. Untimed records are neither.
    """
    kept = stream.where(F.col(ts).isNotNull()).withColumn("_at", F.col(ts).cast("timestamp"))
    kept = kept.withWatermark("_at", delay).dropDuplicatesWithinWatermark([key])
    days, sums_of = f"{folder}/days", f"{folder}/sums"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        accepted = _version(f"{folder}/accepted", batch_id)
        batch.write.mode("overwrite").parquet(accepted)
        rows = spark.read.schema(batch.schema).parquet(accepted)
        own = rows.groupBy(F.to_date(F.window("_at", "1 day")["start"]).alias("day")).agg(*sums.partial(F.col(value)))
        own.coalesce(1).write.mode("overwrite").parquet(_version(days, batch_id))
        if compact and (batch_id + 1) % compact == 0 and batch_id not in _versions(spark, sums_of):
            _day_sums(spark, folder).coalesce(1).write.mode("overwrite").parquet(_version(sums_of, batch_id))
        done = _versions(spark, sums_of)
        for old in [k for k in _versions(spark, days) if done and k <= done[-1] and k < batch_id]:
            _drop_version(spark, days, old)
        for old in done[:-1]:
            _drop_version(spark, sums_of, old)

    return _start(kept, merge, folder, "append", once)


def _day_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Partial sums per day (several rows per day) of the last fold and the batches after it."""
    folds = _versions(spark, f"{folder}/sums")
    paths = [_version(f"{folder}/sums", folds[-1])] if folds else []
    paths += [_version(f"{folder}/days", k) for k in _versions(spark, f"{folder}/days") if not folds or k > folds[-1]]
    if not paths:
        raise FileNotFoundError(f"no finished batch under {folder}")
    parts = spark.read.parquet(*paths)
    return parts.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums.PARTS])


def read_on_time(spark: SparkSession, folder: str) -> DataFrame:
    """The accepted records."""
    paths = [_version(f"{folder}/accepted", k) for k in _versions(spark, f"{folder}/accepted")]
    if not paths:
        raise FileNotFoundError(f"no finished batch under {folder}")
    return spark.read.parquet(*paths).drop("_at")


def late_rows(arrived: DataFrame, folder: str, key: str = "id", ts: str = "ts") -> DataFrame:
    """Timed records of ``arrived`` (all that the stream has read) whose key came too late; copies of accepted
    records are not among them."""
    known = read_on_time(arrived.sparkSession, folder).select(key)
    timed = arrived.where(F.col(ts).isNotNull())
    return timed.join(known, _same(timed, known, [key]), "left_anti")


def read_windowed_daily(spark: SparkSession, folder: str, late: DataFrame | None = None, ts: str = "ts", value: str = "consumo_kwh") -> DataFrame:
    """Energy per day of the accepted records, and of ``late`` ones if given."""
    days = _day_sums(spark, folder)
    if late is not None:
        days = days.unionByName(late.groupBy(F.to_date(ts).alias("day")).agg(*sums.partial(F.col(value))))
    return days.groupBy(times.day_label(F.col("day")).alias("label")).agg(sums.refold(2).alias("value"))


def append_stream(stream: DataFrame, folder: str, once: bool = True) -> StreamingQuery:
    """Appends a stream to a parquet table under ``folder/table``, exactly once per record."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", f"{folder}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start(f"{folder}/table")
