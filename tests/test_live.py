import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattframe.operators import alerts, devices, energy, ranking, standardise
from wattframe.sources import feed
from wattframe.streaming import live

SCHEMA = "id bigint, ts timestamp_ntz, device_id string, estado string, consumo_kwh double"
START = datetime(2024, 1, 30)


def _rows(n=1200, seed=3):
    rng = random.Random(seed)
    return [
        (i, START + timedelta(seconds=rng.randrange(4 * 86400)), f"d{rng.randrange(25)}",
         rng.choice(["activo", "inverso"]), round(rng.expovariate(0.1), 2))
        for i in range(n)
    ]


@pytest.fixture
def landing(spark, tmp_path):
    """A folder of four files whose times interleave, and all their rows."""
    path = str(tmp_path / "feed")
    rows = _rows()
    for part in range(4):
        spark.createDataFrame(rows[part::4], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, SCHEMA)


def _stream(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return live.feed_stream(spark, path, schema, "parquet", maxFilesPerTrigger=1)


def _set(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_last_n_equals_the_batch_answer(spark, landing, tmp_path):
    path, whole = landing
    out = str(tmp_path / "out")
    live.last_n_view(_stream(spark, path), out, 300, value="consumo_kwh", pool=100).awaitTermination()
    expected = ranking.newest(whole, 300)
    assert _set(live.read_latest(spark, f"{out}/view"), "id", "consumo_kwh") == _set(expected, "id", "consumo_kwh")
    assert live.read_latest(spark, f"{out}/alerts").first()[0] == alerts.zscore_count(whole, pool=100).first()[0]
    kept = {r.batch for r in spark.read.parquet(f"{out}/view").select("batch").distinct().collect()}
    assert kept == {2, 3}


def test_restart_adds_only_new_files(spark, landing, tmp_path):
    path, whole = landing
    out = str(tmp_path / "out")
    live.last_n_view(_stream(spark, path), out, 300).awaitTermination()
    live.last_n_view(_stream(spark, path), out, 300).awaitTermination()
    assert _set(live.read_latest(spark, f"{out}/view"), "id") == _set(ranking.newest(whole, 300), "id")
    late = spark.createDataFrame([(9999, START + timedelta(days=9), "d1", "activo", 1.0)], SCHEMA)
    late.write.mode("append").parquet(path)
    live.last_n_view(_stream(spark, path), out, 300).awaitTermination()
    assert _set(live.read_latest(spark, f"{out}/view"), "id") == _set(ranking.newest(whole.union(late), 300), "id")


def test_devices_equal_the_batch_answer(spark, landing, tmp_path):
    path, whole = landing
    out = str(tmp_path / "out")
    live.newest_per_device(_stream(spark, path), out).awaitTermination()
    state = live.read_changes(spark, out, ["device_id"])
    assert _set(state, "device_id", "id", "ts") == _set(ranking.newest_per(whole), "device_id", "id", "ts")
    assert devices.active_split(state, interval="2 hours").first() == devices.active_split(whole, interval="2 hours").first()


def test_energy_equals_the_batch_answer(spark, landing, tmp_path):
    path, whole = landing
    out = str(tmp_path / "out")
    live.daily_energy(_stream(spark, path), out).awaitTermination()
    assert _set(live.read_daily(spark, out), "label", "value") == _set(energy.daily_totals(whole), "label", "value")
    assert _set(live.read_monthly(spark, out), "label", "value") == _set(energy.monthly_totals(whole), "label", "value")


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    keep = live._changes(out, ["device_id"])
    rows = spark.createDataFrame([("a", 1)], "device_id string, n int")
    keep(rows, 0)
    keep(rows, 0)
    keep(rows.withColumn("n", F.lit(2)), 1)
    assert spark.read.parquet(f"{out}/changes").count() == 2
    assert live.read_changes(spark, out, ["device_id"]).first().n == 2


def test_redelivered_records_count_once(spark, landing, tmp_path):
    path, whole = landing
    again = spark.createDataFrame(_rows()[:500], SCHEMA)
    again.write.mode("append").parquet(path)
    out = str(tmp_path / "out")
    live.keyed_table(_stream(spark, path), out).awaitTermination()
    assert _set(live.read_changes(spark, out, ["id"]), "id", "consumo_kwh") == _set(whole, "id", "consumo_kwh")


def test_a_key_sent_again_replaces_its_record(spark, tmp_path):
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    at = lambda d: START + timedelta(days=d)
    batches = [
        [(1, at(1), "a", "activo", 1.0), (2, at(2), "a", "activo", 2.0), (3, at(3), "a", "activo", 3.0)],
        [(2, at(2), "a", "activo", 9.0), (2, at(1), "a", "activo", 8.0)],  # inside a batch the newest time wins
        [(3, at(-30), "a", "activo", 4.0)],  # weeks late, and out of the view again
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        live.last_n_view(_stream(spark, path), out, 2).awaitTermination()
    assert _set(live.read_latest(spark, f"{out}/view"), "id", "consumo_kwh") == [(1, 1.0), (2, 9.0)]
    assert _set(live.read_changes(spark, out, ["id"]), "id", "consumo_kwh") == [(1, 1.0), (2, 9.0), (3, 4.0)]


def _files(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


@pytest.mark.parametrize("buckets", [1, 4])
def test_snapshots_bound_the_change_log(spark, tmp_path, buckets):
    out = str(tmp_path / "out")
    keep = live._changes(out, ["k"], compact=3, buckets=buckets)
    for i in range(10):
        rows = spark.createDataFrame([(i % 4, i), (100 + i, i), (None, i)], "k int, n int")
        keep(rows, i)
        if i == 5:
            keep(rows, i)  # repeated after its snapshot
        changed, kept = live._parts(spark, f"{out}/changes"), live._parts(spark, f"{out}/snapshots")
        assert all(len(v) <= 4 for v in changed.values()) and all(len(v) == 1 for v in kept.values())
    want = {**{100 + i: i for i in range(10)}, 0: 8, 1: 9, 2: 6, 3: 7, None: 9}
    assert {r.k: r.n for r in live.read_changes(spark, out, ["k"]).collect()} == want
    assert live.read_changes(spark, out, ["k"]).count() == len(want)


def test_a_batch_of_one_bucket_rewrites_one_bucket(spark, tmp_path):
    out = tmp_path / "out"
    keep = live._changes(str(out), ["k"], compact=2, buckets=8)
    for i in range(4):
        keep(spark.range(200).select(F.col("id").alias("k"), F.lit(i).alias("n")), i)
    whole = live._parts(spark, f"{out}/snapshots")
    bucket = spark.range(200).where(F.pmod(F.xxhash64("id"), F.lit(8)) == 3).select(F.col("id").alias("k"), F.lit(9).alias("n"))
    before = _files(out / "snapshots")
    for i in range(4, 8):
        keep(bucket, i)
    after = _files(out / "snapshots")
    assert len(whole) == 8 and {f.split("/")[1] for f in before ^ after} <= {"bucket=3"} | {
        # Changes of the earlier batches that were still waiting for their bucket's turn.
        f"bucket={b}" for b in range(8) if whole[b][-1] < 3}
    last = _files(out / "snapshots")
    for i in range(8, 12):
        keep(bucket, i)
    moved = last ^ _files(out / "snapshots")
    assert {f.split("/")[1] for f in moved} == {"bucket=3"}
    assert {r.n: r["count"] for r in live.read_changes(spark, str(out), ["k"]).groupBy("n").count().collect()} == {
        3: 200 - bucket.count(), 9: bucket.count()}


@pytest.mark.parametrize("reserve", [0, 3, 20])
def test_the_view_is_carried_from_batch_to_batch(spark, tmp_path, monkeypatch, reserve):
    """Keys come again, move back and forth, tie and lose their time; the view is always that of the whole table."""
    rng = random.Random(reserve)
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    reads, own = [], live.read_changes
    monkeypatch.setattr(live, "read_changes", lambda *a: reads.append(1) or own(*a))
    table, n = {}, 12
    for turn in range(9):
        rows = {}
        for _ in range(25):
            key = rng.randrange(90) if turn != 6 else rng.choice(sorted(table, key=lambda k: table[k][1] or START)[-14:])
            day = rng.randrange(8) if turn != 6 else -5  # turn 6 moves the newest keys far back
            rows[key] = (key, None if rng.random() < 0.1 else START + timedelta(days=day), "a", "activo", float(turn))
        table |= rows
        spark.createDataFrame(list(rows.values()), SCHEMA).coalesce(1).write.mode("append").parquet(path)
        live.last_n_view(_stream(spark, path), out, n, reserve=reserve, compact=2, buckets=3).awaitTermination()
        order = sorted(table.values(), key=lambda r: (r[1] is not None, r[1] or START, r[0]), reverse=True)
        assert _set(live.read_latest(spark, f"{out}/view"), "id", "consumo_kwh") == sorted((r[0], r[4]) for r in order[:n])
    assert len(reads) <= (1 if reserve == 20 else 9)


def test_a_batch_reads_itself_and_what_is_carried(spark, landing, tmp_path, monkeypatch):
    """With times that move on, no batch after the first reads the keyed table."""
    path, whole = landing
    out = str(tmp_path / "out")
    read = []
    own = live._current
    monkeypatch.setattr(live, "_current", lambda *a: read.append(a[3:]) or own(*a))
    live.last_n_view(_stream(spark, path), out, 100, compact=0).awaitTermination()
    assert read == []
    assert _set(live.read_latest(spark, f"{out}/view"), "id") == _set(ranking.newest(whole, 100), "id")
    assert spark.read.parquet(f"{out}/top").groupBy("batch").count().agg(F.max("count")).first()[0] <= 202


def test_late_records_are_kept_aside(spark, tmp_path):
    """On time and late are all records, each once; copies of accepted records count once, untimed ones are neither."""
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")
    at = lambda d: START + timedelta(days=d)
    batches = [
        [(1, at(0), "a", "x", 1.0), (2, at(10), "a", "x", 2.0), (None, at(10), "a", "x", 0.5)],
        [(3, at(9.5), "a", "x", 4.0), (2, at(10), "a", "x", 2.0), (4, None, "a", "x", 8.0)],
        [(5, at(3), "a", "x", 16.0), (6, at(11), "a", "x", 32.0), (1, at(0), "a", "x", 1.0)],
        [(7, at(-5), "a", "x", 64.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        live.on_time(_stream(spark, path), out, "1 day", compact=2).awaitTermination()
    arrived = spark.read.parquet(path)
    late = live.late_rows(arrived, out)
    accepted = live.read_on_time(spark, out)
    assert {r.id for r in accepted.collect()} >= {1, 2, 3, 6, None} and 7 in {r.id for r in late.collect()}
    assert {r.id for r in accepted.collect()} | {r.id for r in late.collect()} == {1, 2, 3, 5, 6, 7, None}
    assert accepted.count() == accepted.select("id").distinct().count()
    known = spark.createDataFrame([r for b in batches for r in b if r[1]], SCHEMA).dropDuplicates(["id"])
    assert _set(live.read_windowed_daily(spark, out, late), "label", "value") == _set(energy.daily_totals(known), "label", "value")
    assert len(live._versions(spark, f"{out}/days")) <= 2 and len(live._versions(spark, f"{out}/sums")) == 1


def test_raw_json_lines_to_the_live_view(spark, tmp_path):
    path, out = tmp_path / "lines", str(tmp_path / "out")
    path.mkdir()
    for part in range(3):
        lines = [f'{{"id": "{part}-{i}", "timestamp": {1700000000 + 60 * i + part}, "active_power": -{i}}}' for i in range(20)]
        (path / f"{part}.json").write_text("\n".join(lines + ["not json"]))
    text = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(path))
    readings = standardise.dashboard_readings(feed.parse_feed(text))
    live.last_n_view(readings, out, 10, value="consumo").awaitTermination()
    view = live.read_latest(spark, f"{out}/view").collect()
    assert {r.id for r in view} == {f"{p}-{i}" for p in range(3) for i in (17, 18, 19)} | {"2-16"}
    assert max(r.consumo for r in view) == 19.0 and {r.estado for r in view} == {"activo"}
