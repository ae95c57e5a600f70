import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import plan
from pyspark.sql import functions as F

from wattframe.operators import devices, filters, ranking

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(3000):
        device = "hot" if rng.random() < 0.35 else f"d{rng.randrange(40)}"
        out.append((i, START + timedelta(minutes=rng.randrange(3000)), device,
                    rng.choice(["activo", "normal", "inverso"]), float(rng.randrange(90)), float(i)))
    return out


@pytest.fixture(scope="module")
def readings(spark, rows):
    schema = "id bigint, ts timestamp_ntz, device_id string, estado string, consumo_kwh double, costo double"
    return spark.createDataFrame(rows, schema).repartition(9)


def _newest(rows):
    best = {}
    for r in rows:
        if r[2] not in best or (r[1], r[0]) > (best[r[2]][1], best[r[2]][0]):
            best[r[2]] = r
    return best


def test_newest_per_device(readings, rows):
    got = {r.device_id: r.id for r in ranking.newest_per(readings).collect()}
    assert got == {d: r[0] for d, r in _newest(rows).items()}


def test_next_reading_equals_brute_force(readings, rows):
    chains = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        chains[r[2]].append(r)
    expected = {}
    for chain in chains.values():
        for a, b in zip(chain, chain[1:] + [None]):
            expected[a[0]] = (None, None) if b is None else (b[4], b[5])
    for span in ("hour", "day", "month"):
        got = ranking.next_reading(readings, "device_id", span=span).collect()
        assert {r.id: (r.consumo_next, r.costo_next) for r in got} == expected


def test_next_reading_keeps_null_values(frame):
    df = frame([(1, START, "a", None, 1.0), (2, START, "a", 3.0, 2.0)],
               "id int, ts timestamp_ntz, casa_id string, consumo_kwh double, costo double")
    got = {r.id: (r.consumo_next, r.costo_next) for r in ranking.next_reading(df).collect()}
    assert got == {1: (3.0, 2.0), 2: (None, None)}


def test_next_reading_needs_entity_and_time(frame):
    rows = [(1, START, None, 1.0, 1.0), (2, START, None, 2.0, 1.0), (3, None, "a", 3.0, 1.0),
            (4, START, "a", 4.0, 1.0), (5, None, "a", 5.0, 1.0)]
    df = frame(rows, "id int, ts timestamp_ntz, casa_id string, consumo_kwh double, costo double")
    got = {r.id: r.consumo_next for r in ranking.next_reading(df).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None}


def test_sample_keeps_rows_without_a_batch(frame):
    df = frame([(i, None if i % 3 else "b") for i in range(30)], "id int, batch_id string")
    pool = ranking.sample_per_batch(df, per_batch=15)
    assert {r.batch_id: r["count"] for r in pool.groupBy("batch_id").count().collect()} == {None: 15, "b": 10}


def test_sample_is_bounded_and_repeatable(readings):
    batched = readings.withColumn("batch_id", F.to_date("ts").cast("string"))
    pool = ranking.sample_per_batch(batched, per_batch=100)
    per = {r.batch_id: r["count"] for r in pool.groupBy("batch_id").count().collect()}
    sizes = {r.batch_id: r["count"] for r in batched.groupBy("batch_id").count().collect()}
    assert per == {b: min(100, n) for b, n in sizes.items()}
    ids = sorted(r.id for r in pool.select("id").collect())
    assert len(set(ids)) == len(ids)
    again = ranking.sample_per_batch(batched.orderBy(F.rand()).repartition(3), per_batch=100, spread=1)
    assert ids == sorted(r.id for r in again.select("id").collect())
    other = ranking.sample_per_batch(batched, per_batch=100, seed=43)
    assert ids != sorted(r.id for r in other.select("id").collect())
    assert ranking.sample_per_batch(batched, per_batch=100, cap=50).count() == 50


def test_pages_partition_the_rows(readings):
    order = [F.desc("ts"), F.asc("id")]
    few = ranking.newest(readings, 33)
    first = ranking.page(few, 1, 7, order)
    assert first.pages == 5
    pages = [ranking.page(few, n, 7, order).rows.collect() for n in range(1, 6)]
    assert [len(p) for p in pages] == [7, 7, 7, 7, 5]
    assert len({r.id for p in pages for r in p}) == 33
    assert ranking.page(few, 99, 7, order).number == 5
    assert ranking.page(few, 0, 7, order).number == 1
    empty = ranking.page(few.limit(0), 3, 7, order)
    assert (empty.number, empty.pages, empty.rows.count()) == (1, 1, 0)


def test_keyset_pages_walk_everything_once(frame):
    rows = [(i, START + timedelta(minutes=i // 3) if i % 10 else None) for i in range(60)]
    df = frame(rows, "id int, ts timestamp_ntz")
    whole = [r.id for r in ranking.newest(df, 60).collect()]
    seen, last = [], None
    while True:
        page = ranking.page_after(df, 7, last=last).collect()
        if not page:
            break
        seen += [r.id for r in page]
        last = (page[-1].ts, page[-1].id)
    assert seen == whole and len(seen) == 60


def test_clamped_and_top(frame):
    df = frame([("b", 2.0), ("a", 2.0), ("c", 9.0)], "casa_id string, total double")
    assert ranking.clamped(df, -3).count() == 1
    assert ranking.clamped(df, 2).count() == 2
    assert [r.casa_id for r in ranking.top_k(df, 2).collect()] == ["c", "a"]


def test_untimed_rows_sort_last(frame):
    df = frame([(1, None), (2, START)], "id int, ts timestamp_ntz")
    assert [r.id for r in ranking.newest_first(df).collect()] == [2, 1]


def test_activity(readings, rows):
    newest = _newest(rows)
    anchor = max(r[1] for r in rows)
    for minutes in (10, 200):
        bound = anchor - timedelta(minutes=minutes)
        seen = sum(r[1] >= bound for r in newest.values())
        ok = sum(r[1] >= bound and r[3] != "inverso" for r in newest.values())
        assert devices.active_devices(readings, interval=f"{minutes} minutes").first()[0] == seen
        split = devices.active_split(readings, interval=f"{minutes} minutes").first()
        assert (split.activos, split.inactivos) == (ok, len(newest) - ok)
    later = devices.active_split(readings, anchor="2031-01-01").first()
    assert (later.activos, later.inactivos) == (0, len(newest))


def test_live_cards(readings, rows):
    card = devices.live_cards(readings.withColumnRenamed("consumo_kwh", "consumo")).first()
    assert card.consumo == sum(r[4] for r in rows if r[1].month == 1)


def test_filters(readings, rows):
    anchor = max(r[1] for r in rows)
    assert filters.trailing(readings, "1 day").count() == sum(r[1] >= anchor - timedelta(days=1) for r in rows)
    assert filters.trailing(readings, "0 days").count() == sum(r[1] == anchor for r in rows)
    assert filters.current_month(readings, anchor="2024-02-10").count() == 0
    assert filters.search(readings, "HOT", ["device_id"]).count() == sum(r[2] == "hot" for r in rows)


def test_first_batches(frame):
    df = frame([(b, i) for i, b in enumerate("abcabcd")], "batch_id string, id int")
    assert filters.first_batches(df, 2).count() == 4
    assert filters.first_batches(df, 0).count() == 7
    assert filters.first_batches(df, 99).count() == 7


def test_valid_time(frame):
    df = frame([(datetime(1970, 1, 1),), (START,), (None,)], "ts timestamp_ntz")
    assert filters.valid_time(df).count() == 1


def test_newest_per_device_when_devices_are_many(spark, frame, monkeypatch):
    """Above the broadcast limit only each task's newest rows move, hot device included."""
    rows = [(i, None if i % 9 == 0 else START + timedelta(minutes=i * 7 % 500), f"d{i % 40 if i % 3 else 0}") for i in range(900)]
    df = frame(rows, "id bigint, ts timestamp_ntz, device_id string").repartition(6)
    want = sorted(map(tuple, ranking.newest_per(df).collect()))
    monkeypatch.setattr(ranking, "BROADCAST_BYTES", 0)
    many = ranking.newest_per(df)
    assert sorted(map(tuple, many.collect())) == want
    text = plan(many)
    assert "WindowGroupLimit" in text and "SortMergeJoin" not in text and "BroadcastHashJoin" not in text
