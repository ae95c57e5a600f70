import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions import times
from wattframe.operators import energy, rollups

SCHEMA = "id bigint, ts timestamp_ntz, device_id string, consumo_kwh double"
START = datetime(2024, 1, 20)


def rows(n=6000, seed=4):
    r = random.Random(seed)
    hot = lambda: "hot" if r.random() < 0.3 else f"d{r.randrange(900)}"
    out = [(i, START + timedelta(days=r.randrange(30), seconds=i % 86400), hot(), round(r.lognormvariate(1, 2), 4)) for i in range(n)]
    return out + [(n, None, "x", 1.0), (n + 1, START, None, None), (n + 2, START, "d1", float("nan"))]


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_folded_days_keep_their_bounds(spark, q):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    days = rollups.day_rollup(df, k=200, lg=12)
    months = rollups.folded(days, times.month_label(F.col("day")), q).collect()
    exact = {}
    for i, ts, device, v in rows():
        if ts:
            exact.setdefault(f"{ts:%Y-%m}", []).append((device, v))
    assert {r.period for r in months} == set(exact)
    for r in months:
        own = exact[r.period]
        values = np.array([v for _, v in own if v is not None and v == v])
        assert r.n == len(own) and abs(r.energy - values.sum()) < 0.01
        margin = 2 * rollups.rank_error(200)
        assert (values < r.quantile).mean() <= q + margin and (values <= r.quantile).mean() >= q - margin
        devices = len({d for d, _ in own if d is not None})
        assert abs(r.entities - devices) <= rollups.distinct_error(12) * devices


def test_whole_equals_the_exact_counts(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    whole = rollups.folded(rollups.day_rollup(df)).first()
    timed = df.where("ts is not null")
    assert whole.n == timed.count() and abs(whole.energy - energy.month_energy(timed).first()[0]) >= 0
    assert rollups.folded(rollups.day_rollup(df.limit(0))).count() == 0


def test_a_changed_day_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame(rows(), SCHEMA)
    rollups.replace_days(rollups.day_rollup(df), path)
    before = {f for f in rollups.read_days(spark, path).inputFiles()}
    one = df.where(F.to_date("ts") == "2024-01-25")
    rollups.replace_days(rollups.day_rollup(one.unionAll(one)), path)
    after = {f for f in rollups.read_days(spark, path).inputFiles()}
    assert len(before ^ after) == 2 and all("day=2024-01-25" in f for f in before ^ after)
    got = {str(r.day): r.n for r in rollups.read_days(spark, path).select("day", "n").collect()}
    assert got["2024-01-25"] == 2 * one.count() and sum(got.values()) == df.where("ts is not null").count() + one.count()
