import random
from datetime import datetime, timedelta

import pytest
from conftest import plan
from pyspark.sql import functions as F

from wattframe.operators import pages, ranking

SCHEMA = "id bigint, ts timestamp_ntz, v double"
START = datetime(2024, 1, 1)


def rows(n, seed=1):
    r = random.Random(seed)
    return [(i, None if r.random() < 0.1 else START + timedelta(hours=r.randrange(n // 3 + 1)), float(i)) for i in range(n)]


@pytest.mark.parametrize("n,size", [(100, 7), (98, 7), (5, 7), (301, 50)])
def test_pages_equal_those_by_offset(spark, n, size):
    df = spark.createDataFrame(rows(n), SCHEMA).repartition(5)
    index = pages.page_index(df, size)
    order = [F.desc_nulls_last("ts"), F.asc("id")]
    for number in (0, 1, 2, 3, index.pages - 1, index.pages, index.pages + 5):
        want, got = ranking.page(df, number, size, order), pages.page_at(df, index, number)
        assert (got.number, got.pages) == (want.number, want.pages)
        assert [r.id for r in got.rows.collect()] == [r.id for r in want.rows.collect()]


def test_a_page_is_a_range(spark, tmp_path):
    spark.createDataFrame(rows(400), SCHEMA).where("ts is not null").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    text = plan(pages.page_at(df, pages.page_index(df, 10), 17).rows)
    assert "Offset" not in text and "PushedFilters" in text and "LessThan(ts" in text and "GreaterThan(ts" in text


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    page = pages.page_at(df, pages.page_index(df, 5), 3)
    assert page.rows.count() == 0 and page.pages == 1
