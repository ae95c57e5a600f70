import random
from datetime import datetime, timedelta

import pytest
from conftest import plan
from pyspark.sql import functions as F

from wattframe.operators import ranking
from wattframe.sources import daily

SCHEMA = "id bigint, ts timestamp_ntz, estado string"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [(i, None if i % 11 == 0 else START + timedelta(days=r.randrange(40), hours=r.randrange(3)), r.choice("ab")) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("daily") / "t")
    daily.write_by_day(df.repartition(3), path)
    return df, path


@pytest.mark.parametrize("n", [0, 1, 10, 40, 300, 560, 600, 1000])
def test_newest_equals_that_of_the_whole_table(spark, table, n):
    df, path = table
    assert daily.newest_by_day(spark, path, n).collect() == ranking.newest(df, n).collect()
    some = F.col("estado") == "a"
    assert daily.newest_by_day(spark, path, n, where=some).collect() == ranking.newest(df.where(some), n).collect()


def test_only_the_newest_days_are_read(spark, table):
    df, path = table
    names = daily.days(spark, path)
    assert names[0] > names[1] and names[-1].endswith("__HIVE_DEFAULT_PARTITION__") and len(names) == 41
    used = daily.newest_by_day(spark, path, 20).inputFiles()
    days = {f.rsplit("/", 2)[1] for f in used}
    assert days == set(names[: len(days)]) and len(days) <= 3
    assert "Scan parquet" in plan(daily.newest_by_day(spark, path, 20))
    with pytest.raises(FileNotFoundError):
        daily.newest_by_day(spark, f"{path}/none", 5)
