import pytest

from wattframe import session


def test_working_folders_stay_until_discarded(spark, frame):
    session.discard(spark)
    other = session.shared_dir(spark) + "/other"
    frame([(1,)], "a int").write.mode("overwrite").parquet(other)
    kept = session.materialise(frame([(1,), (2,)], "a int"))
    assert kept.count() == 2
    assert session.discard(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0])
    assert spark.read.parquet(other).count() == 1 and session.discard(spark) == 0


def test_small_tables_are_sent_and_large_ones_are_not(spark, monkeypatch):
    df = spark.range(100)
    assert "ResolvedHint" in session.small(df)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 10)
    assert "ResolvedHint" not in session.small(df)._jdf.queryExecution().analyzed().toString()
