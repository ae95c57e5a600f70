import gzip

import pytest
from pyspark.sql import functions as F

from wattframe import schema as S, session
from wattframe.plans import mining, queries
from wattframe.sources import headers, readings, sinks
from wattframe.sources.chunks import with_chunks


@pytest.fixture
def blocks(spark):
    """Files are cut into blocks of 2 kB, so that many tasks read each."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, sizes, header="consumo_kwh,timestamp"):
    for f, n in enumerate(sizes):
        lines = [header] + [f"{i},2024-01-0{f + 1} 00:00:00" + ("\n" if i % 7 == 0 else "") for i in range(n)]
        (folder / f"p{f}.csv").write_text("\n".join(lines) + "\n")


def chunks(df):
    rows = df.groupBy("batch_id", F.substring("timestamp", 1, 10).alias("file")).agg(
        F.min(F.col("consumo_kwh").cast("int")).alias("a"), F.max(F.col("consumo_kwh").cast("int")).alias("b"),
        F.count("*").alias("n")).orderBy("batch_id").collect()
    return [(r.batch_id, r.file, r.a, r.b, r.n) for r in rows]


def wanted(sizes, rows):
    out = []
    for f, n in enumerate(sizes):
        out += [(f"2024-01-0{f + 1}", a, min(a + rows, n) - 1, min(rows, n - a)) for a in range(0, n, rows)]
    return [(i, *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("sizes,rows", [((1000, 1001, 299), 300), ((700,), 100), ((5, 0, 7), 100), ((600, 600), 600)])
def test_chunks_do_not_depend_on_blocks(spark, blocks, tmp_path, sizes, rows):
    write(tmp_path, sizes)
    df = readings.read_readings(spark, str(tmp_path), S.MINING, chunk_rows=rows)
    assert len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}) > 1 or sum(sizes) < 100
    assert chunks(df) == wanted(sizes, rows)
    first = readings.read_readings(spark, str(tmp_path), S.MINING, max_batches=3, chunk_rows=rows)
    assert chunks(first) == wanted(sizes, rows)[:3]


def test_chunks_of_other_files(spark, blocks, tmp_path):
    lines = ["consumo_kwh,timestamp"] + [f"{i},2024-01-01 00:00:00" for i in range(500)]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "p.csv.gz").write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    df = readings.read_readings(spark, str(tmp_path / "z"), S.MINING, chunk_rows=200)
    assert chunks(df) == wanted((500,), 200)
    spark.range(0, 500, 1, 1).select(F.col("id").cast("string").alias("consumo_kwh"), F.lit("2024-01-01").alias("timestamp")).write.parquet(
        str(tmp_path / "q.parquet"))
    df = readings.read_readings(spark, str(tmp_path / "q.parquet"), S.MINING, chunk_rows=200)
    assert chunks(df) == wanted((500,), 200)
    with pytest.raises(ValueError):
        with_chunks([df], "parquet", 0)


def test_chunks_choose_their_own_hours(spark, blocks, tmp_path):
    """In one file, the first chunk has its hours in ``timestamp``, the second in ``hora_dia``."""
    lines = ["timestamp,fecha,hora_dia,consumo_kwh"]
    lines += [f"2024-01-05 {1 + i % 20:02d}:00:00,2024-01-05,0:00,1" for i in range(200)]
    lines += [f"2024-01-05 00:00:00,2024-01-05,{1 + i % 20}:30,1" for i in range(200)]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    rows = readings.read_readings(spark, str(tmp_path / "p.csv"), S.MINING, chunk_rows=200)
    dated = mining.mining_readings(rows).groupBy("batch_id").agg(F.min(F.hour("ts")).alias("a"), F.max(F.hour("ts")).alias("b")).collect()
    assert sorted(map(tuple, dated)) == [(0, 1, 20), (1, 1, 20)]
    mining.build(spark, str(tmp_path / "p.csv"), str(tmp_path / "out"), chunk_rows=200)
    assert sinks.read_bundle(spark, str(tmp_path / "out"))["resumen"].first().n_registros == 400


def test_headers_are_read_by_name(spark, tmp_path):
    write(tmp_path, (3,))
    (tmp_path / "p1.csv").write_text('﻿timestamp, consumo_kwh ,casa_id\r\n2024-01-02 00:00:00,7,"A, b"\r\n')
    (tmp_path / "p2.csv").write_text("consumo_kwh,timestamp\n")
    (tmp_path / "p3.csv").write_text("")
    df = readings.read_readings(spark, str(tmp_path), S.MINING)
    assert sorted((r.timestamp, r.consumo_kwh, r.casa_id) for r in df.collect()) == [
        *(("2024-01-01 00:00:00", str(i), None) for i in range(3)), ("2024-01-02 00:00:00", "7", "A, b")]
    chunked = readings.read_readings(spark, str(tmp_path), S.MINING, chunk_rows=2)
    assert sorted((r.batch_id, r.consumo_kwh) for r in chunked.collect()) == [(0, "0"), (0, "1"), (1, "2"), (2, "7")]


def test_each_header_meets_the_contract(spark, tmp_path):
    write(tmp_path, (3,))
    (tmp_path / "p1.csv").write_text("momento,consumo_kwh\n2024-01-02 00:00:00,7\n")
    with pytest.raises(ValueError, match="mining readings need"):
        readings.read_readings(spark, str(tmp_path), S.MINING)


def test_defaults_fill_what_a_header_lacks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fecha,consumo_kwh\n2024-01-02,7\n")
    (tmp_path / "b.csv").write_text("fecha,consumo_kwh,costo_mx,usuario\n2024-01-03,8,2.5,ana\n")
    rows = readings.read_readings(spark, str(tmp_path), S.DASHBOARD).orderBy("fecha").collect()
    assert [(r.costo_mx, r.usuario, r.estado) for r in rows] == [("0.0", "—", "activo"), ("2.5", "ana", "activo")]


def test_groups_of_headers(spark, tmp_path):
    names = []
    for i in range(40):
        (tmp_path / f"{i:02d}.csv").write_text("a,b\n1,2\n" if i % 3 else "b,a\r\n1,2\n")
        names.append((tmp_path / f"{i:02d}.csv").as_uri())
    groups = headers.by_header(spark, names)
    assert [len(g) for g in groups] == [14, 26] and groups[0][0] == names[0]


def test_chunks_go_on_through_the_parts_of_a_folder(spark, blocks, tmp_path):
    """Two folders of three files each, told apart by their chunks alone."""
    for f, sizes in enumerate(((250, 1, 49), (120, 0, 500))):
        (tmp_path / f"t{f}").mkdir()
        at = 0
        for p, n in enumerate(sizes):
            lines = ["consumo_kwh,timestamp"] + [f"{i},2024-01-0{f + 1} 00:00:00" for i in range(at, at + n)]
            (tmp_path / f"t{f}" / f"p{p}.csv").write_text("\n".join(lines) + "\n")
            at += n
    read = lambda **more: readings.read_readings(
        spark, str(tmp_path / "*"), S.MINING, batch_folders=True, chunk_rows=100, **more)
    assert chunks(read()) == wanted((300, 620), 100)
    assert chunks(read(max_batches=4)) == wanted((300, 620), 100)[:4]


def test_chunked_tables_come_in_parts(spark, monkeypatch):
    """No task orders or writes a whole table, and the chunks do not depend on the parts; some ids are null."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 5 != 0, F.col("id") % 1500).alias("event_id"),
        F.timestamp_seconds(F.col("id") * 1000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 50).alias("user_id"), (F.col("id") / 8).alias("value"))
    monkeypatch.setattr(queries.tables, "load", lambda *a: rows)
    written = []
    monkeypatch.setattr(queries, "work_dir", lambda s, n: written.append(session.work_dir(s, n)) or written[-1])
    got = []
    for part in (100, 10_000):
        monkeypatch.setattr(queries, "PART", part)
        got.append(sorted(map(tuple, queries.csv_chunks(spark, "").collect())))
    assert got[0] == got[1] and sum(r[1] for r in got[0]) == 4000
    sizes = spark.read.csv(written[0], header=True).groupBy(F.input_file_name()).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 400 and sizes[1] >= 40
