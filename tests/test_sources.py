import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattframe import schema as S
from wattframe.operators import energy, standardise
from wattframe.plans import dashboard, mining
from wattframe.sources import feed, readings as files, sinks

RAW = [
    ("Puebla", "2024-01-05 01:30:00", "1.5", "3"),
    ("Atlixco", "2024-01-05 13:00:00", "abc", None),
    ("Puebla", None, "2", "4"),
    (None, "2024-01-06 23:59:59", "0.25", "x"),
]


@pytest.fixture
def csv(spark, tmp_path):
    df = spark.createDataFrame(RAW, "casa_id string, timestamp string, consumo_kwh string, costo_mx string")
    df = df.withColumn("extra", F.lit("unused"))
    path = str(tmp_path / "readings.csv")
    df.repartition(2).write.option("header", True).csv(path)
    return path


def test_contract_accepts_each_alternative():
    files.check(["consumo_kwh", "timestamp"], S.MINING)
    files.check(["consumo_kwh", "fecha", "hora"], S.MINING)
    files.check(["consumo_kwh", "fecha", "hora_dia", "more"], S.MINING)
    for bad in (["timestamp"], ["consumo_kwh", "fecha"], ["consumo_kwh", "hora"], []):
        with pytest.raises(ValueError):
            files.check(bad, S.MINING)
    with pytest.raises(ValueError):
        files.check(["fecha"], S.DASHBOARD)


def test_csv_scan_keeps_known_columns_and_tags_batches(spark, csv):
    df = files.read_readings(spark, csv, S.MINING)
    assert df.columns == ["casa_id", "timestamp", "consumo_kwh", "costo_mx", "batch_id"]
    assert df.count() == 4 and df.select("batch_id").distinct().count() == 2
    one = files.read_readings(spark, csv, S.MINING, max_batches=1)
    first = df.agg(F.min("batch_id")).first()[0]
    assert one.count() == df.filter(F.col("batch_id") == first).count() < 4
    assert files.read_readings(spark, csv, S.MINING, max_batches=9).count() == 4


def test_format_resolution(spark, tmp_path):
    spark.createDataFrame(RAW, "casa_id string, timestamp string, consumo_kwh string, costo_mx string").write.parquet(
        str(tmp_path / "a.parquet")
    )
    assert files.scan(spark, str(tmp_path / "a.csv"))[1] == "parquet"
    spark.range(2).write.option("header", True).csv(str(tmp_path / "b"))
    df, fmt = files.scan(spark, str(tmp_path / "b.csv"))
    assert fmt == "csv" and df.columns == ["id"]
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "none.csv"))


def test_defaults_fill_absent_columns(spark, frame):
    df = files.apply_contract(frame([("2024-01-05", "1")], " fecha  string, consumo_kwh string"), S.DASHBOARD)
    row = df.first()
    assert (row.dispositivo, row.usuario, row.estado, row.costo_mx) == ("Smart Plug", "—", "activo", 0.0)


def test_missing_texts_in_csv(spark, tmp_path):
    path = tmp_path / "gaps.csv"
    path.write_text('fecha,consumo_kwh,estado\n2024-01-05,NaN,activo\n2024-01-06,"",null\n2024-01-07,1,NA\n2024-01-08,x,ok\n')
    df = files.read_readings(spark, str(path), S.DASHBOARD)
    rows = standardise.dashboard_batch(df).orderBy("fecha").collect()
    assert [(r.fecha.day, r.consumo_kwh, r.estado) for r in rows] == [(7, 1.0, "activo"), (8, 0.0, "ok")]


def test_header_names_are_trimmed(spark, tmp_path):
    path = tmp_path / "padded.csv"
    path.write_text("fecha , consumo_kwh\n2024-01-05,1\n")
    df = files.read_readings(spark, str(path), S.DASHBOARD)
    assert [c for c in df.columns if c != "batch_id"][:2] == ["fecha", "consumo_kwh"]
    assert df.first().consumo_kwh == "1"


def test_dashboard_batch_drops_undated_rows(frame):
    rows = [("2024-01-05", "1", None), (None, "2", "x"), ("soon", "3", "x"), ("2024-01-06 10:00:00", "abc", " ACTIVO "), ("2024-01-07", None, "x")]
    raw = files.apply_contract(frame(rows, "fecha string, consumo_kwh string, estado string"), S.DASHBOARD)
    got = [(r.fecha, r.consumo_kwh, r.estado) for r in standardise.dashboard_batch(raw).orderBy("fecha").collect()]
    assert got == [(datetime(2024, 1, 5), 1.0, "activo"), (datetime(2024, 1, 6, 10), 0.0, "activo")]


def test_mining_build(spark, csv, tmp_path):
    out = str(tmp_path / "out")
    mining.build(spark, csv, out)
    bundle = sinks.read_bundle(spark, out)
    assert bundle["resumen"].first().asDict() == {
        "n_registros": 3, "n_municipios": 2, "n_anomalias": 0, "z_threshold": 3.0,
    }
    hours = {r.label: r.value for r in sinks.from_series(bundle["consumo_hora"]).collect()}
    assert len(hours) == 24 and (hours["01"], hours["13"], hours["23"]) == (1.5, 0.0, 0.25)
    days = [(r.label, r.value) for r in sinks.from_series(bundle["consumo_dia"]).orderBy("ord").collect()]
    assert days[0][0] == "Lunes" and dict(days)["Viernes"] == 1.5 and dict(days)["Sábado"] == 0.25
    assert [tuple(r) for r in bundle["top_dispositivos"].collect()] == [("Puebla", 1.5), ("Atlixco", 0.0)]
    assert sorted(map(tuple, bundle["consumo_vs_costo"].collect())) == [(0.0, 0.0), (0.25, 0.0), (1.5, 3.0)]
    mining.build(spark, csv, out, sampled_anomalies=True, max_batches=1)
    assert sinks.read_result(spark, out, "resumen").first().n_registros < 3


def test_dashboard_build(spark, tmp_path):
    rows = [(f"2024-0{1 + i % 3}-{1 + i % 28:02d} 0{i % 10}:00:00", str(i), "activo" if i % 2 else "inactivo") for i in range(300)]
    path, out = str(tmp_path / "c.parquet"), str(tmp_path / "out")
    spark.createDataFrame(rows, "fecha string, consumo_kwh string, estado string").write.parquet(path)
    dashboard.build(spark, path, out)
    bundle = sinks.read_bundle(spark, out, sinks.DASHBOARD_BUNDLE)
    cards = bundle["cards"].first()
    monthly = sinks.from_series(bundle["mensual"]).orderBy("ord").collect()
    daily = sinks.from_series(bundle["semanal"]).orderBy("ord").collect()
    assert [r.label for r in monthly] == ["2024-01", "2024-02", "2024-03"] and len(daily) == 7
    march = [i for i in range(300) if i % 3 == 2]
    assert cards.consumo == monthly[-1].value == float(sum(march)) and cards.alertas == 5
    history = bundle["historico"].collect()
    assert len(history) == 300 and max(r.fecha for r in history).startswith("2024-03-28")


def test_empty_dashboard_is_an_error(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([("soon", "1")], "fecha string, consumo_kwh string").write.parquet(path)
    with pytest.raises(ValueError):
        dashboard.build(spark, path, str(tmp_path / "out"))


def test_missing_result(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sinks.read_result(spark, str(tmp_path), "cards")


def test_result_is_replaced(spark, tmp_path):
    for value in (1.0, 2.0):
        one = spark.createDataFrame([(value, 1, 2)], sinks.RESULTS["cards"])
        sinks.write_result(one, str(tmp_path), "cards")
    assert [r.consumo for r in sinks.read_result(spark, str(tmp_path), "cards").collect()] == [2.0]


def test_csv_export_round_trip(spark, tmp_path):
    rows = [
        ("2024-01-05", 'a "quoted", name', "line\nbreak", 1.5, 4.8, "Normal ✅"),
        ("2024-01-06", " padded ", "", 0.001, 1234.5, "x,y"),
    ]
    df = spark.createDataFrame(rows, "fecha string, dispositivo string, usuario string, consumo double, costo double, estado string")
    path = sinks.export_csv(df, str(tmp_path), "2024-01-31")
    assert path.endswith("historico_2024-01-31")
    back = sinks.read_export(spark, path)
    assert back.columns == ["fecha", "dispositivo", "usuario", "consumo_kwh", "costo_mxn", "estado"]
    got = sorted((r.fecha, r.dispositivo, r.usuario or "", float(r.consumo_kwh), r.costo_mxn, r.estado) for r in back.collect())
    assert got == [(f, d, u, c, f"{m:.2f}", e) for f, d, u, c, m, e in rows]


def test_export_of_nothing_writes_no_rows(spark, tmp_path):
    schema = "fecha string, dispositivo string, usuario string, consumo double, costo double, estado string"
    path = sinks.export_csv(spark.createDataFrame([], schema), str(tmp_path), "x")
    assert spark.read.option("header", True).schema("fecha string").csv(path).count() == 0


def test_report_log(spark, tmp_path):
    path = str(tmp_path / "reports")
    feed.append_report(spark, path, at=datetime(2024, 1, 5, 10))
    feed.append_report(spark, path, tipo="Otro", at=datetime(2024, 1, 6))
    log = feed.read_reports(spark, path)
    assert log.select("id").distinct().count() == 2
    rows = standardise.report_rows(log, "2025-01-01 00:00:00").orderBy("fecha").collect()
    assert [(r.fecha, r.tipo, r.usuario, r.formato, r.estado) for r in rows] == [
        ("2024-01-05", "Consumo mensual", "Sistema", "PDF", "Pendiente"),
        ("2024-01-06", "Otro", "Sistema", "PDF", "Pendiente"),
    ]


def test_feed_records(spark, frame):
    raw = frame([('{"id": "k1", "timestamp": 1700000000, "active_power": -12.5, "extra": {}}',), ("not json",), ("{}",)], "value string")
    rows = feed.parse_feed(raw).collect()
    assert (rows[0].id, rows[0].timestamp, rows[0].active_power, rows[0].estado) == ("k1", "1700000000", "-12.5", None)
    assert len(rows) == 3 and rows[1].id is None and rows[2].id is None
    assert feed.parse_feed(frame([(None,)], "value string")).count() == 1
    readings = standardise.dashboard_readings(feed.parse_feed(raw)).collect()
    assert [(r.fecha, r.device_id, r.consumo, r.estado) for r in readings] == [("2023-11-14", "Smart Plug", 12.5, "activo")]


def test_history_keeps_untimed_rows_on_request(frame):
    raw = feed.parse_feed(frame([('{"id": "a", "active_power": 1500, "timestamp": 1700000000}',), ('{"id": "b", "current": "-1"}',)], "value string"))
    rows = {r.id: r for r in standardise.history_rows(raw).collect()}
    assert (rows["a"].consumo, rows["a"].costo, rows["a"].fecha) == (1.5, 4.8, "2023-11-14")
    assert (rows["b"].fecha, rows["b"].estado) == ("—", S.HISTORY_REVERSE)
    assert standardise.history_rows(raw, keep_untimed=False).count() == 1


def test_tariff_is_a_parameter(frame):
    raw = feed.parse_feed(frame([('{"consumo_kwh": 10, "timestamp": 1700000000}',)], "value string"))
    assert standardise.dashboard_readings(raw).first().costo == 0.015
    assert standardise.dashboard_readings(raw, tariff=2.0).first().costo == 20.0


def test_scoring_records_and_rejects(spark, tmp_path):
    path = tmp_path / "records.json"
    path.write_text(
        '{"consumo_kwh": 1, "consumo_pico": 2.5, "promedio_hora": "3", "costo_estimado": 4}\n'
        '{"consumo_kwh": 1, "consumo_pico": "x", "promedio_hora": 3}\n'
    )
    records = feed.read_scoring_records(spark, str(path))
    good = feed.scoring_records(records).collect()
    assert len(good) == 1
    assert (good[0].promedio_hora, good[0].estado, good[0].hora_dia, good[0].dia_semana, good[0].casa_id,
            good[0].modo_ecologico_activado) == (3.0, "activo", "00:00", "lunes", "Puebla", 0)
    assert [r.faltan for r in feed.scoring_rejects(records).collect()] == ["consumo_pico,costo_estimado"]


def test_series_shape(spark, frame):
    df = frame([(datetime(2024, 1, 5, 3), 2.0)], "ts timestamp_ntz, consumo_kwh double")
    wide = sinks.as_series(energy.energy_by_hour(df), "ord").first()
    assert wide.labels[3] == "03" and wide.data[3] == 2.0 and len(wide.data) == 24


def test_log_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    names = lambda: sorted(r.tipo for r in feed.read_reports(spark, path).collect())
    loose = lambda: [n for n in os.listdir(path) if n.endswith(".json")]
    for i in range(5):
        feed.append_report(spark, path, f"t{i}")
    assert not feed.compact_reports(spark, path, least=100) and len(loose()) == 5
    assert feed.compact_reports(spark, path, least=5)
    assert names() == [f"t{i}" for i in range(5)] and loose() == []
    feed.append_report(spark, path, "t5")
    assert names() == [f"t{i}" for i in range(6)]
    # A run that breaks off before the files go: they are held by the compaction already and count once.
    with monkeypatch.context() as m:
        m.setattr(feed, "file_system", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            feed.compact_reports(spark, path, least=1)
    assert loose() and names() == [f"t{i}" for i in range(6)]
    feed.append_report(spark, path, "t6")
    assert names() == [f"t{i}" for i in range(7)]
    assert feed.compact_reports(spark, path, least=1) and loose() == []
    assert names() == [f"t{i}" for i in range(7)]
    for i in range(7, 30):
        feed.append_report(spark, path, f"t{i:02d}")
        feed.compact_reports(spark, path, least=4)
        assert len(loose()) < 4
    assert len(names()) == 30 and len(os.listdir(f"{path}/_compacted")) <= 2


def test_log_compaction_by_size(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    files = lambda: [n for d, _, f in os.walk(f"{path}/_compacted") for n in f if n.startswith("part-")]
    rows = spark.range(6000).selectExpr("cast(id AS string) AS id", "id AS fecha_ts", "'t' AS tipo", "'u' AS usuario")
    rows.repartition(8).write.json(path)
    monkeypatch.setattr(feed, "FILE_BYTES", 100_000)
    for n in (0, 1):
        feed.append_report(spark, path)
        assert feed.compact_reports(spark, path, least=1)
        log = feed.read_reports(spark, path)
        assert log.where("tipo = 't'").agg({"fecha_ts": "sum"}).first()[0] == 17_997_000 and log.count() == 6001 + n
        assert len(files()) >= 3 * (n + 1)


def test_scoring_lines_that_cannot_be_read(spark, tmp_path):
    good = '{"id": 1, "consumo_kwh": 1.5, "consumo_pico": "2", "promedio_hora": 3, "costo_estimado": 4, "estado": "inactivo"}'
    lines = [good, good[:40], "no json", "", f"[{good}, {good}]", '{"id": 2, "consumo_kwh": 1}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    read = feed.read_scoring_records(spark, str(tmp_path / "r.json"), keep=("id",))
    records = feed.scoring_records(read)
    assert feed.S.CORRUPT not in records.columns
    assert [(r.id, r.consumo_kwh, r.estado) for r in records.collect()] == [("1", 1.5, "inactivo")] * 3
    rejects = [(r.faltan, r[feed.S.CORRUPT]) for r in feed.scoring_rejects(read).collect()]
    assert sorted(rejects, key=str) == sorted([
        ("registro", good[:40]), ("registro", "no json"), ("consumo_pico,promedio_hora,costo_estimado", None)], key=str)
