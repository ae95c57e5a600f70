import os
from datetime import datetime, timedelta

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from wattframe.operators import ranking, scoring
from wattframe.plans import tables
from wattframe.plans.queries import QUERIES
from wattframe.schema import SCORING_RECORD
from wattframe.sources import feed

RECORD = {
    "consumo_kwh": 1.0, "consumo_pico": 2.0, "promedio_hora": 0.5, "costo_estimado": 3.0,
    "estado": "inactivo", "hora_dia": "13:00:30", "dia_semana": " MARTES ", "casa_id": "Atlixco",
    "modo_ecologico_activado": 1,
}


def _records(spark, records):
    rows = [{k: None if r.get(k) is None else str(r[k]) for k in SCORING_RECORD.names} for r in records]
    return spark.createDataFrame(rows, SCORING_RECORD)


def test_feature_names():
    names = scoring.feature_names()
    assert names[:5] == ["consumo_kwh", "consumo_pico", "promedio_hora", "costo_estimado", "modo_ecologico_activado"]
    assert len(names) == 5 + 3 + 23 + 6 + 12
    for first in ("estado_activo", "hora_dia_00:00", "dia_semana_domingo", "casa_id_Amozoc"):
        assert first not in names


def test_one_row_encodes_like_many(spark):
    alone = scoring.feature_matrix(_records(spark, [RECORD])).first().asDict()
    other = dict(RECORD, estado=None, casa_id="Otra", hora_dia="13:07", dia_semana=None, consumo_kwh="x")
    both = scoring.feature_matrix(_records(spark, [RECORD, other]))
    assert alone in [r.asDict() for r in both.collect()]
    on = {k for k, v in alone.items() if v == 1 and "_" in k}
    assert on >= {"estado_inactivo", "hora_dia_13:00", "dia_semana_martes", "casa_id_Atlixco", "modo_ecologico_activado"}
    row = both.filter("consumo_kwh = 0").first().asDict()
    assert row["casa_id_Puebla"] == 1 and row["dia_semana_lunes"] == 1
    assert not any(v for k, v in row.items() if k.startswith("hora_dia_") or k.startswith("estado_"))


def test_absent_columns_take_defaults(frame):
    row = scoring.coerced(frame([(2.0,)], "consumo_kwh double")).first()
    assert (row.consumo_kwh, row.consumo_pico, row.estado, row.hora_dia, row.dia_semana, row.casa_id,
            row.modo_ecologico_activado) == (2.0, 0.0, "activo", "00:00", "lunes", "Puebla", 0)


@pytest.fixture(scope="module")
def training(spark):
    start = datetime(2024, 1, 1)
    rows = [
        (i, start + timedelta(hours=i), "Puebla" if i % 2 else "Atlixco", float(i % 24), float(i % 24) * 3.2, f"{i % 24:02d}:00")
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, casa_id string, consumo_kwh double, costo double, hora_dia string")
    return ranking.next_reading(df).withColumn("costo_estimado", F.col("costo"))


def test_fit_score_save_load(spark, training, tmp_path):
    hours = scoring.hours_present(training)
    assert len(hours) == 24
    scorer = scoring.fit(training, scoring.levels(hours), trees=5, depth=4)
    scored = scorer.score(training).orderBy("id").collect()
    assert len(scored) == 600 and {"consumo_kwh_next", "costo_mx_next", "id"} <= set(scored[0].asDict())
    predicted = {r.id: (r.consumo_kwh_next, r.costo_mx_next) for r in scored}
    # The next reading of a town is two hours on, so the fit has to follow the clock.
    assert abs(predicted[300][0] - 14) < 5
    scorer.save(str(tmp_path))
    loaded = scoring.load(spark, str(tmp_path))
    again = {r.id: (r.consumo_kwh_next, r.costo_mx_next) for r in loaded.score(training).collect()}
    assert again == predicted
    one = scoring.score_one(spark, loaded, RECORD).collect()
    assert len(one) == 1 and one[0].consumo_kwh_next is not None


def _tree(node):
    """A fitted tree as nested tuples (feature, threshold, left, right), a leaf as its value."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")
def test_predictions_are_the_means_of_the_fitted_trees(spark, monkeypatch):
    fit, fitted = scoring.fit, []
    monkeypatch.setattr(scoring, "fit", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    got = {r.id: (r.consumo_kwh_next, r.costo_mx_next) for r in QUERIES["model_predictions"](spark, SF_SMALL).collect()}
    forests = {m.getLabelCol(): [_tree(t._call_java("rootNode")) for t in m.trees] for m in fitted[0].model.stages[1:]}
    assert set(forests) == {"consumo_next", "costo_next"} and all(len(f) == 8 for f in forests.values())
    names = scoring.feature_names(fitted[0].by_level)
    rows = scoring.feature_matrix(feed.scoring_records(tables.raw_scoring(spark, SF_SMALL)), fitted[0].by_level).collect()
    assert len(rows) == len(got) > 0
    for r in rows:
        x = [float(r[n]) for n in names]
        for value, target in zip(got[r.id], ("consumo_next", "costo_next")):
            assert value == pytest.approx(sum(_value(t, x) for t in forests[target]) / 8, abs=2e-6)
    assert len({v for v, _ in got.values()}) > 10
