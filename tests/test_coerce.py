import math

from pyspark.sql import functions as F

from wattframe import schema as S
from wattframe.functions import coerce as C


def test_number(one):
    raw = ["1.5", "abc", "", None, "NaN", " 12 ", "1e3", "-0.5", "1.5d", "2f", "inf"]
    assert one(C.number, raw) == [1.5, 0, 0, 0, 0, 12, 1000, -0.5, 0, 0, 0]
    assert one(lambda c: C.number(c, None), ["x", "3"]) == [None, 3]
    assert one(lambda c: C.number(c, finite=False), ["inf", "-Infinity"]) == [math.inf, -math.inf]


def test_number_of_numeric_column(one):
    values = [1.5, float("nan"), None, math.inf]
    assert one(lambda c: C.number(c, text=False), values, "double") == [1.5, 0, 0, 0]


def test_cost_precedence(frame):
    rows = [(None, "3"), ("2", "3"), (None, None), ("x", "4"), ("NaN", "5")]
    df = frame(rows, "e string, b string").select(C.cost(F.col("e"), F.col("b")))
    assert [r[0] for r in df.collect()] == [3, 2, 0, 4, 5]


def test_consumption_fallback(frame):
    rows = [("0", "-5", None), ("2", "9", None), (None, None, None), (None, "", "7"), ("x", None, "-3")]
    df = frame(rows, "k string, p string, o string")
    got = df.select(C.consumption(F.col("k"), F.col("p"), F.col("o"))).collect()
    assert [r[0] for r in got] == [5, 2, 0, 7, 3]
    assert [r[0] for r in df.select(C.watts_to_kwh(F.col("p"))).collect()] == [0.005, 0.009, 0, 0, 0]


def test_statuses(frame):
    rows = [("-1", "Activo"), ("1", None), ("1", ""), ("-2", None), (None, "OK"), ("x", "Normal")]
    df = frame(rows, "c string, s string")
    got = df.select(
        C.dashboard_status(F.col("c"), F.col("s")),
        C.device_status(F.col("c"), F.col("s")),
        C.history_status(F.col("c")),
    ).collect()
    assert [r[0] for r in got] == ["inverso", "activo", "activo", "inverso", "ok", "normal"]
    assert [r[1] for r in got] == ["activo", "activo", "activo", "inactivo", "ok", "normal"]
    assert [r[2] == S.HISTORY_NORMAL for r in got] == [False, True, True, False, True, True]


def test_batch_status_null_is_active(one):
    assert one(C.batch_status, [" Activo ", None, "SIN CONEXIÓN"]) == ["activo", "activo", "sin conexión"]


def test_status_class(one):
    assert one(C.status_class, ["Activo", "normal", "OK", "inverso", None]) == ["ok", "ok", "ok", "alert", "alert"]
    assert one(lambda c: C.status_class(c, "report"), ["Listo", "Pendiente"]) == ["ok", "alert"]
    assert one(lambda c: C.status_class(c, "history"), [S.HISTORY_NORMAL, S.HISTORY_REVERSE]) == ["ok", "alert"]
    assert one(lambda c: C.status_class(c, "user"), ["Activo", "activo", "Suspendido"]) == ["ok", "alert", "alert"]


def test_clamp_is_per_row(one):
    rule = lambda c: C.clamp(c, S.STATUSES, "activo")
    assert one(rule, ["inactivo", None, "roto", "sin conexión"]) == ["inactivo", "activo", "activo", "sin conexión"]


def test_texts(frame, one):
    rows = [("", "b"), (None, ""), ("a", "b")]
    df = frame(rows, "a string, b string").select(C.first_text("—", F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == ["b", "—", "a"]
    assert one(C.capitalised, ["sin conexión", "a", ""]) == ["Sin conexión", "A", ""]
    assert one(C.role_class, ["Administrador", "Usuario"]) == ["admin", "user"]
    assert one(C.initial, ["Sofía"]) == ["S"]


def test_rounding_is_half_up_on_decimals(one):
    assert one(lambda c: C.rounded(c, 2), [1.005, 2.675, -1.005, 0.125], "double") == [1.01, 2.68, -1.01, 0.13]
    assert one(lambda c: C.money(c), [1234567.891], "double") == ["1,234,567.89"]


def test_search_is_literal(frame):
    df = frame([("50%", "a"), ("500", "B_b"), (None, "c")], "x string, y string")
    assert df.filter(C.matches("0%", ["x", "y"])).count() == 1
    assert df.filter(C.matches("B_B", ["x", "y"])).count() == 1
    assert df.filter(C.matches("_", ["x", "y"])).count() == 1
    assert df.filter(C.matches("", ["x"])).count() == 3
    assert df.filter(~C.matches("c", ["x", "y"])).count() == 2
