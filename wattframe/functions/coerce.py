"""Numbers, texts and statuses: lenient raw values in, typed columns out.

Every rule is a built-in expression, so it stays inside whole-stage codegen. ANSI mode is on in
Spark 4, hence ``try_cast`` throughout: a bad value becomes the default, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from wattframe import schema as S


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# A plain decimal number. Checking first keeps the cast from raising and catching an exception per
# bad value, and keeps out what Java's parser also takes: '1.5d', '2f', '0x1p3'.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NUMBER_OR_INFINITY = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def number(c: Column, default: float | None = 0.0, text: bool = True, finite: bool = True) -> Column:
    """Numeric coercion; unreadable, empty and NaN become ``default``.

    ``text=False`` skips the string check for columns that already are numeric. ``finite=False``
    keeps infinities, as the batch builds do; the live views drop them.
    """
    value = c.try_cast("double")
    if text:
        value = F.when(c.rlike(_NUMBER if finite else _NUMBER_OR_INFINITY), value)
    if finite:
        value = value % float("inf")  # itself, or NaN for an infinity
    if finite or not text:
        value = F.nanvl(value, F.lit(None).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def flag(value: Column) -> Column:
    """A number as an INT flag; 0 for what no INT holds."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def cost(estimated: Column, billed: Column, text: bool = True) -> Column:
    """Estimated cost where readable, else the billed one, else 0."""
    return F.coalesce(
        number(estimated, None, text, finite=False), number(billed, None, text, finite=False), F.lit(0.0)
    )


def tariff_cost(kwh: Column, tariff: float) -> Column:
    return kwh * F.lit(float(tariff))


def consumption(kwh: Column, power: Column, other: Column) -> Column:
    """Energy if present and non-zero, else the magnitude of the power (or other) field."""
    energy = number(kwh)
    proxy = F.abs(number(F.coalesce(blank_to_null(power), other)))
    return F.when(energy != 0, energy).otherwise(proxy)


def watts_to_kwh(power: Column) -> Column:
    return F.abs(number(power)) / 1000.0


def _reversed(current: Column) -> Column:
    return number(current) < 0


def dashboard_status(current: Column, status: Column) -> Column:
    base = F.coalesce(blank_to_null(status), F.lit(S.DEFAULT_STATUS))
    return F.lower(F.when(_reversed(current), F.lit(S.REVERSE_STATUS)).otherwise(base))


def device_status(current: Column, status: Column) -> Column:
    fallback = F.when(_reversed(current), F.lit("inactivo")).otherwise(F.lit(S.DEFAULT_STATUS))
    return F.coalesce(blank_to_null(F.lower(status)), fallback)


def history_status(current: Column) -> Column:
    return F.when(_reversed(current), F.lit(S.HISTORY_REVERSE)).otherwise(F.lit(S.HISTORY_NORMAL))


def batch_status(status: Column) -> Column:
    """Lower-case, trimmed; a missing status counts as active."""
    return F.coalesce(F.lower(F.trim(status)), F.lit(S.DEFAULT_STATUS))


# Which statuses read as healthy, per view.
OK_STATUSES = {"reading": ["activo", "normal", "ok"], "report": ["listo"], "user": ["Activo"]}


def status_class(c: Column, domain: str = "reading") -> Column:
    """``ok`` or ``alert``, by the vocabulary of the view the status comes from."""
    if domain == "history":
        healthy = c.contains("Normal")
    elif domain == "user":
        healthy = c.isin(OK_STATUSES["user"])
    else:
        healthy = F.lower(c).isin(OK_STATUSES[domain])
    return F.when(healthy, F.lit("ok")).otherwise(F.lit("alert"))


def first_text(default: str, *cols: Column) -> Column:
    """First non-empty of several alternate fields."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(default))


def clamp(c: Column, vocabulary: list[str], default: str) -> Column:
    """A value outside the vocabulary, or missing, becomes the default; other rows keep theirs."""
    return F.when(c.isin(vocabulary), c).otherwise(F.lit(default))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2**31 - 1))


def role_class(role: Column) -> Column:
    return F.when(F.lower(role).contains("admin"), F.lit("admin")).otherwise(F.lit("user"))


def initial(name: Column) -> Column:
    return F.substring(name, 1, 1)


def rounded(c: Column, digits: int) -> Column:
    """Half-up on the decimal reading of a double, so 1.005 gives 1.01.

    A double too large for that has no decimals and stays as it is.
    """
    return F.coalesce(F.round(c.try_cast(f"decimal(38,{digits + 6})"), digits).cast("double"), c)


def money(c: Column, digits: int = 2) -> Column:
    """Fixed number of decimals with thousands separators, for display."""
    return F.format_number(c, digits)


def matches(text: str, cols: list[str]) -> Column:
    """Case-insensitive literal substring in any of the columns; an empty text matches all."""
    if not text:
        return F.lit(True)
    needle = F.lit(text.lower())
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, hits)
