"""Energy totals that neither lose small readings nor overflow, at the speed of integer sums.

A plain double sum depends on row order, so it changes with partitioning; a DECIMAL sum does not but
runs about ten times slower. Here a reading is cut by powers of two into four whole numbers (steps of
2^40, 2^20, 1 and 2^-20) and the little that remains below 2^-20. The cuts are exact. The whole
numbers are summed as BIGINT inside the codegen'd hash aggregate, exact and in any order; each row adds
less than 2^20 to a sum, so it would take 2^43 rows in one group to overflow, and under ANSI that would
raise. The remainders are summed as doubles: a billion of them err by less than 1e-9.

Readings of 2^60 kWh and more, and infinite ones, cannot be cut and are summed as doubles beside them;
NaN counts as no reading. Sums of groups kept in a table fold with ``refold`` in DECIMAL, which lets one
pass over the readings serve several totals.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_LIMIT = float(1 << 60)
_STEP = float(1 << 20)
_WHOLE = "decimal(38,0)"
INTEGERS = ("high", "middle", "low", "part")
PARTS = (*INTEGERS, "rest", "odd")


def _parts(value: Column) -> dict[str, Column]:
    v = value.cast("double")
    usual = F.abs(v) < _LIMIT
    high = F.floor(v / (_STEP * _STEP))
    below = v - high * (_STEP * _STEP)
    middle = F.floor(below / _STEP)
    below = below - middle * _STEP
    low = F.floor(below)
    below = (below - low) * _STEP
    part = F.floor(below)
    cut = {"high": high, "middle": middle, "low": low, "part": part, "rest": (below - part) / _STEP}
    return {
        **{name: F.when(usual, c) for name, c in cut.items()},
        "odd": F.when((F.abs(v) >= _LIMIT) & ~F.isnan(v), v),
    }


def _combine(sums: dict[str, Column], digits: int) -> Column:
    high, middle, low, part = (F.coalesce(sums[n].cast(_WHOLE), F.lit(0).cast(_WHOLE)) for n in INTEGERS)
    step = F.lit(1 << 20).cast("decimal(7,0)")
    inner = F.pmod(part, step).cast("double") / _STEP + F.coalesce(sums["rest"], F.lit(0.0))
    whole = (high * step * step + middle * step + low + (part - F.pmod(part, step)) / step).cast(_WHOLE)
    exact = whole.cast(f"decimal(38,{digits + 4})") + inner.cast(f"decimal(38,{digits + 4})")
    return F.round(exact, digits).cast("double") + F.coalesce(sums["odd"], F.lit(0.0))


def total(value: Column, digits: int = 3) -> Column:
    """Sum of ``value`` rounded to ``digits`` decimals; 0 over no rows."""
    return _combine({name: F.sum(c) for name, c in _parts(value).items()}, digits)


def partial(value: Column) -> list[Column]:
    """Aggregate columns, named as in ``PARTS``, to keep in a table."""
    return [F.sum(c).alias(name) for name, c in _parts(value).items()]


def refold(digits: int = 3, where: Column | None = None) -> Column:
    """Total over rows that hold partial sums, optionally only those where a condition holds."""
    def pick(name: str) -> Column:
        c = F.col(name).cast(_WHOLE if name in INTEGERS else "double")
        return F.sum(c if where is None else F.when(where, c))

    return _combine({name: pick(name) for name in PARTS}, digits)
