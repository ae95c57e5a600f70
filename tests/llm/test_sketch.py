import numpy as np
import pytest

from wattframe.llm import sketch


@pytest.fixture
def items():
    def run(batches):
        for batch in batches:
            yield batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    return run


def spread(values):
    return np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@pytest.mark.parametrize("bits", [10, 12, 20])
def test_repeated_items_are_always_found(spark, items, bits):
    df = spark.createDataFrame([(i,) for i in range(3000)] + [(i,) for i in range(0, 3000, 7)], "x long").repartition(5)
    table = sketch.build(df, items, bits)
    assert sketch.repeated(table.value, spread(range(0, 3000, 7))).all()
    if bits == 20:
        assert not sketch.repeated(table.value, spread(range(1, 3000, 7))).all()


def test_chance_makes_nothing_hot(spark, items):
    """So few cells that every one holds more than the limit: only what stands out is hot, and the list is short."""
    df = spark.createDataFrame([(i,) for i in range(60_000)] + [(7,)] * 20_000, "x long").repartition(5)
    table = sketch.build_hot(df, items, 8, 12)
    bits, cells = table.value
    assert bits == 12 and all(len(c) <= (1 << bits) // sketch.ABOVE for c in cells)
    assert sketch.hot(table.value, spread([7])).all()
    assert sketch.hot(table.value, spread(range(100, 5000))).mean() < 0.05


def test_few_items_are_hot_from_the_limit_on(spark, items):
    df = spark.createDataFrame([(1,)] * 64 + [(2,)] * 63 + [(i,) for i in range(100, 200)], "x long").repartition(3)
    table = sketch.build_hot(df, items, 64, 16)
    assert sketch.hot(table.value, spread([1, 2, 150])).tolist() == [True, False, False]


def test_hot_cells_are_bounded():
    counts = np.random.default_rng(1).poisson(2000, 1 << 12).astype(np.uint16)
    assert len(sketch._hot_cells(counts, 1024)) == 0
