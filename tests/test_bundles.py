import glob
import os
from urllib.parse import urlparse

import pytest
from conftest import SF_SMALL

from wattframe import schema as S
from wattframe.operators.standardise import dashboard_batch
from wattframe.plans import dashboard, mining
from wattframe.plans.queries import QUERIES
from wattframe.sources import sinks
from wattframe.sources.readings import read_readings
from wattframe.streaming import live

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")


def files_of(path, kind):
    """Files with rows, in the order they were written."""
    found = glob.glob(f"{urlparse(path).path}/part-*.{kind}")
    return sorted(found, key=lambda f: os.stat(f).st_mtime_ns)


@pytest.fixture(scope="module")
def in_files(spark, tmp_path_factory):
    """The small tables with events in four files."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(4).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name, plan", [("mining_bundle", mining), ("dashboard_bundle", dashboard)])
def test_bundles_from_many_files(spark, in_files, monkeypatch, name, plan):
    build, paths = plan.build, []
    monkeypatch.setattr(plan, "build", lambda s, path, *a, **k: paths.append(path) or build(s, path, *a, **k))
    want, got = (sorted(map(tuple, QUERIES[name](spark, sf).collect())) for sf in (SF_SMALL, in_files))
    assert got == want
    assert len(files_of(paths[1], "csv")) > 1


@pytest.mark.parametrize("name", ["live_dedup", "live_state_daily"])
def test_live_batches_of_many_files(spark, monkeypatch, name):
    feed_stream, seen = live.feed_stream, []
    monkeypatch.setattr(live, "feed_stream", lambda s, path, *a, **k: seen.append((path, k)) or feed_stream(s, path, *a, **k))
    assert QUERIES[name](spark, SF_SMALL).count()
    (path, options), = seen
    n, files = options["maxFilesPerTrigger"], files_of(path, "parquet")
    assert n > 1 and len(files) == 4 * n
    for part in range(4):
        ids = [r.id % 4 for r in spark.read.parquet(*files[n * part : n * part + n]).select("id").collect()]
        assert set(ids) == ({0, 3} if part == 3 and name == "live_dedup" else {part})


def test_bundles_hold_what_the_plans_compute(spark, monkeypatch):
    """Points and history as read back are those computed from the same files without a bundle."""
    paths = {}
    for plan in (mining, dashboard):
        def spied(s, path, *a, build=plan.build, name=plan.__name__, **k):
            paths[name] = path
            return build(s, path, *a, **k)

        monkeypatch.setattr(plan, "build", spied)
    points = sorted(map(tuple, QUERIES["mining_bundle_points"](spark, SF_SMALL).collect()), key=str)
    history = sorted(map(tuple, QUERIES["dashboard_bundle_history"](spark, SF_SMALL).collect()), key=str)
    mined = mining.mining_readings(read_readings(spark, paths[mining.__name__], S.MINING, batch_folders=True, keep=("id",)))
    assert points == sorted(map(tuple, mining.scatter(mining.sample_pool(mined)).collect()), key=str)
    dated = dashboard_batch(read_readings(spark, paths[dashboard.__name__], S.DASHBOARD, keep=("id",)))
    assert history == sorted(map(tuple, dashboard.history(dated).collect()), key=str)
    assert len(points) == 400 and len(history) == 500 and len(set(points)) > 100


CSV = "timestamp,consumo_kwh,casa_id\n2024-01-01 03:00:00,{},a\n2024-01-01 04:00:00,2,b\n"


def test_a_build_becomes_visible_as_a_whole(spark, tmp_path, monkeypatch):
    """A build that breaks off after its first results changes nothing for readers."""
    path, out = tmp_path / "in.csv", str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        sinks.read_bundle(spark, out)
    path.write_text(CSV.format(1))
    mining.build(spark, str(path), out)
    total = lambda: sum(r.total for r in sinks.read_bundle(spark, out)["top_dispositivos"].collect())
    assert total() == 3
    path.write_text(CSV.format(10))
    begun = sinks.read_bundle(spark, out)
    with monkeypatch.context() as m:
        write = mining.write_result
        m.setattr(mining, "write_result", lambda df, folder, name: write(df, folder, name) if name != "consumo_vs_costo" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            mining.build(spark, str(path), out)
    assert total() == 3
    mining.build(spark, str(path), out)
    assert total() == 12
    # The bundle that was opened before the switch still reads its own build.
    assert sum(r.total for r in begun["top_dispositivos"].collect()) == 3
    mining.build(spark, str(path), out)
    assert len([n for n in os.listdir(out) if n.startswith("build=")]) == sinks.KEEP_BUILDS


def test_batches_by_folder(spark, tmp_path):
    for day in ("a", "b"):
        rows = [(f"2024-01-0{i + 1}", str(i), day) for i in range(4)]
        spark.createDataFrame(rows, "timestamp string, consumo_kwh string, casa_id string").repartition(2).write.csv(
            f"{tmp_path}/in/day={day}", header=True)
    path = f"{tmp_path}/in/*"
    sizes = lambda n: sorted(r["count"] for r in read_readings(
        spark, path, S.MINING, n, batch_folders=True).groupBy("batch_id").count().collect())
    assert sizes(0) == [4, 4] and sizes(1) == [4]
