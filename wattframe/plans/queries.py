"""Registered queries: one per operator, each over the whole of its tables.

Checks against another engine compare values, so computed doubles are rounded to six places and
times leave as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattframe import schema as S
from wattframe.functions import coerce as C, sums, times
from wattframe.operators import (
    alerts, devices, energy, filters, hours, pages, ranking, rollups, scoring, standardise,
)
from wattframe.plans import dashboard, mining, tables
from wattframe.session import materialise, work_dir
from wattframe.sources import daily, feed, readings as files, sinks
from wattframe.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Devices report every few hours in these tables, so activity is judged over six of them.
RECENT = "6 hours"
REPORT_NOW = "2002-01-01 12:00:00"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _six(c: Column | str) -> Column:
    return F.round(c, 6)


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    """Times as text with microseconds."""
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS") for n in names})


# --- energy totals -----------------------------------------------------------------------------


@query
def energy_by_hour(spark, sf):
    return energy.energy_by_hour(tables.readings(spark, sf))


@query
def tiny_and_huge_totals(spark, sf):
    """Readings of a hundred-millionth and ten million million times the usual size, totalled per device."""
    rows = tables.readings(spark, sf)
    scaled = rows.select(
        F.col("device_id").alias("device_id"), (F.col("consumo_kwh") * 1e-8).alias("tiny"),
        F.round(F.col("consumo_kwh") * 1e13).alias("huge"))
    return scaled.groupBy("device_id").agg(
        sums.total(F.col("tiny"), 12).alias("tiny"), sums.total(F.col("huge"), 0).alias("huge"))


@query
def infinite_reading_flags_nobody(spark, sf):
    """One infinite reading leaves the anomalies undefined and the histogram to the finite ones."""
    rows = tables.readings(spark, sf)
    value = F.when(F.col("id") == 1, float("inf")).otherwise(F.col("consumo_kwh"))
    faulty = rows.withColumn("consumo_kwh", value)
    return alerts.zscore_count(faulty).select(
        "n_anomalias", alerts.histogram(faulty).agg(F.sum("n")).scalar().alias("en_barras"))


@query
def energy_by_weekday(spark, sf):
    return energy.energy_by_weekday(tables.readings(spark, sf))


@query
def energy_by_labelled_weekday(spark, sf):
    raw = mining.mining_readings(tables.raw_batch(spark, sf))
    return energy.energy_by_weekday(raw, label="dia")


@query
def energy_by_entity(spark, sf):
    lines = tables.line_readings(spark, sf)
    return energy.energy_by_mapped(lines, "s_suppkey", tables.supplier_entity(spark, sf), "casa_id")


@query
def energy_by_device(spark, sf):
    return energy.energy_by(tables.readings(spark, sf), "device_id")


@query
def top_entities(spark, sf):
    return ranking.top_k(energy_by_entity(spark, sf), 10)


@query
def monthly_series(spark, sf):
    return energy.monthly_series(tables.line_readings(spark, sf), 7)


@query
def monthly_series_live(spark, sf):
    return energy.monthly_series(tables.line_readings(spark, sf), 6)


@query
def daily_series(spark, sf):
    return energy.daily_series(tables.readings(spark, sf), 7)


@query
def cumulative_hour_share(spark, sf):
    return energy.cumulative_share(energy.energy_by_hour(tables.readings(spark, sf)))


@query
def record_counts(spark, sf):
    return energy.record_counts(tables.readings(spark, sf), "device_id")


# --- cards and alerts --------------------------------------------------------------------------


@query
def month_card(spark, sf):
    return energy.month_energy(tables.readings(spark, sf))


@query
def quantile_value(spark, sf):
    return alerts.quantile(tables.readings(spark, sf)).select(_six("quantile").alias("quantile"))


@query
def alert_card(spark, sf):
    rows = tables.readings(spark, sf)
    return alerts.quantile_alerts(filters.current_month(rows, anchor=filters.newest_time(rows)))


@query
def above_p95_rows(spark, sf):
    return alerts.above_quantile(tables.readings(spark, sf)).select("id", "consumo_kwh")


@query
def active_rows_card(spark, sf):
    return devices.active_rows(tables.readings(spark, sf))


@query
def card_bundle(spark, sf):
    return devices.batch_cards(tables.readings(spark, sf), ts="ts")


@query
def live_card_bundle(spark, sf):
    standard = tables.readings(spark, sf).withColumnRenamed("consumo_kwh", "consumo")
    return devices.live_cards(standard, interval=RECENT)


@query
def value_spread(spark, sf):
    stats = alerts.spread(tables.readings(spark, sf))
    return stats.select("n", _six("mean").alias("mean"), _six("sd").alias("sd"))


@query
def zscore_count(spark, sf):
    return alerts.zscore_count(tables.readings(spark, sf), min_n=S.Z_MIN_POINTS)


@query
def zscore_newest(spark, sf):
    return alerts.zscore_count(tables.readings(spark, sf), pool=S.ALERT_POOL)


@query
def zscore_labels(spark, sf):
    labelled = alerts.zscore_labels(tables.readings(spark, sf))
    return labelled.select("id", "consumo_kwh", _six("z").alias("z"), "etiqueta")


@query
def zscore_pool(spark, sf):
    labelled = alerts.zscore_labels(tables.readings(spark, sf), pool=S.LABEL_POOL)
    return labelled.select("position", "id", "consumo_kwh", "etiqueta")


@query
def value_histogram(spark, sf):
    bins = alerts.histogram(tables.readings(spark, sf))
    return bins.select("bin", _six("lower").alias("lower"), _six("upper").alias("upper"), "label", "n")


@query
def mining_summary(spark, sf):
    return devices.mining_summary(tables.readings(spark, sf), "device_id")


# --- devices -----------------------------------------------------------------------------------


@query
def last_seen(spark, sf):
    return _stamped(devices.last_seen(tables.readings(spark, sf)), "last_seen")


@query
def active_devices(spark, sf):
    return devices.active_devices(tables.readings(spark, sf), interval=RECENT)


@query
def active_split(spark, sf):
    return devices.active_split(tables.readings(spark, sf), interval=RECENT)


@query
def active_split_searched(spark, sf):
    found = filters.search(ranking.newest_per(tables.readings(spark, sf)), "1", ["device_id"])
    anchor = tables.readings(spark, sf).agg(F.max("ts")).scalar()
    return devices.active_split(found, interval=RECENT, anchor=anchor)


@query
def latest_per_device(spark, sf):
    return _stamped(ranking.newest_per(tables.readings(spark, sf)), "ts")


# --- history, pages, samples -------------------------------------------------------------------


def _history(spark, sf) -> DataFrame:
    rows = tables.readings(spark, sf)
    return rows.select(
        "id",
        "ts",
        times.second_label(F.col("ts")).alias("fecha"),
        F.col("device_id").cast("string").alias("dispositivo"),
        F.lit(S.NO_TEXT).alias("usuario"),
        F.col("consumo_kwh").alias("consumo"),
        C.rounded(C.tariff_cost(F.col("consumo_kwh"), S.HISTORY_TARIFF), 2).alias("costo"),
        "estado",
    )


HISTORY = ["id", "fecha", "dispositivo", "usuario", "consumo", "costo", "estado"]


@query
def latest_history(spark, sf):
    return ranking.newest(_history(spark, sf), S.HISTORY_ROWS).select(*HISTORY)


@query
def history_limited(spark, sf):
    newest = ranking.newest(_history(spark, sf), S.HISTORY_ROWS).select(*HISTORY)
    return ranking.clamped(newest, -3)


@query
def history_search(spark, sf):
    found = filters.search(_history(spark, sf), "CONEXI", ["fecha", "dispositivo", "usuario", "estado"])
    return ranking.newest_first(found).select(*HISTORY)


@query
def history_page(spark, sf):
    found = filters.search(_history(spark, sf), "activo", ["estado"])
    at = ranking.page(found, 3, 7, [F.desc("ts"), F.asc("id")])
    return at.rows.select(*HISTORY, F.lit(at.number).alias("page"), F.lit(at.pages).alias("pages"))


@query
def history_page_indexed(spark, sf):
    """The same page through an index of the pages' first keys."""
    found = filters.search(_history(spark, sf), "activo", ["estado"])
    at = pages.page_at(found, pages.page_index(found, 7), 3)
    return at.rows.select(*HISTORY, F.lit(at.number).alias("page"), F.lit(at.pages).alias("pages"))


def _by_day(spark, sf) -> str:
    """The history as a table laid out by day."""
    folder = work_dir(spark, "by-day")
    daily.write_by_day(_history(spark, sf), folder)
    return folder


@query
def latest_history_by_day(spark, sf):
    """The newest rows of a table laid out by day, of which only the newest days are read."""
    return daily.newest_by_day(spark, _by_day(spark, sf), S.HISTORY_ROWS).select(*HISTORY)


@query
def zscore_pool_by_day(spark, sf):
    """Labels over the newest readings, taken from the newest days alone."""
    folder = work_dir(spark, "readings-by-day")
    daily.write_by_day(tables.readings(spark, sf), folder)
    labelled = alerts.zscore_labels(daily.newest_days(spark, folder, S.LABEL_POOL), pool=S.LABEL_POOL)
    return labelled.select("position", "id", "consumo_kwh", "etiqueta")


@query
def history_last_page(spark, sf):
    newest = ranking.newest(_history(spark, sf), S.TABLE_ROWS)
    at = ranking.page(newest, 99, 7, [F.desc("ts"), F.asc("id")])
    return at.rows.select(*HISTORY, F.lit(at.number).alias("page"), F.lit(at.pages).alias("pages"))


@query
def history_page_after(spark, sf):
    return ranking.page_after(_history(spark, sf), 7, last=("2024-01-15 00:00:00", 0)).select(*HISTORY)


@query
def formatted_values(spark, sf):
    return tables.readings(spark, sf).select(
        "id",
        C.money(F.col("consumo_kwh") * 1000.0).alias("miles"),
        C.rounded(F.col("consumo_kwh") / 7.0, 3).alias("tres"),
        C.capitalised(F.col("estado")).alias("estado"),
        times.second_label(F.col("ts")).alias("momento"),
    )


@query
def batch_sample(spark, sf):
    rows = tables.readings(spark, sf).withColumn("batch_id", times.day_label(F.col("ts")))
    return ranking.sample_per_batch(rows).select("id", "batch_id", "consumo_kwh", "costo")


@query
def batch_sample_emitted(spark, sf):
    rows = tables.readings(spark, sf).withColumn("batch_id", times.day_label(F.col("ts")))
    pool = ranking.sample_per_batch(rows, per_batch=100)
    return mining.scatter(pool)


@query
def next_reading_target(spark, sf):
    chained = ranking.next_reading(tables.readings(spark, sf), "device_id")
    return chained.select("id", "device_id", "consumo_kwh", "consumo_next", "costo_next")


@query
def last_n_scan(spark, sf):
    return feed.last_n(tables.raw_feed(spark, sf), S.FEED_DASHBOARD).select("id", "timestamp", "estado")


@query
def batch_capped(spark, sf):
    capped = filters.first_batches(tables.raw_batch(spark, sf), 7)
    return capped.groupBy("batch_id").agg(F.count("*").alias("n"))


# --- reports and users -------------------------------------------------------------------------


@query
def report_list(spark, sf):
    rows = standardise.report_rows(tables.report_log(spark, sf), REPORT_NOW)
    return rows.withColumn("clase", C.status_class(F.col("estado"), "report"))


@query
def report_page(spark, sf):
    rows = standardise.report_rows(tables.report_log(spark, sf), REPORT_NOW)
    return ranking.page(rows, 2, 5, [F.desc("fecha"), F.asc("id")]).rows


@query
def report_search(spark, sf):
    rows = standardise.report_rows(tables.report_log(spark, sf), REPORT_NOW)
    return filters.search(rows, "urgent", ["fecha", "tipo", "usuario", "formato", "estado"])


@query
def report_count(spark, sf):
    return devices.row_total(tables.report_log(spark, sf))


@query
def user_search(spark, sf):
    return filters.search(tables.users(spark, sf), "ADMIN", ["nombre", "correo", "rol", "estado"])


@query
def user_status_counts(spark, sf):
    return devices.status_tallies(tables.users(spark, sf))


@query
def role_class(spark, sf):
    return tables.users(spark, sf).select(
        "nombre",
        C.role_class(F.col("rol")).alias("clase"),
        C.initial(F.col("nombre")).alias("inicial"),
        C.status_class(F.col("estado"), "user").alias("estado"),
    )


# --- cleaning ----------------------------------------------------------------------------------


@query
def clean_numeric(spark, sf):
    return tables.raw_batch(spark, sf).select(
        "id", C.number(F.col("consumo_kwh"), finite=False).alias("consumo_kwh")
    )


@query
def clean_cost(spark, sf):
    return tables.raw_batch(spark, sf).select(
        "id", C.cost(F.col("costo_estimado"), F.col("costo_mx")).alias("costo")
    )


@query
def clean_time(spark, sf):
    return tables.raw_batch(spark, sf).select("id", times.time_of_day(F.col("hora_dia")).alias("hhmm"))


@query
def clean_date(spark, sf):
    raw = tables.raw_batch(spark, sf)
    clock = times.time_of_day(F.col("hora_dia"))
    return raw.select(
        "id",
        times.second_label(times.parse_time(F.col("timestamp"))).alias("momento"),
        times.day_label(times.parse_time(F.col("fecha"))).alias("dia"),
        times.second_label(times.combine(F.col("fecha"), clock)).alias("junto"),
    )


@query
def clean_weekday(spark, sf):
    raw = tables.raw_batch(spark, sf)
    day = times.parse_time(F.col("batch_id"))
    return raw.select("id", times.weekday_label(F.col("dia_semana"), day).alias("dia"))


@query
def clean_event_time(spark, sf):
    raw = tables.raw_feed(spark, sf)
    ts = times.event_time(F.col("timestamp"), F.col("datetime"), F.col("fecha"), F.col("hora"))
    return raw.select("id", times.second_label(ts).alias("momento"))


@query
def calendar_parts(spark, sf):
    ts = F.col("ts")
    return tables.readings(spark, sf).select(
        "id",
        F.hour(ts).alias("hora"),
        times.hour_label(ts).alias("hora_texto"),
        times.day_label(ts).alias("dia"),
        times.month_label(ts).alias("mes"),
        times.weekday_of(ts).alias("dia_semana"),
    )


@query
def clean_consumption(spark, sf):
    raw = tables.raw_feed(spark, sf)
    power = F.col("active_power")
    kwh = C.consumption(F.col("consumo_kwh"), power, F.col("consumo"))
    return raw.select(
        "id",
        kwh.alias("consumo"),
        _six(C.tariff_cost(kwh, S.LIVE_TARIFF)).alias("costo"),
        _six(C.watts_to_kwh(power)).alias("kwh"),
        C.number(power).alias("watts"),
    )


@query
def clean_domain(spark, sf):
    raw = tables.raw_scoring(spark, sf)
    return raw.select(
        "id",
        C.clamp(F.col("estado"), S.STATUSES, S.DEFAULT_STATUS).alias("estado"),
        C.clamp(F.col("casa_id"), S.MUNICIPALITIES, "Puebla").alias("casa_id"),
    )


@query
def clean_status(spark, sf):
    current, status = F.col("current"), F.col("estado")
    return tables.raw_feed(spark, sf).select(
        "id",
        C.dashboard_status(current, status).alias("tablero"),
        C.device_status(current, status).alias("equipo"),
        C.history_status(current).alias("historia"),
        C.batch_status(status).alias("lote"),
    )


@query
def clean_text(spark, sf):
    device, other = F.col("device_id"), F.col("dispositivo")
    return tables.raw_feed(spark, sf).select(
        "id",
        C.first_text(S.DEFAULT_DEVICE, device, other).alias("equipo"),
        C.first_text(S.NO_TEXT, device).alias("historia"),
        C.first_text(S.NO_TEXT, F.col("usuario")).alias("usuario"),
        C.first_text(S.NO_TEXT, F.col("tipo")).alias("tipo"),
        F.substring("hora", 1, 5).alias("hora"),
    )


@query
def status_class(spark, sf):
    rows = tables.raw_feed(spark, sf)
    return rows.select(
        "id",
        C.status_class(F.col("estado")).alias("lectura"),
        C.status_class(C.history_status(F.col("current")), "history").alias("historia"),
    )


@query
def json_fields(spark, sf):
    events = tables.load(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("id"), feed.json_field("props", "k").try_cast("bigint").alias("k")
    )


@query
def json_feed(spark, sf):
    fields = F.to_json(F.struct(*[c for c in S.FEED.names]))
    raw = tables.raw_feed(spark, sf)
    return feed.parse_feed(raw.select(fields.alias("value"))).select("id", "timestamp", "estado", "usuario")


@query
def complete_rows(spark, sf):
    raw = tables.raw_batch(spark, sf)
    return filters.drop_missing(raw, ["fecha", "consumo_kwh", "casa_id"]).select("id", "fecha", "casa_id")


@query
def standardised_readings(spark, sf):
    rows = standardise.dashboard_readings(tables.raw_feed(spark, sf))
    return _stamped(rows.withColumn("costo", _six("costo")), "ts")


@query
def untimed_dropped(spark, sf):
    raw = tables.raw_feed(spark, sf)
    ts = times.event_time(F.col("timestamp"), F.col("datetime"), F.lit(None), F.lit(None))
    return filters.valid_time(raw.select("id", ts.alias("ts"))).select("id")


@query
def device_list(spark, sf):
    return _stamped(ranking.newest_per(standardise.device_readings(tables.raw_feed(spark, sf))), "ts")


@query
def history_rows(spark, sf):
    return standardise.history_rows(tables.raw_feed(spark, sf)).drop("ts")


@query
def current_month_rows(spark, sf):
    rows = filters.current_month(tables.line_readings(spark, sf))
    return rows.select(times.day_label(F.col("ts")).alias("dia"), "consumo_kwh", "costo")


@query
def last_week_rows(spark, sf):
    return filters.trailing(tables.readings(spark, sf), "7 days").select("id", "consumo_kwh")


@query
def renamed_history(spark, sf):
    raw = tables.raw_batch(spark, sf).select("id", "fecha", "consumo_kwh", "costo_mx")
    filled = files.apply_contract(raw, S.DASHBOARD, keep=("id",))
    return standardise.history_columns(standardise.dashboard_batch(filled))


# --- adaptive time source and the mining build -------------------------------------------------


@query
def best_hour_source(spark, sf):
    found = hours.hour_sources(tables.raw_batch(spark, sf))
    return found.select("batch_id", "source", "n_valid", _six("share_midnight").alias("share_midnight"))


@query
def hour_profile(spark, sf):
    found = hours.hour_profile(tables.raw_batch(spark, sf))
    return found.select("batch_id", "hour_source", "hour", "n", _six("share").alias("share"))


@query
def mining_readings(spark, sf):
    return _stamped(mining.mining_readings(tables.raw_batch(spark, sf)), "ts")


def _cube(spark, sf) -> DataFrame:
    return mining.energy_cube(mining.mining_readings(tables.raw_batch(spark, sf)))


@query
def mined_hours(spark, sf):
    return mining.by_hour(_cube(spark, sf))


@query
def mined_weekdays(spark, sf):
    return mining.by_weekday(_cube(spark, sf))


@query
def mined_top(spark, sf):
    return mining.top_entities(_cube(spark, sf))


@query
def mined_summary(spark, sf):
    rows = materialise(mining.mining_readings(tables.raw_batch(spark, sf)), "readings")
    return mining.summary(materialise(mining.energy_cube(rows), "cube"), rows)


@query
def mined_scatter(spark, sf):
    rows = mining.mining_readings(tables.raw_batch(spark, sf))
    return mining.scatter(mining.sample_pool(rows))


def _bundle_rows(bundle: dict[str, DataFrame]) -> DataFrame:
    """The results of a bundle as rows ``result, label, value``."""
    parts = []
    for name, result in bundle.items():
        if "labels" in result.columns:
            rows = sinks.from_series(result).select("label", "value")
        elif name == "top_dispositivos":
            rows = result.select(F.col("municipio").alias("label"), F.col("total").alias("value"))
        elif name in ("historico", "consumo_vs_costo"):
            rows = result.agg(F.lit("n").alias("label"), F.count("*").cast("double").alias("value"))
        else:
            rows = result.select(F.explode(F.array(*[
                F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for c in result.columns
            ])).alias("p")).select("p.*")
        parts.append(rows.select(F.lit(name).alias("result"), "label", "value"))
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionAll(rows)
    return out


def _mining_bundle(spark, sf) -> dict[str, DataFrame]:
    """The whole mining build from one batch in CSV files, read back through its bundle."""
    folder = work_dir(spark, "mining-build")
    raw = tables.raw_batch(spark, sf).drop("batch_id")
    raw.write.options(**sinks.CSV_OPTIONS).csv(f"{folder}/readings.csv")
    mining.build(spark, f"{folder}/readings.csv", f"{folder}/out", batch_folders=True)
    return sinks.read_bundle(spark, f"{folder}/out")


@query
def mining_bundle(spark, sf):
    return _bundle_rows(_mining_bundle(spark, sf))


@query
def mining_bundle_points(spark, sf):
    """The points that the mining bundle holds."""
    return _mining_bundle(spark, sf)["consumo_vs_costo"]


# --- the dashboard build -----------------------------------------------------------------------


def _dashboard(spark, sf) -> DataFrame:
    raw = tables.raw_batch(spark, sf).withColumnRenamed("timestamp", "momento")
    shown = raw.selectExpr(
        "id", "momento AS fecha", "consumo_kwh", "costo_mx", "upper(dia_semana) AS estado", "casa_id AS usuario"
    )
    return standardise.dashboard_batch(files.apply_contract(shown, S.DASHBOARD, keep=("id",)))


@query
def dashboard_cards(spark, sf):
    rows = materialise(_dashboard(spark, sf), "dated")
    return dashboard.cards(materialise(dashboard.day_table(rows), "days"), rows)


@query
def dashboard_daily(spark, sf):
    return dashboard.daily(dashboard.day_table(_dashboard(spark, sf)))


@query
def dashboard_monthly(spark, sf):
    return dashboard.monthly(dashboard.day_table(_dashboard(spark, sf)))


def _dashboard_bundle(spark, sf) -> dict[str, DataFrame]:
    """The whole dashboard build from CSV files, read back through its bundle."""
    folder = work_dir(spark, "dashboard-build")
    shown = tables.raw_batch(spark, sf).selectExpr(
        "id", "timestamp AS fecha", "consumo_kwh", "costo_mx", "upper(dia_semana) AS estado", "casa_id AS usuario")
    shown.write.options(**sinks.CSV_OPTIONS).csv(f"{folder}/readings.csv")
    dashboard.build(spark, f"{folder}/readings.csv", f"{folder}/out")
    return sinks.read_bundle(spark, f"{folder}/out", sinks.DASHBOARD_BUNDLE)


@query
def dashboard_bundle(spark, sf):
    return _bundle_rows(_dashboard_bundle(spark, sf))


@query
def dashboard_bundle_history(spark, sf):
    """The history rows that the dashboard bundle holds; equal times go by id."""
    return _dashboard_bundle(spark, sf)["historico"]


# --- scoring -----------------------------------------------------------------------------------


@query
def scoring_records(spark, sf):
    return feed.scoring_records(tables.raw_scoring(spark, sf))


@query
def scoring_rejects(spark, sf):
    return feed.scoring_rejects(tables.raw_scoring(spark, sf)).select("id", "faltan")


def _scoring_file(spark, sf) -> DataFrame:
    """The scoring records as JSON lines, every 37th cut off in the middle, every 41st as a list of one."""
    folder = work_dir(spark, "scoring-json")
    line = F.to_json(F.struct(*tables.raw_scoring(spark, sf).columns))
    line = F.when(F.col("id") % 37 == 0, F.substring(line, 1, 25)).when(F.col("id") % 41 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    tables.raw_scoring(spark, sf).select(line.alias("value")).write.text(folder)
    return feed.read_scoring_records(spark, folder, keep=("id",))


@query
def scoring_json(spark, sf):
    """Records as a request brings them; what cannot be read is left out."""
    return feed.scoring_records(_scoring_file(spark, sf)).withColumn("id", F.col("id").cast("bigint"))


@query
def scoring_json_rejects(spark, sf):
    """Records left out: those without a required number, and those that cannot be read, by their text."""
    rejects = feed.scoring_rejects(_scoring_file(spark, sf))
    return rejects.groupBy("faltan").agg(F.count("*").alias("n"), F.count(S.CORRUPT).alias("ilegibles"))


@query
def feature_matrix(spark, sf):
    return scoring.feature_matrix(feed.scoring_records(tables.raw_scoring(spark, sf)))


def _training(spark, sf) -> DataFrame:
    chained = ranking.next_reading(tables.readings(spark, sf), "device_id")
    targets = chained.select("id", "consumo_next", "costo_next")
    return feed.scoring_records(tables.raw_scoring(spark, sf)).join(targets, "id")


@query
def model_scores(spark, sf):
    """A forest's score is a mean of training targets, so it lies in their range."""
    training = _training(spark, sf)
    scored = scoring.fit(training, trees=8, depth=4).score(feed.scoring_records(tables.raw_scoring(spark, sf)))
    known = training.dropna(subset=list(scoring.OUTPUTS)).agg(*[
        F.struct(F.min(t).alias("lo"), F.max(t).alias("hi")).alias(t) for t in scoring.OUTPUTS])
    limits = known.select(F.struct(*scoring.OUTPUTS)).scalar()
    return scored.select("id", *[
        F.col(o).between(limits[t]["lo"], limits[t]["hi"]).alias(o) for t, o in scoring.OUTPUTS.items()])


@query
def model_predictions(spark, sf):
    """The scores themselves; another engine has no such forest, so no SQL."""
    scorer = scoring.fit(_training(spark, sf), trees=8, depth=4)
    scored = scorer.score(feed.scoring_records(tables.raw_scoring(spark, sf)))
    return scored.select("id", *[_six(o).alias(o) for o in scoring.OUTPUTS.values()])


@query
def score_count(spark, sf):
    """How many records a batch request would score."""
    return feed.scoring_records(tables.raw_scoring(spark, sf)).agg(F.count("*").alias("n"))


# --- sources and sinks -------------------------------------------------------------------------


@query
def csv_scan(spark, sf):
    """Readings written as CSV, then scanned through the mining contract."""
    folder = work_dir(spark, "csv-scan")
    raw = tables.raw_batch(spark, sf).drop("batch_id", "id")
    raw.write.options(**sinks.CSV_OPTIONS).csv(f"{folder}/readings.csv")
    rows = files.read_readings(spark, f"{folder}/readings.csv", S.MINING)
    kwh = C.number(F.col("consumo_kwh"), finite=False)
    return rows.select("casa_id", "timestamp", kwh.alias("consumo_kwh"))


#: Rows of a chunk in the queries below.
CHUNK = 300
#: Rows that one task puts in order and writes for them, about.
PART = 250_000


def _chunked_files(spark, sf, max_batches: int = 0) -> DataFrame:
    """Four CSV tables in order of id, each in as many parts as its rows need, read in chunks of their rows.

    Rows of one id stay as they come; however many there are, no single task has to take them all.
    """
    folder = work_dir(spark, "csv-chunks")
    raw = tables.raw_batch(spark, sf).drop("batch_id").withColumn("parte", F.col("id") % 4)
    raw, order = raw.withColumn("orden", F.monotonically_increasing_id()), ["parte", "id", "orden"]
    parts = max(4, -(-raw.count() // PART))
    ordered = raw.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("orden")
    ordered.write.partitionBy("parte").options(**sinks.CSV_OPTIONS).csv(folder)
    return files.read_readings(spark, folder, S.MINING, max_batches, batch_folders=True, chunk_rows=CHUNK, keep=("id",))


@query
def csv_chunks(spark, sf):
    """Rows and hour source of every chunk of some CSV files."""
    rows = _chunked_files(spark, sf)
    counts = rows.groupBy("batch_id").agg(F.count("*").alias("n"))
    return counts.join(hours.hour_sources(rows), "batch_id").select(
        "batch_id", "n", "source", "n_valid", _six("share_midnight").alias("share_midnight"))


@query
def csv_chunks_capped(spark, sf):
    """The first chunks of some CSV files and no more."""
    rows = _chunked_files(spark, sf, 7)
    return rows.select(F.col("id").cast("bigint").alias("id"), "batch_id")


@query
def csv_chunk_sample(spark, sf):
    """A sample from every chunk, dated by the chunk's own hour source."""
    rows = mining.mining_readings(_chunked_files(spark, sf))
    pool = ranking.sample_per_batch(rows.select("id", "batch_id", "consumo_kwh", "costo"), per_batch=40)
    return pool.withColumn("id", F.col("id").cast("bigint"))


@query
def csv_mixed_headers(spark, sf):
    """Files with three different headers in one folder, read as one table by name."""
    folder = work_dir(spark, "csv-mixed")
    raw = tables.raw_batch(spark, sf)
    kinds = [
        ["id", "casa_id", "timestamp", "consumo_kwh", "costo_mx"],
        ["consumo_kwh", "hora_dia", "fecha", "id"],
        ["nota", "timestamp", "id", "consumo_kwh", "dia_semana"],
    ]
    for k, names in enumerate(kinds):
        own = raw.where(F.col("id") % 3 == k).withColumn("nota", F.lit("x, \"y\""))
        own.select(*names).write.mode("append").options(**sinks.CSV_OPTIONS).csv(folder)
    rows = files.read_readings(spark, folder, S.MINING, keep=("id",))
    kwh = C.number(F.col("consumo_kwh"), finite=False)
    return rows.select(F.col("id").cast("bigint").alias("id"), "casa_id", "timestamp", "fecha", "hora_dia", "costo_mx",
                       "dia_semana", kwh.alias("consumo_kwh"))


@query
def parquet_scan(spark, sf):
    """Readings written as parquet and found from the path of the CSV they replace."""
    folder = work_dir(spark, "parquet-scan")
    tables.raw_batch(spark, sf).select("fecha", "consumo_kwh").write.parquet(f"{folder}/readings.parquet")
    rows = files.read_readings(spark, f"{folder}/readings.csv", S.DASHBOARD)
    return rows.drop("batch_id")


@query
def csv_roundtrip(spark, sf):
    folder = work_dir(spark, "export")
    path = sinks.export_csv(_history(spark, sf), folder, "2024-01-31")
    return sinks.read_export(spark, path)


@query
def json_cache_roundtrip(spark, sf):
    folder = work_dir(spark, "results")
    hourly = energy.energy_by_hour(tables.readings(spark, sf))
    sinks.write_result(sinks.as_series(hourly, "ord"), folder, "consumo_hora")
    return sinks.from_series(sinks.read_result(spark, folder, "consumo_hora"))


@query
def report_append(spark, sf):
    folder = work_dir(spark, "reports")
    tables.report_log(spark, sf).write.json(folder)
    feed.append_report(spark, folder)
    log = feed.read_reports(spark, folder)
    return log.groupBy("tipo", "estado").agg(F.count("*").alias("n"))


@query
def report_compacted(spark, sf):
    """A log whose files are folded twice while requests keep coming."""
    folder = work_dir(spark, "reports-compacted")
    tables.report_log(spark, sf).write.json(folder)
    for _ in range(2):
        feed.append_report(spark, folder)
        feed.compact_reports(spark, folder, least=1)
    feed.append_report(spark, folder)
    log = feed.read_reports(spark, folder)
    return log.groupBy("tipo", "estado").agg(F.count("*").alias("n"))


# --- the live feed -----------------------------------------------------------------------------


def _in_four_batches(spark, folder: str, rows: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """The rows as a stream of four batches by id, each of as many files as tasks run at once; the
    last also has the rows of ``again``. Small tables have fewer files, so that none is empty."""
    files = max(1, min(spark.sparkContext.defaultParallelism, rows.count() // 64))
    for part in range(4):
        own = rows.filter(F.col("id") % 4 == part)
        own = own.unionByName(again) if again is not None and part == 3 else own
        own.repartition(files).write.mode("append").parquet(folder)
    return live.feed_stream(spark, folder, rows.schema, "parquet", maxFilesPerTrigger=files)


def _live_feed(spark, sf) -> DataFrame:
    """The events as a stream of four batches with interleaved times. The last batch also sends
    every 20th key again with a new value, every 40th weeks earlier than before."""
    folder = work_dir(spark, "live-feed")
    rows = tables.readings(spark, sf)
    late = F.when(F.col("id") % 40 == 0, F.expr("ts - INTERVAL 20 DAYS")).otherwise(F.col("ts"))
    again = rows.filter(F.col("id") % 20 == 0).withColumns({"consumo_kwh": F.col("consumo_kwh") + 1, "ts": late})
    return _in_four_batches(spark, folder, rows, again)


def _live_table(spark, sf) -> DataFrame:
    """The last copy of every key after the whole stream."""
    folder = work_dir(spark, "live-table")
    live.keyed_table(_live_feed(spark, sf), folder, compact=3).awaitTermination()
    return live.read_changes(spark, folder, ["id"])


@query
def live_last_n(spark, sf):
    folder = work_dir(spark, "live-view")
    live.last_n_view(_live_feed(spark, sf), folder, S.FEED_DASHBOARD).awaitTermination()
    return live.read_latest(spark, f"{folder}/view").select("id", "device_id", "estado", "consumo_kwh")


@query
def live_alerts(spark, sf):
    folder = work_dir(spark, "live-alerts")
    live.last_n_view(_live_feed(spark, sf), folder, value="consumo_kwh", compact=2).awaitTermination()
    return live.read_latest(spark, f"{folder}/alerts")


@query
def live_latest_per_device(spark, sf):
    rows = ranking.newest_per(_live_table(spark, sf))
    return _stamped(rows.select("id", "ts", "device_id", "estado", "consumo_kwh", "costo"), "ts")


@query
def live_active_split(spark, sf):
    return devices.active_split(_live_table(spark, sf), interval=RECENT)


@query
def live_daily(spark, sf):
    return energy.daily_totals(_live_table(spark, sf))


@query
def live_monthly(spark, sf):
    return energy.monthly_totals(_live_table(spark, sf))


@query
def live_dedup(spark, sf):
    return _live_table(spark, sf).select("id", "device_id", "consumo_kwh")


def _sent_once(spark, sf) -> DataFrame:
    """The events as a stream of four batches in which no record comes twice."""
    return _in_four_batches(spark, work_dir(spark, "once-feed"), tables.readings(spark, sf))


@query
def live_state_per_device(spark, sf):
    """The stateful form, for streams that send a record once."""
    folder = work_dir(spark, "live-devices")
    live.newest_per_device(_sent_once(spark, sf), folder).awaitTermination()
    rows = live.read_changes(spark, folder, ["device_id"])
    return _stamped(rows.select("id", "ts", "device_id", "estado", "consumo_kwh", "costo"), "ts")


@query
def live_state_daily(spark, sf):
    folder = work_dir(spark, "live-daily")
    live.daily_energy(_sent_once(spark, sf), folder).awaitTermination()
    return live.read_daily(spark, folder)


@query
def live_state_monthly(spark, sf):
    folder = work_dir(spark, "live-monthly")
    live.daily_energy(_sent_once(spark, sf), folder).awaitTermination()
    return energy.tail_k(live.read_monthly(spark, folder), 6)


def _watermarked(spark, sf) -> tuple[str, DataFrame, DataFrame]:
    """The store of the watermark form, all arrived records, and the late ones, each key's newest copy."""
    feed_folder, folder = work_dir(spark, "windowed-feed"), work_dir(spark, "windowed")
    rows = tables.readings(spark, sf)
    # Old days come last, so that many of their records are behind the watermark by then.
    shift = F.when(F.col("id") % 4 == 3, F.expr("ts - INTERVAL 40 DAYS")).otherwise(F.col("ts"))
    sent = rows.withColumn("ts", shift)
    live.on_time(_in_four_batches(spark, feed_folder, sent), folder, compact=2).awaitTermination()
    arrived = spark.read.parquet(feed_folder)
    return folder, arrived, live.late_rows(arrived, folder)


@query
def live_windowed_daily(spark, sf):
    """Energy per day of the records that came in time, and of the late ones kept aside."""
    folder, _, late = _watermarked(spark, sf)
    return live.read_windowed_daily(spark, folder, late)


@query
def live_late_rows(spark, sf):
    """Every record is accepted or late: counts of both, per part of the feed that came last or before."""
    folder, arrived, late = _watermarked(spark, sf)
    last = (F.col("id") % 4 == 3).alias("ultimo")
    accepted = live.read_on_time(spark, folder).select(last, F.lit(1).alias("a"), F.lit(0).alias("b"))
    both = accepted.unionAll(late.select(last, F.lit(0), F.lit(1)))
    return both.groupBy("ultimo").agg(F.count("*").alias("n"), (F.sum("b") == F.count("*")).alias("todo_tarde"))


@query
def rollup_months(spark, sf):
    """Months folded from a day table: exact counts and energy, and whether the sketched quantile's rank and
    the sketched distinct count lie within their stated errors of the exact ones."""
    rows = tables.line_readings(spark, sf)
    days = materialise(rollups.day_rollup(rows, entity="s_suppkey"), "day-rollup")
    months = materialise(rollups.folded(days, times.month_label(F.col("day"))), "month-rollup")
    named = rows.withColumn("period", times.month_label(F.col("ts"))).join(months.select("period", "quantile"), "period")
    exact = named.groupBy("period").agg(
        (F.count_if(F.col("consumo_kwh") < F.col("quantile")) / F.count("*")).alias("below"),
        (F.count_if(F.col("consumo_kwh") <= F.col("quantile")) / F.count("*")).alias("upto"),
        F.count_distinct("s_suppkey").alias("suppliers"))
    margin, share = 2 * rollups.rank_error(), rollups.distinct_error()
    return months.join(exact, "period").select(
        "period", "n", "energy",
        ((F.col("below") <= S.ALERT_QUANTILE + margin) & (F.col("upto") >= S.ALERT_QUANTILE - margin)).alias("rank_ok"),
        (F.abs(F.col("entities") - F.col("suppliers")) <= F.greatest(F.lit(1.0), share * F.col("suppliers"))).alias("entities_ok"))
