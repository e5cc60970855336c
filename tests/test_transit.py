"""Hand-computed cases for the transit operators."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kerbflow.functions import clock, metrics, skew, text
from kerbflow.operators import arrivals as a
from kerbflow.operators import gtfs as g
from kerbflow.operators import positions as ps
from kerbflow.operators import reliability as r
from kerbflow.operators import ridership as rd
from kerbflow.operators import scorecard as sc
from kerbflow.sources import transit as src

ARRIVALS = ("service_date date, route_id string, direction_id string, half_trip_id string, stop_id string, time_point_id string, "
            "time_point_order int, point_type string, standard_type string, scheduled string, actual string, "
            "scheduled_headway int, headway int")
DAY = dt.date(2024, 1, 10)


def stamp(hms, spaced=False):
    return None if hms is None else (f"1900-01-01 {hms}.000" if spaced else f"1900-01-01T{hms}Z")


def rows(spark, items):
    """items: (scheduled, actual, kind, scheduled_headway, headway)"""
    data = [(DAY, "28", "Inbound", f"H{i}", "S1", "tp", 1, "Midpoint", kind, stamp(s), stamp(x), sh, h)
            for i, (s, x, kind, sh, h) in enumerate(items)]
    return spark.createDataFrame(data, ARRIVALS)


def one(df):
    return df.collect()[0].asDict()


def test_clock_forms(spark):
    df = spark.createDataFrame([("1900-01-01T05:07:00Z",), ("1900-01-01 05:07:30.500",), ("",), (None,), ("x T1:2",)], "t string")
    got = [tuple(x) for x in df.select(clock.clock_seconds(F.col("t")), clock.strict_clock_seconds(F.col("t"))).collect()]
    assert got == [(18420.0, 18420.0), (18450.5, None), (None, None), (None, None), (None, None)]


def test_gtfs_time_passes_midnight(spark):
    df = spark.createDataFrame([("25:30:00",), ("7:05",), ("bad",), (None,)], "t string")
    assert [x[0] for x in df.select(clock.gtfs_seconds(F.col("t"))).collect()][:3] == [91800, 25500, 0]


def test_utc_clock_to_local_service_day(spark):
    df = spark.createDataFrame([(DAY, 18 * 3600.0), (DAY, 3 * 3600.0), (dt.date(2024, 7, 10), 18 * 3600.0)], "d date, c double")
    got = [x[0] for x in df.select(clock.local_service_seconds(F.col("c"), F.col("d"))).collect()]
    assert got == [13 * 3600, -2 * 3600, 14 * 3600]


def test_missing_headway_filled_only_by_positive_gap(spark):
    df = rows(spark, [("08:00:00", "08:00:00", "Schedule", None, None), ("08:10:00", "08:12:00", "Schedule", None, None),
                      ("08:20:00", "08:11:00", "Schedule", None, None), ("08:30:00", "08:31:00", "Headway", None, 300)])
    got = {x.half_trip_id: x.actual_headway_sec for x in a.fill_actual_headway(a.clean_arrivals(df)).collect()}
    assert got == {"H0": None, "H1": 720.0, "H2": None, "H3": 300.0}


def test_stop_day_counts_all_rows_in_bunching(spark):
    df = rows(spark, [("08:00:00", "08:00:00", "Schedule", 600, None), ("08:10:00", "08:20:00", "Schedule", 600, 100),
                      ("08:20:00", "08:21:00", "Schedule", 600, 239), ("08:30:00", "08:29:00", "Schedule", 600, 240),
                      ("08:40:00", "08:38:59", "Schedule", 0, None)])
    m = one(r.stop_day_metrics(a.fill_actual_headway(a.clean_arrivals(df))))
    assert (m["n_obs"], m["on_time_count"], m["bunched_count"]) == (5, 3, 2)
    assert m["median_scheduled_headway_sec"] == 600 and m["bunching_rate"] == pytest.approx(0.4)


def test_scheduled_zero_headway_takes_part_in_the_median(spark):
    df = rows(spark, [("08:00:00", "08:00:00", "Schedule", 0, None), ("08:10:00", "08:10:00", "Schedule", 600, None)])
    assert one(r.stop_day_metrics(a.fill_actual_headway(a.clean_arrivals(df))))["median_scheduled_headway_sec"] == 300


def test_window_needs_previous_trip_inside_and_midnight_means_none(spark):
    df = rows(spark, [("00:00:00", "00:00:30", "Headway", None, 60), ("00:05:00", "00:05:30", "Headway", None, 60),
                      ("06:59:00", "06:59:00", "Headway", None, 60), ("07:10:00", "07:10:00", "Headway", None, 60),
                      ("07:20:00", "07:20:00", "Headway", None, 60), ("09:00:00", "09:00:00", "Headway", None, 60)])
    rec = a.headway_records(df)
    assert [x.half_trip_id for x in a.headway_window(rec, "07:00", "09:00").collect()] == ["H4"]
    assert a.headway_window(rec, "00:00", "01:00").count() == 0


def test_observed_headways_floor_index_quartiles(spark):
    for n in (1, 2, 3, 4, 5, 8, 9):
        values = [float(x) for x in range(10, 10 + n)]
        df = spark.createDataFrame([(v,) for v in values], "x double")
        low, high, mid = df.agg(*[metrics.floor_index("x", q) for q in (0.25, 0.75, 0.5)]).first()
        assert [low, high, mid] == [values[int(n * 0.25)], values[int(n * 0.75)], values[n // 2]]


def test_observed_rate_divides_by_kept_rows(spark):
    df = rows(spark, [("07:00:00", "07:00:00", "Headway", None, None), ("07:10:00", "07:11:00", "Headway", None, 100),
                      ("07:20:00", "07:21:00", "Headway", None, 700)])
    m = one(sc.observed_headways(a.headway_window(a.headway_records(df), "07:00", "09:00"), ["route_id", "stop_id"]))
    assert m["n"] == 2 and m["bunching_rate"] == 0.5 and m["csv_scheduled_min"] == 10


def test_schedule_row_preferred_and_trip_summary(spark):
    data = [(DAY, "28", "Inbound", "H", f"S{o}", "tp", o, "m", kind, stamp(s), stamp(x), None, None) for o, kind, s, x in [
        (1, "Headway", "08:01:00", "08:01:00"), (1, "Schedule", "08:00:00", "08:00:00"), (2, "Schedule", "08:20:00", "08:23:01")]]
    trips = r.trip_summaries(a.dedupe_points(a.clean_arrivals(spark.createDataFrame(data, ARRIVALS))))
    t = one(trips)
    assert t["sched_trip_min"] == 20 and t["delayed"] is True and t["first_sched_sec"] == 28800


def test_bucketed_lag_equals_plain_window(spark):
    data = [(k, s, (s * 7) % 11) for k in ("a", "b") for s in range(0, 20000, 431)] + [("a", 431, 5), ("c", 3, 1)]
    df = spark.createDataFrame(data, "k string, scheduled_sec bigint, x bigint")
    got = skew.bucketed_lag(df, ["k"], F.floor(F.col("scheduled_sec") / 900), ["scheduled_sec", "x"],
                            {"p": "scheduled_sec", "px": "x"}).select("k", "scheduled_sec", "x", "p", "px")
    want = spark.sql("SELECT 1").join(df).selectExpr(
        "k", "scheduled_sec", "x", "lag(scheduled_sec) OVER (PARTITION BY k ORDER BY scheduled_sec, x) AS p",
        "lag(x) OVER (PARTITION BY k ORDER BY scheduled_sec, x) AS px")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_bucketed_running_and_row_number(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(50)] + [("b", 3, 2.0)], "k string, i int, x double")
    bucket = F.floor(F.col("i") / 7)
    total = {(x.k, x.i): x.t for x in skew.bucketed_running(df, ["k"], bucket, ["i"], "x", "t", "sum").collect()}
    assert total[("a", 49)] == 100.0 and total[("b", 3)] == 2.0
    top = {(x.k, x.i): x.t for x in skew.bucketed_running(df, ["k"], bucket, ["i"], "x", "t", "max").collect()}
    assert top[("a", 2)] == 2.0 and top[("a", 30)] == 4.0
    number = {(x.k, x.i): x.n for x in skew.bucketed_row_number(df, ["k"], bucket, ["i"], "n").collect()}
    assert number == {**{("a", i): i + 1 for i in range(50)}, ("b", 3): 1}


def test_salted_lookup_keeps_all_rows(spark):
    big = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "sk string, v int")
    got = skew.salted_lookup(big, small, "k", "sk", ["i"], heavy_rows=10)
    assert got.count() == 52 and got.where("k = 'hot' AND v = 1").count() == 50 and got.where("v IS NULL").count() == 1


@pytest.fixture(scope="session")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    files = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\ns1,Stop One,42.35,-71.06\ns2,,42.351,-71.065\n,No id,1,1\n",
        "routes": "route_id,route_short_name,route_long_name\nr1,1,Route 1\n",
        "trips": "route_id,trip_id,service_id\nr1,t1,wkd\nr1,t2,wkd\n",
        "stop_times": ("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,07:10:00,07:10:00,s1,1\n"
                       "t1,07:25:00,07:25:00,s2,2\nt2,07:30:00,07:30:00,s1,1\nt2,07:45:00,07:45:00,s2,2\n"),
        "calendar": ("service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
                     "wkd,1,1,1,1,1,0,0,20250101,20251231\n"),
    }
    for name, body in files.items():
        (folder / f"{name}.txt").write_text(body)
    return src.read_gtfs(spark, str(folder))


def dates(spark, *days):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "service_date date")


def test_feed_reader_defaults(feed):
    assert feed["stops"].count() == 2 and feed["shapes"].count() == 0 and feed["calendar_dates"].count() == 0
    assert {x.stop_id: x.stop_name for x in g.stop_names(feed["stops"]).collect()} == {"s1": "Stop One", "s2": "s2"}
    assert feed["trips"].where("shape_id IS NULL AND direction_id IS NULL").count() == 2


def test_scheduled_headway_of_the_small_feed(spark, feed):
    active = g.active_services(dates(spark, "2025-02-12", "2025-02-15"), feed["calendar"], feed["calendar_dates"])
    assert [str(x.service_date) for x in active.collect()] == ["2025-02-12"]
    got = g.scheduled_headways(feed, active, {"AM": ("07:00", "09:00")}).collect()
    assert {(x.stop_id, x.scheduled_median_min, x.trip_count) for x in got} == {("s1", 20.0, 2), ("s2", 20.0, 2)}


def test_scheduled_window_end_is_inclusive(spark, feed):
    active = g.active_services(dates(spark, "2025-02-12"), feed["calendar"], feed["calendar_dates"])
    got = g.scheduled_headways(feed, active, {"x": ("07:10", "07:30")}).collect()
    assert [(x.stop_id, x.trip_count) for x in got] == [("s1", 2)]


def test_effective_schedule_and_flags(spark):
    keys = ["route_id", "stop_id"]
    pairs = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "route_id string, stop_id string")
    scheduled = spark.createDataFrame([("r", "a", 10.0)], "route_id string, stop_id string, scheduled_median_min double")
    observed = spark.createDataFrame([("r", "a", 12.0, 8.0), ("r", "b", 9.0, 6.0)],
                                     "route_id string, stop_id string, observed_median_min double, csv_scheduled_min double")
    observed = observed.withColumns({c: F.lit(None).cast("double") for c in ("p25_min", "p75_min", "bunching_rate")})
    got = {x.stop_id: (x.effective_min, x.ratio, x.flags) for x in sc.merge_headways(pairs, scheduled, observed, keys).collect()}
    assert got == {"a": (10.0, 1.2, ""), "b": (6.0, 1.5, "csv-scheduled"), "c": (0.0, None, "no-archived")}


def test_day_type_test_also_takes_weekend(spark):
    df = spark.createDataFrame([("1", "0", "s", "Weekend", 4.0), ("1", "0", "s", "weekday", 2.0), ("1", "0", "s", "sunday", 9.0)],
                               "route_id string, direction_id string, stop_id string, day_type_name string, load double")
    assert one(rd.avg_load(df))["load"] == 3.0


def test_text_normalisation(spark):
    df = spark.createDataFrame([("1624 Blue Hill Avenue @ Morton Street",), ("Nubian Square & X opposite  Y",)], "n string")
    got = [x[0] for x in df.select(text.norm_stop_name(F.col("n"))).collect()]
    assert got == ["blue hill ave at morton st", "nubian sq at x opp y"]
    assert df.limit(1).select(text.canonical_stop(F.lit(" 17865 "))).first()[0] == "17862"


def test_arrivals_reader_drops_short_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    head = ",".join(src.ARRIVAL_COLUMNS)
    full = "20240110,28,Inbound,H1,S1,tp,x,Midpoint,Schedule,1900-01-01T08:00:00Z,,600,"
    path.write_text(f"{head}\n{full}\n2024-01-11,28,Inbound\n{full},extra\n")
    got = src.read_arrivals(spark, str(path)).collect()
    assert len(got) == 2 and got[0].service_date == DAY and got[0].time_point_order is None and got[0].scheduled_headway == 600


def test_annotations_both_layouts(spark, tmp_path):
    one_doc, listed = tmp_path / "a.json", tmp_path / "b.json"
    good = '{"stopId": "s", "routeId": "r", "type": "crowding"}'
    one_doc.write_text(f'{{"annotations": [{good}, {{"stopId": "s"}}]}}')
    listed.write_text(f"[{good}, {good}]")
    assert src.read_annotations(spark, str(one_doc)).count() == 1
    assert src.read_annotations(spark, str(listed)).count() == 2
    assert src.read_annotations(spark, os.path.join(str(tmp_path), "none.json")).count() == 0


def test_corridor_status(spark, feed):
    got = g.validate_corridor([("In", "Stop One", "s1"), ("In", "Stop Two", "s1"), ("In", "Stop Onne", "zz")], feed["stops"])
    assert [(x.status, x.matches) for x in got.orderBy("expected_name").collect()] == [
        ("ok", ""), ("missing", "Stop One (stop_id=s1)"), ("mismatched", "")]


def test_sample_times_are_inclusive(spark):
    df = spark.createDataFrame([(10.0, 30.0), (11.0, 19.0)], "a double, b double")
    closed = [x[0] for x in df.select(ps.sample_times(F.col("a"), F.col("b"), 10)).collect()]
    half = [x[0] for x in df.select(ps.sample_times(F.col("a"), F.col("b"), 10, open_end=True)).collect()]
    assert closed == [[10, 20, 30], []] and half == [[10, 20], []]


def test_pivot_takes_every_date_of_the_data(spark):
    daily = spark.createDataFrame([("28", "S1", dt.date(2024, 2, 3), 9, 0.5), ("28", "S1", dt.date(2024, 1, 30), 9, 1.0),
                                   ("28", "S2", dt.date(2024, 2, 3), 1, 0.5)],
                                  "route_id string, stop_id string, service_date date, n_obs bigint, on_time_rate double")
    got = r.heatmap_pivot(daily, "on_time_rate", ["route_id", "stop_id"])
    assert got.columns == ["route_id", "stop_id", "2024-01-30", "2024-02-03"]
    assert [tuple(x) for x in got.collect()] == [("28", "S1", 1.0, 0.5)]
    assert r.heatmap_pivot(daily.where("false"), "on_time_rate", ["stop_id"]).count() == 0


def test_floor_index_at_every_size(spark):
    for share in (0.25, 0.5, 0.75):
        rows = [(n, i) for n in range(1, 41) for i in range(n)]
        got = spark.createDataFrame(rows, "n int, x int").groupBy("n").agg(metrics.floor_index("x", share).alias("v")).collect()
        assert {x.n: x.v for x in got} == {n: int(n * share) for n in range(1, 41)}


def test_commas_in_quotes_are_no_fields(spark, tmp_path):
    whole = '"s","28","v","1","08:00","d","wk","A, B, C","S1","1","5","1","4","7"'
    short = '"s","28","v","1","08:00","d","wk","A, B, C","S1","1","5","1","4"'
    (tmp_path / "r.csv").write_text(",".join(src.RIDERSHIP_COLUMNS) + f"\n{whole}\n{short}\n{whole},extra\n")
    got = src.read_ridership(spark, str(tmp_path / "r.csv")).collect()
    assert [(x.stop_name, x.load, x.sample_size) for x in got] == [("A, B, C", 4.0, 7)] * 2


def test_missing_feed_file_is_an_empty_table(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name,stop_lat\n"A","x, y",1\n')
    read = src.read_gtfs(spark, str(tmp_path))
    assert [tuple(x) for x in read["stops"].collect()] == [("A", "x, y", 1.0, None)] and read["trips"].count() == 0


def plan_counts(df):
    """(scans, exchanges) of the physical plan, reused exchanges counted once."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ReusedExchange" not in x]
    return sum("FileScan" in x for x in lines), sum(" Exchange " in x for x in lines)


def hot_arrivals(spark, folder):
    """A third of all arrivals at one stop on one day; missing keys, missing headways, repeated rows."""
    import random

    rng, data = random.Random(7), []
    for n in range(1500):
        hot = n % 3 == 0
        day = DAY if hot else DAY + dt.timedelta(days=rng.randrange(4))
        stop = "S1" if hot else rng.choice(["S1", "S2", "S3", None])
        t = rng.randrange(5 * 3600, 23 * 3600) // 30 * 30
        late = t + rng.randrange(-200, 700)
        at, seen = ("%02d:%02d:%02d" % (x // 3600, x // 60 % 60, x % 60) for x in (t, late))
        row = (day, "28", "Inbound", f"H{n % 40}", stop, "tp", rng.choice([1, 2, None]), "m", rng.choice(["Schedule", "Headway"]), stamp(at),
               stamp(seen), rng.choice([None, None, 600, 0, -1]), rng.choice([None, None, 100, 500, -1]))
        data += [row] * (1 + n % 50 // 49)
    spark.createDataFrame(data, ARRIVALS).repartition(3).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def test_one_pass_metrics_equal_plain_windows(spark, tmp_path):
    arrivals = hot_arrivals(spark, tmp_path / "arrivals")
    clean = a.clean_arrivals(arrivals)
    order = ", ".join(a.TRIP_ORDER)
    clean.createOrReplaceTempView("clean_rows")
    plain = spark.sql(f"""
        SELECT *, CASE WHEN route_id IS NOT NULL AND stop_id IS NOT NULL THEN lag(scheduled_sec) OVER w END AS prev_scheduled_sec,
               CASE WHEN route_id IS NOT NULL AND stop_id IS NOT NULL THEN lag(actual_sec) OVER w END AS before
        FROM clean_rows WINDOW w AS (PARTITION BY route_id, stop_id, direction_id, service_date ORDER BY {order})""")
    plain = plain.withColumn("actual_headway_sec", F.coalesce("actual_headway_sec", a.positive(F.col("actual_sec") - F.col("before"))))
    filled = a.fill_actual_headway(clean)
    columns = [*a.STOP_DAY, "half_trip_id", "scheduled_sec", "actual_sec", "prev_scheduled_sec", "actual_headway_sec"]
    assert sorted(map(str, filled.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))
    quarters = r.stop_day_quarters(clean)
    for by_hour in (False, True):
        want = r.stop_day_metrics(plain.drop("before"), by_hour)
        got = r.stop_day_summary(quarters, by_hour).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("bunched_count > 0").count() > 10


def test_scans_and_shuffles(spark, tmp_path):
    clean = a.clean_arrivals(hot_arrivals(spark, tmp_path / "arrivals"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        quarters = r.stop_day_quarters(clean)
        assert plan_counts(r.stop_metrics(r.stop_day_summary(quarters))) == (1, 3)
        assert plan_counts(r.stop_metrics_by_hour(quarters)) == (1, 3)
        assert plan_counts(a.fill_actual_headway(clean)) == (1, 2)
        assert plan_counts(a.headway_records(spark.read.parquet(str(tmp_path / "arrivals")))) == (1, 2)
        windowed = a.headway_window(a.headway_records(spark.read.parquet(str(tmp_path / "arrivals"))), "07:00", "09:00")
        assert plan_counts(sc.observed_headways(windowed, ["route_id", "stop_id"])) == (1, 4)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbering_without_keys_over_many_blocks(spark):
    """One sequence over buckets of several blocks, with gaps and a full bucket."""
    from kerbflow.functions.skew import bucketed_row_number

    values = [*range(0, 500, 7), *range(900_000, 903_000), 5_000_000, 5_000_001]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(7)
    got = bucketed_row_number(rows, [], F.floor(F.col("v") / 64), ["v"], "n").collect()
    assert {r.v: r.n for r in got} == {v: i + 1 for i, v in enumerate(values)}


def test_place_on_a_shape_cut_into_buckets(spark):
    """Segments across bucket borders, repeated vertices at the start, and a shape of a single vertex."""
    line = [("a", i, float(i), 2.0 * i, 100.0 * max(i - 1, 0)) for i in range(600)] + [("b", 0, 7.0, 8.0, 0.0)]
    shapes = spark.createDataFrame(
        [(s, i, y, x, d) for s, i, y, x, d in line],
        "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, cum_dist_m double")
    asked = [("a", 0.0), ("a", 25425.0), ("a", 25450.0), ("a", 25500.0), ("a", 59800.0), ("b", 0.0)]
    got = ps.on_shape(spark.createDataFrame(asked, "shape_id string, d double"), shapes, "d", "lon", "lat").collect()
    want = {("a", 0.0): (0.0, 0.0)}
    want.update({("a", d): (2 * (1 + d / 100), 1 + d / 100) for s, d in asked[1:5]})
    want["b", 0.0] = (8.0, 7.0)
    assert len(got) == len(asked)
    for r in got:
        assert (r.lon, r.lat) == pytest.approx(want[r.shape_id, r.d])


def test_trip_series_is_numbered_across_days(spark):
    rows = [("r", f"2024-01-{day:02d}", f"h{(7 * k) % 5}", "Inbound", float(600 * (k % 3))) for day in (1, 2, 9) for k in range(5)]
    trips = spark.createDataFrame(rows, "route_id string, d string, half_trip_id string, direction_id string, first_sched_sec double")
    trips = trips.withColumn("service_date", F.col("d").cast("date"))
    got = r.trip_series_order(trips).orderBy("pos").collect()
    want = sorted(rows, key=lambda x: (x[1], x[4], x[2]))
    assert [(r.d, r.half_trip_id) for r in got] == [(x[1], x[2]) for x in want]
    assert [r.pos for r in got] == list(range(1, 16))


def test_clocks_are_read_once_and_arrivals_in_one_pass(spark, feed, tmp_path):
    arrivals = hot_arrivals(spark, tmp_path / "arrivals")
    observed = ps.observed_points(arrivals)
    plan = observed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 6  # hour, minute and second of two clocks
    assert observed.count() and not ps.timeline_points(arrivals, feed).inputFiles()
    kept = ps.placed_points(observed, feed)
    assert kept.collect() == ps.timeline_points(arrivals, feed).collect() and not kept.inputFiles()


def test_positions_read_the_shapes_once(spark, tmp_path):
    rows = [("a", i, 42.0, -71.0 + i * 0.001, 100.0 * i) for i in range(5)]
    spark.createDataFrame(rows, "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, cum_dist_m double").write.parquet(
        str(tmp_path / "shapes"))
    points = spark.createDataFrame(
        [("28", DAY, "H1", 1, "S1", 0.0, 0.0, 0.0, "Inbound", "a"), ("28", DAY, "H1", 2, "S2", 400.0, 400.0, None, "Inbound", "a")],
        "route_id string, service_date date, half_trip_id string, time_point_order int, stop_id string, dist_m double, scheduled_sec double, "
        "actual_sec double, direction_id string, shape_id string")
    got = ps.positions_at(points, ps.trip_timelines(points), spark.read.parquet(str(tmp_path / "shapes")), 200)
    assert not got.inputFiles()
    assert {r.t: (round(r.sched_lon, 6), round(r.actual_lon, 6)) for r in got.collect()} == {
        0: (-71.0, -71.0), 200: (-70.998, -71.0), 400: (-70.996, -71.0)}
