import pytest
from pyspark.sql import functions as F

from tremora.fixed import STUDY_BOX, Box
from tremora.operators import regions
from tremora.plans import catalog_build
from tremora.sinks import tables as sinks
from tremora.sources import landing, shapes, text_catalogs

PIPE = """#EventID|Time|Latitude|Longitude|Depth/km|Author|Catalog|Contributor|ContributorID|MagType|Magnitude|MagAuthor|EventLocationName

us1|2023-12-20T12:11:21.5|-15.8585|-72.5207|-3|us|us|us|us1|mww|6.2|us|southern Peru
 us2 | 2023-12-21T00:00:00Z | -8.5 | -74.56 | 900 ||||| mb | 5.0 || |earthquake
us3|2023-12-21T00:00:00||-74.56|10|||||mb|5.0||
us4|not a time|-8.5|-74.56|10|||||mb|5.0||
us5|2023-12-21T00:00:00|-98.5|-74.56|10|||||mb|5.0||
us6|2023-12-22T00:00:00|-8.5|-74.56|||||||||
short|line
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_pipe_text(spark, tmp_path):
    got = {r["source_event_id"]: r for r in text_catalogs.read_pipe(spark, write(tmp_path, "a.txt", PIPE), "usgs").collect()}
    assert set(got) == {"us1", "us2", "us6"}
    assert got["us1"]["depth_km"] == 0.0 and got["us2"]["depth_km"] is None and got["us1"]["country"] == "Peru"
    assert got["us2"]["mw"] == pytest.approx(0.85 * 5 + 1.03) and got["us2"]["mw_method"] == "scordilis_mb" and got["us2"]["author"] is None
    assert got["us6"]["mw"] is None and got["us6"]["mw_method"] == "none"
    assert str(got["us1"]["origin_time"]) == "2023-12-20 12:11:21.500000"


def test_semicolon_table(spark, tmp_path):
    text = "id;Fecha_UTC;HORA_UTC ;LATITUD;LONGITUD;PROFUNDIDAD;MAGNITUD;FECHA_CORTE\n1;20010623;203314;-16.3;-73.6;33;8.4;x\n2;20010624;12.0;-16.3;-73.6;bad;;x\n3;20010699;12;-16.3;-73.6;1;4;x\n4;20010624;12;;-73.6;1;4;x\n"
    got = {r["source_event_id"]: r for r in text_catalogs.read_semicolon(spark, write(tmp_path, "b.csv", text)).collect()}
    assert set(got) == {"1", "2"}
    assert str(got["1"]["origin_time"]) == "2001-06-23 20:33:14" and str(got["2"]["origin_time"]) == "2001-06-24 00:00:12"
    assert got["2"]["depth_km"] is None and got["2"]["mw"] is None and got["1"]["mw_method"] == "assume_unknown"


def ndk(k, mantissa="1.0"):
    return [
        f"PDE  2005/01/{k + 1:02d} 01:20:05.4  13.78  -88.78 193.1 5.0 0.0 EL SALVADOR", f"C20050101{k:03d}   B:  4    4  27", "CENTROID:  -0.3 0.9",
        "23  0.838 0.201 -0.005", f"V10   1.581  56  12   0.537  23 140  -2.118  24 241   {mantissa}  9 29 142",
    ]


def test_five_line_records(spark, tmp_path):
    lines = ndk(0, "1.850") + [""] + ndk(1, "-1.0") + ["PDE too short", *ndk(2)[1:]] + ndk(3)[:4] + ["  "] + ndk(3)[4:] + ndk(4)[:3]
    got = {r["source_event_id"]: r for r in text_catalogs.read_five_line(spark, write(tmp_path, "c.ndk", "\n".join(lines))).collect()}
    assert set(got) == {"C20050101000", "C20050101003"}
    assert got["C20050101000"]["mw"] == pytest.approx(4.78) and got["C20050101000"]["mw_method"] == "direct"
    assert got["C20050101000"]["depth_km"] == 193.1


def test_five_line_records_in_many_splits(spark, tmp_path):
    path = write(tmp_path, "d.ndk", "\n".join(line for k in range(28) for line in ndk(k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = text_catalogs.read_five_line(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert sorted(r["source_event_id"] for r in df.collect()) == [f"C20050101{k:03d}" for k in range(28)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_comma_table(spark, tmp_path):
    fields = lambda date, lat, mw, auth, eid: ",".join([date, lat, " -72", "0", "0", "0", "A", " 30", "0", "A", mw, "0", "A", "0", "0", "0", auth, *["0"] * 6, f" {eid}"])
    text = "\n".join(["# a comment", fields("1960-05-22 19:11:20.00", "-38.1", " 9.6 ", " ", "879136"), fields("bad", "-38", "9", "x", "2"), fields("1960-05-22", "", "9", "x", "3"), fields("1960-05-22", "-3", "", "x", "4")])
    got = text_catalogs.read_comma24(spark, write(tmp_path, "e.csv", text)).collect()
    assert [(r["source_event_id"], r["mw"], r["author"], r["depth_km"]) for r in got] == [("879136", 9.6, "ISC-GEM", 30.0)]


SHAPES = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"NOMBDEP": "LIMA", "NOMBPROV": "SAN-MARTIN O'HIGGINS", "NOMBDIST": "ÁNCASH SUR"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,4],[0,0]], [[1,1],[2,1],[2,2],[1,2],[1,1]]]}},
 {"type": "Feature", "properties": {"NOMBDEP": "CUSCO"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[4,0],[8,0],[8,4],[4,4]]], [[[10,0],[11,0],[11,1]]]]}},
 {"type": "Feature", "properties": {"NOMBDEP": "NOWHERE"}, "geometry": null}]}"""


def test_polygons(spark, tmp_path):
    vertices = shapes.read_shapes(spark, write(tmp_path, "f.geojson", SHAPES)).cache()
    names = {r["region_id"] for r in vertices.select("region_id").distinct().collect()}
    assert names == {"Lima/San-Martin O'Higgins/Áncash Sur", "Cusco"}
    area = {r["region_id"]: r for r in regions.shapes(regions.edges_of(vertices)).collect()}
    import math
    lima = area["Lima/San-Martin O'Higgins/Áncash Sur"]
    cy = (16 * 2 - 1 * 1.5) / 15
    assert lima["cen_lat"] == pytest.approx(cy) and lima["area_km2"] == pytest.approx(15 * 111.32**2 * math.cos(math.radians(cy)))
    points = [(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 5.0, 1.0), (4, 10.9, 0.5), (5, -30.0, 2.0), (6, 9.9, 0.5), (7, 300.0, 0.0)]
    got = {r["point_id"]: (r["region_id"][:4], r["inside"]) for r in regions.assign_regions(spark.createDataFrame(points, "point_id long, lon double, lat double"), vertices).collect()}
    assert got == {1: ("Lima", True), 2: ("Lima", False), 3: ("Cusc", True), 4: ("Cusc", True), 5: ("Lima", False), 6: ("Cusc", False), 7: ("Cusc", False)}


def test_missing_and_failing_sources(spark, tmp_path):
    empty = landing.optional(spark, lambda: text_catalogs.read_comma24(spark, str(tmp_path / "none.csv")), "none")
    assert empty.count() == 0 and "mw_method" in empty.columns
    with pytest.raises(RuntimeError):
        landing.union_sources(spark, ["x"], {})


def test_windows(spark):
    chunks = landing.time_chunks(spark, 0, 25 * 86_400_000_000, 10).collect()
    assert [(c["start_us"] // 86_400_000_000, c["end_us"] // 86_400_000_000) for c in chunks] == [(0, 10), (10, 20), (20, 25)]
    burst = spark.range(100).select(F.lit(5_000_000).cast("long").alias("t_us"))
    got = landing.balanced_windows(burst, 0, 64_000_000, 10).orderBy("from_us").toPandas()
    assert got.n.sum() == 100 and got.truncated.sum() == 1 and got.from_us.iloc[0] == 0 and got.to_us.iloc[-1] == 64_000_000
    assert (got.from_us.iloc[1:].values == got.to_us.iloc[:-1].values).all()


def test_upsert_updates_named_columns_only(spark, tmp_path):
    """Of keys that come twice the last arrival counts; the version before stays readable until the new one is complete, and after."""
    path = str(tmp_path / "obs")
    schema = "source string, source_event_id string, magnitude double, mw double, mw_method string, country string, canonical_id long"
    sinks.publish(spark.createDataFrame([("a", "1", 5.0, 5.1, "direct", "Peru", 1), ("a", "2", 4.0, 4.1, "direct", "Peru", 2)], schema), path)
    new = spark.createDataFrame([("a", "2", 8.0, 8.0, "direct", "Peru", 3, 1), ("a", "2", 9.0, None, "none", "Chile", 7, 2), ("b", "1", 6.0, 6.0, "direct", "Peru", 8, 1), ("b", "1", 6.0, 6.0, "direct", "Peru", 8, 1)], schema + ", came int")
    sinks.upsert(new, path, arrival="came")
    rows = sinks.current(spark, path).collect()
    assert {(r["source"], r["source_event_id"]): tuple(r)[2:] for r in rows} == {
        ("a", "1"): (5.0, 5.1, "direct", "Peru", 1), ("a", "2"): (4.0, None, "none", "Chile", 7), ("b", "1"): (6.0, 6.0, "direct", "Peru", 8),
    }
    assert len(rows) == 3 and spark.read.parquet(f"{path}/v=1").count() == 2
    (tmp_path / "obs" / "v=3").mkdir()  # a version whose writer was lost
    assert sinks.current(spark, path).count() == 3


def test_catalog_build_end_to_end(spark, tmp_path):
    usgs = write(tmp_path, "usgs.txt", PIPE)
    igp = write(tmp_path, "igp.csv", "ID;FECHA_UTC;HORA_UTC;LATITUD;LONGITUD;PROFUNDIDAD;MAGNITUD;FECHA_CORTE\n9;20231220;121123;-15.9;-72.5;40;6.1;x\n10;19500101;0;-15.9;-72.5;40;6.1;x\n")
    readers = {
        "usgs": lambda: text_catalogs.read_pipe(spark, usgs, "usgs"), "igp": lambda: text_catalogs.read_semicolon(spark, igp),
        "iscgem": lambda: landing.optional(spark, lambda: text_catalogs.read_comma24(spark, str(tmp_path / "none.csv")), "iscgem"),
    }
    out = str(tmp_path / "out")
    summary = catalog_build.build_catalog(spark, ["usgs", "igp", "iscgem", "other"], readers, out, "1960-01-01", "2024-12-31", STUDY_BOX, min_mag=None)
    found = {r["metric"]: r["n"] for r in summary.collect()}
    assert found == {"source:usgs": 3, "source:igp": 1, "observations": 4, "events": 3, "events:Peru": 3, "unknown:other": 0}
    events = spark.read.parquet(f"{out}/events").orderBy("origin_time").collect()
    assert events[0]["preferred_source"] == "igp" and events[0]["mag_source"] == "usgs" and events[0]["sources"] == "igp,usgs"
    assert spark.read.parquet(f"{out}/events_focus").count() == 3 and spark.read.parquet(f"{out}/members").filter("is_preferred").count() == 3


def test_raw_landing_keeps_earlier_batches(spark, tmp_path):
    rows = spark.createDataFrame([("e1",), ("e2",)], "event_id string")
    for batch in ("b1", "b2"):
        sinks.append_raw(rows, str(tmp_path / "raw"), "usgs", batch)
    sinks.append_raw(rows.limit(1), str(tmp_path / "raw"), "usgs", "b2")  # landed already
    landed = spark.read.parquet(str(tmp_path / "raw")).groupBy("source", "batch_id").count().collect()
    assert {(r["source"], r["batch_id"]): r["count"] for r in landed} == {("usgs", "b1"): 2, ("usgs", "b2"): 2}
    document = sinks.manifest(rows, "usgs", "b1", "2000-01-01", "2001-01-01", Box(-1, 1, -2, 2), 4.5, "now").first()["document"]
    assert '"n_events":2' in document and '"min_lat":-1.0' in document


def test_source_that_breaks_late_is_left_out_and_told(spark, tmp_path):
    good = write(tmp_path, "good.txt", PIPE)

    def late():
        rows = text_catalogs.read_pipe(spark, good, "bad")
        return rows.withColumn("place", F.when(F.col("magnitude") == rows.agg(F.max("magnitude")).first()[0], F.raise_error(F.lit("bad block"))).otherwise(F.col("place")))

    union, told = landing.landed_sources(spark, ["usgs", "bad", "none"], {"usgs": lambda: text_catalogs.read_pipe(spark, good, "usgs"), "bad": late})
    assert {r["source"] for r in union.collect()} == {"usgs"}
    status = {r["source"]: (r["status"], r["n"]) for r in told.collect()}
    assert status == {"usgs": ("landed", union.count()), "bad": ("failed", 0), "none": ("unknown", 0)}


def test_numbers_are_plain_decimals(spark):
    texts = ["5", " 5.25 ", "-.5", "+1e-2", "5.", "5.0d", "5.0f", "0x10", "1_000", "", "five", "1e", None]
    got = [r["v"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string").orderBy("k").select(text_catalogs._number(F.col("x")).alias("v")).collect()]
    assert got == [5.0, 5.25, -0.5, 0.01, 5.0] + [None] * 8


def test_records_of_one_type_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tremora.checks import io_queries
    from tremora.checks.registry import QUERIES

    rows = spark.range(400).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts", "id % 50 AS user_id", "'click' AS event_type", "CAST(1 + id % 90 AS DOUBLE) AS value", "'' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(io_queries, "scratch_path", lambda session, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["src_04_five_line_records"](spark, str(tmp_path)).select("source_event_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r[0] for r in found) == sorted(f"C{k}" for k in range(400))
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "five-line").glob("part-*")]
    assert len(sizes) > 1 and sum(sizes) == 2400 and all(n % 6 == 0 for n in sizes)
