"""Source formats parsed from text that Spark writes from the tables, landing windows, and sinks read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremora.checks import sql as S
from tremora.checks.catalog_queries import linked_observations
from tremora.checks.registry import query, rounded
from tremora.fixed import DAY_US, STUDY_BOX
from tremora.operators import canonical
from tremora.plans.driver_tables import observations, reports, table
from tremora.session import scratch_path
from tremora.sinks import tables as sinks
from tremora.sources import landing, text_catalogs

def _ts():
    return F.timestamp_micros("t_us")


def _s(c):
    return F.col(c).cast("string")


def _pipe_lines(spark, sf):
    fields = [
        _s("event_id"), F.date_format(_ts(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), _s("latitude"), _s("longitude"), _s("depth_raw"), F.lit(" us "), F.lit(""), F.lit("net"), F.lit(""),
        F.coalesce(F.col("magnitude_type"), F.lit("")), _s("magnitude"), F.lit(""), F.lit("near the coast"),
    ]
    line = F.concat_ws("|", *fields)
    # Each record comes with a comment, a blank line, a short line and, for some, a fourteenth field.
    lines = F.array(F.lit("#EventID|Time"), F.lit("   "), F.lit("1|2|3"), F.when(F.col("magnitude") >= 4.5, F.concat(line, F.lit("|earthquake"))).otherwise(line))
    return reports(spark, sf).select(F.explode(lines).alias("value"))


@query("src_01_pipe_text", f"WITH {S.reports()} SELECT event_id::VARCHAR AS event_id, latitude, longitude, depth_raw AS depth_km, 'us' AS author, NULL::VARCHAR AS catalog, 'net' AS contributor, magnitude_type AS mag_type, magnitude, 'near the coast' AS place FROM reports")
def _(spark, sf):
    return text_catalogs.pipe_events(_pipe_lines(spark, sf)).select("event_id", "latitude", "longitude", "depth_km", "author", "catalog", "contributor", "mag_type", "magnitude", "place")


@query("src_02_native_observations", f"WITH {S.reports()} SELECT event_id::VARCHAR AS source_event_id, t_us, latitude, longitude, {S.DEPTH} AS depth_km, magnitude, round({S.mw()}, 8) AS mw, {S.mw_method()} AS mw_method, {S.COUNTRY} AS country FROM reports")
def _(spark, sf):
    path = scratch_path(spark, "pipe")
    _pipe_lines(spark, sf).write.text(path)
    o = text_catalogs.read_pipe(spark, path, "usgs")
    return o.select("source_event_id", F.unix_micros("origin_time").alias("t_us"), "latitude", "longitude", "depth_km", "magnitude", F.round("mw", 8).alias("mw"), "mw_method", "country")


@query("src_03_semicolon_table", f"WITH {S.reports()} SELECT event_id::VARCHAR AS source_event_id, t_us // 1000000 * 1000000 AS t_us, latitude, longitude, {S.DEPTH} AS depth_km, magnitude AS mw, 'assume_unknown' AS mw_method FROM reports")
def _(spark, sf):
    clock = F.concat(F.date_format(_ts(), "HHmmss").cast("int").cast("string"), F.lit(".0"))  # unpadded, as published
    text = reports(spark, sf).select(
        _s("event_id").alias(" id "), F.date_format(_ts(), "yyyyMMdd").alias("fecha_utc"), clock.alias("HORA_UTC"), _s("latitude").alias("Latitud"),
        _s("longitude").alias("LONGITUD"), _s("depth_raw").alias("PROFUNDIDAD"), _s("magnitude").alias("MAGNITUD"),
    )
    path = scratch_path(spark, "semicolon")
    text.write.option("sep", ";").option("header", True).csv(path)
    o = text_catalogs.read_semicolon(spark, path)
    return o.select("source_event_id", F.unix_micros("origin_time").alias("t_us"), "latitude", "longitude", "depth_km", "mw", "mw_method")


_MW5 = "round_even((2.0::DOUBLE / 3.0::DOUBLE) * (log10(value + 0.01::DOUBLE) + (23 + event_id % 3) - 16.1::DOUBLE), 2)"


_RECORDS = 100_000  # five-line records of one task


def _moment_lines(spark, sf):
    value = table(spark, sf, "events").select("event_id", "event_type", "value")
    e = reports(spark, sf).join(value, "event_id")
    mantissa = (F.col("value") + F.lit(0.01)).cast("string")
    return e.select(
        "event_id", "event_type",
        F.concat_ws(" ", F.lit("PDE"), F.date_format(_ts(), "yyyy/MM/dd"), F.date_format(_ts(), "HH:mm:ss.S"), _s("latitude"), _s("longitude"), _s("depth_raw"), F.lit("0.0 0.0 SOMEWHERE")).alias("l1"),
        F.concat(F.lit("C"), _s("event_id"), F.lit("   B: 4 4 27")).alias("l2"), F.lit("CENTROID: 1.1").alias("l3"),
        F.concat((F.lit(23) + F.col("event_id") % 3).cast("string"), F.lit("  1.0 0.1 2.0 0.1")).alias("l4"),
        F.concat(F.lit("V10   1.0 20 110  2.0 30 120  3.0 40 130 "), mantissa, F.lit(" 10 20 30")).alias("l5"),
    )


@query("src_04_five_line_records", f"WITH {S.reports()}, e AS (SELECT r.*, value FROM reports r JOIN events USING (event_id)) SELECT 'C' || event_id AS source_event_id, t_us // 100000 * 100000 AS t_us, latitude, longitude, {S.DEPTH} AS depth_km, {_MW5} AS mw, 'direct' AS mw_method FROM e")
def _(spark, sf):
    records = _moment_lines(spark, sf)
    six = F.posexplode(F.array("l1", F.lit("  "), "l2", "l3", "l4", "l5"))
    lines = records.select("event_id", F.col("event_type").alias("file"), six.alias("pos", "value")).withColumn("at", F.col("event_id") * 6 + F.col("pos"))
    # Ranges of events of a type stay together and in order: every file holds whole records, and no task the lines of a whole type.
    path = scratch_path(spark, "five-line")
    parts = table(spark, sf, "events").count() // _RECORDS
    parts = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    lines.repartitionByRange(*parts, "file", "event_id").sortWithinPartitions("file", "at").select("value").write.text(path)
    o = text_catalogs.read_five_line(spark, path)
    return o.select("source_event_id", F.unix_micros("origin_time").alias("t_us"), "latitude", "longitude", "depth_km", "mw", "mw_method")


@query("src_04_split_files", f"WITH {S.reports()}, e AS (SELECT r.*, value FROM reports r JOIN events USING (event_id)) SELECT 'C' || event_id AS source_event_id, {_MW5} AS mw FROM e")
def _(spark, sf):
    lines = _moment_lines(spark, sf).select("event_id", F.col("event_type").alias("file"), F.posexplode(F.array("l1", F.lit("  "), "l2", "l3", "l4", "l5")).alias("pos", "value"))
    # Splits of a file end anywhere, also inside a record.
    at = F.col("event_id") * 6 + F.col("pos")
    split = lines.withColumn("at", at).withColumn("block", F.floor(at / 997).cast("long"))
    return text_catalogs.five_line_observations(text_catalogs.number_lines(split)).select("source_event_id", "mw")


@query("src_05_moment_magnitude", f"SELECT event_id, {_MW5} AS mw FROM events")
def _(spark, sf):
    return _moment_lines(spark, sf).select("event_id", text_catalogs.moment_magnitude(F.col("l4"), F.col("l5")).alias("mw"))


@query("src_06_comma_table", f"WITH {S.reports()} SELECT event_id::VARCHAR AS source_event_id, t_us // 10000 * 10000 AS t_us, latitude, longitude, {S.DEPTH} AS depth_km, magnitude AS mw, 'direct' AS mw_method, CASE WHEN magnitude >= 4.5 THEN 'auth' ELSE 'ISC-GEM' END AS author FROM reports")
def _(spark, sf):
    from tremora.schema import COMMA24_PLACES
    known = {
        "time": F.date_format(_ts(), "yyyy-MM-dd HH:mm:ss.SS"), "latitude": _s("latitude"), "longitude": _s("longitude"), "depth": _s("depth_raw"), "magnitude": _s("magnitude"),
        "agency": F.when(F.col("magnitude") >= 4.5, F.lit("auth")).otherwise(F.lit("  ")), "id": F.concat(F.lit(" "), _s("event_id")),
    }
    placed = {COMMA24_PLACES[name]: text for name, text in known.items()}
    line = F.concat_ws(",", *[placed.get(k, F.lit("0")) for k in range(24)])
    path = scratch_path(spark, "comma")
    reports(spark, sf).select(F.explode(F.array(F.lit("# comment"), line)).alias("value")).write.text(path)
    o = text_catalogs.read_comma24(spark, path)
    return o.select("source_event_id", F.unix_micros("origin_time").alias("t_us"), "latitude", "longitude", "depth_km", "mw", "mw_method", "author")


@query("src_07_optional_file", f"WITH {S.obs()} SELECT source, count(*) AS n FROM obs GROUP BY 1")
def _(spark, sf):
    # The absent file contributes an empty table and the rest continues.
    absent = landing.optional(spark, lambda: text_catalogs.read_comma24(spark, f"{sf}/no-such-catalog.csv"), "comma table")
    both = observations(spark, sf).unionByName(absent, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("src_08_failing_source", f"WITH {S.obs()} SELECT source, count(*) AS n FROM obs WHERE source <> 'isc' GROUP BY 1")
def _(spark, sf):
    o = observations(spark, sf)

    def broken():
        raise OSError("connection reset")

    readers = {"usgs": lambda: o.filter("source = 'usgs'"), "isc": broken, "igp": lambda: o.filter("source = 'igp'")}
    return landing.union_sources(spark, ["usgs", "isc", "igp", "unknown"], readers).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("src_09_parquet_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def _(spark, sf):
    items = table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return rounded(items.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), 2)


_SPAN = (946_684_800_000_000, 946_684_800_000_000 + 3650 * DAY_US)
_L = _SPAN[1] - _SPAN[0]


def _edge(k: str) -> str:
    return f"{_SPAN[0]} + (({k})::HUGEINT * {_L} // (1::HUGEINT << depth))::BIGINT"


@query("src_10_balanced_windows", f"""WITH RECURSIVE {S.cat()}, w AS (SELECT 0::BIGINT AS depth, 0::BIGINT AS slot, {_SPAN[0]}::BIGINT AS from_us, {_SPAN[1]}::BIGINT AS to_us, (SELECT count(*) FROM cat WHERE t_us >= {_SPAN[0]} AND t_us < {_SPAN[1]}) AS n
    UNION ALL SELECT depth, slot, {_edge('slot')}, {_edge('slot + 1')}, (SELECT count(*) FROM cat WHERE t_us >= {_edge('slot')} AND t_us < {_edge('slot + 1')}) FROM (SELECT depth + 1 AS depth, unnest([slot * 2, slot * 2 + 1]) AS slot FROM w WHERE n >= 100 AND depth < 28) x)
    SELECT *, n >= 100 AS truncated FROM w WHERE n < 100 OR depth = 28""")
def _(spark, sf):
    return landing.balanced_windows(reports(spark, sf), *_SPAN, max_rows=100)


@query("src_11_time_chunks", f"WITH {S.cat()}, s AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM cat) SELECT chunk, lo + chunk * 90 * {DAY_US} AS start_us, least(lo + (chunk + 1) * 90 * {DAY_US}, hi) AS end_us FROM (SELECT unnest(range(0, (hi - lo + 90 * {DAY_US} - 1) // (90 * {DAY_US}))) AS chunk, lo, hi FROM s)")
def _(spark, sf):
    first, last = reports(spark, sf).agg(F.min("t_us"), F.max("t_us")).first()
    return landing.time_chunks(spark, first, last, 90)


@query("src_12_last_per_id", f"WITH {S.obs()} SELECT source, source_event_id, CASE WHEN magnitude >= 4.5 THEN 1 ELSE 0 END::BIGINT AS arrival, round(CASE WHEN magnitude >= 4.5 THEN magnitude + 0.1 ELSE magnitude END, 6) AS magnitude FROM obs")
def _(spark, sf):
    o = observations(spark, sf).select("source", "source_event_id", "magnitude", F.lit(0).cast("long").alias("arrival"))
    revised = o.filter("magnitude >= 4.5").select("source", "source_event_id", (F.col("magnitude") + 0.1).alias("magnitude"), F.lit(1).cast("long").alias("arrival"))
    return rounded(landing.last_per_id(o.unionByName(revised)))


# --- sinks ------------------------------------------------------------------------------------------


@query("snk_01_raw_landing", f"WITH {S.obs()} SELECT source, 'b' || year(make_timestamp(t_us)) AS batch_id, count(*) AS n FROM obs GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "raw")
    batches = observations(spark, sf).withColumn("batch_id", F.concat(F.lit("b"), F.year(F.timestamp_micros("t_us"))))
    sinks.land(batches.filter("source = 'igp'"), path)
    sinks.land(batches, path)  # the batches of igp are there already and stay as they are
    return spark.read.parquet(path).groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("n"))


@query("snk_02_manifest", f"WITH {S.obs()} SELECT 'usgs' AS source, 'b1' AS batch_id, count(*) AS n_events, -60.0::DOUBLE AS min_lat, NULL::DOUBLE AS min_magnitude FROM obs WHERE source = 'usgs'")
def _(spark, sf):
    rows = observations(spark, sf).filter("source = 'usgs'")
    row = sinks.manifest(rows, "usgs", "b1", "2000-01-01", "2010-01-01", STUDY_BOX, None, "2024-01-01T00:00:00Z")
    path = scratch_path(spark, "manifest")
    sinks.append_manifest(row, path)
    back = spark.read.text(path).select(F.from_json("value", "source string, batch_id string, n_events bigint, bbox struct<min_lat: double>, min_magnitude double").alias("d"))
    return back.select("d.source", "d.batch_id", "d.n_events", "d.bbox.min_lat", "d.min_magnitude")


@query("snk_03_overwrite", f"WITH {S.obs()} SELECT country, count(*) AS n, round(sum(mw), 4) AS mw_sum FROM obs GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "interim")
    o = observations(spark, sf)
    sinks.overwrite(o.filter("source = 'igp'"), path)
    sinks.overwrite(o, path)
    return rounded(spark.read.parquet(path).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.sum("mw").alias("mw_sum")), 4)


@query("snk_04_upsert", f"""WITH {S.obs()} SELECT source, source_event_id, magnitude, round(CASE WHEN magnitude >= 4.5 THEN NULL ELSE mw END, 8) AS mw, CASE WHEN magnitude >= 4.5 THEN 'revised' ELSE mw_method END AS mw_method, CASE WHEN magnitude >= 4.5 THEN 'X' ELSE country END AS country, NULL::BIGINT AS canonical_id FROM obs WHERE source <> 'igp'
    UNION ALL SELECT source, source_event_id, magnitude + 2, NULL, 'revised', 'X', NULL FROM obs WHERE source = 'igp' AND magnitude >= 4.5""")
def _(spark, sf):
    path = scratch_path(spark, "observations")
    columns = ["source", "source_event_id", "magnitude", "mw", "mw_method", "country"]
    o = observations(spark, sf).select(*columns, F.lit(None).cast("long").alias("canonical_id"))
    sinks.publish(o.filter("source <> 'igp'"), path)
    new = o.filter("magnitude >= 4.5").withColumn("magnitude", F.col("magnitude") + 1).withColumn("mw", F.lit(None).cast("double")).withColumn("mw_method", F.lit("revised")).withColumn("country", F.lit("X"))
    # keys come twice: the row that arrived last counts
    twice = new.withColumn("arrival", F.lit(1)).unionByName(new.withColumns({"magnitude": F.col("magnitude") + 1, "arrival": F.lit(2)}))
    sinks.upsert(twice, path, arrival="arrival")
    return rounded(sinks.current(spark, path), 8)


@query("snk_05_replace_events", f"WITH RECURSIVE {S.events_of_linked()} SELECT preferred_source, mag_source, n_sources, country, count(*) AS n FROM canon GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "events")
    sinks.replace_events(canonical.canonical_events(linked_observations(spark, sf)), path)
    return spark.read.parquet(path).groupBy("preferred_source", "mag_source", "n_sources", "country").agg(F.count(F.lit(1)).alias("n"))


@query("snk_06_bridge", f"WITH RECURSIVE {S.events_of_linked()} SELECT is_preferred, count(*) AS n, count(DISTINCT canonical_id) AS n_events FROM (SELECT canonical_id, rn = 1 AS is_preferred FROM origin) GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "members")
    linked = linked_observations(spark, sf)
    sinks.overwrite(canonical.preferred_members(linked, canonical.canonical_events(linked)), path)
    return spark.read.parquet(path).groupBy("is_preferred").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("canonical_id").alias("n_events"))


@query("snk_07_documents", f"WITH {S.cat()} SELECT country, count(*) AS n, max(preferred_mw) AS max_mw FROM cat GROUP BY 1")
def _(spark, sf):
    from tremora.plans.driver_tables import catalog
    path = scratch_path(spark, "documents")
    stats = catalog(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.max("preferred_mw").alias("max_mw"))
    sinks.write_document(sinks.as_document(stats), path)
    return spark.read.schema("country string, n bigint, max_mw double").json(path)


@query("snk_08_run_summary", f"WITH RECURSIVE {S.events_of_linked()} SELECT 'source:' || source AS metric, count(*) AS n FROM linked GROUP BY 1 UNION ALL SELECT 'observations', count(*) FROM linked UNION ALL SELECT 'events', count(*) FROM canon UNION ALL SELECT 'events:Peru', count(*) FROM canon WHERE country = 'Peru'")
def _(spark, sf):
    linked = linked_observations(spark, sf)
    return sinks.run_summary(linked, canonical.canonical_events(linked))
