"""Text catalogs as DataFrames of lines or string columns, turned into validated observations.

Each format is a function of a DataFrame, so it works on files, on a table of landed lines and on a
stream alike; the `read_*` functions only open the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremora.operators.normalize import to_observations
from tremora.schema import COMMA24_PLACES, COMMA24_TEXT, NATIVE


# A cast alone would also read suffixed literals such as 5.0d.
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _text(c: Column) -> Column:
    """Trimmed text, empty becoming NULL."""
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def _number(c: Column) -> Column:
    text = _text(c)
    return F.when(text.rlike(_DECIMAL), text).try_cast("double")


def _zero_filled(c: Column, width: int) -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


# --- pipe-delimited event text ----------------------------------------------------------------------


def pipe_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Native rows from `a|b|...` lines: comments, blanks and lines with fewer than 13 fields are skipped."""
    text = F.trim(F.col(line))
    fields = lines.filter((text != "") & ~text.startswith("#")).select(F.split(text, r"\|").alias("f")).filter(F.size("f") >= 13)
    picked = []
    for position, field in enumerate(NATIVE.fields):
        value = F.col("f")[position]
        if field.name in ("event_id", "time"):
            value = F.trim(value)
        else:
            value = _number(value) if field.dataType.typeName() == "double" else _text(value)
        picked.append(value.alias(field.name))
    return fields.select(*picked)


def native_observations(native: DataFrame, source: str) -> DataFrame:
    """Observations of one source; rows without coordinates or a readable time are dropped."""
    placed = native.filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    return to_observations(placed.select(
        F.lit(source).alias("source"), F.col("event_id").alias("source_event_id"),
        F.try_to_timestamp("time").alias("origin_time"), "latitude", "longitude", "depth_km", "magnitude",
        F.col("mag_type").alias("magnitude_type"), "author", "catalog", "contributor", "place",
    ))


def read_pipe(spark: SparkSession, path: str, source: str) -> DataFrame:
    return native_observations(pipe_events(spark.read.text(path)), source)


# --- semicolon table --------------------------------------------------------------------------------


def semicolon_observations(table: DataFrame) -> DataFrame:
    """Observations from a table of text columns; header names are matched trimmed and upper-cased."""
    table = table.toDF(*[c.strip().upper() for c in table.columns])
    day = _zero_filled(F.trim("FECHA_UTC"), 8)
    clock = _zero_filled(F.regexp_replace(F.trim("HORA_UTC"), r"\.0$", ""), 6)
    return to_observations(table.select(
        F.lit("igp").alias("source"), F.col("ID").alias("source_event_id"),
        F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss")).alias("origin_time"),
        _number(F.col("LATITUD")).alias("latitude"), _number(F.col("LONGITUD")).alias("longitude"),
        _number(F.col("PROFUNDIDAD")).alias("depth_km"), _number(F.col("MAGNITUD")).alias("magnitude"),
        F.lit(None).cast("string").alias("magnitude_type"), F.lit("IGP").alias("author"), F.lit("IGP-CENSIS").alias("catalog"),
    ).filter("latitude IS NOT NULL AND longitude IS NOT NULL"))


def read_semicolon(spark: SparkSession, path: str) -> DataFrame:
    # Without inferSchema every column arrives as text.
    return semicolon_observations(spark.read.option("sep", ";").option("header", True).csv(path))


# --- comma table without header ---------------------------------------------------------------------


def comma24_observations(table: DataFrame) -> DataFrame:
    """Observations from the 24 positional text columns; all magnitudes are Mw."""
    at = lambda field: F.col(COMMA24_TEXT.names[COMMA24_PLACES[field]])
    return to_observations(table.select(
        F.lit("iscgem").alias("source"), F.trim(at("id")).alias("source_event_id"), F.try_to_timestamp(F.trim(at("time"))).alias("origin_time"),
        _number(at("latitude")).alias("latitude"), _number(at("longitude")).alias("longitude"), _number(at("depth")).alias("depth_km"),
        _number(at("magnitude")).alias("magnitude"), F.lit("Mw").alias("magnitude_type"),
        F.coalesce(_text(at("agency")), F.lit("ISC-GEM")).alias("author"), F.lit("ISC-GEM").alias("catalog"),
    ).filter("latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude IS NOT NULL"))


def read_comma24(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.schema(COMMA24_TEXT).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path)
    return comma24_observations(table)


# --- five-line moment-tensor records ----------------------------------------------------------------


def number_lines(lines: DataFrame, file: str = "file", block: str = "block", at: str = "at", line: str = "value") -> DataFrame:
    """(file, n, value): lines counted from 0 in file order, blank ones left out.

    `block` orders the splits of a file and `at` the lines inside one. Lines are counted per split and
    shifted by the split sizes before it, so one large file is still read by many tasks.
    """
    filled = lines.filter(F.trim(line) != "")
    sizes = filled.groupBy(file, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(file, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(file, block).orderBy(at)) - 1
    return filled.withColumn("_k", inside).join(shifts, [file, block]).select(
        F.col(file).alias("file"), (F.col("_k") + F.col("_shift")).alias("n"), F.col(line).alias("value")
    )


def moment_magnitude(line4: Column, line5: Column) -> Column:
    """Mw from the exponent (first token) and the scalar moment (eleventh token), NULL unless positive."""
    token = lambda l, k: F.try_element_at(F.split(F.trim(l), r"\s+"), F.lit(k + 1))
    exponent = F.when(token(line4, 0).rlike(r"^[+-]?\d+$"), token(line4, 0)).try_cast("int")
    mantissa = _number(token(line5, 10))
    positive = F.when(mantissa > 0, mantissa)
    return F.bround(F.lit(2.0 / 3.0) * (F.log10(positive) + exponent - F.lit(16.1)), 2)


def five_line_observations(numbered: DataFrame) -> DataFrame:
    """Observations from complete five-line records; unreadable records are dropped."""
    record = F.floor(F.col("n") / 5).cast("long")
    rows = numbered.groupBy("file", record.alias("record")).agg(
        *[F.max(F.when(F.col("n") % 5 == k, F.col("value"))).alias(f"l{k + 1}") for k in range(5)]
    ).filter("l5 IS NOT NULL")
    first = F.split(F.trim("l1"), r"\s+")
    token = lambda k: F.try_element_at(first, F.lit(k + 1))
    name = F.coalesce(_text(F.split(F.trim("l2"), r"\s+")[0]), F.concat(F.lit("gcmt_"), (F.col("record") * 5).cast("string")))
    return to_observations(rows.filter(F.size(first) >= 6).select(
        F.lit("gcmt").alias("source"), name.alias("source_event_id"),
        F.try_to_timestamp(F.concat_ws(" ", F.translate(token(1), "/", "-"), token(2))).alias("origin_time"),
        _number(token(3)).alias("latitude"), _number(token(4)).alias("longitude"),
        _number(token(5)).alias("depth_km"), moment_magnitude(F.col("l4"), F.col("l5")).alias("magnitude"),
        F.lit("Mw").alias("magnitude_type"), F.lit("GCMT").alias("author"), F.lit("GCMT").alias("catalog"), _number(token(5)).alias("_depth"),
    ).filter("latitude IS NOT NULL AND longitude IS NOT NULL AND _depth IS NOT NULL AND magnitude IS NOT NULL").drop("_depth"))


def read_five_line(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    return five_line_observations(number_lines(lines))
