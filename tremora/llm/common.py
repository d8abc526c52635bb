"""Helpers shared by the training-data operators: words, tables in the shared folder, batches of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.session import configure, scratch_path

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
#: `bytes.split()` splits at exactly these six, so tasks work on UTF-8 bytes and never decode a text to find words.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = 500
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """`df` written to a fresh table in the shared folder and read back: lineage ends there, executors may be lost.

    Writer and reader hold a row group at once; `group_rows` bounds its rows where these are megabytes long.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(group_rows))
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(docs: DataFrame) -> DataFrame:
    """Texts go to Python a few hundred at a time: batches of the usual number of rows would hold very long texts by the thousand."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def identified(docs: DataFrame, *more: str | Column) -> DataFrame:
    """(doc_id long, text as UTF-8 bytes, more): all that crosses to Python, whatever else the table holds."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def word_count(text: Column) -> Column:
    """Number of words, on the JVM; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
