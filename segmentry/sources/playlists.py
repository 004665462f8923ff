"""Playlist sources: text files, and byte ranges of binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def playlist_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as playlists without a base URL, so relative URIs do not resolve."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("playlist_id"),
        F.lit(None).cast("string").alias("playlist_url"),
        F.col("value").alias("content"),
    )


def fetched_playlists(rows: DataFrame) -> DataFrame:
    """Playlists that something else has fetched: ``url``, the final one, and ``content``."""
    return rows.select(F.col("url").alias("playlist_id"), F.col("url").alias("playlist_url"), "content")


def byte_ranges(items: DataFrame, files: DataFrame) -> DataFrame:
    """``items`` with ``data``, the asked part of the file of their ``url``, and ``fault``.

    ``files``: ``url, content`` as the ``binaryFile`` source gives them.
    """
    start, size = F.col("byte_range.offset"), F.col("byte_range.length")
    data = F.when(F.col("byte_range").isNull(), F.col("content")).otherwise(
        F.substring("content", (start + 1).cast("int"), size.cast("int"))
    )
    return (
        items.join(files.select("url", "content"), "url", "left")
        .withColumn("data", data)
        .withColumn(
            "fault",
            F.when(F.col("content").isNull(), "a resource is missing").when(
                F.col("byte_range").isNotNull() & (F.octet_length("data") != size), "a range is not whole"
            ),
        )
        .drop("content")
    )


def config_options(rows: DataFrame, schema: str) -> DataFrame:
    """``owner`` and the options of its first valid JSON object by ``priority``."""
    parsed = F.when(F.try_parse_json("text").isNotNull() & F.trim("text").startswith("{"), F.from_json("text", schema))
    return (
        rows.withColumn("options", parsed)
        .groupBy("owner")
        .agg(F.min_by("options", F.when(F.col("options").isNotNull(), F.col("priority"))).alias("options"))
    )
