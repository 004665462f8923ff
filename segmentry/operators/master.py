"""Master playlists: variants and audio renditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.functions.text import attributes, parse_int, tag_body, whole_number
from segmentry.functions.urls import resolve
from segmentry.operators.syntax import lines


def _value(name: str) -> Column:
    """Attribute of that name; an empty one counts as absent."""
    return F.nullif(F.try_element_at("a", F.lit(name)), F.lit(""))


def variants(playlists: DataFrame) -> DataFrame:
    """Stream tags with the next URI, which two tags in a row share."""
    order = Window.partitionBy("playlist_id").orderBy("line_no")
    next_uri = F.first(F.when(~F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(
        order.rowsBetween(1, Window.unboundedFollowing)
    )
    size = _value("RESOLUTION")
    sized = size.contains("x")
    return (
        lines(playlists)
        .withColumn("uri", next_uri)
        .where(F.col("line").startswith("#EXT-X-STREAM-INF"))
        .withColumn("a", attributes(tag_body(F.col("line"))))
        .select(
            "playlist_id",
            (F.row_number().over(order) - 1).alias("variant_index"),
            resolve(F.col("playlist_url"), F.col("uri")).alias("url"),
            whole_number(_value("BANDWIDTH")).alias("bandwidth"),
            _value("CODECS").alias("codecs"),
            whole_number(_value("FRAME-RATE")).alias("frame_rate"),
            F.when(sized, parse_int(F.split_part(size, F.lit("x"), F.lit(1)))).alias("width"),
            F.when(sized, parse_int(F.split_part(size, F.lit("x"), F.lit(2)))).alias("height"),
            _value("AUDIO").alias("audio_group_id"),
            F.when(F.col("uri").isNull(), "a stream has no URI")
            .when(_value("BANDWIDTH").isNull(), "a stream has no bandwidth")
            .when(resolve(F.col("playlist_url"), F.col("uri")).isNull(), "a URI cannot be resolved")
            .alias("error"),
        )
    )


def audio_renditions(playlists: DataFrame) -> DataFrame:
    """Media tags of type AUDIO, numbered over the playlist."""
    order = Window.partitionBy("playlist_id").orderBy("line_no")
    uri = _value("URI")
    return (
        lines(playlists)
        .where(F.col("line").startswith("#EXT-X-MEDIA:"))
        .withColumn("a", attributes(tag_body(F.col("line"))))
        .where(_value("TYPE") == "AUDIO")
        .select(
            "playlist_id",
            (F.row_number().over(order) - 1).alias("rendition_index"),
            _value("GROUP-ID").alias("group_id"),
            _value("NAME").alias("name"),
            F.when(uri.isNotNull(), resolve(F.col("playlist_url"), uri)).alias("url"),
            _value("LANGUAGE").alias("language"),
            _value("CHARACTERISTICS").alias("characteristics"),
            parse_int(F.split_part(_value("CHANNELS"), F.lit("/"), F.lit(1))).alias("channels"),
            F.coalesce(_value("DEFAULT") == "YES", F.lit(False)).alias("is_default"),
            F.coalesce(_value("AUTOSELECT") == "YES", F.lit(False)).alias("auto_select"),
            F.when(_value("GROUP-ID").isNull() | _value("NAME").isNull(), "a rendition has no group or name").alias("error"),
        )
    )


def missing_groups(variants_: DataFrame, renditions: DataFrame) -> DataFrame:
    """Variants whose audio group no rendition has."""
    groups = renditions.select("playlist_id", F.col("group_id").alias("audio_group_id")).distinct()
    return variants_.where("audio_group_id IS NOT NULL").join(groups, ["playlist_id", "audio_group_id"], "left_anti")
