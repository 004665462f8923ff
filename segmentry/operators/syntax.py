"""Playlist text to lines, and the kind of a playlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions.text import trimmed


def lines(playlists: DataFrame) -> DataFrame:
    """``playlist_id, playlist_url, line_no, line`` of all lines that are not blank.

    Playlists have their text as ``content``, or are rows of ``line_no`` and ``line`` already,
    which no row or task has to hold as a whole.
    """
    if "content" in playlists.columns:
        at = F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")
        playlists = playlists.select("playlist_id", "playlist_url", at)
    return playlists.select("playlist_id", "playlist_url", "line_no", trimmed(F.col("line")).alias("line")).where("line <> ''")


def is_master(content: Column) -> Column:
    """Whether any line of a playlist's text is a stream tag."""
    return F.exists(F.split(content, r"\r?\n"), lambda x: trimmed(x).startswith("#EXT-X-STREAM-INF"))


def playlist_kind(playlists: DataFrame) -> DataFrame:
    """``playlist_id, kind``: master if any line is a stream tag, else media."""
    return playlists.select("playlist_id", F.when(is_master(F.col("content")), F.lit("master")).otherwise(F.lit("media")).alias("kind"))
