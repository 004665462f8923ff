"""A caller's selection of tracks as rows, and the tracks that are taken.

A selection is ``playlist_id, place, track_id``: a row for each selected track, ``place``
being its place in the selection, a whole number that is unique in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.operators import catalog

EMPTY = "nothing is selected"
FOREIGN = "a track is not offered"
TWICE = "a track is selected twice"
CROSSING = "no option has all selected tracks"


def _met(variants: DataFrame, renditions: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected tracks with what is offered under their ids, ``nth`` being 1 at the
    first time a track is selected and 2 at the second; further ones are no news."""
    again = Window.partitionBy("playlist_id", "track_id").orderBy("place")
    told = selected.select("playlist_id", "place", "track_id", F.row_number().over(again).alias("nth")).where("nth <= 2")
    return told.join(catalog.offered(variants, renditions), ["playlist_id", "track_id"], "left")


def faults(variants: DataFrame, renditions: DataFrame, selected: DataFrame) -> DataFrame:
    """``playlist_id, fault`` of every playlist with variants; null where the selection is sound.

    The first track of a selection that is not offered, or was selected before, tells the
    fault. Whether some option has all tracks is a division by counts: an option has the
    selected tracks that are its own, and as many as are selected of its audio group, and
    some option must have as many as are selected. Groups are counted once and joined with
    the options that name them, so no row is made for a track of an option. Selected
    tracks of playlists without variants are left out.
    """
    met = _met(variants, renditions, selected)
    told = F.when(F.col("type").isNull(), FOREIGN).when(F.col("nth") > 1, TWICE)
    sums = met.groupBy("playlist_id").agg(
        F.count_if(F.col("nth") == 1).alias("total"), F.min_by(told, F.when(told.isNotNull(), F.col("place"))).alias("told")
    )
    distinct = met.where("nth = 1 AND type IS NOT NULL")
    own = distinct.where("rendition_index < 0").groupBy("playlist_id", F.col("variant_index").alias("option_index")).agg(F.count(F.lit(1)).alias("own"))
    shared = distinct.where("rendition_index >= 0").groupBy("playlist_id", "audio_group_id").agg(F.count(F.lit(1)).alias("shared"))
    held = F.coalesce("own", F.lit(0)) + F.coalesce("shared", F.lit(0))
    most = (
        catalog.own_options(variants)
        .join(own, ["playlist_id", "option_index"], "left")
        .join(shared, ["playlist_id", "audio_group_id"], "left")
        .groupBy("playlist_id")
        .agg(F.max(held).alias("most"))
    )
    fault = F.when(F.coalesce("total", F.lit(0)) == 0, EMPTY).when(F.col("told").isNotNull(), F.col("told")).when(F.col("most") < F.col("total"), CROSSING)
    return most.join(sums, "playlist_id", "left").select("playlist_id", fault.alias("fault"))


def chosen(variants: DataFrame, renditions: DataFrame, selected: DataFrame) -> DataFrame:
    """``playlist_id, place, track_id, type, url`` of the sound selections, in their order."""
    sound = faults(variants, renditions, selected).where("fault IS NULL").select("playlist_id")
    found = selected.join(catalog.offered(variants, renditions), ["playlist_id", "track_id"])
    return found.join(sound, "playlist_id").select("playlist_id", F.col("place").cast("long"), "track_id", "type", "url")


def default(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """``playlist_id, place, track_id, type, url`` of the default option of each playlist.

    Only the option that is chosen is joined with the tracks of its group.
    """
    best = catalog.default_option(catalog.own_options(variants))
    own = best.select("playlist_id", F.lit(0).cast("long").alias("place"), F.element_at("track_ids", 1).alias("track_id"), "type", "url")
    at = Window.partitionBy("playlist_id").orderBy("rendition_index")
    audio = catalog.external_tracks(renditions).join(best.select("playlist_id", "audio_group_id"), ["playlist_id", "audio_group_id"])
    return own.unionByName(audio.select("playlist_id", F.row_number().over(at).cast("long").alias("place"), "track_id", "type", "url"))
