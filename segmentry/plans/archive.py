"""Plans: playlists from text to items, items to clear bytes, and outcomes to artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.functions import binary
from segmentry.operators import catalog, discovery, master, media, output, selection, syntax, tasks
from segmentry.sources.playlists import byte_ranges
from segmentry.streaming import runs


def archive_items(playlists: DataFrame, start: float | None = None, end: float | None = None) -> DataFrame:
    """Playlist text to numbered items of each track, within a time slice if one is given."""
    items = discovery.items(media.segments(playlists))
    if start is not None and end is not None:
        items = discovery.time_slice(items, start, end)
    return tasks.track_index(items.withColumnRenamed("playlist_id", "track_id"), "item_ord")


def artifacts(outcomes: DataFrame, types: DataFrame) -> DataFrame:
    """``track_id, type, paths``: how many outputs each track's outcomes make.

    Only the contiguous prefix of a track is written.
    """
    made = output.runs(output.contiguous_prefix(outcomes)).groupBy("track_id").agg(
        F.countDistinct("run").alias("paths")
    )
    return types.join(made, "track_id", "left").withColumn("paths", F.coalesce("paths", F.lit(0)))


def planned_tracks(playlists: DataFrame, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The tracks to take of ``playlists`` that a user gives, and why some give none.

    The first has ``playlist_id, place, track_id, type, url``, the second ``playlist_id,
    fault``. A media playlist is a track of its own. Of a master the tracks are those of
    the caller's selection (rows as in ``operators.selection``), or without any caller
    those of the default option. A master with a faulty line gives no track. Variants and
    renditions are written as tables, as several joins read them.
    """
    is_master = syntax.is_master(F.col("content"))
    masters, direct = playlists.where(is_master), playlists.where(~is_master)
    variants = runs.written(master.variants(masters), "variants")
    renditions = runs.written(master.audio_renditions(masters), "renditions")
    lines = [x.where("error IS NOT NULL").select("playlist_id", F.col("error").alias("fault")) for x in (variants, renditions)]
    bad = lines[0].unionByName(lines[1]).groupBy("playlist_id").agg(F.min("fault").alias("fault"))
    variants = variants.join(bad, "playlist_id", "left_anti")
    renditions = renditions.join(bad, "playlist_id", "left_anti")
    if selected is None:
        taken, faults = selection.default(variants, renditions), bad
    else:
        taken = selection.chosen(variants, renditions, selected)
        faults = bad.unionByName(selection.faults(variants, renditions, selected).where("fault IS NOT NULL"))
    own = catalog.direct_tracks(direct).withColumn("place", F.lit(0).cast("long"))
    return taken.unionByName(own), faults


def track_faults(tracks: DataFrame, media_playlists: DataFrame) -> DataFrame:
    """``playlist_id, track_id, fault`` of tracks whose playlist is missing or no media."""
    found = media_playlists.select(F.col("playlist_url").alias("url"), syntax.is_master(F.col("content")).alias("master"))
    fault = F.when(F.col("master").isNull(), "a track's playlist is missing").when(F.col("master"), "a track is another master playlist")
    return tracks.join(found, "url", "left").select("playlist_id", "track_id", fault.alias("fault")).where("fault IS NOT NULL")


def archive_of(
    tracks: DataFrame, media_playlists: DataFrame, start: float | None = None, end: float | None = None
) -> DataFrame:
    """``playlist_id, place, track_id`` and the numbered items of each of ``tracks``, all in one plan.

    ``media_playlists`` have been fetched; those of the tracks are found by URL. Tracks
    that :func:`track_faults` names have no items. The texts of the tracks are written as a
    table, as the plan of their segments reads them several times.
    """
    known = media_playlists.where(~syntax.is_master(F.col("content")))
    found = tracks.join(known.select(F.col("playlist_url").alias("url"), "content"), "url").select(
        F.struct("playlist_id", "place", "track_id").alias("playlist_id"), F.col("url").alias("playlist_url"), "content"
    )
    items = archive_items(runs.written(found, "tracks"), start, end)
    return items.select("track_id.*", *(f"`{c}`" for c in items.columns if c != "track_id"))


def default_archive(masters: DataFrame, media_playlists: DataFrame) -> DataFrame:
    """Masters to the items of the tracks of their default option; faulty lines are left out."""
    variants_ = master.variants(masters).where("error IS NULL")
    renditions = master.audio_renditions(masters).where("error IS NULL")
    return archive_of(selection.default(variants_, renditions), media_playlists)


def decrypted_items(items: DataFrame, files: DataFrame, held: DataFrame) -> DataFrame:
    """Items with ``clear``, their bytes after decryption, or a ``fault``: range, then key,
    then cipher. Items without encryption are clear as they are."""
    fetched = byte_ranges(items, files).withColumnRenamed("fault", "range_fault")
    keyed = discovery.key_lookup(fetched, held)
    sealed = F.col("encryption").isNotNull()
    opened = binary.cbc_decrypt(
        F.col("data"), F.unhex("key"), binary.initial_vector(F.col("encryption.iv"))
    )
    return keyed.withColumn("fault", F.coalesce("range_fault", "fault")).withColumn(
        "clear", F.when(F.col("fault").isNull(), F.when(sealed, opened).otherwise(F.col("data")))
    )
