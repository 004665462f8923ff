"""Follow mode: refreshes of live playlists to new items, as two streams.

The first parses each batch of refreshes with the operators for whole playlists, and
writes it under the batch's number, so a batch that is repeated replaces itself. The
second keeps what a track must remember and emits its new items and how it ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.operators import discovery, media
from segmentry.streaming import live

#: A row for each item of a refresh, and one without an item for a refresh that has none.
PARSED = (
    "track_id string, refresh long, status int, has_end_list boolean, fault string, sealed string,"
    " item_ord long, kind string, identity string, sequence_id long, url string"
)


def parsed_refreshes(fetched: DataFrame, explicit: Sequence[str] = ()) -> DataFrame:
    """``PARSED`` rows of refreshes ``track_id, refresh, status, playlist_url, content``.

    ``fault`` is what is wrong with the text, ``sealed`` why a SAMPLE-AES segment cannot be
    opened with the ``explicit`` keys. A repeated refresh counts once.
    """
    once = fetched.dropDuplicates(["track_id", "refresh"])
    playlists = once.select(F.struct("track_id", "refresh").alias("playlist_id"), "playlist_url", "content")
    keys = F.array(*map(F.lit, explicit)).cast("array<string>")
    method = F.when(F.col("encryption.scheme") == "mpeg-ts-sample-aes", "SAMPLE-AES")
    found = discovery.identity(discovery.items(media.segments(playlists))).select(
        "playlist_id", discovery.sample_aes_fault(method, keys).alias("sealed"),
        F.col("item_ord").cast("long"), "kind", "identity", F.col("sequence_id").cast("long"), "url",
    )
    faults = media.errors(playlists).select("playlist_id", F.col("error").alias("fault"))
    return (
        once.select(
            F.struct("track_id", "refresh").alias("playlist_id"), F.col("status").cast("int"), media.has_end_list(F.col("content")).alias("has_end_list")
        )
        .join(faults, "playlist_id", "left")
        .join(found, "playlist_id", "left")
        .select("playlist_id.*", "status", "has_end_list", "fault", "sealed", "item_ord", "kind", "identity", "sequence_id", "url")
    )


def write_parsed(folder: str, explicit: Sequence[str] = ()):
    """For ``foreachBatch``: a batch of refreshes as ``folder/batch-<number>``."""

    def each(fetched: DataFrame, number: int) -> None:
        parsed_refreshes(fetched, explicit).write.mode("overwrite").parquet(f"{folder}/batch-{number}")

    return each


def followed(parsed: DataFrame) -> DataFrame:
    """``live.FOLLOWED`` rows of a stream of ``PARSED`` rows."""
    return parsed.groupBy("track_id").transformWithStateInPandas(live.Follow(), live.FOLLOWED, "Append", "None")
