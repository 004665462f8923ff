"""Discovery: segments to download items, time slices, unseen items, keys, sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions.binary import inline_key
from segmentry.operators import spans


def effective_iv(kind: Column, iv: Column, sequence_id: Column) -> Column:
    """A media segment without an IV has the hex digits of its sequence number."""
    return F.coalesce(iv, F.when(kind == "media", F.lower(F.hex(sequence_id.cast("long")))))


def items(segments: DataFrame) -> DataFrame:
    """What a download needs of a segment."""
    method = F.col("encryption.method")
    return segments.select(
        "playlist_id",
        F.col("seg_ord").alias("item_ord"),
        "kind",
        "url",
        "duration",
        "sequence_id",
        "byte_range",
        F.when(
            F.col("encryption").isNotNull(),
            F.struct(
                F.when(method == "AES-128", F.lit("aes-128-cbc")).otherwise(F.lit("mpeg-ts-sample-aes")).alias("scheme"),
                F.col("encryption.key_id").alias("key_id"),
                effective_iv(F.col("kind"), F.col("encryption.iv"), F.col("sequence_id")).alias("iv"),
            ),
        ).alias("encryption"),
    )


def running_time(rows: DataFrame, track: str = "playlist_id", order: str = "item_ord") -> DataFrame:
    """Add ``start_time`` and ``end_time``; initialization takes no time.

    Times are sums of decimals of six places, so they do not depend on the order in
    which a plan adds them, nor on the spans in which a track is added up.
    """
    played = F.when(F.col("kind") == "media", F.col("duration").cast("decimal(20,6)")).otherwise(0)
    timed = spans.before(rows, [track], order, sums={"start_time": played})
    return timed.withColumn("end_time", F.col("start_time") + F.coalesce(played, F.lit(0)))


def time_slice(rows: DataFrame, start: float, end: float, track: str = "playlist_id", order: str = "item_ord") -> DataFrame:
    """Media that overlaps [start, end), and initialization until the clock is at ``end``."""
    overlaps = (F.col("end_time") > F.lit(start)) & (F.col("start_time") < F.lit(end))
    return running_time(rows, track, order).where(
        F.when(F.col("kind") == "media", overlaps).otherwise(F.col("start_time") < F.lit(end))
    )


def identity(rows: DataFrame) -> DataFrame:
    """Add ``identity``: media by sequence number, initialization by resource and range."""
    init = F.to_json(F.struct("url", "byte_range.offset", "byte_range.length"))
    return rows.withColumn(
        "identity", F.when(F.col("kind") == "media", F.col("sequence_id").cast("string")).otherwise(init)
    )


def unseen(found: DataFrame, seen: DataFrame, order: str = "item_ord") -> DataFrame:
    """Items of ``found`` not in ``seen``, each once: that of least order.

    Both have ``track_id, kind, identity``.
    """
    names = ["track_id", "kind", "identity"]
    rest = [c for c in found.columns if c not in names]
    first = F.min_by(F.struct(*rest), F.col(order))
    return (
        found.join(seen.select(names).distinct(), names, "left_anti")
        .groupBy(names)
        .agg(first.alias("item"))
        .select(*names, "item.*")
    )


def missing_keys(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Keys of ``wanted`` whose id is not held."""
    return wanted.join(held.select("id"), "id", "left_anti")


def upsert_keys(held: DataFrame, more: DataFrame) -> DataFrame:
    """``id, key, version``: the last version of every id."""
    latest = F.max_by(F.struct("key", "version"), F.col("version"))
    return held.unionByName(more).groupBy("id").agg(latest.alias("last")).select("id", "last.*")


def key_lookup(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Items with their ``key``, and why one cannot be used: ``fault`` or null."""
    keys = held.select(F.col("id").alias("key_id"), F.col("key"))
    scheme, iv = F.col("encryption.scheme"), F.col("encryption.iv")
    fault = (
        F.when(F.col("encryption").isNull(), None)
        .when(F.col("key").isNull(), "a key is not registered")
        .when(~scheme.isin("aes-128-cbc", "mpeg-ts-sample-aes"), "a scheme is not supported")
        .when(~F.col("key").rlike("^[0-9a-fA-F]{32}$"), "a key is not 32 hex digits")
        .when(~F.coalesce(iv.rlike("^[0-9a-fA-F]{1,32}$"), F.lit(False)), "an IV is not 1 to 32 hex digits")
    )
    return (
        rows.withColumn("key_id", F.col("encryption.key_id"))
        .join(keys, "key_id", "left")
        .withColumn("fault", fault)
    )


def without_ads(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("url").contains("/tspgsl/") & ~F.col("url").contains("/tsad/"))


def site_of(first_key: Column, source_path: Column, mode: Column) -> Column:
    """Which site rule applies; the key rules come first, and only they see keys."""
    archive = mode == "archive"
    keyed = (
        F.when(first_key.startswith("abematv-license"), "abema")
        .when(archive & source_path.contains("d22puzix29w08m"), "hibiki")
        .otherwise("common")
    )
    clear = (
        F.when(source_path.contains("googlevideo"), "youtube")
        .when(archive & source_path.contains("bcovlive"), "stagecrowd")
        .otherwise("common")
    )
    return F.when(first_key.isNotNull(), keyed).otherwise(clear)


def external_keys_without_explicit(keys: DataFrame, explicit: int) -> DataFrame:
    """Playlists that cannot start: an external key needs one explicit key."""
    return keys.groupBy("playlist_id").agg(
        F.when(F.lit(explicit > 1), "more than one explicit key")
        .when(F.bool_or(F.col("key_kind") == "external") & F.lit(explicit == 0), "an external key needs an explicit one")
        .alias("fault")
    )


def resolved_keys(keys: DataFrame, files: DataFrame, explicit: Sequence[str] = ()) -> DataFrame:
    """``keys`` with ``key``, its bytes in hex, and ``fault``, why there is none.

    ``keys``: ``playlist_id, id, key_kind``, an id being an absolute URI, and any other
    columns; ``files``: ``url, content``, the fetched ones. One explicit key is the key of
    every id, more are a fault. An external key without one is a fault of all keys of its
    playlist, of which none is then looked for.
    """
    if explicit:
        one = F.lit(explicit[0] if len(explicit) == 1 else None).cast("string")
        return keys.withColumns({"key": one, "fault": F.when(one.isNull(), "more than one explicit key")})
    batches = external_keys_without_explicit(keys, 0)
    met = keys.join(batches.withColumnRenamed("fault", "batch_fault"), "playlist_id")
    fetched = F.when(F.col("batch_fault").isNull() & (F.col("key_kind") == "http"), F.col("id"))
    found = met.join(files.select(F.col("url").alias("file_url"), F.col("content").alias("file")), fetched == F.col("file_url"), "left")
    bytes_ = F.when(F.col("key_kind") == "http", F.lower(F.hex("file"))).otherwise(inline_key(F.col("id")))
    key = F.when(F.col("batch_fault").isNull(), bytes_)
    fault = F.coalesce("batch_fault", F.when(key.isNull(), "a key cannot be fetched"))
    return found.withColumns({"key": key, "fault": fault}).drop("batch_fault", "file_url", "file")


def sound_average(average: Column) -> Column:
    """The average segment of a playlist; five seconds where it is no positive number."""
    return F.when(F.isnan(average) | average.isNull() | (average <= 0), 5.0).otherwise(average)


def refresh_seconds(segments: Column, average: Column) -> Column:
    """20 to 60 seconds, by the playlist's length."""
    return F.least(F.greatest(segments * sound_average(average), F.lit(20.0)), F.lit(60.0))


def poll_seconds(average: Column) -> Column:
    return F.least(F.lit(5.0), sound_average(average))


def item_seconds(average: Column) -> Column:
    """Twenty times the average, at most a minute."""
    return F.least(20 * sound_average(average), F.lit(60.0))


def sample_aes_fault(method: Column, explicit: Column) -> Column:
    """Why a SAMPLE-AES segment cannot be opened: there must be exactly one explicit key, of
    32 hex digits. ``explicit`` is an array of the explicit keys' texts."""
    sound = F.element_at(explicit, 1).rlike("^[0-9a-fA-F]{32}$")
    return F.when(
        method == "SAMPLE-AES",
        F.when(F.size(explicit) != 1, "SAMPLE-AES needs exactly one explicit key").when(
            ~sound, "a SAMPLE-AES key is not 32 hex digits"
        ),
    )


def sample_aes_faults(segments: DataFrame, explicit: Column) -> DataFrame:
    """``playlist_id, fault`` of playlists with such segments.

    ``segments`` have ``playlist_id`` and ``encryption``. After each refresh of a live
    playlist this holds anew.
    """
    fault = sample_aes_fault(F.col("encryption.method"), explicit)
    return segments.select("playlist_id", fault.alias("fault")).where("fault IS NOT NULL").distinct()


def attempt_seconds(attempt: Column, timeout: Column) -> Column:
    return F.least(attempt * timeout, 5 * timeout)
