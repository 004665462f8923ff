"""Catalogs of tracks and stream options, and the selection of tracks from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.functions.text import kilobits, megabits, number_text

# Codec names of audio, before the first dot.
AUDIO_CODECS = ("mp4a", "ac-3", "ec-3", "opus", "vorbis", "flac", "alac")


# Fixed value: what stands between the details of a track.
DETAIL = " · "

# Renditions of one group that are one row of a join.
BLOCK = 64
# Places of variants, and of renditions, that are one row of a join, if they are of one group.
TILE = 1024
# Parts that the renditions of a group are joined in, so a large group is not one task.
COPIES = 8


def codec_list(codecs: Column) -> Column:
    return F.transform(F.split(codecs, ","), lambda c: F.trim(c))


def audio_only(codecs: Column, width: Column) -> Column:
    """No resolution, and only audio codecs of which there is at least one."""
    prefix = F.forall(codec_list(codecs), lambda c: F.split_part(F.lower(c), F.lit("."), F.lit(1)).isin(*AUDIO_CODECS))
    return width.isNull() & codecs.isNotNull() & F.coalesce(prefix, F.lit(False))


def primary_tracks(variants: DataFrame) -> DataFrame:
    """One track for each variant: audio if nothing else is in it, else video."""
    audio = audio_only(F.col("codecs"), F.col("width"))
    number = F.col("variant_index") + 1
    return variants.select(
        "playlist_id",
        F.when(audio, F.concat(F.lit("audio-primary-"), number)).otherwise(F.concat(F.lit("video-"), number)).alias("track_id"),
        F.when(audio, F.lit("audio")).otherwise(F.lit("video")).alias("type"),
        "variant_index",
        "url",
        "bandwidth",
        F.when(F.col("codecs").isNotNull(), codec_list(F.col("codecs"))).alias("codecs"),
        F.when(~audio, F.col("width")).alias("width"),
        F.when(~audio, F.col("height")).alias("height"),
        F.when(~audio, F.col("frame_rate")).alias("frame_rate"),
        "audio_group_id",
    )


def linked(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """Variants and the renditions of their group that can be downloaded.

    ``missing`` marks a variant whose group no rendition has. The rows can be many more than
    those read: lists of variants are joined with lists of renditions, of at most ``TILE`` places
    each, and the pairs of two lists are made last and stand together, so neither a shuffle
    nor a sort holds pairs, and columns of a writer repeat within a list.
    """
    keys = ["playlist_id", "audio_group_id"]
    groups = renditions.groupBy("playlist_id", F.col("group_id").alias("audio_group_id")).agg(F.count(F.lit(1)).alias("members"))
    own = [c for c in variants.columns if c not in keys]
    more = [c for c in renditions.columns if c not in ("playlist_id", "group_id", "rendition_index", "url")]
    lists = (
        variants.groupBy(*keys, F.floor(F.col("variant_index") / TILE).alias("tile"))
        .agg(F.collect_list(F.struct(*own)).alias("variants"))
        .join(groups, keys, "left")
        .withColumn("copy", (F.col("tile") % COPIES).cast("int"))
    )
    external = (
        renditions.where("url IS NOT NULL")
        .groupBy("playlist_id", F.col("group_id").alias("audio_group_id"), F.floor(F.col("rendition_index") / TILE).alias("tile"))
        .agg(F.collect_list(F.struct("rendition_index", F.col("url").alias("audio_url"), *more)).alias("renditions"))
        .select(*keys, "renditions", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    )
    return (
        lists.join(external, [*keys, "copy"], "left")
        .select(*keys, "members", "renditions", F.inline("variants"))
        .select(*keys, *own, "members", F.inline_outer("renditions"))
        .withColumn("missing", F.col("audio_group_id").isNotNull() & F.col("members").isNull())
        .withColumn("audio_track_id", F.concat(F.lit("audio-"), F.col("rendition_index") + 1))
    )


def offered(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """Each track once, with where it first appears: ``playlist_id, track_id, type, url,
    variant_index, rendition_index, audio_group_id``.

    A variant's own track has rendition -1 and no group. A rendition is joined with the
    first variant that names its group, so rows grow with variants and renditions and not
    with their pairs.
    """
    own = primary_tracks(variants).select(
        "playlist_id", "track_id", "type", "url", "variant_index", F.lit(-1).alias("rendition_index"), F.lit(None).cast("string").alias("audio_group_id")
    )
    used = variants.where("audio_group_id IS NOT NULL").groupBy("playlist_id", "audio_group_id").agg(F.min("variant_index").alias("variant_index"))
    audio = external_tracks(renditions).join(used, ["playlist_id", "audio_group_id"])
    return own.unionByName(audio)


def external_tracks(renditions: DataFrame) -> DataFrame:
    """Renditions that can be downloaded, as tracks of their group."""
    playlist = [c for c in renditions.columns if c == "playlist_id"]
    return renditions.where("url IS NOT NULL").select(
        *playlist, F.col("group_id").alias("audio_group_id"), F.concat(F.lit("audio-"), F.col("rendition_index") + 1).alias("track_id"),
        F.lit("audio").alias("type"), "url", "rendition_index",
    )


def tracks(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """All tracks in the order they first appear; a shared audio track appears once.

    Renditions without ``playlist_id`` are those of every playlist that names their group.
    They are numbered within their group, and a playlist only adds up the sizes of the groups
    that it names. A playlist's group is joined with lists of its renditions, in ``COPIES`` parts
    so a large group is not one task, and the tracks, which can be many more than the rows
    read, are made of the lists last: they are neither shuffled nor sorted.
    """
    audio = external_tracks(renditions)
    keys = [c for c in audio.columns if c in ("playlist_id", "audio_group_id")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("rendition_index")) - 1
    audio = audio.select(*keys, place.alias("place"), F.col("track_id").alias("audio_id"), F.col("url").alias("audio_url"))
    sizes = audio.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("playlist_id").orderBy("variant_index")
    first = F.row_number().over(Window.partitionBy("playlist_id", "audio_group_id").orderBy("variant_index")) == 1
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = (
        primary_tracks(variants)
        .select("playlist_id", "audio_group_id", "variant_index", "track_id", "type", "url", first.alias("first"))
        .join(sizes, keys, "left")
        .withColumn("size", F.when(F.col("first"), F.coalesce("size", F.lit(0))).otherwise(0))
        .withColumn("track_ord", (F.row_number().over(order) - 1 + F.coalesce(before, F.lit(0))).cast("int"))
    )
    # A playlist has renditions of its own, or takes part in one copy of those of all.
    copies = 1 if "playlist_id" in keys else COPIES
    part = F.pmod(F.xxhash64("playlist_id"), F.lit(copies))
    blocks = (
        audio.groupBy(*keys, F.expr(f"place div {BLOCK}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "audio_id", "audio_url"))).alias("renditions"))
        .select(*keys, "renditions", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"))
    )
    # A variant's own track is in a part that no rendition is in.
    alone = F.lit(copies) + F.pmod(F.xxhash64("playlist_id"), F.lit(1 << 16))
    external = F.explode(F.when(F.col("size") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("external")
    return (
        own.select(*own.columns, external)
        .withColumn("copy", F.when(F.col("external"), part).otherwise(alone))
        .join(blocks, [*keys, "copy"], "left")
        .select("playlist_id", "external", "track_id", "type", "url", "track_ord", F.inline_outer("renditions"))
        .select(
            "playlist_id",
            F.when(F.col("external"), F.col("audio_id")).otherwise(F.col("track_id")).alias("track_id"),
            F.when(F.col("external"), "audio").otherwise(F.col("type")).alias("type"),
            F.when(F.col("external"), F.col("audio_url")).otherwise(F.col("url")).alias("url"),
            F.when(F.col("external"), F.col("track_ord") + 1 + F.col("place")).otherwise(F.col("track_ord")).alias("track_ord"),
        )
    )


def own_options(variants: DataFrame) -> DataFrame:
    """An option for each variant with its own track alone, and the group that the rest of
    its tracks are in: ``playlist_id, option_id, option_index, bandwidth, track_ids, type,
    url, audio_group_id``."""
    return primary_tracks(variants).select(
        "playlist_id", F.concat(F.lit("option-"), F.col("variant_index") + 1).alias("option_id"), F.col("variant_index").alias("option_index"),
        "bandwidth", F.array("track_id").alias("track_ids"), "type", "url", "audio_group_id",
    )


def options(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """Stream options: a primary track and the external audio tracks of its group.

    A group is collected once and not for each variant that names it.
    """
    members = F.array_sort(F.collect_list(F.struct("rendition_index", "track_id"))).getField("track_id")
    groups = external_tracks(renditions).groupBy("playlist_id", "audio_group_id").agg(members.alias("audio"))
    none = F.array().cast("array<string>")
    return own_options(variants).join(groups, ["playlist_id", "audio_group_id"], "left").select(
        "playlist_id", "option_id", "option_index", "bandwidth", F.concat("track_ids", F.coalesce("audio", none)).alias("track_ids")
    )


def option_counts(variants: DataFrame, renditions: DataFrame) -> DataFrame:
    """``playlist_id, option_id, option_index, bandwidth, videos, audios``: how many tracks
    of each type an option has, ``audios`` being those of its group."""
    groups = external_tracks(renditions).groupBy("playlist_id", "audio_group_id").agg(F.count(F.lit(1)).alias("n"))
    return own_options(variants).join(groups, ["playlist_id", "audio_group_id"], "left").select(
        "playlist_id", "option_id", "option_index", "bandwidth", (F.col("type") == "video").cast("long").alias("videos"), F.coalesce("n", F.lit(0)).alias("audios")
    )


def effective_bandwidth(bandwidth: Column, track_bandwidths: Column) -> Column:
    """The option's own bandwidth, 0 included, else the sum of its tracks'."""
    total = F.aggregate(track_bandwidths, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.coalesce(bandwidth, total)


def with_effective_bandwidth(options_: DataFrame, tracks_: DataFrame) -> DataFrame:
    """``options_`` whose ``bandwidth``, where it is null, is the sum of their tracks'.

    ``tracks_``: ``playlist_id, option_id, bandwidth``; an option without any has 0.
    """
    total = tracks_.groupBy("playlist_id", "option_id").agg(F.sum("bandwidth").alias("total"))
    return options_.join(total, ["playlist_id", "option_id"], "left").withColumn("bandwidth", F.coalesce("bandwidth", "total", F.lit(0.0))).drop("total")


def default_option(options_: DataFrame, bandwidth: str = "bandwidth") -> DataFrame:
    """The option of highest bandwidth of each playlist, as a whole row; of equal ones the first."""
    rest = [c for c in options_.columns if c != "playlist_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.col(bandwidth), -F.col("option_index")))
    return options_.groupBy("playlist_id").agg(best.alias("best")).select("playlist_id", "best.*")


def selection_fault(selected: Column, options_: Column) -> Column:
    """Why ids are no selection, or null: ``options_`` is an array of arrays of ids."""
    offered = F.flatten(options_)
    return (
        F.when(F.size(selected) == 0, "nothing is selected")
        .when(F.size(F.array_distinct(selected)) < F.size(selected), "a track is selected twice")
        .when(F.size(F.array_except(selected, offered)) > 0, "a track is not offered")
        .when(
            ~F.exists(options_, lambda o: F.size(F.array_except(selected, o)) == 0),
            "no option has all selected tracks",
        )
    )


def initial_audio_choice(choices: DataFrame) -> DataFrame:
    """Place of the first default rendition of each group, else 0."""
    first = F.min(F.when(F.col("is_default"), F.col("place")))
    return choices.groupBy("playlist_id", "group_id").agg(F.coalesce(first, F.lit(0)).alias("place"))


def _named(text: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(text, F.lit(""))


def video_title(track: Column) -> Column:
    """Size, else name or id; then frame rate and codecs, of a track struct."""
    label = F.when(
        track["width"].isNotNull() & track["height"].isNotNull(),
        F.concat(track["width"], F.lit("x"), track["height"]),
    ).otherwise(F.coalesce(_named(track["name"]), track["id"]))
    rate = F.concat(number_text(track["frame_rate"]), F.lit(" fps"))
    return F.concat_ws(DETAIL, label, rate, _codecs(track))


def video_choice_title(track: Column, bandwidth: Column) -> Column:
    """Title of a video to choose: the track's, and the bandwidth of its option if known."""
    return F.concat_ws(DETAIL, F.concat(F.lit("video: "), video_title(track)), megabits(bandwidth))


def audio_title(track: Column) -> Column:
    """Name, language or id; then channels, codecs and bandwidth, of a track struct."""
    language = _named(track["language"])
    label = F.coalesce(_named(track["name"]), language, track["id"])
    named = F.when(language != label, F.concat(label, F.lit(" ("), language, F.lit(")")))
    channels = F.concat(track["channels"].cast("string"), F.lit(" ch"))
    return F.concat_ws(
        DETAIL, F.coalesce(named, label), channels, _codecs(track), kilobits(track["bandwidth"])
    )


def _codecs(track: Column) -> Column:
    return F.when(F.size(track["codecs"]) > 0, F.array_join(track["codecs"], ","))


def option_title(videos: Column, audios: Column, bandwidth: Column) -> Column:
    """Title of an option from the titles of its tracks."""
    parts = F.concat_ws(
        " | ",
        F.when(F.size(videos) > 0, F.concat(F.lit("video: "), F.array_join(videos, ", "))),
        F.when(F.size(audios) > 0, F.concat(F.lit("audio: "), F.array_join(audios, ", "))),
        megabits(bandwidth),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("unnamed stream option"))


def video_choices(options_: DataFrame) -> DataFrame:
    """Video tracks to choose from, best option first: ``playlist_id, place, track_id``.

    ``options_``: ``playlist_id, option_index, bandwidth, track_ids``; equal bandwidths
    keep the order of the options, and of the tracks in them.
    """
    at = Window.partitionBy("playlist_id").orderBy(F.desc("bandwidth"), "option_index", "in_option")
    return (
        options_.select("playlist_id", "option_index", "bandwidth", F.posexplode("track_ids").alias("in_option", "track_id"))
        .where(F.col("track_id").startswith("video-"))
        .select("playlist_id", (F.row_number().over(at) - 1).alias("place"), "option_index", "track_id")
    )


def direct_tracks(playlists: DataFrame) -> DataFrame:
    """A media playlist that was given itself is one video track of the name ``main``."""
    return playlists.select(
        "playlist_id", F.lit("main").alias("track_id"), F.lit("video").alias("type"), F.col("playlist_url").alias("url")
    )


def audio_choices(tracks_: DataFrame) -> DataFrame:
    """Audio tracks of each option, and behind them the choice of none."""
    none = (
        tracks_.groupBy("playlist_id", "option_id")
        .agg(F.count(F.lit(1)).alias("place"))
        .select("playlist_id", "option_id", "place", F.lit(None).cast("string").alias("track_id"), F.lit("None").alias("title"))
    )
    return tracks_.select("playlist_id", "option_id", F.col("place").cast("long"), "track_id", "title").unionByName(none)


def automatic_choice(counts: DataFrame, interactive: bool) -> DataFrame:
    """The branches of the selection that ask nothing, from :func:`option_counts`.

    ``default``: there is no video and one option, or nobody to ask. ``video``: one
    video without external audio. ``ask``: anything else.
    """
    video, one = F.sum("videos"), F.count(F.lit(1)) == 1
    return counts.groupBy("playlist_id").agg(
        F.when(F.lit(not interactive), "default")
        .when((video == 0) & one, "default")
        .when((video == 1) & one & (F.max("audios") == 0), "video")
        .otherwise("ask")
        .alias("choice")
    )
