"""Playlists, segments, outcomes and attempts made from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.operators import spans

CDN = "https://cdn.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for each user and a segment for each event, sign-ups being initialization."""
    one = F.lit(1).cast("long")
    return spans.before(table(spark, sf_dir, "events"), ["user_id"], "event_id", sums={"ord": one}).select(
        F.concat(F.lit("u"), "user_id").alias("track_id"),
        "event_id",
        "ord",
        F.when(F.col("event_type") == "signup", "init").otherwise("media").alias("kind"),
        F.col("value").alias("duration"),
        F.concat(F.lit(CDN), "user_id", F.lit("/"), "event_id", F.lit(".ts")).alias("url"),
    )


def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome for each event, errors being dropped; the payload is the event's id."""
    one = F.lit(1).cast("long")
    return spans.before(table(spark, sf_dir, "events"), ["user_id"], "event_id", sums={"track_index": one}).select(
        F.concat(F.lit("u"), "user_id").alias("track_id"),
        "event_id",
        "track_index",
        F.when(F.col("event_type") == "error", "dropped").otherwise("ready").alias("status"),
        F.when(F.col("event_type") == "signup", "init").otherwise("media").alias("kind"),
        F.col("value").alias("duration"),
        F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("payload"),
    )


def event_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's task needs one to seven attempts, and is tried until one succeeds."""
    needed = F.col("event_id") % 7 + 1
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"), F.explode(F.sequence(F.lit(1).cast("long"), needed)).alias("attempt"), needed.alias("needed")
    ).select("task_id", "attempt", (F.col("attempt") == F.col("needed")).alias("ok"))


#: Lines of every playlist before its items, and behind them.
HEAD = ("#EXTM3U", "# a comment", "", "#EXT-X-MEDIA-SEQUENCE:100")
TAIL = ("#EXT-X-ENDLIST", "#EXTINF:9,", "late.ts")


def _item_texts() -> Column:
    """Text of an item of :func:`event_segments`, of one to three lines."""
    turn = F.expr("ord div 5")
    iv = F.lower(F.hex(F.col("ord") + 1))
    key = F.when(
        F.col("ord") % 5 == 0,
        F.when(
            turn % 2 == 0,
            F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="../keys/'), "ord", F.lit('?a=b,c",IV=0x'), iv),
        ).otherwise(F.lit("#EXT-X-KEY:METHOD=NONE")),
    )
    name = F.concat("event_id", F.lit(".ts"))
    item = F.when(
        F.col("kind") == "init", F.concat(F.lit('#EXT-X-MAP:URI="'), name, F.lit('"'))
    ).otherwise(F.concat(F.lit("#EXTINF:"), F.col("duration").cast("string"), F.lit(",title\r\n  "), name))
    return F.concat_ws("\n", key, item)


def _playlist_url(track: Column) -> Column:
    return F.concat(F.lit(CDN), F.substr(track, F.lit(2)), F.lit("/list.m3u8"))


def playlist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of :func:`playlist_texts`, which no row holds together."""
    rows = event_segments(spark, sf_dir).where("track_id IS NOT NULL")
    most = F.lit(4).cast("long")  # places an item has for its lines
    items = rows.select(
        F.col("track_id").alias("playlist_id"), ((F.col("ord") + len(HEAD)) * most).alias("at"),
        F.posexplode(F.split(_item_texts(), r"\r?\n")).alias("k", "line"),
    )
    ends = rows.groupBy(F.col("track_id").alias("playlist_id")).agg((F.max("ord") + 1 + len(HEAD)).alias("after"))
    head = ends.select("playlist_id", F.lit(0).cast("long").alias("at"), F.posexplode(F.array(*map(F.lit, HEAD))).alias("k", "line"))
    tail = ends.select("playlist_id", (F.col("after") * most).alias("at"), F.posexplode(F.array(*map(F.lit, TAIL))).alias("k", "line"))
    return items.unionByName(head).unionByName(tail).select(
        "playlist_id", _playlist_url(F.col("playlist_id")).alias("playlist_url"), (F.col("at") + F.col("k")).alias("line_no"), "line"
    )


def playlist_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media playlist of every track, as text.

    Sequences start at 100. Every fifth item changes the key: a key with a vector, or
    none. Text behind the end mark must be ignored.
    """
    rows = event_segments(spark, sf_dir)
    text = _item_texts()
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))), lambda x: x["text"])
    return rows.groupBy("track_id").agg(
        F.concat(
            F.lit("\n".join((*HEAD, ""))),
            F.array_join(body, "\n"),
            F.lit("\n".join(("", *TAIL, ""))),
        ).alias("content")
    ).select(
        F.col("track_id").alias("playlist_id"),
        _playlist_url(F.col("track_id")).alias("playlist_url"),
        "content",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes of live playlists: refresh r of a conversation shows its turns r to r + 3."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat(F.lit("c"), "conv_id").alias("track_id"),
        F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("turn") - 3), F.col("turn"))).alias("refresh"),
        F.col("turn").alias("sequence_id"),
        F.lit("media").alias("kind"),
        F.col("turn").cast("string").alias("identity"),
        F.length("text").alias("size"),
    )


def customer_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant for each customer, whose audio group is the customer's nation."""
    order = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("playlist_id"),
        (F.row_number().over(order) - 1).cast("long").alias("variant_index"),
        (F.col("c_custkey") % 97 * 1000).cast("double").alias("bandwidth"),
        F.concat(F.lit("g"), "c_nationkey").alias("audio_group_id"),
        "c_custkey",
    )


# The market segments of customers.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def supplier_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audio rendition for each supplier and market segment, in the group of its nation;
    each third has no URI."""
    return table(spark, sf_dir, "supplier").select(
        F.explode(F.array(*map(F.lit, SEGMENTS))).alias("playlist_id"),
        (F.col("s_suppkey") - 1).alias("rendition_index"),
        F.concat(F.lit("g"), "s_nationkey").alias("group_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("https://cdn.example/a/"), "s_suppkey")).alias("url"),
        (F.col("s_suppkey") % 2 == 1).alias("is_default"),
    )
