"""Registered queries of live tracks: streams over what the tables say arrives.

What arrives is written in two parts, and the same stream is run after each, so it has to
go on from its checkpoint with the state it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import media
from segmentry.plans import archive, follow
from segmentry.sources import bindings as b
from segmentry.sources import tracks
from segmentry.streaming import live, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _in_parts(rows: DataFrame, parts: list[Column], run: Callable[[DataFrame], None]) -> None:
    """Write the rows of each condition in turn, and ``run`` one stream over all so far."""
    spark = rows.sparkSession
    feed = runs.new_folder(spark, "feed")
    for part in parts:
        rows.where(part).write.mode("append").parquet(feed)
        run(spark.readStream.schema(rows.schema).parquet(feed))


def _refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live track for each conversation: refresh r lists turns r - 3 to r.

    By their number tracks vanish (404), miss a refresh, never start (503), turn to
    SAMPLE-AES, have a broken refresh, or end with the fifth turn.
    """
    conv, r = F.col("conv_id"), F.col("turn")
    first = F.greatest(F.lit(0).cast("long"), r - 3)
    # The key of every second refresh is another one.
    key = F.when((conv % 7 == 3) & (r >= 3), '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://k",IV=0x1\n').otherwise(
        F.concat(F.lit('#EXT-X-KEY:METHOD=AES-128,URI="k'), F.expr("turn div 2"), F.lit('",IV=0x1\n'))
    )
    start = F.when((conv % 7 == 3) & (r >= 3), "").otherwise(
        F.concat(F.lit('#EXT-X-MAP:URI="i'), F.expr("turn div 4"), F.lit('.mp4"\n'))
    )
    segments = F.array_join(
        F.transform(F.sequence(first, r), lambda t: F.concat(F.lit("#EXTINF:2,\n"), t, F.lit(".ts"))), "\n"
    )
    tail = F.when((conv % 11 == 5) & (r == 1), "\n#EXTINF:2,").when((conv % 4 == 0) & (r == 4), "\n#EXT-X-ENDLIST").otherwise("")
    return b.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), conv).alias("track_id"),
        r.alias("refresh"),
        F.when((conv % 5 == 1) & (r == 2), 404).when((conv % 5 == 2) & (r == 1), 0).when((conv % 5 == 3) & (r == 0), 503).otherwise(200).alias("status"),
        F.concat(F.lit(b.CDN), conv, F.lit("/live.m3u8")).alias("playlist_url"),
        F.concat(F.lit("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), first, F.lit("\n"), key, start, segments, tail).alias("content"),
    )


@query("""
WITH r AS (
  SELECT conv_id, turn,
         CASE WHEN conv_id % 5 = 1 AND turn = 2 THEN 'status 404' WHEN conv_id % 5 = 2 AND turn = 1 THEN 'status 0'
              WHEN conv_id % 5 = 3 AND turn = 0 THEN 'status 503'
              WHEN conv_id % 11 = 5 AND turn = 1 THEN 'a tag applies to no segment' END AS fault,
         conv_id % 7 = 3 AND turn >= 3 AS sealed, conv_id % 4 = 0 AND turn = 4 AS last
  FROM conversations
), o AS (SELECT *, fault IS NULL AND NOT sealed AS ok FROM r),
s AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS started FROM o),
v AS (
  SELECT conv_id, turn, ok,
         CASE WHEN fault IS NULL AND sealed THEN 'fatal' WHEN fault IS NOT NULL AND NOT started THEN 'fatal'
              WHEN fault IN ('status 404', 'status 503') THEN 'ended' WHEN ok AND last THEN 'ended' END AS event,
         CASE WHEN fault IS NULL AND sealed THEN 'SAMPLE-AES needs exactly one explicit key' ELSE fault END AS fault
  FROM s
), e AS (SELECT conv_id, min(turn) AS over FROM v WHERE event IS NOT NULL GROUP BY conv_id),
used AS (SELECT v.* FROM v LEFT JOIN e USING (conv_id) WHERE over IS NULL OR turn <= over),
found AS (
  SELECT conv_id, turn, 'media' AS kind, unnest(range(greatest(0, turn - 3), turn + 1)) AS n FROM used WHERE ok
  UNION ALL SELECT conv_id, turn, 'init', turn // 4 FROM used WHERE ok
)
SELECT 'c' || conv_id AS track_id, min(turn) AS refresh, 'item' AS event, NULL::VARCHAR AS fault, kind,
       CASE WHEN kind = 'media' THEN n END AS sequence_id,
       'https://cdn.example/' || conv_id || CASE WHEN kind = 'media' THEN '/' || n || '.ts' ELSE '/i' || n || '.mp4' END AS url
FROM found GROUP BY conv_id, kind, n
UNION ALL SELECT 'c' || conv_id, turn, event, fault, NULL, NULL, NULL FROM used WHERE event IS NOT NULL
""")
def follow_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tracks from the text of their refreshes to new items, and how each track ends."""
    folder = runs.new_folder(spark, "follow")
    parsed = f"{folder}/parsed"

    def run(stream: DataFrame) -> None:
        runs.drain(stream, f"{folder}/parsing", follow.write_parsed(parsed))
        rows = spark.readStream.schema(follow.PARSED).parquet(f"{parsed}/batch-*")
        runs.drain(follow.followed(rows), f"{folder}/tracks")

    _in_parts(_refreshes(spark, sf_dir), [F.col("refresh") < 2, F.col("refresh") >= 2], run)
    return spark.read.schema(live.FOLLOWED).parquet(f"{folder}/tracks/out").drop("identity")


@query(ORACLE["follow_tracks"])
def recorded_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a source of recorded playlists, its stream run again after each recording."""
    folder = runs.new_folder(spark, "recorded")
    source, parsed = f"{folder}/source", f"{folder}/parsed"
    refreshes = _refreshes(spark, sf_dir)
    for part, some in enumerate((F.col("refresh") < 2, F.col("refresh") >= 2), 1):
        tracks.record(refreshes.where(some), source, part)
        runs.drain(tracks.recorded_stream(spark, source), f"{folder}/parsing", follow.write_parsed(parsed))
        rows = spark.readStream.schema(follow.PARSED).parquet(f"{parsed}/batch-*")
        runs.drain(follow.followed(rows), f"{folder}/tracks")
    return spark.read.schema(live.FOLLOWED).parquet(f"{folder}/tracks/out").drop("identity")


@query("""
WITH u AS (
  SELECT user_id AS u, user_id // 10 AS part, (user_id * 37 % 101 + 1) * 1000 AS bandwidth
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)
), o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY u) - 1 AS place FROM u),
best AS (SELECT part, u FROM o QUALIFY row_number() OVER (PARTITION BY part ORDER BY bandwidth DESC, place) = 1)
SELECT 'k' || part AS playlist_id, row_number() OVER (PARTITION BY part ORDER BY event_id) - 1 AS track_index,
       'https://cdn.example/' || u || '/' || event_id || '.ts' AS url
FROM best JOIN events ON user_id = u
""")
def recorded_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters to the items of their default option, all playlists read from a recording."""
    folder = runs.new_folder(spark, "recorded")
    texts = b.playlist_texts(spark, sf_dir).where("playlist_id IS NOT NULL")
    user = F.regexp_extract("playlist_url", "example/([0-9]+)/", 1).cast("long")
    entry = F.concat(
        F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("u") * 37 % 101 + 1) * 1000, F.lit("\n"), F.col("playlist_url")
    )
    masters = (
        texts.select(user.alias("u"), "playlist_url")
        .select(F.expr("u div 10").alias("part"), F.struct("u", entry.alias("line")).alias("entry"))
        .groupBy("part")
        .agg(F.array_sort(F.collect_list("entry")).getField("line").alias("lines"))
        .select(F.concat(F.lit("k"), "part").alias("track_id"), F.lit(b.CDN).alias("playlist_url"), F.array_join("lines", "\n").alias("content"))
    )
    every = masters.unionByName(texts.withColumnRenamed("playlist_id", "track_id"))
    tracks.record(every.withColumns({"refresh": F.lit(0), "status": F.lit(200)}), f"{folder}/source", 1)
    found = tracks.last_playlists(tracks.recorded(spark, f"{folder}/source"))
    kinds = F.col("content").contains("#EXT-X-STREAM-INF")
    return archive.default_archive(found.where(kinds), found.where(~kinds)).select("playlist_id", "track_index", "url")


@query("""
WITH r AS (SELECT conv_id, turn AS refresh, unnest(range(greatest(0, turn - 3), turn + 1)) AS n FROM conversations),
first AS (SELECT conv_id, n, min((refresh % 2 = 0, refresh)) AS came FROM r GROUP BY ALL)
SELECT 'c' || conv_id AS track_id, n AS sequence_id, struct_extract(came, 2) AS refresh FROM first
""")
def late_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second refresh of a live track comes late, and still brings what it alone has."""
    folder, r = runs.new_folder(spark, "late"), F.col("turn")
    first = F.greatest(F.lit(0).cast("long"), r - 3)
    lines = F.array_join(F.transform(F.sequence(first, r), lambda t: F.concat(F.lit("#EXTINF:2,\n"), t, F.lit(".ts"))), "\n")
    fetched = b.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), "conv_id").alias("track_id"), r.alias("refresh"), F.lit(200).alias("status"),
        F.lit(b.CDN).alias("playlist_url"), F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), first, F.lit("\n"), lines).alias("content"),
    )

    def run(stream: DataFrame) -> None:
        runs.drain(follow.followed(stream), folder)

    _in_parts(runs.written(follow.parsed_refreshes(fetched), "parsed"), [F.col("refresh") % 2 == 1, F.col("refresh") % 2 == 0], run)
    return spark.read.schema(live.FOLLOWED).parquet(f"{folder}/out").where("event = 'item'").select("track_id", "sequence_id", "refresh")


@query("""
SELECT DISTINCT 'https://cdn.example/' || conv_id || '/k' || turn // 2 AS id FROM conversations
WHERE NOT (conv_id % 7 = 3 AND turn >= 3) AND conv_id % 6 <> 0
""")
def new_live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of live tracks as they change; those of every sixth track are held already."""
    folder = runs.new_folder(spark, "keys")
    texts = _refreshes(spark, sf_dir).where("content NOT LIKE '%SAMPLE-AES%'")
    turns = b.table(spark, sf_dir, "conversations").where("conv_id % 6 = 0")
    held = turns.select(F.concat(F.lit(b.CDN), "conv_id", F.lit("/k"), F.expr("turn div 2")).alias("id")).distinct()

    def each(batch: DataFrame, number: int) -> None:
        playlists = batch.select(F.struct("track_id", "refresh").alias("playlist_id"), "playlist_url", "content")
        media.keys(playlists).select("id").write.mode("overwrite").parquet(f"{folder}/found/batch-{number}")

    def run(stream: DataFrame) -> None:
        runs.drain(stream, f"{folder}/finding", each)
        found = spark.readStream.schema("id string").parquet(f"{folder}/found/batch-*")
        runs.drain(live.new_keys(found, held), f"{folder}/keys")

    _in_parts(texts, [F.col("refresh") < 3, F.col("refresh") >= 3], run)
    return spark.read.schema("id string").parquet(f"{folder}/keys/out")


@query("SELECT 'c' || conv_id AS track_id, count(*) AS total FROM conversations GROUP BY conv_id")
def live_track_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open totals: items of overlapping refreshes from two producers, each counted once."""
    folder = runs.new_folder(spark, "totals")
    found = b.snapshots(spark, sf_dir).select("track_id", "refresh", "kind", "identity")

    def totals(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/totals")

    def run(stream: DataFrame) -> None:
        even, odd = stream.where("refresh % 2 = 0"), stream.where("refresh % 2 = 1")
        once = live.first_seen(live.merged([even, odd]))
        runs.drain(once, f"{folder}/items")
        items = spark.readStream.schema(once.schema).parquet(f"{folder}/items/out")
        runs.drain(live.live_totals(items), f"{folder}/counting", totals, "complete")

    _in_parts(found, [F.col("refresh") % 3 != 1, F.col("refresh") % 3 == 1], run)
    return spark.read.schema("track_id string, total long").parquet(f"{folder}/totals")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
lost AS (SELECT user_id, min(n) AS n FROM e WHERE event_id % 97 = 0 GROUP BY user_id)
SELECT 'u' || e.user_id AS track_id, e.n AS track_index, CASE WHEN event_type = 'error' THEN 'dropped' ELSE 'ready' END AS status,
       event_id || ';' AS payload
FROM e LEFT JOIN lost ON e.user_id = lost.user_id WHERE lost.n IS NULL OR e.n < lost.n
""")
def live_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that arrive out of order come out in order; some never arrive."""
    folder = runs.new_folder(spark, "prefix")
    outcomes = b.event_outcomes(spark, sf_dir).where("event_id % 97 <> 0 AND track_id IS NOT NULL").select(
        "track_id", "track_index", "status", "payload"
    )

    def run(stream: DataFrame) -> None:
        runs.drain(live.ordered_outcomes(stream), folder)

    _in_parts(outcomes, [F.col("track_index") % 3 == 1, F.col("track_index") % 3 != 1], run)
    return spark.read.schema(live.OUTCOME).parquet(f"{folder}/out")
