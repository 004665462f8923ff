"""Registered queries of selections, direct playlists, keys and outcomes, with their SQL.

Each query stands above its SQL, which starts from the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions import urls
from segmentry.more_queries import OWN, _catalog, _text
from segmentry.operators import catalog, discovery, output, selection, tasks
from segmentry.plans import archive
from segmentry.sources import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


# Selections --------------------------------------------------------------------------


@query(f"""
WITH {OWN}, sel AS (
  SELECT playlist_id, substr(playlist_id, 2)::BIGINT AS part, 0 AS place, c_custkey, c_nationkey,
         CASE WHEN c_custkey % 15 = 0 THEN 'audio-primary-' ELSE 'video-' END || (c_custkey % 50 + 1) AS track_id
  FROM c WHERE (c_custkey % 50 = (c_custkey // 50) * 7 % 50) AND (c_custkey // 50) % 6 <> 5
), every AS (
  SELECT playlist_id, place, track_id FROM sel
  UNION ALL SELECT playlist_id, s_suppkey + 1, 'audio-' || s_suppkey FROM sel JOIN supplier
    ON part BETWEEN 3 * s_suppkey // 10 AND 3 * s_suppkey // 10 + 7
    WHERE CASE WHEN part % 4 = 3 THEN s_suppkey % 5 = 0 ELSE s_nationkey = c_nationkey AND s_suppkey % 3 <> 0 END
  UNION ALL SELECT playlist_id, 1000000000000, track_id FROM sel WHERE part % 7 = 2
), ids AS (
  SELECT playlist_id, list(track_id ORDER BY place) AS chosen FROM every GROUP BY 1
), o AS (
  SELECT playlist_id, list(ids) AS options, list_distinct(flatten(list(ids))) AS offered FROM opts GROUP BY 1
)
SELECT playlist_id, CASE WHEN chosen IS NULL THEN 'nothing is selected'
       WHEN NOT list_has_all(offered, chosen) THEN 'a track is not offered'
       WHEN len(list_distinct(chosen)) < len(chosen) THEN 'a track is selected twice'
       WHEN len(list_filter(options, lambda x: list_has_all(x, chosen))) = 0 THEN 'no option has all selected tracks' END AS fault
FROM o LEFT JOIN ids USING (playlist_id)
""")
def selection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One customer of each playlist as the selected variant, with audio tracks of its
    nation, or of any; in some playlists it is selected again, in others nothing is."""
    key, part = F.col("c_custkey"), F.expr("c_custkey div 50")
    one = b.table(spark, sf_dir, "customer").where((key % 50 == part * 7 % 50) & (part % 6 != 5)).select(
        part.alias("part"), _text("m", part).alias("playlist_id"), "c_nationkey", F.lit(0).cast("long").alias("place"),
        _text(F.when(key % 15 == 0, "audio-primary-").otherwise("video-"), key % 50 + 1).alias("track_id"),
    )
    sounds = b.table(spark, sf_dir, "supplier").select(
        F.explode(F.expr("sequence(3 * s_suppkey div 10, 3 * s_suppkey div 10 + 7)")).alias("part"), "s_suppkey", "s_nationkey"
    )
    wanted = F.when(F.col("part") % 4 == 3, F.col("s_suppkey") % 5 == 0).otherwise((F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") % 3 != 0))
    audio = one.join(sounds, "part").where(wanted).select(
        "playlist_id", (F.col("s_suppkey") + 1).alias("place"), _text("audio-", F.col("s_suppkey")).alias("track_id")
    )
    again = one.where("part % 7 = 2").select("playlist_id", F.lit(10**12).alias("place"), "track_id")
    selected = one.select("playlist_id", "place", "track_id").unionByName(audio).unionByName(again)
    return selection.faults(*_catalog(spark, sf_dir), selected)


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events), seg AS (
  SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events
), m AS (
  SELECT user_id, user_id // 10 AS part, row_number() OVER (PARTITION BY user_id // 10, user_id % 10 < 7 ORDER BY user_id) AS n FROM u
), taken AS (
  SELECT 'k' || part AS playlist_id, 1 AS place, 'video-' || n AS track_id, user_id FROM m WHERE user_id % 10 = part % 7
  UNION ALL SELECT 'k' || part, CASE WHEN part % 2 = 0 THEN 10 - n ELSE n + 1 END, 'audio-' || n, user_id FROM m
  WHERE user_id % 10 >= 7 AND part IN (SELECT part FROM m WHERE user_id % 10 = part % 7)
  UNION ALL SELECT 'd' || user_id, 0, 'main', user_id FROM u WHERE user_id % 9 = 0
)
SELECT playlist_id, place, track_id, ord AS track_index, 'https://cdn.example/' || user_id || '/' || event_id || '.ts' AS url,
       CASE WHEN event_type <> 'signup' THEN CASE WHEN value = 0 THEN 5.0 ELSE value END END AS duration
FROM taken JOIN seg USING (user_id)
""")
def selected_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters with a caller's selection, and media playlists given themselves, to items.

    Of ten users seven are variants and three the audio that these share. One variant and
    all audio are selected, in some playlists the last audio first.
    """
    texts = b.playlist_texts(spark, sf_dir)
    users = b.table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("u")).where("u IS NOT NULL").distinct()
    url = _text(b.CDN, F.col("u"), "/list.m3u8")
    line = F.when(F.col("u") % 10 < 7, _text("#EXT-X-STREAM-INF:BANDWIDTH=", F.col("u") + 1, ',AUDIO="g"\n', url)).otherwise(
        _text('#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="n', F.col("u"), '",URI="', url, '"')
    )
    lines = users.select(F.expr("u div 10").alias("part"), F.struct(F.col("u"), line.alias("line")).alias("entry"))
    masters = lines.groupBy("part").agg(F.array_sort(F.collect_list("entry")).getField("line").alias("lines")).select(
        _text("k", F.col("part")).alias("playlist_id"), F.lit(b.CDN).alias("playlist_url"), F.array_join("lines", "\n").alias("content")
    )
    user = F.substr("playlist_id", F.lit(2)).cast("long")
    direct = texts.where(user % 9 == 0).select(_text("d", user).alias("playlist_id"), "playlist_url", "content")
    # Users are whole from 0, so that a user's place among the variants of its ten is known.
    part, n = F.expr("u div 10"), F.col("u") % 10
    audio = n >= 7
    place = F.when(~audio, 1).when(part % 2 == 0, 10 - (n - 6)).otherwise(n - 5)
    selected = users.where(audio | (n == part % 7)).select(
        _text("k", part).alias("playlist_id"), place.cast("long").alias("place"),
        F.when(audio, _text("audio-", n - 6)).otherwise(_text("video-", n + 1)).alias("track_id"),
    )
    taken, _ = archive.planned_tracks(masters.unionByName(direct), selected)
    return archive.archive_of(taken, texts).select("playlist_id", "place", "track_id", "track_index", "url", "duration")


@query("""
WITH t AS (
  SELECT o_custkey, o_orderkey, max(o_orderkey % 3) AS kind, max(floor(o_totalprice)) AS own,
         sum(CASE WHEN l_linenumber % 2 = 1 THEN floor(l_extendedprice) END) AS total
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL
), o AS (SELECT o_custkey, o_orderkey, CASE WHEN kind = 0 THEN coalesce(total, 0) WHEN kind = 1 THEN 0 ELSE own END AS bandwidth FROM t)
SELECT o_custkey AS playlist_id, o_orderkey AS option_index, bandwidth::DOUBLE AS bandwidth FROM o
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY bandwidth DESC, o_orderkey) = 1
""")
def effective_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as options of a customer, and their lines as tracks: an order without a
    bandwidth has its tracks', one of 0 keeps it."""
    key = F.col("o_orderkey")
    options = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("playlist_id"), key.alias("option_id"), key.alias("option_index"),
        F.when(key % 3 == 1, 0.0).when(key % 3 == 2, F.floor("o_totalprice").cast("double")).alias("bandwidth"),
    )
    tracks = b.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("option_id"), F.when(F.col("l_linenumber") % 2 == 1, F.floor("l_extendedprice").cast("double")).alias("bandwidth")
    ).join(options.select("option_id", "playlist_id"), "option_id")
    best = catalog.default_option(catalog.with_effective_bandwidth(options, tracks))
    return best.select("playlist_id", "option_index", "bandwidth")


# Keys --------------------------------------------------------------------------------


@query("""
WITH k AS (
  SELECT l_orderkey AS playlist_id, l_linenumber, l_partkey, p_name,
         CASE WHEN l_partkey % 11 = 0 AND l_orderkey % 2 = 0 THEN 'external' WHEN l_partkey % 3 = 0 THEN 'base64' WHEN l_partkey % 3 = 1 THEN 'percent' ELSE 'http' END AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey
), b AS (SELECT playlist_id, bool_or(kind = 'external') AS opaque FROM k GROUP BY 1)
SELECT playlist_id, l_linenumber, CASE WHEN NOT opaque AND (kind <> 'http' OR l_partkey % 7 <> 0) THEN lower(hex(encode(p_name || '+/'))) END AS key,
       CASE WHEN opaque THEN 'an external key needs an explicit one' WHEN kind = 'http' AND l_partkey % 7 = 0 THEN 'a key cannot be fetched' END AS fault
FROM k JOIN b USING (playlist_id)
""")
def resolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its keys: part names as bytes of data URIs or of files.

    An external key makes all keys of its order fail; every seventh part has no file.
    """
    part, name = F.col("l_partkey"), F.concat("p_name", F.lit("+/"))
    url = _text("https://keys.example/", part)
    data = F.encode(name, "UTF-8")
    escaped = F.regexp_replace(F.hex(data), "(..)", "%$1")
    uri = (
        F.when((part % 11 == 0) & (F.col("l_orderkey") % 2 == 0), _text("skd://", part))
        .when(part % 3 == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(data)))
        .when(part % 3 == 1, F.concat(F.lit("data:,"), escaped))
        .otherwise(url)
    )
    parts = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    keys = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("playlist_id"), "l_linenumber", uri.alias("id"), urls.key_kind(uri).alias("key_kind")
    )
    files = parts.where("l_partkey % 7 <> 0").select(url.alias("url"), data.alias("content"))
    return discovery.resolved_keys(keys, files).select("playlist_id", "l_linenumber", "key", "fault")


@query("""
SELECT l_orderkey AS playlist_id, CASE WHEN bool_or(l_partkey % 11 = 0) THEN 'an external key needs an explicit one' END AS fault
FROM lineitem GROUP BY 1
""")
def external_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cannot start as one of their parts is an external key."""
    part = F.col("l_partkey")
    uri = _text(F.when(part % 11 == 0, "skd://").when(part % 11 == 1, "data:,").otherwise("HTTPS://keys.example/"), part)
    keys = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("playlist_id"), urls.key_kind(uri).alias("key_kind"))
    return discovery.external_keys_without_explicit(keys, 0)


# Outcomes ----------------------------------------------------------------------------


@query("""
SELECT 'u' || user_id AS track_id, 0 AS run, count(*) AS items, md5(string_agg(event_id || ';', '' ORDER BY event_id)) AS payload_md5
FROM events WHERE event_type <> 'error' AND user_id IS NOT NULL GROUP BY user_id
""")
def whole_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track as one output, whatever was dropped in between."""
    rows = b.event_outcomes(spark, sf_dir).where("track_id IS NOT NULL")
    return output.concentrated(rows, "payload", ignore_gaps=True).select("track_id", "run", "items", F.md5("payload").alias("payload_md5"))


@query("""
SELECT 'u' || user_id AS track_id, event_id // 4 AS track_index, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1
""")
def double_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a track that more than one outcome came for, when four events share one."""
    rows = b.table(spark, sf_dir, "events").select(_text("u", F.col("user_id")).alias("track_id"), F.expr("event_id div 4").alias("track_index"))
    return output.duplicate_outcomes(rows)


@query("""
SELECT p_brand, arg_min(p_name || '/' || p_partkey, (p_size, p_partkey)) AS name FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_brand
""")
def first_muxer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the muxers of a host, its brand; every third probe fails or is missing."""
    key = F.col("p_partkey")
    muxers = b.table(spark, sf_dir, "part").select(
        "p_brand", _text(F.col("p_name"), "/", key).alias("name"), F.struct("p_size", "p_partkey").alias("priority"),
        F.when(key % 3 != 0, True).when(key % 6 == 0, False).alias("available"),
    )
    return output.first_available(muxers, "p_brand")


@query("""
WITH t AS (
  SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok,
         sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN value ELSE 0 END::DECIMAL(20, 6)) AS played
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id
), s AS (SELECT *, greatest(1, floor(n * 7919 / 1000 + 0.5)) AS seconds FROM t)
SELECT 'u' || user_id AS track_id, (round(ok::DECIMAL(20, 10) / seconds::DECIMAL(20, 0), 2)::DECIMAL(20, 2))::VARCHAR AS chunks_per_second,
       (round(played::DECIMAL(20, 10) / seconds::DECIMAL(20, 0), 2)::DECIMAL(20, 2))::VARCHAR AS media_per_second
FROM s
""")
def media_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and seconds of media that each track gained in a second; its clock starts at 0.

    An event without a type is still open. A track has no rate of media where no item tells one.
    """
    kind = F.col("event_type")
    rows = b.table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(
        _text("u", F.col("user_id")).alias("track_id"), F.when(kind == "error", "dropped").when(kind.isNotNull(), "ready").alias("status"),
        F.when(kind == "signup", "init").otherwise("media").alias("kind"), F.col("value").alias("duration"),
    )
    silent = F.expr("status <=> 'ready' AND kind = 'media' AND duration IS NULL")
    told = rows.groupBy("track_id").agg(F.bool_or(~silent).alias("told"))
    per_track = tasks.progress(rows).where("track_id IS NOT NULL").join(told, "track_id")
    per_track = per_track.withColumn("successful_duration", F.when(F.col("told"), F.col("successful_duration")))
    seconds = tasks.elapsed_seconds(F.lit(0), F.col("total") * 7919)
    return tasks.rates(per_track, seconds).select("track_id", "chunks_per_second", "media_per_second")
