"""Registered queries of catalogs, validation, policies and binary streams, with their SQL.

Each query stands above its SQL, which starts from the tables and never sees the texts and
bytes that the query makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions import binary, text, urls
from segmentry.operators import catalog, discovery, master, media, output, rewrite, syntax, tasks, transport
from segmentry.plans import archive, clear_stream
from segmentry.sources import bindings as b
from segmentry.sources import playlists as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _text(*parts: Column | str | int) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, (str, int)) else p for p in parts))


# Master playlists and catalogs -------------------------------------------------------


def _masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master playlist for each fifty customers, and renditions for each twenty suppliers.

    Every seventh customer's tag has no URI behind it, so it takes the next one's; every
    eleventh has no bandwidth.
    """
    key, group = F.col("c_custkey"), F.expr("c_custkey div 50")
    tag = F.concat(
        F.lit("#EXT-X-STREAM-INF:"), F.when(key % 11 == 0, "NAME=x").otherwise(_text("BANDWIDTH=", key * 1000)),
        F.lit(',CODECS="'), F.when(key % 5 == 0, "mp4a.40.2, ac-3").otherwise("avc1.4d,mp4a.40.2"), F.lit('"'),
        F.when(key % 3 != 0, _text(",RESOLUTION=", key % 640 + 1, "x", key % 360 + 1, ",FRAME-RATE=", (key % 60 + 0.5).cast("string"))).otherwise(""),
        F.lit(',AUDIO="g'), F.col("c_nationkey"), F.lit('"'), F.when(key % 7 != 0, _text("\n v", key, ".m3u8")).otherwise(""),
    )
    streams = b.table(spark, sf_dir, "customer").groupBy(group.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(key.alias("k"), tag.alias("line")))).getField("line").alias("lines")
    ).select(_text("m", F.col("part")).alias("playlist_id"), "lines")
    supplier = F.col("s_suppkey")
    media_tag = F.concat(
        F.lit("#EXT-X-MEDIA:TYPE="), F.when(supplier % 4 == 3, "SUBTITLES").otherwise("AUDIO"),
        F.lit(',GROUP-ID="g'), F.col("s_nationkey"), F.lit('"'), F.when(supplier % 9 == 0, "").otherwise(_text(',NAME="', F.col("s_name"), '"')),
        F.when(supplier % 3 != 0, _text(',URI="../a/', supplier, '.m3u8"')).otherwise(""),
        F.when(supplier % 2 == 0, ',LANGUAGE="en",CHANNELS="6/JOC"').otherwise(',CHANNELS="2"'),
        F.when(supplier % 5 == 0, ",DEFAULT=YES,AUTOSELECT=YES").otherwise(",DEFAULT=NO"),
    )
    sounds = b.table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 20").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(supplier.alias("k"), media_tag.alias("line")))).getField("line").alias("lines")
    ).select(_text("r", F.col("part")).alias("playlist_id"), "lines")
    return streams.unionByName(sounds).select(
        "playlist_id",
        _text(b.CDN, "m/", F.col("playlist_id"), "/list.m3u8").alias("playlist_url"),
        _text("#EXTM3U\n# about #EXT-X-STREAM-INF\n", F.array_join("lines", "\n"), "\n").alias("content"),
    )


VARIANTS = """
c AS (
  SELECT *, 'm' || (c_custkey // 50) AS playlist_id FROM customer
), v AS (
  SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY c_custkey) - 1 AS variant_index,
         min(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END)
           OVER (PARTITION BY playlist_id ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS uri
  FROM c
), variants AS (
  SELECT playlist_id, variant_index::INTEGER AS variant_index, 'https://cdn.example/m/' || playlist_id || '/v' || uri || '.m3u8' AS url,
         CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 1000)::DOUBLE END AS bandwidth,
         CASE WHEN c_custkey % 5 = 0 THEN 'mp4a.40.2, ac-3' ELSE 'avc1.4d,mp4a.40.2' END AS codecs,
         CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 60 + 0.5)::DOUBLE END AS frame_rate,
         CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 640 + 1 END AS width,
         CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 360 + 1 END AS height,
         'g' || c_nationkey AS audio_group_id,
         CASE WHEN uri IS NULL THEN 'a stream has no URI' WHEN c_custkey % 11 = 0 THEN 'a stream has no bandwidth' END AS error
  FROM v
)"""


@query(f"WITH {VARIANTS} SELECT * FROM variants")
def master_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.variants(_masters(spark, sf_dir))


@query("""
WITH s AS (SELECT *, 'r' || (s_suppkey // 20) AS playlist_id FROM supplier WHERE s_suppkey % 4 <> 3)
SELECT playlist_id, (row_number() OVER (PARTITION BY playlist_id ORDER BY s_suppkey) - 1)::INTEGER AS rendition_index,
       'g' || s_nationkey AS group_id, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS name,
       CASE WHEN s_suppkey % 3 <> 0 THEN 'https://cdn.example/m/a/' || s_suppkey || '.m3u8' END AS url,
       CASE WHEN s_suppkey % 2 = 0 THEN 'en' END AS language, NULL::VARCHAR AS characteristics,
       CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 2 END::BIGINT AS channels,
       s_suppkey % 5 = 0 AS is_default, s_suppkey % 5 = 0 AS auto_select,
       CASE WHEN s_suppkey % 9 = 0 THEN 'a rendition has no group or name' END AS error
FROM s
""")
def audio_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.audio_renditions(_masters(spark, sf_dir))


@query("""
SELECT DISTINCT 'm' || (c_custkey // 50) AS playlist_id, 'master' AS kind FROM customer
UNION ALL SELECT DISTINCT 'r' || (s_suppkey // 20), 'media' FROM supplier
""")
def playlist_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag makes a master, a comment about one does not."""
    return syntax.playlist_kind(_masters(spark, sf_dir))


def _renditions(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Every supplier as a rendition of its nation's group."""
    return b.table(spark, sf_dir, "supplier").select(
        *more, (F.col("s_suppkey") - 1).alias("rendition_index"), _text("g", F.col("s_nationkey")).alias("group_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 3 != 0, _text(b.CDN, "a/", F.col("s_suppkey"))).alias("url"), (F.col("s_suppkey") % 2 == 1).alias("is_default"),
    )


def _sound_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master.variants(_masters(spark, sf_dir)).where("error IS NULL")


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Variants of the sound masters, and every supplier as a rendition of eight of the
    playlists, so a shared rendition is one track of several options."""
    part = F.explode(F.sequence(F.expr("3 * s_suppkey div 10"), F.expr("3 * s_suppkey div 10 + 7")))
    suppliers = _renditions(spark, sf_dir, part.alias("part"))
    return _sound_variants(spark, sf_dir), suppliers.select(_text("m", F.col("part")).alias("playlist_id"), "*").drop("part")


def _own(held: str = "") -> str:
    """The options of each variant. ``held`` limits the playlists that have a supplier; without
    it a supplier is a rendition of all playlists that name its group."""
    return f"""{VARIANTS}, own AS (
  SELECT *, CASE WHEN codecs LIKE 'mp4a%' AND width IS NULL THEN 'audio-primary-' ELSE 'video-' END || (variant_index + 1) AS own_id
  FROM variants WHERE error IS NULL
), ext AS (
  SELECT own.playlist_id, variant_index, s_suppkey, 'audio-' || s_suppkey AS audio_id, 'https://cdn.example/a/' || s_suppkey AS audio_url
  FROM own JOIN supplier ON audio_group_id = 'g' || s_nationkey{held} WHERE s_suppkey % 3 <> 0
), opts AS (
  SELECT own.*, list_concat([own_id], coalesce((SELECT list(audio_id ORDER BY s_suppkey) FROM ext
           WHERE ext.playlist_id = own.playlist_id AND ext.variant_index = own.variant_index), [])) AS ids FROM own
)"""


OWN = _own(" AND substr(playlist_id, 2)::BIGINT BETWEEN 3 * s_suppkey // 10 AND 3 * s_suppkey // 10 + 7\n ")


@query(f"""
WITH {_own()}, t AS (
  SELECT playlist_id, own_id AS track_id, CASE WHEN own_id LIKE 'audio%' THEN 'audio' ELSE 'video' END AS type, url, variant_index AS v, -1 AS sub FROM own
  UNION ALL SELECT playlist_id, audio_id, 'audio', audio_url, min(variant_index), s_suppkey - 1 FROM ext GROUP BY ALL
)
SELECT playlist_id, track_id, type, url, (row_number() OVER (PARTITION BY playlist_id ORDER BY v, sub) - 1)::INTEGER AS track_ord FROM t
""")
def catalog_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of each sound master, with every supplier in all playlists that name its group."""
    return catalog.tracks(_sound_variants(spark, sf_dir), _renditions(spark, sf_dir))


@query(f"""
WITH {OWN}
SELECT playlist_id, (row_number() OVER (PARTITION BY playlist_id ORDER BY bandwidth DESC, variant_index) - 1)::INTEGER AS place,
       variant_index AS option_index, own_id AS track_id
FROM opts WHERE own_id LIKE 'video-%'
""")
def video_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video tracks, those of the best options first."""
    variants, _ = _catalog(spark, sf_dir)
    return catalog.video_choices(catalog.own_options(variants))


@query(f"""
WITH {OWN}
SELECT playlist_id, CASE WHEN count(*) > 1 THEN 'ask' WHEN bool_or(own_id LIKE 'video-%') AND max(len(ids)) = 1 THEN 'video'
       WHEN bool_or(own_id LIKE 'video-%') THEN 'ask' ELSE 'default' END AS choice
FROM opts GROUP BY playlist_id
""")
def automatic_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.automatic_choice(catalog.option_counts(*_catalog(spark, sf_dir)), interactive=True)


@query("""
WITH p AS (
  SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier
)
SELECT s_nationkey::VARCHAR AS playlist_id, (s_nationkey % 3)::INTEGER AS group_id,
       coalesce(min(place) FILTER (s_suppkey % 4 = 2), 0)::INTEGER AS place FROM p GROUP BY s_nationkey
""")
def initial_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the choice of audio starts: at the first default one."""
    rows = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("track_id"), "s_suppkey", (F.col("s_nationkey") % 3).alias("group_id"))
    placed = tasks.track_index(rows, "s_suppkey").select(
        F.col("track_id").alias("playlist_id"), "group_id", F.col("track_index").cast("int").alias("place"), (F.col("s_suppkey") % 4 == 2).alias("is_default")
    )
    return catalog.initial_audio_choice(placed)


@query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier)
SELECT s_nationkey::VARCHAR AS playlist_id, 'o' AS option_id, place, s_suppkey::VARCHAR AS track_id, s_name AS title FROM s
UNION ALL SELECT s_nationkey::VARCHAR, 'o', count(*), NULL, 'None' FROM supplier GROUP BY s_nationkey
""")
def audio_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio tracks of an option and, last, none of them."""
    rows = b.table(spark, sf_dir, "supplier").withColumn("track_id", F.col("s_nationkey").cast("string"))
    placed = tasks.track_index(rows, "s_suppkey").select(
        F.col("track_id").alias("playlist_id"), F.lit("o").alias("option_id"), F.col("track_index").alias("place"),
        F.col("s_suppkey").cast("string").alias("track_id"), F.col("s_name").alias("title"),
    )
    return catalog.audio_choices(placed)


@query("""
SELECT c_custkey,
       concat_ws(' · ', CASE WHEN c_custkey % 3 = 0 THEN c_custkey || 'x720' WHEN c_custkey % 3 = 1 THEN c_name ELSE 'id' || c_custkey END,
         CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 60) || ' fps' WHEN c_custkey % 4 = 1 THEN (c_custkey % 60) || '.5 fps' END,
         CASE WHEN c_custkey % 2 = 0 THEN 'avc1,mp4a' END) AS video,
       concat_ws(' · ', CASE WHEN c_custkey % 3 = 1 THEN c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (en)' ELSE '' END
                             WHEN c_custkey % 2 = 0 THEN 'en' ELSE 'id' || c_custkey END,
         CASE WHEN c_custkey % 5 = 0 THEN '6 ch' END, CASE WHEN c_custkey % 2 = 0 THEN 'avc1,mp4a' END, (c_custkey * 3) || ' kbps') AS audio,
       'video: ' || concat_ws(' · ', CASE WHEN c_custkey % 3 = 0 THEN c_custkey || 'x720' WHEN c_custkey % 3 = 1 THEN c_name ELSE 'id' || c_custkey END,
         CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 60) || ' fps' WHEN c_custkey % 4 = 1 THEN (c_custkey % 60) || '.5 fps' END,
         CASE WHEN c_custkey % 2 = 0 THEN 'avc1,mp4a' END,
         CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey // 100) || '.' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ' Mbps' END) AS choice,
       coalesce(nullif(concat_ws(' | ', CASE WHEN c_custkey % 3 = 0 THEN 'video: v, w' END, CASE WHEN c_custkey % 2 = 0 THEN 'audio: a' END,
         CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey // 100) || '.' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ' Mbps' END), ''),
         'unnamed stream option') AS option
FROM customer
""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of tracks, choices and options made from each customer."""
    key = F.col("c_custkey")
    name = F.when(key % 3 == 1, F.col("c_name")).when(key % 3 == 2, "")
    codecs = F.when(key % 2 == 0, F.array(F.lit("avc1"), F.lit("mp4a"))).otherwise(F.array().cast("array<string>"))
    rate = F.when(key % 4 == 0, (key % 60).cast("double")).when(key % 4 == 1, key % 60 + 0.5)
    sized = F.when(key % 3 == 0, key)
    video = F.struct(
        _text("id", key).alias("id"), name.alias("name"), sized.alias("width"), F.when(sized.isNotNull(), 720).alias("height"),
        rate.alias("frame_rate"), codecs.alias("codecs"),
    )
    audio = F.struct(
        _text("id", key).alias("id"), name.alias("name"), F.when(key % 2 == 0, "en").alias("language"), F.when(key % 5 == 0, 6).alias("channels"),
        codecs.alias("codecs"), (key * 3000).cast("double").alias("bandwidth"),
    )
    bandwidth = F.when(key % 5 != 0, (key * 10_000).cast("double"))
    none = F.array().cast("array<string>")
    rows = b.table(spark, sf_dir, "customer").select("c_custkey", video.alias("v"), audio.alias("a"), bandwidth.alias("w"))
    return rows.select(
        "c_custkey",
        catalog.video_title(F.col("v")).alias("video"),
        catalog.audio_title(F.col("a")).alias("audio"),
        catalog.video_choice_title(F.col("v"), F.col("w")).alias("choice"),
        catalog.option_title(
            F.when(key % 3 == 0, F.array(F.lit("v"), F.lit("w"))).otherwise(none), F.when(key % 2 == 0, F.array(F.lit("a"))).otherwise(none), F.col("w")
        ).alias("option"),
    )


@query("""
WITH m AS (
  SELECT user_id, 'k' || (user_id // 10) AS playlist_id, (user_id * 37 % 101 + 1) * 1000 AS bandwidth,
         row_number() OVER (PARTITION BY user_id // 10 ORDER BY user_id) AS n FROM (SELECT DISTINCT user_id FROM events)
), best AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY bandwidth DESC, n) = 1
), seg AS (
  SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events
)
SELECT playlist_id, 'video-' || n AS track_id, ord AS track_index, 'https://cdn.example/' || user_id || '/' || event_id || '.ts' AS url,
       CASE WHEN event_type <> 'signup' THEN CASE WHEN value = 0 THEN 5.0 ELSE value END END AS duration
FROM best JOIN seg USING (user_id)
""")
def master_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the text of a master to the items of the tracks of its default option."""
    media_texts = b.playlist_texts(spark, sf_dir)
    user = F.substring_index(F.regexp_extract("playlist_url", "example/([0-9]+)/", 1), "/", 1).cast("long")
    lines = media_texts.select(user.alias("u"), "playlist_url").select(
        F.expr("u div 10").alias("part"),
        F.struct(F.col("u"), _text("#EXT-X-STREAM-INF:BANDWIDTH=", (F.col("u") * 37 % 101 + 1) * 1000, "\n", F.col("playlist_url")).alias("line")).alias("entry"),
    )
    masters = lines.groupBy("part").agg(F.array_sort(F.collect_list("entry")).getField("line").alias("lines")).select(
        _text("k", F.col("part")).alias("playlist_id"), F.lit(b.CDN).alias("playlist_url"), F.array_join("lines", "\n").alias("content")
    )
    return archive.default_archive(masters, media_texts).select("playlist_id", "track_id", "track_index", "url", "duration")


# Texts of options --------------------------------------------------------------------


@query("""
SELECT c_custkey, 2 AS entries, c_name AS agent, 'b:' || c_custkey AS cookie FROM customer
""")
def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request headers: a line without a value is none, and of two values the last stays."""
    lines = _text("User: old\nno header\nUser: ", F.col("c_name"), "  \\nCookie:b:", F.col("c_custkey"), "\n: x")
    return b.table(spark, sf_dir, "customer").select("c_custkey", text.request_headers(lines).alias("h")).select(
        "c_custkey", F.size("h").alias("entries"), F.col("h")["User"].alias("agent"), F.col("h")["Cookie"].alias("cookie")
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS kid,
       CASE WHEN p_size % 2 = 0 THEN md5(p_partkey::VARCHAR) ELSE p_name || ',' || p_partkey END AS key FROM part
""")
def explicit_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("p_size") % 2 == 0, _text(F.col("p_brand"), ":", F.md5(F.col("p_partkey").cast("string")))).otherwise(
        _text(F.col("p_name"), ",", F.col("p_partkey"))
    )
    return b.table(spark, sf_dir, "part").select("p_partkey", text.explicit_key(written).alias("k")).select("p_partkey", "k.kid", "k.key")


@query("""
SELECT o_orderkey, o_orderkey % 50 * 60 + o_orderkey % 60 AS start,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 * 3600 + 60 + o_orderkey % 60 END AS "end" FROM orders
""")
def slice_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    end = F.when(key % 3 != 0, _text(key % 7, ":1:", key % 60)).otherwise("1:two")
    written = _text(key % 50, ":", key % 60, "-", end)
    return b.table(spark, sf_dir, "orders").select("o_orderkey", text.slice_bounds(written).alias("s")).select("o_orderkey", "s.start", "s.end")


@query("""
SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's'
       ELSE s // 3600 || 'h ' || s % 3600 // 60 || 'm ' || s % 60 || 's' END AS left_over
FROM (SELECT o_orderkey, o_orderkey * 7 % 9000 AS s FROM orders)
""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").select("o_orderkey", text.duration_text(F.col("o_orderkey") * 7 % 9000).alias("left_over"))


@query("""
WITH p AS (
  SELECT p_partkey, p_size, list_extract(['3g2','3gp','asf','avi','flv','m2ts','m4v','mkv','mov','mp4','mpe','mpeg','mpg','mts',
    'ogv','rm','rmvb','ts','vob','webm','wmv','mxf','f4v','final'], (p_partkey % 24 + 1)::INTEGER) AS e FROM part
)
SELECT p_partkey, CASE WHEN e IN ('mxf', 'f4v', 'final') THEN './a//d.x/' || p_partkey || '.' || e ELSE 'a/d.x/' || p_partkey END AS base,
       CASE WHEN e <> 'final' OR p_size % 2 = 0 THEN 'o' || CASE WHEN p_size % 3 = 0 THEN '.video-1' ELSE '' END || '.'
                 || CASE WHEN e = 'final' THEN 'x1' ELSE e END END AS container
FROM p
""")
def output_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output paths by each video extension and by others, in upper case where even."""
    names = ("3g2", "3gp", "asf", "avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpe", "mpeg", "mpg", "mts",
             "ogv", "rm", "rmvb", "ts", "vob", "webm", "wmv", "mxf", "f4v", "final")
    extension = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 24 + 1).cast("int"))
    known = ~extension.isin("mxf", "f4v", "final")
    written = F.when(known & (F.col("p_size") % 2 == 0), F.upper(extension)).otherwise(extension)
    given = F.when(extension != "final", extension).when(F.col("p_size") % 2 == 0, "x1").otherwise("too.long")
    return b.table(spark, sf_dir, "part").select(
        "p_partkey",
        output.output_base(_text("./a//d.x/", F.col("p_partkey"), ".", written)).alias("base"),
        output.container_path(F.lit("o"), F.lit("video-1"), given, F.col("p_size") % 3 == 0).alias("container"),
    )


@query("""
SELECT 'o/' || c_custkey AS base, 'ts' AS extension,
       CASE WHEN c_nationkey % 3 = 0 OR c_nationkey % 3 = 1 THEN 'o/' || c_custkey || '_77.ts' ELSE 'o/' || c_custkey || '.ts' END AS path
FROM customer
""")
def free_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are not taken, by a plain file or by the first of several runs."""
    rows = b.table(spark, sf_dir, "customer").select(_text("o/", F.col("c_custkey")).alias("base"), F.lit("ts").alias("extension"), "c_nationkey")
    there = rows.where("c_nationkey % 3 < 2").select(
        F.when(F.col("c_nationkey") % 3 == 0, _text(F.col("base"), ".ts")).otherwise(_text(F.col("base"), "_0.ts")).alias("path")
    )
    return output.free_path(rows.drop("c_nationkey"), there, 77)


# Validation, policies, sessions ------------------------------------------------------


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN 't' || (p_partkey - 1) WHEN 2 THEN '-' || p_partkey
                                 ELSE p_name || '/' || p_partkey END AS track_id FROM part)
SELECT track_id, CASE WHEN p_partkey % 4 >= 2 THEN 'a track id is malformed' ELSE 'a track id is not unique' END AS fault
FROM t WHERE p_partkey % 4 >= 2 OR EXISTS (SELECT 1 FROM t u WHERE lower(u.track_id) = lower(t.track_id) AND u.p_partkey <> t.p_partkey)
""")
def track_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that differ in case only, that begin with no letter, and that hold a slash."""
    key = F.col("p_partkey")
    named = F.when(key % 4 == 0, _text("T", key)).when(key % 4 == 1, _text("t", key - 1)).when(key % 4 == 2, _text("-", key)).otherwise(
        _text(F.col("p_name"), "/", key)
    )
    return tasks.track_faults(b.table(spark, sf_dir, "part").select(named.alias("track_id")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)
""")
def unknown_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of tracks that were never declared."""
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_partkey").alias("track_id"))
    declared = b.table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("track_id"))
    return tasks.unknown_tracks(rows, declared).drop("track_id")


@query("""
WITH e AS (
  SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN 10 WHEN user_id % 3 = 1 AND event_id % 97 = 0 THEN 1000 WHEN user_id % 3 = 1 THEN 2000 END AS total,
         count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS found FROM events
)
SELECT user_id AS track_id, CASE WHEN min(total) < max(total) THEN 'a total changes' ELSE 'a total is too small' END AS fault
FROM e GROUP BY user_id HAVING min(total) < max(total) OR max(found) > min(total)
""")
def total_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose batches declare too small or changing totals."""
    user, event = F.col("user_id"), F.col("event_id")
    total = F.when(user % 3 == 0, 10).when(user % 3 == 1, F.when(event % 97 == 0, 1000).otherwise(2000))
    rows = b.table(spark, sf_dir, "events").select(user.alias("track_id"), event.alias("batch"), F.lit(1).alias("items"), total.alias("total"))
    return tasks.total_faults(rows)


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN 'a file name is invalid' END AS fault FROM part
""")
def filename_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.when(key % 6 == 0, "").when(key % 6 == 1, "..").when(key % 6 == 2, _text("a/", key)).when(key % 6 == 3, _text("a\\", key)).when(
        key % 6 == 4, "."
    ).otherwise(_text(F.col("p_name"), ".ts"))
    return b.table(spark, sf_dir, "part").select("p_partkey", tasks.filename_fault(name).alias("fault"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'O' THEN 'stopping' WHEN o_orderstatus = 'O' THEN 'downloading'
            WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'merging' ELSE 'downloading' END ELSE 'completed' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN 'ECODE' WHEN o_orderkey % 5 = 1 THEN '503 Busy' WHEN o_orderkey % 5 = 2 THEN '404'
            WHEN o_orderkey % 5 = 3 THEN 'broken ' || o_orderkey ELSE 'UNKNOWN' END AS reason
FROM orders
""")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public states of sessions, and why their items failed."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    state = F.when(status == "O", "running").when(status == "F", "finalizing").otherwise("completed")
    http = F.when(key % 5 == 1, 503).when(key % 5 == 2, 404)
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        tasks.session_status(state, key % 2 == 0, key % 3 == 0).alias("status"),
        tasks.failure_reason(
            F.when(key % 5 == 0, "ECODE").when(key % 5 == 1, ""), http, F.when(key % 5 < 4, _text("broken ", key)), F.when(key % 5 == 1, "Busy")
        ).alias("reason"),
    )


@query("""
WITH e AS (SELECT event_id, CASE event_id % 40 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN NULL ELSE value END AS value FROM events),
s AS (SELECT *, CASE WHEN value > 0 THEN value ELSE 5 END AS sound FROM e)
SELECT event_id, least(20 * sound, 60) AS item, least(5, sound) AS poll, least(greatest(event_id % 50 * sound, 20), 60) AS refresh,
       CASE WHEN value IS NOT NULL THEN least(event_id % 9 * value, 5 * value) END AS attempt
FROM s
""")
def timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time limits by the average segment; some averages are zero, negative, or missing."""
    event = F.col("event_id")
    value = F.when(event % 40 == 0, 0.0).when(event % 40 == 1, -1.0).when(event % 40 != 2, F.col("value"))
    return b.table(spark, sf_dir, "events").select(
        "event_id",
        discovery.item_seconds(value).alias("item"),
        discovery.poll_seconds(value).alias("poll"),
        discovery.refresh_seconds(event % 50, value).alias("refresh"),
        discovery.attempt_seconds(event % 9, value).alias("attempt"),
    )


@query("""
SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'abema' WHEN page_id % 6 = 1 THEN 'hibiki' WHEN page_id % 6 IN (2, 5) THEN 'common'
                     WHEN page_id % 6 = 3 THEN 'youtube' ELSE 'stagecrowd' END AS site,
       CASE WHEN page_id % 4 = 0 THEN page_id::VARCHAR END AS item
FROM pages
""")
def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of sites by the first key and the path of the source."""
    page = F.col("page_id") % 6
    first = F.when(page == 0, "abematv-license://k").when(page.isin(1, 2), "https://k")
    path = F.when(page == 1, "d22puzix29w08m").when(page.isin(2, 3), "googlevideo").when(page == 4, "bcovlive").otherwise("")
    item = F.when(F.col("page_id") % 4 == 0, _text(F.col("url"), "/", F.col("page_id"), "/goap/x")).otherwise(F.col("url"))
    return b.table(spark, sf_dir, "pages").select(
        "page_id", discovery.site_of(first, _text(F.col("url"), path), F.lit("archive")).alias("site"), urls.site_item_name(item).alias("item")
    )


@query("""
SELECT n_nationkey AS playlist_id, 'a SAMPLE-AES key is not 32 hex digits' AS fault FROM nation WHERE n_nationkey % 4 = 1
UNION ALL SELECT n_nationkey, 'SAMPLE-AES needs exactly one explicit key' FROM nation WHERE n_nationkey % 4 IN (2, 3)
""")
def sample_aes_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as playlists whose customers are segments: one sound explicit key, one of
    wrong form, none, and two. All customers are read; clear ones need no key."""
    nations = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.lit("SAMPLE-AES").alias("method"))
    customers = b.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("AES-128").alias("method"))
    sound = F.lit("00112233445566778899aabbCCDDEEFF")
    keys = F.when(F.col("nation") % 4 == 0, F.array(sound)).when(F.col("nation") % 4 == 1, F.array(F.lit("xyz"))).when(
        F.col("nation") % 4 == 2, F.array().cast("array<string>")
    ).otherwise(F.array(sound, sound))
    rows = nations.unionByName(customers).select(F.col("nation").alias("playlist_id"), F.struct("method").alias("encryption"), keys.alias("keys"))
    return discovery.sample_aes_faults(rows, F.col("keys"))


FAULTS = (
    ("#EXTINF:4,\na.ts", None),
    ("a.ts", "a segment has no duration"),
    ("#EXTINF:4,\n#EXTINF:5,\na.ts", "a segment has several durations"),
    ("#EXTINF:4,\n#EXT-X-BYTERANGE:5@1\n#EXT-X-BYTERANGE:5@9\na.ts", "a segment has several byte ranges"),
    ('#EXT-X-MAP:BYTERANGE="9@0"\n#EXTINF:4,\na.ts', "an initialization has no URI"),
    ("#EXTINF:4,\n#EXT-X-BYTERANGE:0@0\na.ts", "a byte range is invalid"),
    ("#EXTINF:4,\n#EXT-X-BYTERANGE:2@9007199254740991\na.ts", "a byte range is invalid"),
    ('#EXT-X-MAP:URI="i",BYTERANGE="100"\n#EXTINF:4,\na.ts', "an initialization range has no offset"),
    ("#EXTINF:4,\n#EXT-X-BYTERANGE:7\na.ts", "a byte range has no offset to follow"),
    ('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k",IV=0x1\n#EXT-X-MAP:URI="i"\n#EXTINF:4,\na.ts', "an initialization is SAMPLE-AES encrypted"),
    ('#EXT-X-KEY:METHOD=AES-128,URI="k"\n#EXT-X-MAP:URI="i"\n#EXTINF:4,\na.ts', "an encrypted initialization has no IV"),
    ('#EXT-X-I-FRAMES-ONLY\n#EXT-X-KEY:METHOD=AES-128,URI="k"\n#EXTINF:4,\n#EXT-X-BYTERANGE:7@0\na.ts', "an I-frame byte range is encrypted"),
    ("#EXTINF:4,\na.ts\n#EXTINF:4,", "a tag applies to no segment"),
    ("#EXT-X-KEY:METHOD=AES-128\n#EXTINF:4,\na.ts", "a key has no URI"),
    ('#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0xGG\n#EXTINF:4,\na.ts', "an IV is malformed"),
    ('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k"\n#EXTINF:4,\na.ts', "a SAMPLE-AES key has no IV"),
    ('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k",IV=0x1,KEYFORMAT="z"\n#EXTINF:4,\na.ts', "a key format is unknown"),
    ('#EXT-X-KEY:METHOD=AES-128, URI="k"\n#EXTINF:4,\na.ts', "a key has no URI"),
)


@query(
    "WITH f AS (SELECT p_partkey, (["
    + ", ".join("NULL" if error is None else f"'{error}'" for _, error in FAULTS)
    + f"])[(p_partkey % {len(FAULTS)} + 1)::INTEGER] AS error FROM part) SELECT p_partkey::VARCHAR AS playlist_id, error FROM f WHERE error IS NOT NULL"
)
def playlist_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playlist for each part, with every kind of fault in turn."""
    body = F.element_at(F.array(*(F.lit(text_) for text_, _ in FAULTS)), (F.col("p_partkey") % len(FAULTS) + 1).cast("int"))
    texts = b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("playlist_id"), F.lit(b.CDN + "x/list").alias("playlist_url"), _text("#EXTM3U\n", body, "\n").alias("content")
    )
    return media.errors(texts).select("playlist_id", "error")


@query("""
SELECT 'u' || user_id AS track_id, count(*) AS successful, sum(CASE WHEN event_type <> 'signup' THEN value ELSE 0 END::DECIMAL(20, 6))::DOUBLE AS successful_duration,
       ((count(*)::DECIMAL(20, 10) / 8)::DECIMAL(20, 2))::VARCHAR AS chunks_per_second
FROM events WHERE event_type <> 'error' GROUP BY user_id
""")
def admitted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over eight seconds of outcomes that arrive twice: the second does not count."""
    rows = b.event_outcomes(spark, sf_dir).withColumn("arrival", F.col("event_id"))
    again = rows.withColumn("arrival", F.col("arrival") + 10_000_000).withColumn("status", F.lit("ready"))
    counted = tasks.progress(tasks.admitted(rows.unionByName(again))).where("track_id IS NOT NULL AND successful > 0")
    return tasks.rates(counted, F.lit(8)).select("track_id", "successful", "successful_duration", "chunks_per_second")


@query("""
SELECT 'u' || user_id AS track_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS track_index, event_type FROM events WHERE false
UNION ALL
SELECT track_id, event_id, ord, event_type FROM (
  SELECT 'u' || user_id AS track_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events)
WHERE event_type <> 'error'
""")
def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without merging: every ready item keeps a file of its own."""
    rows = b.event_outcomes(spark, sf_dir).withColumn("filename", F.col("event_id").cast("string"))
    kinds = b.table(spark, sf_dir, "events").select("event_id", "event_type")
    return output.kept_items(rows).withColumn("event_id", F.col("filename").cast("long")).join(kinds, "event_id").select(
        "track_id", "event_id", "track_index", "event_type"
    )


@query("""
WITH r AS (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders
)
SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey, run) - 1 AS place, c_custkey AS track_id, c_custkey || '_' || o_orderkey AS path
FROM r JOIN customer ON o_custkey = c_custkey
""")
def ordered_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs in the declared order of tracks: by nation and customer, then by run."""
    tracks = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("track_id"), (F.col("c_nationkey").cast("long") * 1_000_000_000 + F.col("c_custkey")).alias("track_ord")
    )
    runs = b.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("track_id"), F.col("o_orderkey").alias("run"), _text(F.col("o_custkey"), "_", F.col("o_orderkey")).alias("path")
    )
    return output.ordered_paths(runs, tracks)


@query("""
WITH t AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS dropped FROM events GROUP BY user_id)
SELECT 'u' || user_id AS track_id, total, dropped, CASE WHEN c_custkey IS NOT NULL THEN 'out/' || user_id END AS planned,
       CASE WHEN c_custkey IS NULL THEN 'a track has no output state' END AS fault
FROM t LEFT JOIN customer ON user_id = c_custkey AND c_nationkey < 20
""")
def session_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress beside the output state of each track; some tracks have none."""
    counted = tasks.progress(b.event_outcomes(spark, sf_dir)).where("track_id IS NOT NULL").select("track_id", "total", "dropped")
    outputs = b.table(spark, sf_dir, "customer").where("c_nationkey < 20").select(
        _text("u", F.col("c_custkey")).alias("track_id"), _text("out/", F.col("c_custkey")).alias("planned")
    )
    return output.snapshot(counted, outputs)


# Binary ------------------------------------------------------------------------------


#: The query of this name is with the others; its SQL folds the bytes bit by bit.
ORACLE["crc32_mpeg2"] = """
WITH p AS (SELECT p_partkey, list_transform(range(0, strlen(p_name)), lambda i: ('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::BIGINT) AS bytes FROM part)
SELECT p_partkey, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, byte:
         list_reduce(list_prepend(xor(crc, byte << 24), range(0, 8)), lambda c, i:
           CASE WHEN c & 2147483648 <> 0 THEN xor((c << 1) & 4294967295, 79764919) ELSE (c << 1) & 4294967295 END)) AS crc
FROM p
"""


@query("""
SELECT doc_id, md5(text) AS text_md5, octet_length(encode(text))::INTEGER AS bytes, NULL::VARCHAR AS fault
FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, NULL, NULL, 'a key is not registered' FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0
""")
def range_key_decrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte range, key lookup, decryption: each text is encrypted between other bytes of a
    resource, and comes back from its range; every fifth one's key is not known."""
    key, iv = F.md5(F.col("doc_id").cast("string")), F.lower(F.hex(F.col("doc_id") + 1))
    sealed = binary.cbc_encrypt(F.encode("text", "UTF-8"), F.unhex(key), binary.initial_vector(iv))
    docs = b.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", key.alias("key"), iv.alias("iv"), sealed.alias("sealed"))
    url = _text(b.CDN, F.col("doc_id"))
    files = docs.select(url.alias("url"), F.concat(F.encode(url, "UTF-8"), F.col("sealed"), F.encode(F.lit("tail"), "UTF-8")).alias("content"))
    items = docs.select(
        "doc_id", url.alias("url"), F.struct(F.octet_length(url).cast("long").alias("offset"), F.octet_length("sealed").cast("long").alias("length")).alias("byte_range"),
        F.struct(F.lit("aes-128-cbc").alias("scheme"), F.col("doc_id").cast("string").alias("key_id"), F.col("iv").alias("iv")).alias("encryption"),
    )
    held = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("id"), "key")
    return archive.decrypted_items(items, files, held).select(
        "doc_id", F.md5("clear").alias("text_md5"), F.octet_length("clear").alias("bytes"), "fault"
    )


@query("""
SELECT p_partkey, n AS length, array_to_string(list_transform(
         CASE WHEN n > 48 THEN range(0, (n - 49) // 160 + 1) ELSE []::BIGINT[] END, lambda k: 32 + 160 * k), ' ') AS places
FROM (SELECT p_partkey, p_partkey * 37 % 1500 AS n FROM part)
""")
def protected_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the encrypted blocks of units of many lengths."""
    n = F.col("p_partkey") * 37 % 1500
    return b.table(spark, sf_dir, "part").select(
        "p_partkey", n.alias("length"), F.array_join(binary.protected_offsets(n.cast("int")).cast("array<string>"), " ").alias("places")
    )


def _opened(docs: DataFrame, places: Column) -> DataFrame:
    """Documents whose ``data`` has been sealed at ``places`` and opened again."""
    key, iv = F.unhex(F.md5(F.coalesce("source", F.lit("")))), binary.initial_vector(F.hex("doc_id"))
    sealed = docs.withColumn("places", places).withColumn("sealed", binary.seal_blocks(F.col("data"), F.col("places"), key, iv))
    return sealed.withColumn("opened", binary.open_blocks(F.col("sealed"), F.col("places"), key, iv)).select(
        "doc_id",
        F.octet_length("sealed").alias("bytes"),
        F.size("places").alias("blocks"),
        (F.col("sealed") != F.col("data")).alias("was_sealed"),
        F.md5("opened").alias("opened_md5"),
    )


@query("""
SELECT doc_id, n AS bytes, blocks, blocks > 0 AS was_sealed, md5('e' || body) AS opened_md5 FROM (
  SELECT *, (CASE WHEN n > 48 THEN (n - 49) // 160 + 1 ELSE 0 END)::INTEGER AS blocks
  FROM (SELECT *, coalesce(text, '') AS body, (octet_length(encode(coalesce(text, ''))) + 1)::INTEGER AS n FROM documents))
""")
def opened_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a slice unit, one block of every ten sealed, and opened again."""
    docs = b.table(spark, sf_dir, "documents")
    docs = docs.withColumn("data", F.concat(F.lit(b"e"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return _opened(docs, binary.protected_offsets(F.octet_length("data")))


@query("""
SELECT doc_id, n AS bytes, blocks, blocks > 0 AS was_sealed, md5(body) AS opened_md5 FROM (
  SELECT *, (greatest(0, n // 3 // 16 - 1) + greatest(0, (n - n // 3 - 9) // 16 - 1))::INTEGER AS blocks
  FROM (SELECT *, coalesce(text, '') AS body, octet_length(encode(coalesce(text, '')))::INTEGER AS n FROM documents))
""")
def opened_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as two audio frames of one chain, of which the second has a header."""
    docs = b.table(spark, sf_dir, "documents").withColumn("data", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    size = F.octet_length("data")
    first = F.floor(size / 3).cast("int")

    def frame(start: Column, length: Column, header: int) -> Column:
        return F.struct(start.alias("start"), length.alias("length"), F.lit(header).alias("header"))

    frames = F.array(frame(F.lit(0), first, 0), frame(first, size - first, 9))
    return _opened(docs, binary.audio_places(frames))


def _packet(head: Column, body: Column) -> Column:
    """A packet of four header bytes and a body that is cut or filled up to 188."""
    return F.substring(F.concat(head, body, F.unhex(F.repeat(F.lit("ff"), 188))), 1, 188)


@query("""
SELECT event_id AS "index", user_id AS resource_id,
       CASE WHEN event_id % 11 = 0 THEN 'a packet has no sync byte' WHEN event_id % 11 = 1 THEN 'a packet is marked as faulty'
            WHEN event_id % 4 = 3 AND event_id % 11 = 2 THEN 'an adaptation field is too long' END AS fault,
       CASE WHEN event_id % 4 = 3 THEN 5 + CASE WHEN event_id % 11 = 2 THEN 184 ELSE event_id % 180 END ELSE 4 END::INTEGER AS payload_offset,
       (event_id % 16)::INTEGER AS continuity,
       CASE WHEN event_id % 11 IN (0, 1) OR (event_id % 4 = 3 AND event_id % 11 = 2) THEN NULL
            WHEN event_id % 4 = 3 THEN 183 - event_id % 180 ELSE 184 END::INTEGER AS bytes
FROM events WHERE event_id % 4 IN (1, 3) OR event_id % 11 = 0
""")
def packet_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with and without adaptation fields, sound and faulty."""
    event = F.col("event_id")

    def byte(x: Column) -> Column:
        return F.unhex(F.lpad(F.hex(x), 2, "0"))

    control = event % 4
    head = F.concat(
        F.when(event % 11 == 0, F.unhex(F.lit("46"))).otherwise(F.unhex(F.lit("47"))), F.when(event % 11 == 1, F.unhex(F.lit("81"))).otherwise(F.unhex(F.lit("01"))),
        F.unhex(F.lit("00")), byte(control * 16 + event % 16),
    )
    field = F.when(event % 11 == 2, 184).otherwise(event % 180)
    body = F.when(control == 3, F.concat(byte(field.cast("long")), F.unhex(F.lit("00")))).otherwise(F.unhex(F.lit("aa")))
    rows = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("resource_id"), event.alias("index"), _packet(head, body).alias("data"))
    return transport.payloads(rows).select(
        "index", "resource_id", "fault", "payload_offset", "continuity", F.octet_length("payload").alias("bytes")
    )


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream for each part: an association, a map, and two packets of media.

    Every tenth part's association is of a wrong table, every tenth map is too short.
    """
    key = F.col("p_partkey")

    def two(x: Column, top: int = 0) -> Column:
        return F.lpad(F.hex(x.cast("long") + top), 4, "0")

    pid, video, audio = key % 4000 + 32, key % 3000 + 4100, key % 900 + 7150
    table = F.when(key % 10 == 4, "02").otherwise("00")
    pat = F.concat(F.lit("47400010"), F.lit("00"), table, F.lit("b00d0001c10000"), F.lit("0001"), two(pid, 0xE000), F.lit("00000000"))
    types = F.when(key % 3 == 0, "db").otherwise("1b")
    short = key % 10 == 5
    entries = F.concat(types, two(video, 0xE000), F.lit("f000"), F.lit("cf"), two(audio, 0xE000), F.lit("f0022020"))
    pmt = F.concat(
        F.lit("47"), two(pid, 0x4000), F.lit("10"), F.lit("00"), F.lit("02"), F.when(short, "b002").otherwise("b019"), F.lit("0001c10000"), two(video, 0xE000),
        F.lit("f000"), entries, F.lit("00000000"),
    )
    first = F.concat(F.lit("47"), two(video, 0x4000), F.lit("10"), F.lit("000001e00000800000"))
    second = F.concat(F.lit("47"), two(audio, 0x4000), F.lit("10"), F.lit("000001c00000800000"))
    four = F.concat(*(_packet(F.unhex(x), F.unhex(F.lit(""))) for x in (pat, pmt, first, second)))
    return transport.packets(b.table(spark, sf_dir, "part").select(key.alias("resource_id"), four.alias("content")))


STREAMS = """
s AS (SELECT p_partkey AS resource_id, p_partkey % 3000 + 4100 AS video, p_partkey % 900 + 7150 AS audio, p_partkey % 3 = 0 AS sealed FROM part
      WHERE p_partkey % 10 NOT IN (4, 5)),
p AS (SELECT resource_id, video::INTEGER AS pid, 219 AS stream_type, 27 AS clear_type, 2 AS "index" FROM s WHERE sealed
      UNION ALL SELECT resource_id, audio::INTEGER, 207, 15, 3 FROM s)"""


@query(f"WITH {STREAMS} SELECT resource_id, pid, stream_type, clear_type FROM p")
def protected_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program association to program map to the encrypted streams of each resource."""
    return transport.protected_streams(_streams(spark, sf_dir))


@query(f"""WITH {STREAMS} SELECT resource_id, pid, "index", clear_type FROM p""")
def protected_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.protected_packets(_streams(spark, sf_dir)).select("resource_id", "pid", "index", "clear_type")


@query("""
SELECT p_partkey AS resource_id, CASE WHEN p_partkey % 10 = 4 THEN 'a section is of another table' ELSE 'a section is too short' END AS fault
FROM part WHERE p_partkey % 10 IN (4, 5)
""")
def table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.table_faults(_streams(spark, sf_dir))


@query("""
WITH s AS (SELECT p_partkey, unnest([p_partkey % 4000 + 32, p_partkey % 3000 + 4100, p_partkey % 900 + 7150, 0]) AS pid FROM part)
SELECT p_partkey AS resource_id, pid::INTEGER AS pid, count(*) AS packets, count(*) * 184 AS bytes FROM s GROUP BY ALL
""")
def stream_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of payload in the packets of each stream."""
    return transport.capacity(transport.payloads(_streams(spark, sf_dir)))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'a unit has no start code' WHEN 2 THEN 'a unit has no header' WHEN 3 THEN 'a header is longer than its unit'
         WHEN 4 THEN 'a unit has another length than it declares' END AS fault FROM orders
""")
def elementary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of elementary units: sound ones with and without a length, and four faults."""
    kind = F.col("o_orderkey") % 5
    start = F.when(kind == 1, "000002").otherwise("000001")
    flags = F.when(kind == 2, "00").otherwise("80")
    rest = F.when(kind == 3, "ff").otherwise("02")
    declared = F.when(kind == 4, "0009").when(F.col("o_orderkey") % 2 == 0, "0000").otherwise("0007")
    data = F.unhex(F.concat(start, F.lit("e0"), declared, flags, F.lit("00"), rest, F.lit("aabb"), F.lit("ccdd")))
    return transport.elementary(b.table(spark, sf_dir, "orders").select("o_orderkey", data.alias("data"))).select("o_orderkey", "fault")


@query("""
SELECT o_orderkey, 0 AS k, 4 AS start, (1 + o_orderkey % 40)::INTEGER AS length FROM orders
UNION ALL SELECT o_orderkey, 1, (4 + 1 + o_orderkey % 40 + 2 + 3)::INTEGER, (1 + o_orderkey % 7)::INTEGER FROM orders
""")
def nal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units behind start codes of four and three bytes, with zeros between them."""
    key = F.col("o_orderkey")

    def body(n: Column) -> Column:
        return F.concat(F.lit("65"), F.repeat(F.lit("aa"), n.cast("int")))

    data = F.unhex(F.concat(F.lit("00000001"), body(key % 40), F.lit("0000000001"), body(key % 7), F.lit("0000")))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(transport.annexb_units(data)).alias("k", "u")).select(
        "o_orderkey", "k", F.col("u.start").alias("start"), F.col("u.length").alias("length")
    )


@query("""
SELECT o_orderkey, (4 + o_orderkey % 9)::INTEGER AS bytes, '65' || repeat('aa', (o_orderkey % 9)::INTEGER) || '000001' AS unit FROM orders
""")
def emulation_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    data = F.unhex(F.concat(F.lit("65"), F.repeat(F.lit("aa"), (key % 9).cast("int")), F.lit("00000301")))
    rows = b.table(spark, sf_dir, "orders").select("o_orderkey", transport.without_emulation(data).alias("u"))
    return rows.select("o_orderkey", F.octet_length("u").alias("bytes"), F.lower(F.hex("u")).alias("unit"))


@query("""
WITH f AS (
  SELECT p_partkey, p_partkey % 3 AS codec, unnest(range(0, p_partkey % 4 + 1)) AS k,
         CASE p_partkey % 3 WHEN 0 THEN 9 + p_partkey % 200 WHEN 1 THEN 160 ELSE 2 * (p_partkey % 60 + 8) END AS length FROM part
)
SELECT p_partkey, k::INTEGER AS k, (k * length)::INTEGER AS start, length::INTEGER AS length,
       CASE codec WHEN 0 THEN 9 ELSE 0 END AS header, CASE codec WHEN 2 THEN (6)::INTEGER END AS blocks,
       CASE WHEN p_partkey % 5 = 0 THEN 'no ' || CASE codec WHEN 0 THEN 'aac' WHEN 1 THEN 'ac3' ELSE 'eac3' END || ' frame at ' || (p_partkey % 4 + 1) * length END AS fault,
       greatest(0, (length - CASE codec WHEN 0 THEN 9 ELSE 0 END - 16) // 16 * 16)::INTEGER AS sealed
FROM f
""")
def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three audio codecs, every fifth stream ending in bytes that are no frame."""
    key = F.col("p_partkey")
    codec = F.when(key % 3 == 0, "aac").when(key % 3 == 1, "ac3").otherwise("eac3")

    def hexed(x: Column, digits: int) -> Column:
        return F.lpad(F.hex(x.cast("long")), digits, "0")

    def filled(head: Column, n: Column) -> Column:
        return F.concat(head, F.repeat(F.lit("00"), n.cast("int")))

    size = key % 200 + 9
    # Seven bytes of a header without protection bit, whose last 30 bits begin with the length.
    aac = filled(F.concat(F.lit("fff050"), hexed(size * 8192, 8)), size - 7)
    words = key % 60 + 8
    eac3 = filled(F.concat(F.lit("0b77"), hexed(words - 1, 4), F.lit("3000")), 2 * words - 6)
    ac3 = filled(F.lit("0b7700000200"), F.lit(154))
    one = F.when(key % 3 == 0, aac).when(key % 3 == 1, ac3).otherwise(eac3)
    tail = F.when(key % 5 == 0, "1234").otherwise("")
    data = F.unhex(F.concat(F.repeat(one, (key % 4 + 1).cast("int")), tail))
    rows = b.table(spark, sf_dir, "part").select("p_partkey", transport.audio_frames(data, codec).alias("a"))
    return rows.select("p_partkey", F.posexplode("a.frames").alias("k", "f"), F.col("a.fault").alias("fault")).select(
        "p_partkey", "k", "f.start", "f.length", "f.header", "f.blocks", "fault",
        transport.audio_block_bytes(F.col("f.length"), F.col("f.header")).alias("sealed"),
    )


@query("""
WITH e AS (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events
)
SELECT user_id AS resource_id, event_id, CASE WHEN k > 0 OR user_id % 4 <> 0 THEN ((k + CASE WHEN user_id % 4 = 0 THEN -1 ELSE 0 END) // 4) END AS "group",
       CASE WHEN k = 0 AND user_id % 4 = 0 THEN 'a stream begins with no independent frame'
            WHEN (n - CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END + 1) // 2 % 2 <> 0 THEN 'a group is not whole' END AS fault
FROM e
""")
def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent frames of three blocks, each with a dependent one behind it: two pairs
    are a group. Every fourth user's stream begins with a dependent frame."""
    rows = b.event_segments(spark, sf_dir)
    user = F.substring("track_id", 2, 20).cast("long")
    turn = F.col("ord") + F.when(user % 4 == 0, 1).otherwise(0)
    frames = rows.select(
        user.alias("resource_id"), F.col("ord").alias("k"), "event_id", F.when(turn % 2 == 0, 0).otherwise(1).alias("stream_type"), F.lit(0).alias("substream"), F.lit(3).alias("blocks")
    )
    return transport.frame_groups(frames).select("resource_id", "event_id", "group", "fault")


def _sealed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transport stream for each document, with its key and vector: the text as slice unit
    of one picture and as frames of sound, both sealed.

    By their number the maps of some documents have no encrypted stream, are cut off, or the
    second packet of a picture that has more is lost. Texts are dealt by document, and so are
    the streams made of them, which do not compress.
    """
    key, raw = F.col("resource_id"), F.col("raw")
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).repartition("resource_id")
    # Frames of 507 bytes, seven of them a header that ends in the frame's length.
    n = F.ceil(F.octet_length("raw") / 500).cast("int")
    keyed = docs.select("*", n.alias("n"), F.unhex(F.md5(key.cast("string"))).alias("key"), binary.initial_vector(F.lower(F.hex(key))).alias("iv"))
    slice_ = F.concat(F.lit(b"\x65"), raw)
    sealed = binary.seal_blocks(slice_, binary.protected_offsets(F.octet_length(slice_)), F.col("key"), F.col("iv"))
    head, tail = F.unhex(F.lit("000001e00000800000000001")), F.lit(b"\x00")
    picture = binary.once(sealed, lambda x: F.concat(head, transport.with_emulation(x), tail))

    def frame(i: Column) -> Column:
        body = binary.part(raw, i * 500, F.lit(500))
        size = F.octet_length(body) + 7
        head = F.concat(F.unhex(F.lit("fff150")), F.unhex(F.lpad(F.hex(size.cast("long") * 8192), 8, "0")))
        blocks = binary.audio_places(F.array(F.struct(F.lit(0).alias("start"), size.alias("length"), F.lit(7).alias("header"))))
        return binary.seal_blocks(F.concat(head, body), blocks, F.col("key"), F.col("iv"))

    def spoken(i: Column) -> Column:
        body = F.when(F.col("n") > 0, frame(i)).otherwise(F.lit(b""))
        whole = binary.once(body, lambda x: F.concat(F.unhex(F.lit("000001c0")), rewrite.two_bytes(3 + F.octet_length(x)), F.unhex(F.lit("800000")), x))
        return F.struct(F.lit(257).alias("pid"), i.alias("unit"), whole.alias("data"))

    seen = F.array(F.struct(F.lit(256).alias("pid"), F.lit(0).alias("unit"), picture.alias("data")))
    every = F.concat(seen, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), spoken))
    units = keyed.select("resource_id", "key", "iv", F.octet_length(raw).alias("bytes"), F.inline(every))
    media_packets = rewrite.packetised(units, keep=["key", "iv", "bytes"])
    place = (F.when(F.col("pid") == 256, 0).otherwise(1_000_000) + F.col("unit")).cast("long") * 1_000_000 + F.col("k")
    lost = (key % 11 == 5) & (F.col("pid") == 256) & (F.col("k") == 1) & (F.col("bytes") > 400)
    types = F.when(key % 11 == 3, F.lit("1be100f0000fe101f000")).otherwise("dbe100f000cfe101f000")
    size = F.when(key % 11 == 4, "b016").otherwise("b017")
    pmt = F.concat(F.lit("4750001000"), F.lit("02"), size, F.lit("0001c10000e100f000"), types, F.lit("00000000"))
    pat = "474000100000b00d0001c100000001f00000000000"
    return (
        media_packets.where(~lost)
        .select("resource_id", "key", "iv", place.alias("at"), "data")
        .groupBy("resource_id")
        .agg(F.first("key").alias("key"), F.first("iv").alias("iv"), F.expr("listagg(data) WITHIN GROUP (ORDER BY at)").alias("media"))
        .select("resource_id", F.concat(_packet(F.unhex(F.lit(pat)), F.lit(b"")), _packet(F.unhex(pmt), F.lit(b"")), "media").alias("content"), "key", "iv")
    )


def _slice_of(payload: Column) -> Column:
    """A payload of one slice unit without its start code and the zero behind it."""
    return binary.part(payload, 3, F.octet_length(payload) - 4)


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 11 = 3 THEN 'no stream is encrypted' WHEN doc_id % 11 = 4 THEN 'an entry of a map is cut off'
                     WHEN doc_id % 11 = 5 AND n > 400 THEN 'a counter does not follow the one before it' END AS fault FROM d)
SELECT doc_id AS resource_id, fault, CASE WHEN fault IS NULL THEN md5('e' || text) END AS picture_md5, CASE WHEN fault IS NULL THEN md5(text) END AS sound_md5,
       CASE WHEN fault IS NULL THEN greatest(1, (n + 499) // 500) END AS sound_units,
       CASE WHEN fault IS NULL THEN '1b0f' END AS types, CASE WHEN fault IS NULL THEN true END AS whole
FROM f
""")
def clear_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed transport streams to clear ones, which are then read as any stream is: each
    document comes back as picture and as sound, the map tells clear types, its check sum
    holds, and all packets are there.

    All is one pass over the texts, dealt by document; the clear packets are dealt once more."""
    found = clear_stream.clear_streams(_sealed_streams(spark, sf_dir).withColumn("before", F.octet_length("content")))
    own = ["told", "before", "after"]
    packets = transport.packets(found.select("resource_id", "content", F.col("fault").alias("told"), "before", F.octet_length("content").alias("after")), keep=own)
    rows = transport.packet_fields(packets).where("index IS NULL OR held AND pid IN (256, 257, 4096)")
    held = clear_stream.elementary_bytes(rows, own)
    section = transport.section(F.col("data"), transport.MAP)
    types = F.transform(rewrite.map_entries(section)["entries"], lambda e: F.lpad(F.lower(F.hex(e["stream_type"].cast("long"))), 2, "0"))
    size = F.octet_length("section")
    summed = binary.crc32_mpeg2(binary.part(F.col("section"), 0, size - 4)) == F.conv(F.hex(binary.part(F.col("section"), size - 4, F.lit(4))), 16, 10).cast("long")
    spoken = F.when(F.col("pid") == 257, binary.part(F.col("payload"), 7, F.octet_length("payload")))
    told = (
        held.withColumn("section", F.when(F.col("pid") == 4096, section))
        .withColumn("summed", F.when(F.col("section").isNotNull(), summed))
        .withColumn("types", F.when(F.col("pid") == 4096, F.array_join(types, "")))
        .withColumn("picture_md5", F.when(F.col("pid") == 256, F.md5(_slice_of(F.col("payload")))))
        .withColumn("body", spoken)
    )
    return (
        told.groupBy("resource_id")
        .agg(
            *(F.first(c).alias(c) for c in own),
            *(F.max(c).alias(c) for c in ("picture_md5", "types", "summed")),
            F.md5(F.expr("listagg(body) WITHIN GROUP (ORDER BY unit)")).alias("sound_md5"),
            F.nullif(F.count_if(F.col("pid") == 257), F.lit(0).cast("long")).alias("sound_units"),
        )
        .select(
            "resource_id", F.col("told").alias("fault"), "picture_md5", "sound_md5", "sound_units", "types",
            F.when(F.col("told").isNull(), F.col("summed") & (F.col("after") == F.col("before"))).alias("whole"),
        )
    )


@query("""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://[^?#]*(.*)$', 1) AS tail, url FROM pages
)
SELECT page_id, url AS same, scheme || '://' || host || path || tail AS written, 'http://' || host || ':443' || path AS port,
       scheme || '://' || host || '/%C3%A9%20' || page_id || '?q=%22%C3%A9%22' AS escapes, NULL::VARCHAR AS bad
FROM p
""")
def url_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs as they are, and written in other ways that mean the same."""
    url = F.col("url")
    scheme, host, path = F.regexp_extract(url, "^([a-z]+)://", 1), urls.authority(url), urls.url_path(url)
    tail = F.regexp_extract(url, r"^[a-z]+://[^?#]*(.*)$", 1)
    default = F.when(scheme == "https", ":443").otherwise(":0080")
    odd = _text(F.upper(scheme), ":\\\\", F.upper(host), default, "/.\\x/%2E./", "\t", F.substring(path, 2, 10_000), tail, " ")
    return b.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.normalised(url).alias("same"),
        urls.normalised(odd).alias("written"),
        urls.normalised(_text("http://", host, ":443", path)).alias("port"),
        urls.normalised(_text(scheme, "://", host, "/é ", F.col("page_id"), '?q="é"')).alias("escapes"),
        urls.normalised(_text(scheme, "://", host, ":port", path)).alias("bad"),
    )
