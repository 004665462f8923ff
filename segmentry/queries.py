"""Registered queries: the manifest operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry import choice_queries, more_queries, stream_queries
from segmentry.functions import binary, text, urls
from segmentry.operators import catalog, discovery, master, media, output, syntax, tasks, transport
from segmentry.plans import archive
from segmentry.sources import bindings as b
from segmentry.sources.playlists import config_options


def media_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every user's playlist that overlap [60, 600) seconds."""
    return archive.archive_items(b.playlist_lines(spark, sf_dir), 60, 600).select(
        "track_id", "item_ord", "track_index", "kind", "sequence_id", "url", "duration"
    )


def segment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.segments(b.playlist_lines(spark, sf_dir)).select(
        "playlist_id", "seg_ord", "kind", "url", "duration", "sequence_id",
        F.col("encryption.method").alias("method"), F.col("encryption.key_id").alias("key_id"),
        F.col("encryption.key_kind").alias("key_kind"), F.col("encryption.iv").alias("iv"),
    )


def playlist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.summary(b.playlist_lines(spark, sf_dir)).withColumn(
        "average_duration", F.round("average_duration", 6)
    )


def playlist_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.keys(b.playlist_lines(spark, sf_dir)).select("playlist_id", "id", "key_kind")


def playlist_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First faults of playlists that are cut off after their last duration tag."""
    cut = b.playlist_texts(spark, sf_dir).withColumn(
        "content", F.regexp_replace("content", r"(?s)\r\n[^\r]*\z", "")
    )
    return media.errors(cut).select("playlist_id", "error")


def byte_range_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranges of their order: the first and each fifth line have an offset."""
    rows = b.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(*(c for c in rows.columns if c != "l_orderkey"))
    size = F.col("l_quantity").cast("long")
    ranges = (
        rows.withColumn("line_no", F.row_number().over(order) - 1)
        .select(
            F.col("l_orderkey").alias("playlist_id"),
            "line_no",
            F.lit(True).alias("is_uri"),
            F.concat(F.lit("r"), "l_orderkey").alias("url"),
            F.struct(
                size.alias("length"),
                F.when(F.col("line_no") % 5 == 0, F.col("line_no").cast("long") * 1000).alias("offset"),
            ).alias("asked"),
        )
    )
    return media.byte_ranges(ranges).select(
        "playlist_id", "line_no", "offset", "length", urls.range_header(F.col("offset"), F.col("length")).alias("header")
    )


def iv_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.event_segments(spark, sf_dir)
    iv = F.when(F.col("event_id") % 3 == 0, F.lower(F.hex("event_id")))
    found = discovery.effective_iv(F.col("kind"), iv, F.col("ord"))
    return rows.select("event_id", found.alias("iv"), F.hex(binary.initial_vector(found)).alias("vector"))


def track_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of all tracks, and of each, where every other track declares a total."""
    rows = b.event_outcomes(spark, sf_dir)
    declared = rows.select("track_id").distinct().where("cast(substr(track_id, 2) as bigint) % 2 = 0").withColumn(
        "declared_total", F.lit(1000).cast("long")
    )
    return tasks.progress(rows, declared)


def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("track_id"))
    return tasks.expected_counts(tracks, b.event_outcomes(spark, sf_dir))


def attempt_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.outcomes(b.event_attempts(spark, sf_dir))


def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and remaining time of each track, whose clock starts at 0."""
    per_track = tasks.progress(b.event_outcomes(spark, sf_dir)).where("track_id IS NOT NULL")
    now = F.col("total") * 7919
    seconds = tasks.elapsed_seconds(F.lit(0), now)
    return per_track.select(
        "track_id",
        text.fixed(F.col("successful") / seconds, F.lit(2)).alias("chunks_per_second"),
        tasks.eta_text(F.lit(0), now, F.col("completed"), F.col("total") * 3).alias("eta"),
    )


def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tasks.task_id(tasks.track_index(b.event_segments(spark, sf_dir), "event_id"), "event_id")
    return rows.select(
        "event_id", "track_id", "task_id", "track_index", urls.item_name(F.col("track_index"), F.col("url")).alias("filename")
    )


def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each track's output stands when each 37th event has no outcome yet."""
    rows = b.event_outcomes(spark, sf_dir)
    expected = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("expected"))
    return output.completeness(rows.where("event_id % 37 <> 5"), expected)


def output_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = output.concentrated(b.event_outcomes(spark, sf_dir), "payload")
    return output.output_paths(joined, F.concat(F.lit("out/"), "track_id"), "ts").select(
        "track_id", "run", "items", "path", F.md5("payload").alias("payload_md5")
    )


def mux_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in threes are one resource: two tracks of video and one of audio."""
    rows = b.event_outcomes(spark, sf_dir).where("event_id % 3 <> 0 OR status = 'ready'")
    types = rows.select("track_id").distinct().withColumn(
        "type", F.when(F.expr("cast(substr(track_id, 2) as bigint) % 3 = 0"), "audio").otherwise("video")
    )
    numbered = tasks.track_index(rows.drop("track_index"), "event_id")
    made = archive.artifacts(numbered, types).withColumn("resource", F.expr("cast(substr(track_id, 2) as bigint) div 3"))
    return output.mux_plan(made, "resource")


def catalog_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = b.customer_variants(spark, sf_dir).select("playlist_id", "audio_group_id", "variant_index")
    linked = catalog.linked(variants, b.supplier_renditions(spark, sf_dir).drop("name", "is_default"))
    return linked.select("playlist_id", "variant_index", "audio_track_id", "audio_url", "missing")


def missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants without a group, when suppliers of small balance are no renditions."""
    few = b.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(
        F.lit("all").alias("playlist_id"), F.concat(F.lit("g"), "s_nationkey").alias("group_id")
    )
    variants = b.customer_variants(spark, sf_dir).withColumn("playlist_id", F.lit("all"))
    return master.missing_groups(variants, few).select("c_custkey", "audio_group_id")


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as keys that no line of a return holds; odd sizes have keys of another range."""
    own = F.col("p_partkey") + F.col("p_size") % 2 * 1_000_000_000
    wanted = b.table(spark, sf_dir, "part").select(own.alias("id"), "p_brand")
    held = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return discovery.missing_keys(wanted, held)


def key_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every type and user as a versioned key."""
    rows = b.table(spark, sf_dir, "events").select(
        F.concat("event_type", F.lit("/"), "user_id").alias("id"), F.col("value").alias("key"), F.col("event_id").alias("version")
    )
    return discovery.upsert_keys(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"))


def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items whose key is their part's, where it has one and it is sound."""
    parts = b.table(spark, sf_dir, "part").where("p_size % 4 <> 0").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_size") % 4 == 1, F.md5(F.col("p_partkey").cast("string"))).otherwise("short").alias("key"),
    )
    items = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.struct(
            F.lit("aes-128-cbc").alias("scheme"),
            F.col("l_partkey").cast("string").alias("key_id"),
            F.when(F.col("l_linenumber") == 1, "xyz").otherwise(F.hex("l_orderkey")).alias("iv"),
        ).alias("encryption"),
    )
    return (
        discovery.key_lookup(items, parts)
        .groupBy(F.coalesce("fault", F.lit("none")).alias("fault"))
        .agg(F.count(F.lit(1)).alias("items"), F.countDistinct("key_id").alias("keys"))
    )


def default_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = b.customer_variants(spark, sf_dir).withColumn("option_id", F.concat(F.lit("option-"), F.col("variant_index") + 1))
    best = catalog.default_option(options.withColumnRenamed("variant_index", "option_index"))
    return best.select("playlist_id", "option_id", "option_index", "bandwidth")


def stream_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of all variants: their own track and the audio tracks of their group."""
    variants = b.customer_variants(spark, sf_dir).withColumns(
        {
            "codecs": F.when(F.col("c_custkey") % 5 == 0, "mp4a.40.2, ac-3").otherwise("avc1.4d,mp4a.40.2"),
            "width": F.lit(None).cast("long"), "height": F.lit(None).cast("long"),
            "frame_rate": F.lit(None).cast("double"), "url": F.lit("https://cdn.example/v"),
        }
    )
    options = catalog.options(variants, b.supplier_renditions(spark, sf_dir))
    return options.select(
        "playlist_id", "option_id", F.size("track_ids").alias("tracks"), F.md5(F.array_join("track_ids", ",")).alias("tracks_md5")
    )


def compatible_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's suppliers as a selection from the options that its line's parts are."""
    rows = b.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.concat(F.lit("t"), F.col("l_suppkey") % 7).alias("track"), (F.col("l_partkey") % 3).alias("option")
    )
    options = rows.groupBy("l_orderkey", "option").agg(F.collect_set("track").alias("tracks"))
    offered = options.groupBy("l_orderkey").agg(F.collect_list("tracks").alias("options"))
    chosen = rows.where("track IN ('t0', 't1', 't2', 't6')").groupBy("l_orderkey").agg(F.collect_set("track").alias("selected"))
    nothing = F.array().cast("array<string>")
    return offered.join(chosen, "l_orderkey", "left").select(
        "l_orderkey", catalog.selection_fault(F.coalesce("selected", nothing), F.col("options")).alias("fault")
    )


def live_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn once: at the first refresh that shows it; turn 0 was seen before."""
    found = b.snapshots(spark, sf_dir)
    seen = found.where("sequence_id = 0").select("track_id", "kind", "identity")
    return discovery.unseen(found, seen, "refresh").select("track_id", "sequence_id", "refresh", "size")


def ad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose path is no advertisement, some being moved into such folders."""
    pages = b.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, F.regexp_replace("url", "/en/", "/tsad/"))
        .when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "/fr/", "/tspgsl/"))
        .otherwise(F.col("url")).alias("url"),
    )
    return discovery.without_ads(pages)


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return b.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.protocol(url).alias("protocol"),
        urls.authority(url).alias("host"),
        urls.url_path(url).alias("path"),
        urls.key_kind(url).alias("key_kind"),
        urls.item_name(F.col("page_id"), url).alias("filename"),
    )


def uri_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative forms against every page's URL."""
    forms = F.array(*map(F.lit, ("a.ts", "../a.ts?q=1", "/r/./b/../c.ts", "//h.example/x", "?q", "#f", "data:,x")))
    return (
        b.table(spark, sf_dir, "pages")
        .select("page_id", "url", F.explode(forms).alias("uri"))
        .select("page_id", "uri", urls.resolve(F.col("url"), F.col("uri")).alias("resolved"))
    )


def line_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("playlist_id"), F.lit(None).cast("string").alias("playlist_url"), F.col("text").alias("content")
    )
    rows = syntax.lines(docs)
    return rows.groupBy("playlist_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("characters"), F.max("line_no").alias("last_line")
    )


def attribute_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a tag line made from each customer; the segment is repeated."""
    body = F.concat(
        F.lit("BANDWIDTH="), "c_custkey", F.lit(',NAME="'), "c_name", F.lit(', a=b",SEGMENT=x,FLAG,SEGMENT='), "c_mktsegment"
    )
    a = text.attributes(text.tag_body(F.concat(F.lit("#EXT-X-T:"), body)))
    return b.table(spark, sf_dir, "customer").select("c_custkey", a.alias("a")).select(
        "c_custkey",
        F.size("a").alias("entries"),
        text.parse_int(F.col("a")["BANDWIDTH"]).alias("bandwidth"),
        F.col("a")["NAME"].alias("name"),
        F.col("a")["FLAG"].alias("flag"),
        F.col("a")["SEGMENT"].alias("segment"),
    )


def config_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of each user: the first event whose properties are an object counts."""
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("priority"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("{broken").alias("text"),
    )
    options = config_options(rows, "k long").select(
        "owner", F.col("options.k").alias("threads"), F.lit(None).cast("long").alias("source_request_attempts"),
        F.lit(None).cast("long").alias("task_attempts"),
    )
    return tasks.normalized_config(options)


def time_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as written times, sound and unsound."""
    key = F.col("o_orderkey")
    written = (
        F.when(key % 4 == 0, F.concat(key % 100, F.lit(":"), key % 61))
        .when(key % 4 == 1, F.concat(key % 10, F.lit(":"), key % 60, F.lit(":"), key % 77))
        .when(key % 4 == 2, key.cast("string"))
        .otherwise(F.concat(key, F.lit(":")))
    )
    return b.table(spark, sf_dir, "orders").select("o_orderkey", text.seconds_of(written).alias("seconds"))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two producers' items in one table, each numbered in its own order."""
    from segmentry.streaming.live import merged

    orders = b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_custkey") % 50).alias("track_id"), F.col("o_orderkey").alias("item")
    )
    events = b.table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("user_id") % 50).alias("track_id"), F.col("event_id").alias("item")
    )
    return tasks.track_index(merged([orders, events]), "item")


def packetize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of whole 188-byte parts of each document's bytes."""
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.encode("text", "UTF-8").alias("raw"))
    whole = docs.withColumn("content", F.expr("substring(raw, 1, cast(octet_length(raw) div 188 * 188 as int))"))
    rows = transport.packets(whole)
    return rows.select("resource_id", "index", "pid", "payload_unit_start", F.md5("data").alias("data_md5"))


def packet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as packets of one stream, whose units start at purchases."""
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("resource_id"),
        F.lit(256).alias("pid"),
        F.col("event_id").alias("index"),
        (F.col("event_type") == "purchase").alias("payload_unit_start"),
        F.encode(F.concat("event_id", F.lit(",")), "UTF-8").alias("payload"),
    )
    return transport.units(rows).select("resource_id", "unit", "packets", "first_index", F.md5("data").alias("data_md5"))


def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("resource_id"), F.lit(256).alias("pid"), F.col("event_id").alias("index"),
        (F.col("event_id") % 16).cast("int").alias("continuity"), (F.col("event_type") == "error").alias("discontinuity"),
    )
    return transport.continuity_faults(rows).select("resource_id", "index", "continuity", "expected")


def aes_cbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encrypted and decrypted again, with padding and as whole blocks."""
    key, iv = F.unhex(F.md5(F.col("source"))), binary.initial_vector(F.hex("doc_id"))
    data = F.encode("text", "UTF-8")
    whole = F.expr("substring(data, 1, cast(octet_length(data) div 16 * 16 as int))")
    return (
        b.table(spark, sf_dir, "documents")
        .select("doc_id", data.alias("data"), key.alias("key"), iv.alias("iv"))
        .withColumn("blocks", whole)
        .withColumn("padded", binary.cbc_encrypt(F.col("data"), F.col("key"), F.col("iv")))
        .withColumn("bare", binary.cbc_encrypt(F.col("blocks"), F.col("key"), F.col("iv")))
        .withColumn("bare", F.expr("substring(bare, 1, octet_length(blocks))"))
        .select(
            "doc_id",
            F.octet_length("padded").alias("padded_bytes"),
            (binary.cbc_decrypt(F.col("padded"), F.col("key"), F.col("iv")) == F.col("data")).alias("same_padded"),
            (binary.cbc_decrypt_blocks(F.col("bare"), F.col("key"), F.col("iv")) == F.col("blocks")).alias("same_blocks"),
        )
    )


def crc32_mpeg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = b.table(spark, sf_dir, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("data"))
    return names.select("p_partkey", binary.crc32_mpeg2(F.col("data")).alias("crc"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        media_slice, segment_parse, playlist_summary, playlist_keys, playlist_errors, byte_range_chain, iv_derivation,
        track_progress, expected_counts, attempt_outcome, progress_eta, task_ids, contiguous_prefix, output_runs,
        mux_plan, catalog_link, missing_groups, missing_keys, key_upsert, key_lookup, default_stream, stream_options,
        compatible_selection, live_dedup, ad_filter, url_parts, uri_resolution, line_normalize, attribute_map,
        config_normalize, time_fold, fan_in, packetize, packet_units, continuity, aes_cbc_roundtrip, crc32_mpeg2,
    )
}
QUERIES |= more_queries.QUERIES | choice_queries.QUERIES | stream_queries.QUERIES
