"""Plan: transport streams with encrypted samples to clear ones, all packets kept in place.

Packets are read once and stay with their resource: windows over it tell its map and which
streams are encrypted; their packets' payloads are joined to units, which keep the packets; a
unit's payload is cut into slice units or audio frames, whose blocks are opened as chains and
joined again; the new unit is put back into the packets it came from, the rest of each being
stuffing; and the map gets clear types and a new check sum. A resource with any fault has no
content but its fault.

A resource is one row of bytes, as a segment is one file; what is dealt by a stream or a
unit is a part of it. All steps before the last deal rows by resource, so encrypted bytes,
which do not compress, are shuffled once at most, and not where the resources come dealt so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.functions import binary
from segmentry.operators import rewrite, transport

UNIT = ["resource_id", "pid", "unit"]
# Codecs of encrypted stream types.
CODECS = {0xDB: "h264", 0xCF: "aac", 0xC1: "ac3", 0xC2: "eac3"}


# Packets of a resource that are in no encrypted stream are kept in lists of so many places.
LIST = 4096


def _mapped(rows: DataFrame) -> DataFrame:
    """Packets (:func:`transport.packet_fields`) with ``map_start``, ``walked`` and ``map_fault``
    of those that start the program map of their resource, and what its ``first_map`` says:
    ``streams`` (``pid, codec``) that are encrypted, and its fault."""
    resource = Window.partitionBy("resource_id")
    payload, starts = F.col("payload"), F.col("held") & F.col("payload_unit_start")
    association = F.when(starts & (F.col("pid") == 0), transport.program_map_pid(transport.section(payload, transport.ASSOCIATION)))
    codecs = F.create_map(*(F.lit(x) for pair in CODECS.items() for x in pair))

    def streams(entries: Column) -> Column:
        told = F.transform(entries, lambda e: F.struct(e["pid"].alias("pid"), F.try_element_at(codecs, e["stream_type"]).alias("codec")))
        return F.filter(told, lambda e: e["codec"].isNotNull())

    fault = F.coalesce("fault", transport.section_fault(payload, transport.MAP), "walked.fault")
    first = F.min_by(F.struct("streams", "map_fault"), F.when(F.col("map_start"), F.col("index")))
    return (
        rows.withColumn("told_pid", association)
        .withColumn("map_pid", F.min_by("told_pid", F.when(F.col("told_pid").isNotNull(), F.col("index"))).over(resource))
        .withColumn("map_start", F.coalesce(starts & (F.col("pid") == F.col("map_pid")), F.lit(False)))
        .withColumn("walked", F.when(F.col("map_start"), rewrite.map_entries(transport.section(payload, transport.MAP))))
        .withColumn("map_fault", F.when(F.col("map_start"), fault))
        .withColumn("streams", streams(F.col("walked.entries")))
        .withColumn("first_map", first.over(resource))
        .drop("told_pid", "map_pid", "walked", "streams")
    )


def _laned(rows: DataFrame) -> DataFrame:
    """Packets of :func:`_mapped` with the ``lane`` that they are in, the PID of an encrypted
    stream or null, its ``codec``, and the ``fault`` of a packet, its map and its resource."""
    resource = Window.partitionBy("resource_id")
    own = F.try_element_at(F.filter(F.col("first_map.streams"), lambda e: e["pid"] == F.col("pid")), F.lit(-1))["codec"]
    streams, first = F.col("first_map.streams"), F.coalesce(F.col("index"), F.lit(0)) == 0
    resource_fault = (
        F.when(F.col("told").isNotNull(), F.col("told"))
        .when(F.col("first_map").isNull(), "there is no program map")
        .when(F.size(streams) == 0, "no stream is encrypted")
        .when(F.exists(streams, lambda e: ~F.array_contains("lanes", e["pid"])), "a stream has no unit")
    )
    packet_fault = F.when(F.col("lane").isNotNull(), F.col("fault"))
    return (
        rows.withColumn("codec", F.when(F.col("held"), own))
        .withColumn("lane", F.when(F.col("codec").isNotNull(), F.col("pid")))
        .withColumn("lanes", F.collect_set("lane").over(resource))
        .withColumn("own_fault", packet_fault)
        .withColumn("more_fault", F.least("map_fault", F.when(first, resource_fault)))
        .drop("lanes", "first_map", "fault", "told")
    )


def in_units(rows: DataFrame, lane: str = "lane") -> DataFrame:
    """Packets of lanes with their ``unit``, counted from 0, the payload bytes ``ahead`` of
    them in their lane, and whether their counter leaves a ``gap``."""
    order = Window.partitionBy("resource_id", lane).orderBy("index")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.sum(transport.PACKET - F.col("payload_offset")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = ~F.col("discontinuity") & (F.col("continuity") != (F.lag("continuity").over(order) + 1) % 16)
    return (
        rows.withColumn("unit", F.sum(F.col("payload_unit_start").cast("long")).over(upto) - 1)
        .withColumn("ahead", F.coalesce(ahead, F.lit(0)))
        .withColumn("gap", gap)
    )


def encrypted_units(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Packets of :func:`_laned` as ``resource_id, lane, unit, codec, data``, ``keep`` of a packet,
    and ``packets``: their ``index, data, room, from, fault, more_fault`` in order. Packets of no
    lane are in lists of :data:`LIST` places, with no data."""
    counted = in_units(rows)
    scrambled = binary.byte_at(F.col("data"), 3).bitwiseAND(F.lit(0xC0)) != 0
    fault = F.coalesce(
        "own_fault",
        F.when(scrambled, "a packet is scrambled")
        .when(F.col("gap"), "a counter does not follow the one before it")
        .when(F.col("unit") < 0, "a stream begins within a unit"),
    )
    alone, sealed = F.col("lane").isNull(), F.col("lane").isNotNull()
    # A map has a new check sum and clear types.
    remade = F.when(alone & F.col("map_start") & F.col("map_fault").isNull(), rewrite.clear_map_packet())
    packet = F.struct(
        "index", F.coalesce("new_map", "data").alias("data"), (transport.PACKET - F.col("payload_offset")).alias("room"),
        F.col("ahead").alias("from"), F.col("own_fault").alias("fault"), "more_fault",
    )
    return (
        counted.withColumn("own_fault", F.when(sealed, fault))
        .withColumn("unit", F.when(sealed, F.col("unit")).otherwise(F.expr(f"index div {LIST}")))
        .withColumn("new_map", remade)
        .withColumn("sealed", F.when(sealed, F.col("payload")))
        .groupBy("resource_id", "lane", "unit")
        .agg(
            *(F.first(c).alias(c) for c in ("codec", *keep)),
            F.sort_array(F.collect_list(packet)).alias("packets"),
            F.expr("listagg(sealed) WITHIN GROUP (ORDER BY index)").alias("data"),
        )
    )


def _opened_slices(payload: Column, parsed: Column, key: Column, iv: Column) -> Column:
    """An access unit whose slice units of types 1 and 5 and more than 48 bytes are opened."""

    def opened(x: Column) -> Column:
        raw = transport.without_emulation(x)
        return binary.once(raw, lambda r: binary.open_blocks(r, binary.protected_offsets(F.octet_length(r)), key, iv))

    def one(u: Column) -> Column:
        before = binary.part(payload, u["prefix"], u["start"] - u["prefix"])

        def body(x: Column) -> Column:
            kind = binary.byte_at(x, 0).bitwiseAND(F.lit(0x1F))
            return F.when(kind.isin(1, 5) & (F.octet_length(x) > 48), opened(x)).otherwise(x)

        return F.concat(F.hex(before), F.hex(binary.once(binary.part(payload, u["start"], u["end"] - u["start"]), body)))

    units = F.unhex(F.array_join(F.transform(parsed["units"], one), ""))
    return F.concat(units, binary.part(payload, parsed["tail"], F.octet_length(payload)))


def _opened_chains(payload: Column, frames: Column, starts: Column, key: Column, iv: Column) -> Column:
    """Audio frames whose blocks are opened; an E-AC-3 group is one chain, any other frame one each."""

    def run(own: Column) -> Column:
        start, last = F.element_at(own, 1)["start"], F.element_at(own, -1)
        data = binary.part(payload, start, last["start"] + last["length"] - start)
        places = F.transform(binary.audio_places(own), lambda p: p - start)
        return F.hex(binary.open_blocks(data, places, key, iv))

    def chain(i: Column, k: Column) -> Column:
        until = F.coalesce(F.try_element_at(starts, k + 2), F.size(frames))
        return binary.once(F.slice(frames, i + 1, until - i), run)

    return F.unhex(F.array_join(F.transform(starts, chain), ""))


def _chain_starts(frames: Column) -> Column:
    """Places of the first frames of chains: frames of a chain stand together."""
    before = F.transform(frames, lambda f, i: F.when((i == 0) | (f["chain"] != F.try_element_at(frames, i)["chain"]), i))
    return F.filter(before, lambda i: i.isNotNull())


def opened_payloads(units: DataFrame) -> DataFrame:
    """``units`` (``codec, payload, key, iv``) with ``opened`` and the ``payload_fault``."""
    payload, key, iv, video = F.col("payload"), F.col("key"), F.col("iv"), F.col("codec") == "h264"
    chains = _opened_chains(payload, F.col("frames"), F.col("starts"), key, iv)
    return (
        units.withColumn("video", transport.access_unit(F.when(video, payload)))
        .withColumn("audio", transport.audio_chains(F.when(~video, payload), F.col("codec")))
        .withColumn("payload_fault", F.coalesce("video.fault", "audio.fault"))
        .withColumn("frames", F.col("audio.frames"))
        .withColumn("starts", _chain_starts(F.col("frames")))
        .withColumn("opened", F.when(F.col("payload_fault").isNull(), F.when(video, _opened_slices(payload, F.col("video"), key, iv)).otherwise(chains)))
        .withColumn("opened", F.coalesce("opened", F.lit(b"")))
        .drop("video", "audio", "frames", "starts")
    )


def clear_units(units: DataFrame) -> DataFrame:
    """Units of :func:`encrypted_units` with ``clear``, their opened payloads and new length, if
    they tell it, or ``unit_fault``. Lists of packets of no lane have neither."""
    data, declared = F.col("data"), F.col("declared")
    end = F.when(declared > 0, declared + 6).otherwise(F.octet_length(data))
    payload = binary.part(data, F.col("header_bytes"), end - F.col("header_bytes"))
    sealed, sound = F.col("lane").isNotNull(), F.col("lane").isNotNull() & F.col("fault").isNull()
    opened = opened_payloads(transport.elementary(units).withColumn("payload", F.when(sound, payload)))
    size = F.col("header_bytes") - 6 + F.octet_length("opened")
    header = F.when(
        declared > 0,
        F.concat(binary.part(data, 0, 4), rewrite.two_bytes(F.least(size, F.lit(0xFFFF))), binary.part(data, 6, F.col("header_bytes") - 6)),
    ).otherwise(binary.part(data, 0, F.col("header_bytes")))
    fault = F.coalesce("fault", "payload_fault", F.when((declared > 0) & (size > 0xFFFF), "a clear unit is too large"))
    return opened.withColumn("unit_fault", F.when(sealed, fault)).withColumn("clear", F.when(sound, F.concat(header, F.col("opened")))).drop(
        "fault", "payload_fault", "payload", "opened", "data", "declared", "header_bytes"
    )


def filled_packets(units: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``resource_id``, ``keep`` and ``index, data, fault`` of the packets of :func:`clear_units`, which
    are filled anew from their units (see :func:`rewrite.refilled`), or stay as they are."""
    packets, clear, sealed = F.col("packets"), F.col("clear"), F.col("lane").isNotNull()
    first, last = F.element_at(packets, 1), F.element_at(packets, -1)
    fits = F.octet_length(clear) <= last["from"] + last["room"] - first["from"]
    short = F.when(~F.col("fits"), "a unit is larger than its packets")

    def cut(p: Column) -> Column:
        own = F.coalesce(p["fault"], F.when(sealed, F.coalesce("unit_fault", short)))
        return F.struct(
            p["index"].alias("index"), p["data"].alias("data"),
            F.when(sealed & F.col("fits"), binary.part(clear, (p["from"] - F.col("base")).cast("int"), p["room"])).alias("payload"),
            F.least(own, p["more_fault"]).alias("fault"),
        )

    each = units.withColumn("fits", fits).withColumn("base", first["from"]).select("resource_id", *keep, F.inline(F.transform(packets, cut)))
    new = F.when(F.col("payload").isNotNull(), rewrite.packet_of(F.col("data"), rewrite.adaptation_field(), F.col("payload")))
    return each.select("resource_id", *keep, "index", F.coalesce(new, "data").alias("data"), "fault")


def clear_streams(resources: DataFrame) -> DataFrame:
    """``resource_id, content, fault`` of resources ``resource_id, content, key, iv``, and their
    other columns; key and iv are binary, of 16 bytes.

    ``resources`` are read once, and nothing is written.
    """
    more = [c for c in resources.columns if c not in ("resource_id", "content", "key", "iv")]
    bad_size = (F.octet_length("content") == 0) | (F.octet_length("content") % transport.PACKET != 0) | F.col("content").isNull()
    bad_key = F.coalesce((F.octet_length("key") != 16) | (F.octet_length("iv") != 16), F.lit(True))
    told = F.when(bad_size, "a resource is not made of packets").when(bad_key, "a key or vector is not of 16 bytes")
    held = resources.withColumn("told", told).withColumn("content", F.when(F.col("told").isNull(), F.col("content")))
    rows = transport.packet_fields(transport.packets(held, keep=["key", "iv", "told", *more]))
    units = encrypted_units(_laned(_mapped(rows)), ["key", "iv", *more])
    return (
        filled_packets(clear_units(units), more)
        .groupBy("resource_id")
        .agg(
            *(F.first(c).alias(c) for c in more),
            F.min("fault").alias("fault"),
            F.expr("listagg(data) WITHIN GROUP (ORDER BY index)").alias("content"),
        )
        .select("resource_id", F.when(F.col("fault").isNull(), F.col("content")).alias("content"), "fault", *more)
    )


def elementary_bytes(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``UNIT, payload``: what the units of streams hold behind their headers; ``keep`` are columns
    of a resource."""
    units = in_units(rows, "pid").groupBy(*UNIT).agg(*(F.first(c).alias(c) for c in keep), F.expr("listagg(payload) WITHIN GROUP (ORDER BY index)").alias("data"))
    end = F.when(F.col("declared") > 0, F.col("declared") + 6).otherwise(F.octet_length("data"))
    return transport.elementary(units).select(*UNIT, *keep, "data", binary.part(F.col("data"), F.col("header_bytes"), end - F.col("header_bytes")).alias("payload"))
