"""Transport streams as rows of packets: layout, program map, continuity, units.

Layouts of fixed place are built-in expressions over binary columns. Lists of entries
of varying length are walked by small functions in a vectorised UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from segmentry.functions.binary import byte_at, part

PACKET = 188
SYNC = 0x47
# Stream types that are encrypted, and what they are when clear.
CLEAR_TYPES = {0xDB: 0x1B, 0xCF: 0x0F, 0xC1: 0x81, 0xC2: 0x87}


def _pairs(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, IntegerType()) for n in names]))


def packets(resources: DataFrame, content: str = "content", keep: Sequence[str] | None = None) -> DataFrame:
    """``resource_id, index, pid, payload_unit_start, data`` of every 188 bytes.

    Resources whose length is not a positive multiple of that give none; with ``keep``, more
    columns that the rows have, they give one row of a null ``index``.
    """
    size = F.octet_length(content)
    sound = (size > 0) & (size % PACKET == 0)
    places = F.when(sound, F.sequence(F.lit(0), F.expr(f"cast(octet_length(`{content}`) div {PACKET} - 1 AS int)")))
    each = F.transform(places, lambda i: part(F.col(content), i * PACKET, PACKET))
    cut = (F.posexplode if keep is None else F.posexplode_outer)(each).alias("index", "data")
    return resources.select("resource_id", *(keep or ()), cut).select(
        "resource_id",
        *(keep or ()),
        F.col("index").cast("long").alias("index"),
        (byte_at(F.col("data"), 1).bitwiseAND(F.lit(0x1F)) * 256 + byte_at(F.col("data"), 2)).alias("pid"),
        (byte_at(F.col("data"), 1).bitwiseAND(F.lit(0x40)) != 0).alias("payload_unit_start"),
        "data",
    )


def packet_fields(rows: DataFrame) -> DataFrame:
    """Packets with ``payload_offset, continuity, discontinuity, fault``, with ``held``, which
    says whether there is a payload or a fault, and with the ``payload`` of those without one."""
    data = F.col("data")
    control = F.shiftright(byte_at(data, 3), 4).bitwiseAND(F.lit(3))
    adaptation = byte_at(data, 4)
    offset = F.when(F.col("control") == 3, 5 + adaptation).otherwise(4)
    some = (byte_at(data, 0) != SYNC) | F.col("control").isin(1, 3)
    return (
        rows.withColumn("control", control)
        .withColumn("payload_offset", offset)
        .withColumn("continuity", byte_at(data, 3).bitwiseAND(F.lit(0x0F)))
        .withColumn(
            "discontinuity",
            (F.col("control") == 3) & (adaptation > 0) & (byte_at(data, 5).bitwiseAND(F.lit(0x80)) != 0),
        )
        .withColumn(
            "fault",
            F.when(byte_at(data, 0) != SYNC, "a packet has no sync byte")
            .when(byte_at(data, 1).bitwiseAND(F.lit(0x80)) != 0, "a packet is marked as faulty")
            .when(F.col("payload_offset") > PACKET, "an adaptation field is too long"),
        )
        .withColumn("held", F.coalesce(some & (F.col("fault").isNotNull() | (F.col("payload_offset") < PACKET)), F.lit(False)))
        .withColumn("payload", F.when(F.col("held") & F.col("fault").isNull(), part(data, F.col("payload_offset"), PACKET)))
        .drop("control")
    )


def payloads(rows: DataFrame) -> DataFrame:
    """Packets with a payload: ``payload_offset, continuity, discontinuity, payload, fault``."""
    return packet_fields(rows).where("held").drop("held")


def continuity_faults(rows: DataFrame) -> DataFrame:
    """Payload packets whose counter does not follow the one before it in their stream."""
    order = Window.partitionBy("resource_id", "pid").orderBy("index")
    before = F.lag("continuity").over(order)
    return rows.withColumn("expected", (before + 1) % 16).where(
        F.col("expected").isNotNull() & ~F.col("discontinuity") & (F.col("continuity") != F.col("expected"))
    )


def units(rows: DataFrame) -> DataFrame:
    """Payloads joined from each unit start to the next; unit -1 begins without a start."""
    order = Window.partitionBy("resource_id", "pid").orderBy("index")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("unit", F.sum(F.col("payload_unit_start").cast("long")).over(upto) - 1)
        .groupBy("resource_id", "pid", "unit")
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.min("index").alias("first_index"),
            F.expr("listagg(payload) WITHIN GROUP (ORDER BY index)").alias("data"),
        )
    )


def section(payload: Column, table: int) -> Column:
    """A section of one packet, from its table id to its length's end.

    Null where the table is another, or the section is shorter than its check sum or
    longer than the packet: :func:`section_fault` tells which.
    """
    at = 1 + byte_at(payload, 0)
    size = byte_at(payload, at + 1).bitwiseAND(F.lit(0x0F)) * 256 + byte_at(payload, at + 2)
    return F.when(section_fault(payload, table).isNull(), part(payload, at, size + 3))


def section_fault(payload: Column, table: int) -> Column:
    at = 1 + byte_at(payload, 0)
    size = byte_at(payload, at + 1).bitwiseAND(F.lit(0x0F)) * 256 + byte_at(payload, at + 2)
    return (
        F.when(F.coalesce(byte_at(payload, at) != table, F.lit(True)), "a section is of another table")
        .when(F.coalesce(size < 4, F.lit(True)), "a section is too short")
        .when(at + 3 + size > F.octet_length(payload), "a section is longer than its packet")
    )


# Table ids of the program association and the program map.
ASSOCIATION, MAP = 0x00, 0x02


def program_map_pid(association: Column) -> Column:
    """The PID of the first program in an association section, null where it has none."""
    size = F.octet_length(association)
    places = F.when(size >= 16, F.sequence(F.lit(8), size - 8, F.lit(4)))

    def entry(at: Column) -> Column:
        program = byte_at(association, at) * 256 + byte_at(association, at + 1)
        pid = byte_at(association, at + 2).bitwiseAND(F.lit(0x1F)) * 256 + byte_at(association, at + 3)
        return F.struct(program.alias("program"), pid.alias("pid"))

    return F.try_element_at(F.filter(F.transform(places, entry), lambda e: e["program"] > 0), F.lit(1))["pid"]


def program_map_pids(rows: DataFrame) -> DataFrame:
    """``resource_id, pid`` of the first program in the association table, PID 0."""
    return (
        payloads(rows.where("pid = 0 AND payload_unit_start"))
        .select("resource_id", "index", program_map_pid(section(F.col("payload"), ASSOCIATION)).alias("pid"))
        .where("pid IS NOT NULL")
        .groupBy("resource_id")
        .agg(F.min_by("pid", "index").alias("pid"))
    )


@F.pandas_udf(_pairs("pid", "stream_type"))
def stream_entries(sections: pd.Series) -> pd.Series:
    """Elementary streams of program map sections."""

    def walk(s: bytes | None) -> list[dict] | None:
        if s is None or len(s) < 16:
            return None
        at, found = 12 + ((s[10] & 0x0F) << 8 | s[11]), []
        while at + 5 <= len(s) - 4:
            found.append({"pid": (s[at + 1] & 0x1F) << 8 | s[at + 2], "stream_type": s[at]})
            at += 5 + ((s[at + 3] & 0x0F) << 8 | s[at + 4])
        return found

    return sections.map(walk)


def first_maps(rows: DataFrame) -> DataFrame:
    """The first packet of each resource's program map."""
    found = rows.join(program_map_pids(rows), ["resource_id", "pid"]).where("payload_unit_start")
    first = F.min_by(F.struct(*(c for c in found.columns if c != "resource_id")), F.col("index"))
    return found.groupBy("resource_id").agg(first.alias("first")).select("resource_id", "first.*")


def table_faults(rows: DataFrame) -> DataFrame:
    """``resource_id, fault`` of resources whose tables cannot be read."""
    starts = payloads(rows.where("payload_unit_start"))
    pat = starts.where("pid = 0").select("resource_id", section_fault(F.col("payload"), ASSOCIATION).alias("fault"))
    pmt = payloads(first_maps(rows)).select("resource_id", section_fault(F.col("payload"), MAP).alias("fault"))
    return pat.unionByName(pmt).where("fault IS NOT NULL").groupBy("resource_id").agg(F.min("fault").alias("fault"))


def protected_packets(rows: DataFrame) -> DataFrame:
    """Packets of encrypted streams, with what they are: ``stream_type, clear_type``.

    The streams of a resource are a few; the packets stay where they are if those fit
    a broadcast, else both are dealt by resource and stream.
    """
    return rows.join(protected_streams(rows), ["resource_id", "pid"])


def capacity(rows: DataFrame) -> DataFrame:
    """Payload bytes that the packets of a stream hold."""
    return rows.groupBy("resource_id", "pid").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("payload")).alias("bytes")
    )


def elementary(units_: DataFrame) -> DataFrame:
    """Units with ``header_bytes``, ``declared`` and ``fault`` of their packet header.

    A header is the start code, the stream id, the length of what follows, two bytes of
    flags and the length of the header's rest. A declared length of 0 means all that is there;
    what lies behind a declared length is no part of the unit.
    """
    data = F.col("data")
    declared = byte_at(data, 4) * 256 + byte_at(data, 5)
    header = 9 + byte_at(data, 8)
    return units_.withColumns({"declared": declared, "header_bytes": header}).withColumn(
        "fault",
        F.when(F.coalesce(part(data, 0, 3) != F.lit(b"\x00\x00\x01"), F.lit(True)), "a unit has no start code")
        .when(F.coalesce(byte_at(data, 6).bitwiseAND(F.lit(0xC0)) != 0x80, F.lit(True)), "a unit has no header")
        .when(F.coalesce(F.octet_length(data) < header, F.lit(True)), "a header is longer than its unit")
        .when((declared > 0) & (declared + 6 > F.octet_length(data)), "a unit has another length than it declares")
        .when((declared > 0) & (declared + 6 < header), "a header is longer than its unit"),
    )


def protected_streams(rows: DataFrame) -> DataFrame:
    """``resource_id, pid, stream_type, clear_type`` of encrypted elementary streams."""
    maps = first_maps(rows)
    types = F.create_map(*(F.lit(x) for pair in CLEAR_TYPES.items() for x in pair))
    return (
        payloads(maps)
        .select("resource_id", F.explode(stream_entries(section(F.col("payload"), MAP))).alias("e"))
        .select("resource_id", F.col("e.pid").alias("pid"), F.col("e.stream_type").alias("stream_type"))
        .distinct()
        .withColumn("clear_type", F.try_element_at(types, F.col("stream_type")))
        .where("clear_type IS NOT NULL")
    )


@F.pandas_udf(_pairs("start", "length"))
def annexb_units(data: pd.Series) -> pd.Series:
    """Byte ranges of the units between start codes, without zeros around them."""

    def split(s: bytes | None) -> list[dict] | None:
        if s is None:
            return None
        found, at = [], s.find(b"\x00\x00\x01")
        while at >= 0:
            begin = at + 3
            at = s.find(b"\x00\x00\x01", begin)
            unit = s[begin : at if at >= 0 else len(s)].rstrip(b"\x00")
            if unit:
                found.append({"start": begin, "length": len(unit)})
        return found

    return data.map(split)


def _replaced(data: Column | str, found: bytes, pattern: str, by: bytes) -> Column:
    """Bytes as the characters of the same number, replaced where ``found`` is in them."""
    data = F.col(data) if isinstance(data, str) else data
    text = F.regexp_replace(F.decode(data, "ISO-8859-1"), F.lit(pattern), F.lit(by.decode("latin-1")))
    return F.when(F.contains(data, F.lit(found)), F.encode(text, "ISO-8859-1")).otherwise(data)


def without_emulation(data: Column | str) -> Column:
    """Units without the bytes 3 that keep start codes out of them."""
    return _replaced(data, b"\x00\x00\x03", r"\x00\x00\x03(?=[\x00-\x03])", b"\x00\x00")


# Bit rates of AC-3 in kbit/s by code, and audio blocks of an E-AC-3 frame by code.
AC3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
EAC3_BLOCKS = (1, 2, 3, 6)

FRAME_FIELDS = ("start", "length", "header", "stream_type", "substream", "blocks")


def _aac(s: bytes, at: int) -> tuple | None:
    if s[at : at + 1] != b"\xff" or s[at + 1 : at + 2] < b"\xf0" or len(s) < at + 7:
        return None
    return (s[at + 3] & 3) << 11 | s[at + 4] << 3 | s[at + 5] >> 5, 9 - 2 * (s[at + 1] & 1), None, None, None


def _ac3(s: bytes, at: int) -> tuple | None:
    rate, code = divmod(s[at + 4], 64) if len(s) >= at + 6 else (3, 0)
    if s[at : at + 2] != b"\x0bw" or rate == 3 or code // 2 >= len(AC3_RATES):
        return None
    # Words of two bytes in 1536 samples at 48, 44.1 and 32 kHz.
    kbit = AC3_RATES[code // 2]
    words = {0: 2 * kbit, 1: kbit * 320 // 147 + code % 2, 2: 3 * kbit}[rate]
    return 2 * words, 0, None, None, None


def _eac3(s: bytes, at: int) -> tuple | None:
    if s[at : at + 2] != b"\x0bw" or len(s) < at + 6:
        return None
    head = int.from_bytes(s[at + 2 : at + 5], "big")  # type 2, substream 3, words 11, rate 2, blocks 2
    blocks = 6 if head >> 6 & 3 == 3 else EAC3_BLOCKS[head >> 4 & 3]
    return 2 * ((head >> 8 & 0x7FF) + 1), 0, head >> 22, head >> 19 & 7, blocks


READERS = {"aac": _aac, "ac3": _ac3, "eac3": _eac3}


def _frames(s: bytes, name: str) -> tuple[list[tuple], str | None]:
    """The frames of audio, and why what is behind them is none."""
    at, frames = 0, []
    while at < len(s):
        frame = READERS[name](s, at)
        if frame is None:
            return frames, f"no {name} frame at {at}"
        if frame[0] < max(1, frame[1]) or at + frame[0] > len(s):
            return frames, f"a frame of wrong length at {at}"
        frames.append((at, *frame))
        at += frame[0]
    return frames, None


@F.pandas_udf(
    StructType([StructField("frames", _pairs(*FRAME_FIELDS)), StructField("fault", StringType())])
)
def audio_frames(data: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """Frames of audio streams (``aac``, ``ac3`` or ``eac3``) up to the first fault.

    ``header`` is the clear bytes in front of a frame; stream type, substream and number
    of audio blocks are those of E-AC-3.
    """
    found, faults = [], []
    for s, name in zip(data, codec, strict=True):
        frames, fault = (None, None) if s is None else _frames(s, name)
        found.append(frames and [dict(zip(FRAME_FIELDS, f, strict=True)) for f in frames] if s is not None else None)
        faults.append(fault)
    return pd.DataFrame({"frames": found, "fault": faults})


CHAIN_FAULTS = ("a group has too many blocks", "a group is not whole", "a stream begins with no independent frame")


@F.pandas_udf(
    StructType([StructField("frames", _pairs("start", "length", "header", "chain")), StructField("fault", StringType())])
)
def audio_chains(data: pd.Series, codec: pd.Series) -> pd.DataFrame:
    """Frames of whole units with the ``chain`` that their encrypted blocks are in, as
    :func:`frame_groups` has it for E-AC-3; any other frame is a chain of its own."""
    found, faults = [], []
    for s, name in zip(data, codec, strict=True):
        frames, fault = ([], None) if s is None else _frames(s, name)
        chains, upto, told = [], 0, [fault]
        for k, (start, length, header, kind, substream, blocks) in enumerate(frames):
            if name != "eac3":
                chain = k
            else:
                own = blocks if kind != 1 and substream == 0 else 0
                if own and upto % 6 + own > 6:
                    told.append(CHAIN_FAULTS[0])
                upto += own
                if not upto:
                    told.append(CHAIN_FAULTS[2])
                chain = (upto - 1) // 6
            chains.append({"start": start, "length": length, "header": header, "chain": chain})
        if upto % 6:
            told.append(CHAIN_FAULTS[1])
        found.append(None if s is None or fault else chains)
        faults.append(fault or min(filter(None, told), default=None))
    return pd.DataFrame({"frames": found, "fault": faults})


def frame_groups(frames: DataFrame) -> DataFrame:
    """E-AC-3 frames (``resource_id, k`` in order, and their fields) with ``group`` and ``fault``.

    A group has six audio blocks of independent frames of substream 0, and the other
    frames behind them; its encrypted blocks are one chain.
    """
    upto = Window.partitionBy("resource_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    main = (F.col("stream_type") != 1) & (F.col("substream") == 0)
    own = F.when(main, F.col("blocks")).otherwise(0)
    whole = Window.partitionBy("resource_id")
    return (
        frames.withColumn("upto", F.sum(own).over(upto))
        .withColumn("all", F.sum(own).over(whole))
        .withColumn(
            "fault",
            F.when(F.col("upto") == 0, "a stream begins with no independent frame")
            .when(main & ((F.col("upto") - own) % 6 + own > 6), "a group has too many blocks")
            .when(F.col("all") % 6 != 0, "a group is not whole"),
        )
        .withColumn("group", F.when(F.col("upto") > 0, F.expr("(upto - 1) div 6")))
        .drop("upto", "all")
    )


@F.pandas_udf(_pairs("start", "length"))
def adts_frames(data: pd.Series) -> pd.Series:
    """Frames of an AAC stream by their 12-bit sync word and 13-bit length."""

    def walk(s: bytes | None) -> list[dict] | None:
        if s is None:
            return None
        at, found = 0, []
        while at + 7 <= len(s) and s[at] == 0xFF and s[at + 1] & 0xF0 == 0xF0:
            size = (s[at + 3] & 3) << 11 | s[at + 4] << 3 | s[at + 5] >> 5
            if size < 7 or at + size > len(s):
                break
            found.append({"start": at, "length": size})
            at += size
        return found

    return data.map(walk)


def audio_block_bytes(frame_length: Column, header: Column) -> Column:
    """Encrypted bytes of an audio frame: whole blocks behind the header and 16 bytes."""
    return F.greatest(F.lit(0), F.floor((frame_length - header - 16) / 16).cast("int") * 16)


@F.pandas_udf(
    StructType([StructField("units", _pairs("prefix", "start", "end")), StructField("tail", IntegerType()), StructField("fault", StringType())])
)
def access_unit(data: pd.Series) -> pd.DataFrame:
    """The units of an access unit with the zeros and start codes in front of each, and the
    place of the zeros behind the last. One that does not begin with a start code, or has a
    unit of no bytes, is faulty."""
    units, tails, faults = [], [], []
    for s in data:
        found, tail, fault = [], None, None
        at = -1 if s is None else s.find(b"\x00\x00\x01")
        while at >= 0:
            begin = at + 3
            prefix = len(s[:at].rstrip(b"\x00")) if not found else max(len(s[:at].rstrip(b"\x00")), found[-1]["start"])
            if found:
                found[-1]["end"] = prefix
            found.append({"prefix": prefix, "start": begin, "end": None})
            at = s.find(b"\x00\x00\x01", begin)
        if s is not None and (not found or found[0]["prefix"]):
            fault = "a payload does not begin with a start code"
        elif found:
            tail = found[-1]["end"] = max(len(s.rstrip(b"\x00")), found[-1]["start"])
            if any(u["end"] <= u["start"] for u in found):
                fault = "a payload has an empty unit"
        units.append(None if s is None or fault else found)
        tails.append(tail if fault is None else None)
        faults.append(fault)
    return pd.DataFrame({"units": units, "tail": pd.array(tails, "Int32"), "fault": faults})


def with_emulation(data: Column | str) -> Column:
    """Units with a byte 3 wherever two zeros would be followed by a byte of at most 3."""
    return _replaced(data, b"\x00\x00", r"\x00\x00(?=[\x00-\x03])", b"\x00\x00\x03")
