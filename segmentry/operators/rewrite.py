"""Transport streams written anew: program maps of clear types, units refilled into packets.

Everything here is an expression over a packet, a section or a unit, or a window over the
packets of one unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.functions.binary import byte_at, byte_values, crc32_mpeg2, once, part
from segmentry.operators.transport import CLEAR_TYPES, MAP, PACKET, section

ENTRIES = "array<struct<place:int,pid:int,stream_type:int>>"
#: A section in one packet has no more entries of five bytes.
MOST_ENTRIES = 34


def byte(value: Column) -> Column:
    """One byte of a whole number from 0 to 255."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def two_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 4, "0"))


def stuffing(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("ff"), F.greatest(n, F.lit(0)).cast("int")))


def map_entries(map_section: Column) -> Column:
    """``entries`` and ``fault`` of a program map section: place, PID and type of each stream.

    A walk over entries of varying length: the state is the place of the next one. A fault
    ends it, and what was read before stays.
    """

    def walk(x: Column) -> Column:
        values, size = x["values"], F.size(x["values"])
        end = size - 4

        def at(place: Column | int) -> Column:
            return F.coalesce(F.try_element_at(values, (F.lit(place) if isinstance(place, int) else place) + 1), F.lit(0))

        def length(place: Column | int) -> Column:
            low = at(place + 1)
            return at(place).bitwiseAND(F.lit(0x0F)) * 256 + low

        start = 12 + length(10)
        fault = F.when(F.coalesce(size < 16, F.lit(True)), "a program map is too short").when(
            start > end, "the descriptors of a program are longer than its map"
        )
        state = F.struct(start.alias("at"), F.array().cast(ENTRIES).alias("entries"), fault.alias("fault"))

        def step(s: Column, _: Column) -> Column:
            place, more = s["at"], length(s["at"] + 3)
            going = s["fault"].isNull() & (place < end)
            broken = F.when(place + 5 > end, "an entry of a map is cut off").when(
                place + 5 + more > end, "the descriptors of a stream are longer than its map"
            )
            entry = F.struct(
                place.alias("place"), (at(place + 1).bitwiseAND(F.lit(0x1F)) * 256 + at(place + 2)).alias("pid"), at(place).alias("stream_type")
            )
            whole = going & broken.isNull()
            return F.struct(
                F.when(whole, place + 5 + more).otherwise(place).alias("at"),
                F.when(whole, F.array_append(s["entries"], entry)).otherwise(s["entries"]).alias("entries"),
                F.when(going, broken).otherwise(s["fault"]).alias("fault"),
            )

        done = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_ENTRIES)), state, step)
        return once(done, lambda s: F.struct(s["entries"], s["fault"]))

    return once(F.struct(byte_values(map_section).alias("values")), walk)


def clear_map(map_section: Column) -> Column:
    """A program map section whose encrypted types are clear ones, with its check sum anew.

    Null where the map cannot be read.
    """
    types = F.create_map(*(F.lit(x) for pair in CLEAR_TYPES.items() for x in pair))

    def edited(x: Column) -> Column:
        sealed = F.filter(x["walked"]["entries"], lambda e: F.map_contains_key(types, e["stream_type"]))
        body = F.substring(x["section"], F.lit(1), F.octet_length(x["section"]) - 4)
        changed = F.aggregate(
            sealed, body, lambda b, e: F.overlay(b, byte(F.element_at(types, e["stream_type"])), e["place"] + 1, F.lit(1))
        )
        summed = once(changed, lambda b: F.concat(b, F.unhex(F.lpad(F.hex(crc32_mpeg2(b)), 8, "0"))))
        return F.when(x["walked"]["fault"].isNull(), summed)

    return once(F.struct(map_section.alias("section"), map_entries(map_section).alias("walked")), edited)


def clear_map_packet() -> Column:
    """A packet that starts a program map (see :func:`transport.payloads`) with clear types, null
    where the map cannot be read; all else of a packet stays as it is."""
    data, payload = F.col("data"), F.col("payload")

    def made(x: Column) -> Column:
        after = x["at"] + F.octet_length(x["old"])
        return F.concat(part(data, 0, x["at"]), clear_map(x["old"]), part(data, after, F.lit(PACKET)))

    at = F.col("payload_offset") + 1 + byte_at(payload, 0)
    return once(F.struct(at.alias("at"), section(payload, MAP).alias("old")), made)


def packet_of(head: Column, adaptation: Column, payload: Column) -> Column:
    """188 bytes of a packet: three header bytes as in ``head``, the fourth without scrambling,
    the bytes of its adaptation field (null: none), and a payload that may be too short.

    What the payload leaves free becomes stuffing in the adaptation field, which is made
    where there is none; a field of no length grows by a byte of flags first.
    """

    def made(x: Column) -> Column:
        own, held = x["adaptation"], F.octet_length(x["adaptation"])
        free = PACKET - 4 - F.octet_length(x["payload"]) - F.when(own.isNotNull(), held + 1).otherwise(0)
        counter = byte_at(x["head"], 3).bitwiseAND(F.lit(0x0F))
        field = (
            F.when(own.isNull() & (free == 0), F.lit(b""))
            .when(own.isNull() & (free == 1), F.lit(b"\x00"))
            .when(own.isNull(), F.concat(byte(free - 1), F.lit(b"\x00"), stuffing(free - 2)))
            .when((held == 0) & (free > 0), F.concat(byte(free), F.lit(b"\x00"), stuffing(free - 1)))
            .otherwise(F.concat(byte(held + free), own, stuffing(free)))
        )
        control = F.when(own.isNull() & (free == 0), 0x10).otherwise(0x30)
        return F.when(free >= 0, F.concat(part(x["head"], 0, 3), byte(control + counter), field, x["payload"]))

    return once(F.struct(head.alias("head"), adaptation.alias("adaptation"), payload.alias("payload")), made)


def adaptation_field() -> Column:
    """The bytes of a packet's adaptation field, null where it has none."""
    told = F.shiftright(byte_at(F.col("data"), 3), 4).bitwiseAND(F.lit(2)) != 0
    return F.when(told, part(F.col("data"), 5, byte_at(F.col("data"), 4)))


def refilled(packets: DataFrame, units: DataFrame) -> DataFrame:
    """Payload packets filled with their units' new bytes: ``data`` anew, or a ``fault``.

    ``packets`` are those of :func:`transport.payloads` with their ``unit``; ``units`` have
    ``resource_id, pid, unit, clear, fault``. A packet gets as much of its unit as it held before,
    from where the packets before it end; the last ones may have less, and are stuffed.
    """
    names = ["resource_id", "pid", "unit"]
    order = Window.partitionBy(*names).orderBy("index")
    ahead, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*names)
    room = PACKET - F.col("payload_offset")
    placed = (
        packets.withColumn("room", room)
        .withColumn("from", F.coalesce(F.sum("room").over(ahead), F.lit(0)))
        .withColumn("all_room", F.sum("room").over(whole))
        .join(units.select(*names, "clear", F.col("fault").alias("unit_fault")), names)
    )
    payload = part(F.col("clear"), F.col("from").cast("int"), F.col("room"))
    fits = F.octet_length("clear") <= F.col("all_room")
    fault = F.coalesce("fault", "unit_fault", F.when(~fits, "a unit is larger than its packets"))
    return placed.withColumn("fault", fault).withColumn("data", F.when(fits, packet_of(F.col("data"), adaptation_field(), payload))).drop(
        "room", "from", "all_room", "clear", "unit_fault"
    )


def packetised(units: DataFrame, payload: str = "data", keep: Sequence[str] = ()) -> DataFrame:
    """``resource_id, pid, unit, k, data``: packets of units ``resource_id, pid, unit`` and bytes;
    ``keep`` are more columns that they have.

    The first packet of a unit is marked as its start; the last is stuffed. Counters go on
    over the units of a stream.
    """
    n = F.ceil(F.greatest(F.octet_length(payload), F.lit(1)) / (PACKET - 4)).cast("int")
    order = Window.partitionBy("resource_id", "pid").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    names = ["resource_id", "pid", "unit", *keep]
    counted = units.withColumn("n", n).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    bodies = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: part(F.col(payload), k * (PACKET - 4), F.lit(PACKET - 4)))
    each = counted.select(*names, "before", F.posexplode(bodies).alias("k", "body"))
    start = F.when(F.col("k") == 0, 0x40).otherwise(0)
    counter = (F.col("before") + F.col("k")) % 16
    head = F.concat(F.lit(b"\x47"), two_bytes(start * 256 + F.col("pid")), byte(counter))
    return each.select(*names, "k", packet_of(head, F.lit(None).cast("binary"), F.col("body")).alias("data"))
