"""Binary expressions: byte access, CRC-32/MPEG-2, AES-128-CBC with and without padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(data: Column, place: Column | int) -> Column:
    """Unsigned byte at a 0-based place, null beyond the end."""
    at = place + 1 if isinstance(place, Column) else F.lit(place + 1)
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).try_cast("int")


def part(data: Column, start: Column | int, length: Column | int) -> Column:
    at = start + 1 if isinstance(start, Column) else F.lit(start + 1)
    size = length if isinstance(length, Column) else F.lit(length)
    return F.substring(data, at, size)


def byte_values(data: Column) -> Column:
    """All bytes as an array of whole numbers, decoded once."""
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).otherwise(F.array().cast("array<int>"))
    digits = F.struct(F.hex(data).alias("hex"), places.alias("places"))

    def decoded(x: Column) -> Column:
        return F.transform(x["places"], lambda i: F.conv(F.substring(x["hex"], 2 * i + 1, F.lit(2)), 16, 10).cast("int"))

    return once(digits, decoded)


def crc32_mpeg2(data: Column) -> Column:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    size = F.octet_length(data)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    top, mask, polynomial = F.lit(0x80000000), F.lit(0xFFFFFFFF), F.lit(0x04C11DB7)

    def bit(crc: Column, _: Column) -> Column:
        moved = F.shiftleft(crc, 1).bitwiseAND(mask)
        return F.when(crc.bitwiseAND(top) != 0, moved.bitwiseXOR(polynomial)).otherwise(moved)

    def byte(crc: Column, place: Column) -> Column:
        fed = crc.bitwiseXOR(F.shiftleft(byte_at(data, place).cast("long"), 24))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), fed, bit)

    return F.aggregate(places, F.lit(0xFFFFFFFF).cast("long"), byte)


def initial_vector(iv: Column) -> Column:
    """Hex digits padded on the left to 16 bytes."""
    return F.unhex(F.lpad(iv, 32, "0"))


def cbc_decrypt(data: Column, key: Column, iv: Column) -> Column:
    """Padded AES-CBC; ``iv`` and ``key`` are binary."""
    return F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS"))


def cbc_encrypt(data: Column, key: Column, iv: Column) -> Column:
    """Padded AES-CBC without the vector in front."""
    whole = F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv)
    return F.substring(whole, F.lit(17), F.octet_length(whole) - 16)


def cbc_decrypt_blocks(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC of whole blocks without padding: a block that decrypts to padding is added."""
    last = F.substring(data, F.octet_length(data) - 15, F.lit(16))
    padding = cbc_encrypt(F.lit(b""), key, last)
    return F.when(F.octet_length(data) == 0, data).otherwise(cbc_decrypt(F.concat(data, padding), key, iv))


def protected_offsets(length: Column) -> Column:
    """Places of the encrypted 16-byte blocks of a slice unit: 32 clear bytes, then one
    block of every ten; units of 48 bytes and less are clear."""
    return F.when(length > 48, F.sequence(F.lit(32), length - 17, F.lit(160))).otherwise(
        F.array().cast("array<int>")
    )


def audio_places(frames: Column) -> Column:
    """Places of the encrypted blocks of audio frames (``start, length, header``): all whole
    blocks of a frame behind its header and 16 more bytes."""

    def of_frame(f: Column) -> Column:
        first = f["start"] + f["header"] + 16
        blocks = F.floor((f["length"] - f["header"] - 16) / 16).cast("int")
        return F.when(blocks > 0, F.sequence(first, first + 16 * (blocks - 1), F.lit(16))).otherwise(
            F.array().cast("array<int>")
        )

    return F.flatten(F.transform(frames, of_frame))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _changed(data: Column, places: Column, change: Callable[[Column], Column]) -> Column:
    """``data`` with its blocks at ``places``, which ascend, changed as one run of bytes."""

    def spliced(x: Column) -> Column:
        data, places = x["data"], x["places"]
        size = F.octet_length(data)

        def piece(p: Column, k: Column) -> Column:
            until = F.coalesce(F.try_element_at(places, k + 2), size)
            return F.concat(F.hex(part(x["blocks"], 16 * k, F.lit(16))), F.hex(part(data, p + 16, until - p - 16)))

        head = part(data, F.lit(0), F.try_element_at(places, F.lit(1)))
        return F.when(F.size(places) == 0, data).otherwise(
            F.concat(head, F.unhex(F.array_join(F.transform(places, piece), "")))
        )

    def changed(x: Column) -> Column:
        found = F.unhex(F.array_join(F.transform(x["places"], lambda p: F.hex(part(x["data"], p, F.lit(16)))), ""))
        blocks = once(found, change)
        return once(F.struct(x["data"].alias("data"), x["places"].alias("places"), blocks.alias("blocks")), spliced)

    return once(F.struct(data.alias("data"), places.alias("places")), changed)


def open_blocks(data: Column, places: Column, key: Column, iv: Column) -> Column:
    """``data`` with its blocks of 16 bytes at ``places`` decrypted as one AES-CBC chain.

    A slice unit is a chain, an AAC or AC-3 frame is one, and so is a whole group of E-AC-3
    frames. No place leaves the data as it is.
    """
    return _changed(data, places, lambda blocks: cbc_decrypt_blocks(blocks, key, iv))


def seal_blocks(data: Column, places: Column, key: Column, iv: Column) -> Column:
    """The inverse of :func:`open_blocks`."""
    return _changed(data, places, lambda blocks: cbc_encrypt(blocks, key, iv))


def inline_key(uri: Column) -> Column:
    """Hex of the bytes of a data URI: its data without a fragment and percent escapes,
    decoded if the URI says that it is base64. Null for what is no data URI, or no base64."""
    head = F.regexp_extract(uri, r"^[dD][aA][tT][aA]:([^,]*),", 1)
    body = F.regexp_extract(uri, r"^[dD][aA][tT][aA]:[^,]*,([^#]*)", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(%[0-9A-Fa-f]{2}|(?s:.))"), 1)
    whole = F.array_join(
        F.transform(parts, lambda p: F.when(F.length(p) == 3, F.substr(p, F.lit(2))).otherwise(F.hex(F.encode(p, "UTF-8")))), ""
    )

    def decoded(digits: Column) -> Column:
        letters = F.regexp_replace(F.decode(F.unhex(digits), "UTF-8"), r"[\s=]", "")
        padded = F.rpad(letters, F.ceil(F.length(letters) / 4).cast("int") * 4, F.lit("="))
        return F.hex(F.try_to_binary(padded, F.lit("base64")))

    is_base64 = F.lower(head).rlike(r";\s*base64\s*$")
    return F.when(uri.rlike("^[dD][aA][tT][aA]:[^,]*,"), F.lower(once(whole, lambda x: F.when(is_base64, decoded(x)).otherwise(x))))
