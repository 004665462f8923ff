"""Binary expressions against published vectors, transport streams, and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segmentry.functions import binary
from segmentry.operators import discovery, transport
from segmentry.sources import playlists as sources
from segmentry.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
    return value


def test_crc_check_value_and_lengths(spark):
    assert one(spark, binary.crc32_mpeg2(F.lit(b"123456789"))) == 0x0376E6E7
    for n in (0, 1, 33):
        data = random.Random(n).randbytes(n)
        assert one(spark, binary.crc32_mpeg2(F.lit(data))) == crc(data)


def test_cbc_vectors(spark):
    # The AES-128-CBC example of NIST SP 800-38A, F.2.1.
    key = F.unhex(F.lit("2b7e151628aed2a6abf7158809cf4f3c"))
    iv = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f"))
    clear = F.unhex(F.lit("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51"))
    cipher = F.unhex(F.lit("7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"))
    assert one(spark, binary.cbc_decrypt_blocks(cipher, key, iv) == clear)
    sealed = binary.cbc_encrypt(clear, key, iv)
    assert one(spark, F.substring(sealed, 1, 32) == cipher) and one(spark, binary.cbc_decrypt(sealed, key, iv) == clear)
    assert one(spark, F.hex(binary.initial_vector(F.lit("1")))) == "0" * 31 + "1"
    assert one(spark, binary.inline_key(F.lit("data:text/plain;base64,AAECAwQFBgcICQoLDA0ODw=="))) == "000102030405060708090a0b0c0d0e0f"


@pytest.mark.parametrize("length", [0, 16, 47, 48, 49, 64, 207, 208, 209, 700])
def test_protected_blocks(spark, length):
    want, at = [], 32
    while length > 48 and at + 16 < length:
        want.append(at)
        at += 160
    assert one(spark, binary.protected_offsets(F.lit(length))) == want


def packet(pid: int, payload: bytes, start: bool, counter: int) -> bytes:
    head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
    room = 184 - len(payload)
    if not room:
        return head + bytes([0x10 | counter]) + payload
    stuffing = bytes([room - 1]) + (b"\x00" + b"\xff" * (room - 2) if room > 1 else b"")
    return head + bytes([0x30 | counter]) + stuffing + payload


def table(body: bytes, table_id: int) -> bytes:
    size = len(body) + 4
    section = bytes([table_id, 0xB0 | size >> 8, size & 255]) + body
    return b"\x00" + section + crc(section).to_bytes(4, "big")


@pytest.fixture(scope="module")
def stream():
    pat = table(b"\x00\x01\xc1\x00\x00" + b"\x00\x00\xe0\x10" + b"\x00\x01\xe1\x00" + b"\x00\x02\xe2\x00", 0)
    entries = b"\xdb\xe1\x01\xf0\x02zz" + b"\x1b\xe1\x02\xf0\x00" + b"\xcf\xe1\x03\xf0\x00"
    pmt = table(b"\x00\x01\xc1\x00\x00\xe1\x01\xf0\x03abc" + entries, 2)
    return (
        packet(0, pat, True, 0) + packet(0x100, pmt, True, 0) + packet(0x101, b"A" * 184, True, 5)
        + packet(0x101, b"B" * 100, False, 6) + packet(0x101, b"C" * 50, True, 9)
    )


def test_transport_stream(spark, stream):
    resources = spark.createDataFrame([("r", bytearray(stream)), ("odd", bytearray(stream[:-1])), ("none", bytearray())], "resource_id string, content binary")
    rows = transport.packets(resources).cache()
    assert [(r["index"], r.pid) for r in rows.orderBy("index").collect()] == [(0, 0), (1, 0x100), (2, 0x101), (3, 0x101), (4, 0x101)]
    assert transport.program_map_pids(rows).first().pid == 0x100
    got = {(r.pid, r.stream_type, r.clear_type) for r in transport.protected_streams(rows).collect()}
    assert got == {(0x101, 0xDB, 0x1B), (0x103, 0xCF, 0x0F)}
    body = transport.payloads(rows.where("pid = 257"))
    assert [r.expected for r in transport.continuity_faults(body).collect()] == [7]
    units = transport.units(body).orderBy("unit").collect()
    assert [bytes(u.data) for u in units] == [b"A" * 184 + b"B" * 100, b"C" * 50] and [u.packets for u in units] == [2, 1]


def test_faulty_packets(spark):
    bad = b"\x00" * 188 + packet(1, b"x", True, 0).replace(b"\x47\x40", b"\x47\xc0", 1) + b"\x47\x00\x01\x30\xc0" + b"\xff" * 183 + b"\x47\x00\x01\x20" + b"\x00" * 184
    rows = transport.packets(spark.createDataFrame([("r", bytearray(bad))], "resource_id string, content binary"))
    got = [r.fault for r in transport.payloads(rows).orderBy("index").collect()]
    assert got == ["a packet has no sync byte", "a packet is marked as faulty", "an adaptation field is too long"]


def test_units_of_elementary_streams(spark):
    data = b"\x00\x00\x00\x01\x65abc\x00\x00\x00\x00\x01\x41d\x00\x00\x01"
    frame = b"\xff\xf1\x50\x80\x01\x3f\xfc" + b"xy"
    df = spark.createDataFrame([(bytearray(data), bytearray(frame * 3 + b"zz"), bytearray(b"\x00\x00\x03\x01a\x00\x00\x03\x04\x00\x00\x03"))], "n binary, a binary, e binary")
    row = df.select(transport.annexb_units("n"), transport.adts_frames("a"), transport.without_emulation("e")).first()
    assert [data[u.start : u.start + u.length] for u in row[0]] == [b"\x65abc", b"\x41d"]
    assert [(u.start, u.length) for u in row[1]] == [(0, 9), (9, 9), (18, 9)]
    assert bytes(row[2]) == b"\x00\x00\x01a\x00\x00\x03\x04\x00\x00\x03"
    assert [one(spark, transport.audio_block_bytes(F.lit(n), F.lit(7))) for n in (10, 23, 39, 64)] == [0, 0, 16, 32]


def test_byte_ranges_of_files(spark):
    files = spark.createDataFrame([("u", bytearray(b"0123456789"))], "url string, content binary")
    items = spark.createDataFrame([("u", (4, 5)), ("u", None), ("u", (8, 5)), ("gone", None)], "url string, byte_range struct<offset:long,length:long>")
    got = {(r.url, r.byte_range and r.byte_range.offset): (r.data and bytes(r.data), r.fault) for r in sources.byte_ranges(items, files).collect()}
    assert got[("u", 4)] == (b"45678", None) and got[("u", None)] == (b"0123456789", None)
    assert got[("u", 8)][1] == "a range is not whole" and got[("gone", None)][1] == "a resource is missing"


def test_playlist_files_and_configs(spark, tmp_path):
    (tmp_path / "a.m3u8").write_text("#EXTM3U\n#EXTINF:1,\nhttps://h/x.ts\n")
    assert sources.playlist_files(spark, str(tmp_path)).first().content.startswith("#EXTM3U")
    rows = spark.createDataFrame([(1, 0, "{broken"), (1, 1, "[1]"), (1, 2, '{"threads": 3}'), (1, 3, '{"threads": 9}')], "owner int, priority int, text string")
    assert sources.config_options(rows, "threads int").first().options.threads == 3


def run_stream(spark, tmp_path, batches, schema, make, mode="append"):
    """Feed rows file by file, and return what the query has put out."""
    source, name = tmp_path / "in", f"q{random.randrange(10**9)}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    stream = spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect()


def test_stream_dedup_is_the_batch_dedup(spark, tmp_path):
    schema = "track_id string, kind string, identity string, item_ord int"
    batches = [[("t", "media", "1", 0), ("t", "media", "2", 1)], [("t", "media", "2", 2), ("t", "media", "3", 3), ("u", "media", "2", 4)]]
    got = run_stream(spark, tmp_path, batches, schema, live.first_seen)
    every = spark.createDataFrame(sum(batches, []), schema)
    want = discovery.unseen(every, every.where("false")).collect()
    assert {(r.track_id, r.identity) for r in got} == {(r.track_id, r.identity) for r in want} and len(got) == 4


def test_stream_emits_the_contiguous_prefix(spark, tmp_path):
    schema = "track_id string, track_index long, status string, payload string"
    batches = [[("t", 1, "ready", "b"), ("u", 0, "ready", "x")], [("t", 0, "dropped", "a"), ("t", 3, "ready", "d")], [("t", 1, "ready", "twice")]]
    got = run_stream(spark, tmp_path, batches, schema, live.ordered_outcomes)
    assert [(r.track_index, r.payload) for r in sorted(got, key=lambda r: r.track_index) if r.track_id == "t"] == [(0, "a"), (1, "b")]
    assert [r.payload for r in got if r.track_id == "u"] == ["x"]


def test_refresh_policy(spark, tmp_path):
    schema = "track_id string, refresh long, status int, items int, has_end_list boolean"
    rows = [("a", 0, 500, 0, False), ("b", 0, 200, 2, False), ("b", 1, 0, 0, False), ("b", 2, 404, 0, False), ("b", 3, 200, 1, False), ("c", 0, 200, 1, True)]
    got = run_stream(spark, tmp_path, [rows[:3], rows[3:]], schema, live.refresh_policy)
    found = {}
    for r in sorted(got, key=lambda r: r.refresh):
        found.setdefault(r.track_id, []).append(r.verdict)
    assert found == {"a": ["fatal"], "b": ["ok", "retry", "ended"], "c": ["ended"]}


def test_merged_streams_and_open_totals(spark, tmp_path):
    schema = "track_id string, item int"
    got = run_stream(spark, tmp_path, [[("t", 1)], [("t", 2), ("u", 3)]], schema, lambda s: live.live_totals(live.merged([s, s])), "complete")
    assert {r.track_id: r.total for r in got} == {"t": 4, "u": 2}


def test_follow_ends_tracks_and_counts_a_refresh_once(spark, tmp_path):
    from segmentry.plans import follow
    from segmentry.streaming import runs

    sealed = '#EXT-X-KEY:METHOD=SAMPLE-AES,URI="skd://k",IV=0x1\n'
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:{}\n#EXTINF:1,\n{}.ts\n"
    base = "https://h/l.m3u8"
    first = [("a", 0, 200, base, text.format(5, "x")), ("b", 0, 200, base, "#EXTM3U\n"), ("c", 0, 200, base, text.format(0, "x")), ("d", 0, 200, base, text.format(0, "x"))]
    second = [
        ("a", 0, 200, base, text.format(9, "late")), ("a", 1, 200, base, text.format(5, "x") + "#EXTINF:1,\ny.ts\n#EXT-X-ENDLIST"), ("a", 2, 200, base, text.format(7, "z")),
        ("b", 1, 0, base, None), ("c", 1, 200, base, sealed + text.format(1, "y")), ("d", 1, 302, base, None), ("d", 2, 410, base, None),
    ]
    schema = "track_id string, refresh long, status int, playlist_url string, content string"
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for rows in (first, second):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(feed)
        runs.drain(spark.readStream.schema(schema).parquet(feed), out + "/parsing", follow.write_parsed(out + "/parsed"))
        parsed = spark.readStream.schema(follow.PARSED).parquet(out + "/parsed/batch-*")
        got = runs.drained(follow.followed(parsed), out + "/tracks").collect()
    assert sorted((r.track_id, r.refresh, r.event, r.sequence_id if r.event == "item" else r.fault) for r in got) == sorted(
        [
            ("a", 0, "item", 5), ("a", 1, "item", 6), ("a", 1, "ended", None), ("b", 1, "fatal", "status 0"), ("c", 0, "item", 0),
            ("c", 1, "fatal", "SAMPLE-AES needs exactly one explicit key"), ("d", 0, "item", 0), ("d", 2, "ended", "status 410"),
        ], key=lambda r: (r[0], r[1], r[2], str(r[3])),
    )
    assert live.poll(2.5) == {"processingTime": "2500 milliseconds"} and live.poll(0) == live.poll(None) == {"processingTime": "5000 milliseconds"}


def test_sealed_blocks(spark):
    """A chain over blocks apart from each other is that of the blocks side by side."""
    df = spark.createDataFrame([(bytearray(range(100)), [10, 26, 60])], "d binary, p array<int>")
    key, iv = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f")), F.unhex(F.lit("0f" * 16))
    sealed = binary.seal_blocks(F.col("d"), F.col("p"), key, iv)
    row = df.select(sealed.alias("s"), binary.open_blocks(sealed, F.col("p"), key, iv).alias("o"), binary.cbc_encrypt(F.substring("d", 11, 32), key, iv).alias("w")).first()
    s = bytes(row.s)
    assert bytes(row.o) == bytes(range(100)) and s[10:42] == bytes(row.w)[:32]
    assert s[:10] == bytes(range(10)) and s[42:60] == bytes(range(42, 60)) and s[76:] == bytes(range(76, 100)) and s[60:76] != bytes(range(60, 76))
