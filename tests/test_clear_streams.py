"""Maps with clear types, units put back into packets, and whole streams made clear."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segmentry import more_queries
from segmentry.functions import binary
from segmentry.operators import rewrite, transport
from segmentry.plans import clear_stream
from segmentry.streaming import runs

KEY, IV = bytes(range(16)), bytes(range(100, 116))


def crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
    return value


def map_section(entries, info=b"", cut=0) -> bytes:
    body = b"".join(bytes([t, 0xE0 | pid >> 8, pid & 255, 0xF0, len(more)]) + more for t, pid, more in entries)
    rest = b"\x00\x01\xc1\x00\x00\xe1\x00\xf0" + bytes([len(info)]) + info + body
    size = len(rest) + 4 - cut
    whole = b"\x02" + (0xB000 | size).to_bytes(2, "big") + rest
    return whole[: size + 3 - 4] + crc(whole[: size + 3 - 4]).to_bytes(4, "big")


def test_entries_and_faults_of_maps(spark):
    three = [(0xDB, 256, b"ab"), (0x1B, 257, b""), (0xC2, 258, b"xyz")]
    cases = [
        (map_section(three, b"info"), [(0xDB, 256), (0x1B, 257), (0xC2, 258)], None),
        (map_section([]), [], None),
        (map_section(three, cut=1), [(0xDB, 256), (0x1B, 257)], "the descriptors of a stream are longer than its map"),
        (map_section(three, cut=5), [(0xDB, 256), (0x1B, 257)], "an entry of a map is cut off"),
        (map_section([], b"123", cut=2), [], "the descriptors of a program are longer than its map"),
        (b"\x02\xb0\x05\x00\x01\xc1\x00\x00", [], "a program map is too short"),
        (None, [], "a program map is too short"),
    ]
    df = spark.createDataFrame([(i, c[0] and bytearray(c[0])) for i, c in enumerate(cases)], "i int, s binary")
    for r in df.select("i", rewrite.map_entries(F.col("s")).alias("m")).collect():
        _, entries, fault = cases[r.i]
        assert ([(e.stream_type, e.pid) for e in r.m.entries], r.m.fault) == (entries, fault), r.i


def test_clear_maps_differ_in_types_and_check_sum_only(spark):
    kinds = [(0xDB, 1, b""), (0xCF, 2, b"\xdb"), (0xC1, 3, b"q"), (0xC2, 4, b""), (0x06, 5, b"\xcf")]
    clear = [(0x1B, 1, b""), (0x0F, 2, b"\xdb"), (0x81, 3, b"q"), (0x87, 4, b""), (0x06, 5, b"\xcf")]
    df = spark.createDataFrame([(bytearray(map_section(kinds, b"\xdb\xdb")),), (bytearray(map_section(kinds, cut=1)),)], "s binary")
    got = [r[0] for r in df.select(rewrite.clear_map(F.col("s"))).collect()]
    assert bytes(got[0]) == map_section(clear, b"\xdb\xdb") and got[1] is None


@pytest.mark.parametrize("held", [None, 0, 1, 40, 183])
def test_packets_of_every_payload_length(spark, held):
    """Adaptation fields as the standard counts them: a length, flags, stuffing of 0xFF."""
    field = None if held is None else bytes([0x10] + [0xAA] * (held - 1))[:held]
    room = 184 if held is None else 183 - held
    rows = [(n, bytearray(b"\x47\x41\x00\xd7"), None if field is None else bytearray(field), bytearray(bytes([7]) * n)) for n in {0, 1, room // 2, room - 2, room - 1, room, room + 1} if n >= 0]
    df = spark.createDataFrame(rows, "n int, head binary, field binary, payload binary")
    for r in df.select("n", rewrite.packet_of(F.col("head"), F.col("field"), F.col("payload")).alias("p")).collect():
        if r.n > room:
            assert r.p is None
            continue
        p, free = bytes(r.p), room - r.n
        assert len(p) == 188 and p[:3] == b"\x47\x41\x00" and p[188 - r.n :] == bytes([7]) * r.n
        if held is None and free == 0:
            assert p[3] == 0x17
            continue
        size = p[4]
        assert p[3] == 0x37 and 5 + size + r.n == 188
        own = field or b""
        assert p[5 : 5 + len(own)] == own
        grown = p[5 + len(own) : 5 + size]
        flags = b"\x00" if not own and grown else b""
        assert grown == flags + b"\xff" * (len(grown) - len(flags))


def packets_of(unit: bytes, pid: int, counter: int, fields=()) -> list[bytes]:
    """Packets of a unit; ``fields`` are adaptation fields of the first of them, then stuffing."""
    out, at, k = [], 0, 0
    while at < len(unit) or not out:
        field = fields[k] if k < len(fields) else None
        room = 184 if field is None else 183 - len(field)
        part = unit[at : at + room]
        free = room - len(part)
        if field is None and free:
            field = b"" if free == 1 else b"\x00" + b"\xff" * (free - 2)
        elif field is not None and free:
            field += (b"" if field else b"\x00") + b"\xff" * (free - (not field))
        control = 0x10 if field is None else 0x30
        head = bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, control | (counter + k) % 16])
        out.append(head + (b"" if field is None else bytes([len(field)]) + field) + part)
        assert len(out[-1]) == 188
        at, k = at + len(part), k + 1
    return out


def table_packet(section: bytes, pid: int) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(188, b"\xff")


PAT = b"\x00\xb0\x0d\x00\x01\xc1\x00\x00\x00\x01\xf0\x00\x00\x00\x00\x00"


def sealed(spark, data: bytes, places: list[int]) -> bytes:
    df = spark.createDataFrame([(bytearray(data), places)], "d binary, p array<int>")
    return bytes(df.select(binary.seal_blocks(F.col("d"), F.col("p"), F.lit(KEY), F.lit(IV))).first()[0])


def guarded(unit: bytes) -> bytes:
    out, zeros = bytearray(), 0
    for x in unit:
        if zeros >= 2 and x <= 3:
            out.append(3)
            zeros = 0
        out.append(x)
        zeros = zeros + 1 if x == 0 else 0
    return bytes(out)


def pes(payload: bytes, kind: int, told: bool, header: bytes = b"") -> bytes:
    size = 3 + len(header) + len(payload)
    return b"\x00\x00\x01" + bytes([kind]) + (size if told else 0).to_bytes(2, "big") + b"\x80\x00" + bytes([len(header)]) + header + payload


def opened(spark, content: bytes, key=KEY, iv=IV):
    df = spark.createDataFrame([("r", bytearray(content), bytearray(key), bytearray(iv))], "resource_id string, content binary, key binary, iv binary")
    return clear_stream.clear_streams(df).first()


def payload_of(content: bytes, pid: int) -> list[bytes]:
    """Units of a stream, read packet by packet."""
    found = []
    for i in range(0, len(content), 188):
        p = content[i : i + 188]
        if (p[1] & 0x1F) << 8 | p[2] == pid:
            found += [b""] if p[1] & 0x40 else []
            found[-1] += p[4 if p[3] & 0x30 == 0x10 else 5 + p[4] :]
    return found


@pytest.fixture(scope="module")
def picture(spark):
    """Two access units: slices that are sealed, one of which has bytes to guard, and others."""
    rng = random.Random(2)
    slices = [bytes([0x65]) + rng.randbytes(700), bytes([0x41]) + b"\x00\x00\x01\x00\x00" * 90, bytes([0x67]) + rng.randbytes(80).replace(b"\x00", b"x") + b"z", bytes([0x61]) + b"s" * 47]
    kept, made = [], []
    for body in slices:
        seal = body[0] & 31 in (1, 5) and len(body) > 48
        kept.append(body)
        made.append(guarded(sealed(spark, body, list(range(32, len(body) - 16, 160)))) if seal else body)
    prefix = [b"\x00\x00\x00\x01", b"\x00\x00\x01", b"\x00\x00\x00\x00\x01", b"\x00\x00\x01"]
    join = lambda bodies: b"".join(p + b for p, b in zip(prefix, bodies, strict=True)) + b"\x00\x00"
    return join(made), join(kept)


def test_streams_become_clear(spark, picture):
    made, kept = picture
    first, second = pes(made, 0xE0, False), pes(made, 0xE0, True, b"\x21\x00\x01\x00\x01")
    # Four E-AC-3 frames of two chains: an independent one of three blocks and one that depends on it.
    frame = lambda kind, n: b"\x0bw" + bytes([kind << 6 | (n // 2 - 1) >> 8, (n // 2 - 1) & 255, 0x20]) + bytes(range(n - 5))
    frames = [frame(0, 90), frame(1, 60), frame(0, 70), frame(0, 90), frame(0, 100)]
    sound, at, chains = b"".join(frames), 0, []
    for k, f in enumerate(frames):
        if k in (0, 3):
            chains.append([])
        chains[-1] += [at + 16 + 16 * i for i in range((len(f) - 16) // 16)]
        at += len(f)
    spoken = sealed(spark, sealed(spark, sound, chains[0]), chains[1])
    table = map_section([(0xDB, 256, b"d"), (0xC2, 257, b""), (0x06, 258, b"")])
    other = packets_of(b"left as it is" * 20, 258, 9)
    video = packets_of(first, 256, 14, [b"\x50abcdef", b""]) + packets_of(second, 256, 14 + len(packets_of(first, 256, 0, [b"\x50abcdef", b""])))
    audio = packets_of(pes(spoken, 0xBD, True), 257, 0)
    parts = [table_packet(PAT, 0), table_packet(table, 0x1000), *video, *audio, *other, table_packet(table, 0x1000)]
    got = opened(spark, b"".join(parts))
    assert got.fault is None
    clear = bytes(got.content)
    assert len(clear) == 188 * len(parts) and clear[:188] == parts[0]
    clear_table = table_packet(map_section([(0x1B, 256, b"d"), (0x87, 257, b""), (0x06, 258, b"")]), 0x1000)
    assert clear[188:376] == clear[-188:] == clear_table
    assert payload_of(clear, 256) == [pes(kept, 0xE0, False), pes(kept, 0xE0, True, b"\x21\x00\x01\x00\x01")]
    assert payload_of(clear, 257) == [pes(sound, 0xBD, True)] and b"".join(other) in clear
    assert clear[376 + 5 : 376 + 12] == b"\x50abcdef" and all(clear[i] == 0x47 for i in range(0, len(clear), 188))
    assert [clear[i + 3] & 15 for i in range(0, len(clear), 188)] == [p[3] & 15 for p in parts]


def test_faults_of_streams(spark, picture):
    made, _ = picture
    tables = [table_packet(PAT, 0), table_packet(map_section([(0xDB, 256, b"")]), 0x1000)]
    video = packets_of(pes(made, 0xE0, False), 256, 0)
    scrambled = video[1][:3] + bytes([video[1][3] | 0x80]) + video[1][4:]
    cases = {
        "a resource is not made of packets": (b"".join(tables + video) + b"x",),
        "a key or vector is not of 16 bytes": (b"".join(tables + video), b"short"),
        "there is no program map": (b"".join(video),),
        "no stream is encrypted": (b"".join([tables[0], table_packet(map_section([(0x1B, 256, b"")]), 0x1000), *video]),),
        "a stream has no unit": (b"".join(tables),),
        "a counter does not follow the one before it": (b"".join(tables + [video[0], *video[2:]]),),
        "a packet is scrambled": (b"".join(tables + [video[0], scrambled, *video[2:]]),),
        "a stream begins within a unit": (b"".join(tables + video[1:]),),
        "a unit has no start code": (b"".join(tables + packets_of(b"no unit at all", 256, 0)),),
        "a unit has another length than it declares": (b"".join(tables + packets_of(pes(made, 0xE0, True)[:-9], 256, 0)[:-1]),),
        "a payload does not begin with a start code": (b"".join(tables + packets_of(pes(b"q" + made, 0xE0, False), 256, 0)),),
        "a payload has an empty unit": (b"".join(tables + packets_of(pes(made + b"\x00\x00\x01\x00\x00\x01\x67a", 0xE0, False), 256, 0)),),
    }
    rows = [(name, *map(bytearray, (c[0], c[1] if len(c) > 1 else KEY, IV))) for name, c in cases.items()]
    df = spark.createDataFrame(rows, "resource_id string, content binary, key binary, iv binary")
    got = {r.resource_id: (r.fault, r.content) for r in clear_stream.clear_streams(df).collect()}
    assert got == {name: (name, None) for name in cases}


def test_the_query_writes_nothing_and_shuffles_texts_and_clear_packets_only(spark, tmp_path, monkeypatch):
    import duckdb

    rng = random.Random(4)
    texts = ["", None, "a", "x" * 47, "\0\0\1\0\0\3" * 300, *("".join(rng.choices("ab \0\1\3é", k=n)) for n in (100, 399, 401, 500, 501, 2000, 30_000))]
    rows = [(i + 11 * k, t) for i, t in enumerate(texts) for k in (i, i + 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(runs, "new_folder", lambda *a: pytest.fail("a table is written"))
    frame = more_queries.clear_streams(spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.count("FileScan") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(more_queries.ORACLE["clear_streams"])
    names = want.columns
    assert sorted(map(tuple, frame.select(*names).collect())) == sorted(want.fetchall())


def test_units_that_outgrow_their_packets(spark):
    packets = spark.createDataFrame(
        [("r", 1, 0, i, bytearray(p), 4, None) for i, p in enumerate(packets_of(b"a" * 368, 1, 0))],
        "resource_id string, pid int, unit long, index long, data binary, payload_offset int, fault string",
    )
    for size, fault in ((368, None), (369, "a unit is larger than its packets"), (10, None)):
        units = spark.createDataFrame([("r", 1, 0, bytearray(b"b" * size), None)], "resource_id string, pid int, unit long, clear binary, fault string")
        rows = rewrite.refilled(packets, units).orderBy("index").collect()
        assert {r.fault for r in rows} == {fault}
        if fault is None:
            assert payload_of(b"".join(bytes(r.data) for r in rows), 1) == [b"b" * size]


def test_emulation_bytes_come_and_go(spark):
    rng = random.Random(7)
    units = [bytes(rng.choices([0, 0, 0, 1, 2, 3, 4, 9], k=rng.randrange(1, 60))) + b"e" for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(u)) for i, u in enumerate(units)], "i int, u binary")
    for r in df.withColumn("g", transport.with_emulation("u")).withColumn("o", transport.without_emulation("g")).collect():
        assert bytes(r.g) == guarded(units[r.i]) and bytes(r.o) == units[r.i]
        assert all(bytes(r.g).find(bytes([0, 0, k])) < 0 for k in (0, 1, 2))
