"""Playlist parsing: lines, tags, ranges, keys, and faults."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from segmentry.functions import text, urls
from segmentry.operators import discovery, master, media, syntax

BASE = "https://cdn.example/path/list.m3u8"
KEY16 = "0x" + "1" * 32


def playlists(spark, *contents, base=BASE):
    rows = [(str(i), base, c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "playlist_id string, playlist_url string, content string")


def by_playlist(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (int(r.playlist_id), r.seg_ord)):
        out.setdefault(int(r.playlist_id), []).append(r)
    return out


def test_sequence_initialization_and_end(spark):
    found = playlists(
        spark,
        '#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:58\n#EXT-X-MAP:URI="init.mp4",BYTERANGE="640@32"\n'
        "#EXTINF:3.5,\na.ts\r\n#EXTINF:8.5,title\n\n  b.ts\n#EXT-X-ENDLIST\n#EXTINF:9,\nlate.ts",
        "#EXTM3U\n#EXTINF:0,\na.ts\n#EXTINF:x,\nb.ts\n#EXT-X-MEDIA-SEQUENCE:9\n#EXTINF:1.5e0x,\nc.ts",
        "#EXTM3U",
    )
    got = by_playlist(media.segments(found).collect())
    init, a, b = got[0]
    assert (init.kind, init.url, init.byte_range, init.sequence_id) == ("init", "https://cdn.example/path/init.mp4", (32, 640), None)
    assert [(x.url[-4:], x.duration, x.sequence_id) for x in (a, b)] == [("a.ts", 3.5, 58), ("b.ts", 8.5, 59)]
    assert [(x.duration, x.sequence_id) for x in got[1]] == [(5.0, 0), (5.0, 1), (1.5, 9)]
    sums = {r.playlist_id: r for r in media.summary(found).collect()}
    assert (sums["0"].has_end_list, sums["0"].total_duration, sums["0"].average_duration) == (True, 12, 6)
    assert not sums["1"].has_end_list and sums["2"].average_duration != sums["2"].average_duration


def test_byte_ranges(spark):
    found = playlists(
        spark,
        '#EXT-X-MAP:URI="i",BYTERANGE="31@2"\n#EXTINF:1,\n#EXT-X-BYTERANGE:6@40\nx\n#EXT-X-BYTERANGE:9\n#EXTINF:1,\nx\n'
        "#EXTINF:1,\n#EXT-X-BYTERANGE:7\nx",
        "#EXTINF:1,\n#EXT-X-BYTERANGE:invalid\nx",
        "#EXTINF:1,\n#EXT-X-BYTERANGE:0@0\nx",
        "#EXTINF:1,\n#EXT-X-BYTERANGE:2@9007199254740991\nx",
        "#EXTINF:1,\n#EXT-X-BYTERANGE:2\nx",
        "#EXTINF:1,\n#EXT-X-BYTERANGE:2@0\ny\n#EXTINF:1,\n#EXT-X-BYTERANGE:2\nx",
        "#EXTINF:1,\nx\n#EXTINF:1,\n#EXT-X-BYTERANGE:2\nx",
        '#EXT-X-MAP:URI="i",BYTERANGE="100"',
    )
    got = by_playlist(media.segments(found).collect())
    assert [s.byte_range.offset for s in got[0]] == [2, 40, 46, 55]
    faults = {int(r.playlist_id): r.error for r in media.errors(found).collect()}
    assert 0 not in faults and set(faults) == set(range(1, 8))
    assert faults[1] == faults[2] == faults[3] == "a byte range is invalid"
    assert faults[4] == faults[5] == faults[6] == "a byte range has no offset to follow"
    assert faults[7] == "an initialization range has no offset"


def test_keys_carry_forward_until_cleared(spark):
    found = playlists(
        spark,
        f'#EXT-X-KEY:METHOD=AES-128,URI="k1?sig=x=y,z",IV={KEY16}\n#EXT-X-MAP:URI="i"\n#EXTINF:1,\na\n'
        '#EXT-X-KEY:METHOD=NONE\n#EXTINF:1,\nb\n#EXTINF:1,\n#EXT-X-KEY:METHOD=AES-128,URI="k2"\nc\n'
        '#EXT-X-KEY:METHOD=OTHER,URI="z"\n#EXTINF:1,\nd',
        '#EXT-X-KEY:METHOD=AES-128,URI="skd://one"\n#EXTINF:1,\na\n#EXT-X-KEY:METHOD=AES-128,URI="data:text/plain;base64,AAEC"\n#EXTINF:1,\nb',
    )
    got = by_playlist(media.segments(found).collect())
    enc = [s.encryption for s in got[0]]
    assert [e and e.key_id for e in enc] == ["https://cdn.example/path/k1?sig=x=y,z"] * 2 + [None, "https://cdn.example/path/k2", None]
    assert enc[0].iv == "1" * 32 and enc[3].iv is None
    assert [s.encryption.key_kind for s in got[1]] == ["external", "inline"]
    ids = [r.id for r in media.keys(found).where("playlist_id = '0'").orderBy("key_ord").collect()]
    assert [i[-2:] for i in ids] == [",z", "k2"]
    items = by_playlist(discovery.items(media.segments(found)).withColumnRenamed("item_ord", "seg_ord").collect())
    assert [i.encryption and i.encryption.iv for i in items[0]] == ["1" * 32] * 2 + [None, "2", None]


@pytest.mark.parametrize(
    ("content", "error"),
    [
        ("#EXTINF:1,\n#EXTINF:2,\nx", "a segment has several durations"),
        ("#EXTINF:1,\n#EXT-X-BYTERANGE:1@0\n#EXT-X-BYTERANGE:1@1\nx", "a segment has several byte ranges"),
        ("x", "a segment has no duration"),
        ("#EXTINF:1,", "a tag applies to no segment"),
        ("#EXTINF:1,\n#EXT-X-ENDLIST\nx", "a tag applies to no segment"),
        ("#EXT-X-BYTERANGE:1@0", "a tag applies to no segment"),
        ("#EXT-X-MAP:X=1", "an initialization has no URI"),
        ("#EXT-X-KEY:METHOD=AES-128", "a key has no URI"),
        ('#EXT-X-KEY:METHOD=AES-128,URI="k",IV=is0x2A', "an IV is malformed"),
        ('#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0xGG', "an IV is malformed"),
        ('#EXT-X-KEY:METHOD=AES-128,URI="k",IV=0x' + "1" * 33, "an IV is malformed"),
        ('#EXT-X-KEY:METHOD=AES-128,URI="k"\n#EXT-X-MAP:URI="i"', "an encrypted initialization has no IV"),
        ('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k"', "a SAMPLE-AES key has no IV"),
        ('#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k",IV=0x1,KEYFORMAT="f"', "a key format is unknown"),
        (f'#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k",IV={KEY16}\n#EXT-X-MAP:URI="i"', "an initialization is SAMPLE-AES encrypted"),
        (f'#EXT-X-MAP:URI="i"\n#EXT-X-KEY:METHOD=SAMPLE-AES,URI="k",IV={KEY16}\n#EXTINF:1,\nx', "an initialization is SAMPLE-AES encrypted"),
        (f'#EXT-X-I-FRAMES-ONLY\n#EXT-X-KEY:METHOD=AES-128,URI="k",IV={KEY16}\n#EXTINF:1,\n#EXT-X-BYTERANGE:4@0\nx', "an I-frame byte range is encrypted"),
        (f'#EXT-X-KEY:METHOD=AES-128,URI="k",IV={KEY16}\n#EXTINF:1,\n#EXT-X-BYTERANGE:4@0\nx\n#EXT-X-ENDLIST\n#EXT-X-I-FRAMES-ONLY', "an I-frame byte range is encrypted"),
    ],
)
def test_faults(spark, content, error):
    assert [r.error for r in media.errors(playlists(spark, content)).collect()] == [error]


def test_relative_uris_need_a_base(spark):
    found = playlists(spark, "#EXTINF:1,\na.ts", base=None)
    assert media.errors(found).first().error == "a URI cannot be resolved"


def test_master_playlists(spark):
    found = playlists(
        spark,
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="One",URI="a.m3u8",DEFAULT=YES,CHANNELS="6/JOC",LANGUAGE="en"\n'
        '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",NAME="Two",DEFAULT=yes,CHANNELS="x"\n#EXT-X-MEDIA:TYPE=VIDEO,GROUP-ID="v"\n'
        '#EXT-X-STREAM-INF:BANDWIDTH=2400000,CODECS="avc1.4d, mp4a.40",RESOLUTION=1280x720,FRAME-RATE=29.97,AUDIO="g"\n'
        '#EXT-X-STREAM-INF:BANDWIDTH=64000,RESOLUTION=1X1\n# a comment\n../v.m3u8\n#EXT-X-STREAM-INF:AUDIO="gone"',
    )
    assert syntax.playlist_kind(found).first().kind == "master"
    one, two, three = master.variants(found).orderBy("variant_index").collect()
    assert one.url == two.url == "https://cdn.example/v.m3u8"
    assert (one.bandwidth, one.width, one.height, one.frame_rate, one.audio_group_id) == (2400000.0, 1280, 720, 29.97, "g")
    assert two.width is None and three.error == "a stream has no URI"
    a, b = master.audio_renditions(found).orderBy("rendition_index").collect()
    assert (a.name, a.url, a.channels, a.is_default, a.language) == ("One", "https://cdn.example/path/a.m3u8", 6, True, "en")
    assert (b.url, b.channels, b.is_default) == (None, None, False)
    gone = master.missing_groups(master.variants(found), master.audio_renditions(found)).collect()
    assert [r.audio_group_id for r in gone] == ["gone"]


def test_kind_needs_a_tag_not_a_comment_about_it(spark):
    found = playlists(spark, "# see #EXT-X-STREAM-INF", "  #EXT-X-STREAM-INF:BANDWIDTH=1\nx")
    assert [r.kind for r in syntax.playlist_kind(found).orderBy("playlist_id").collect()] == ["media", "master"]


def scan(body):
    out = {}
    while body:
        key = re.match("[^=,]*", body).group()
        body, value = body[len(key) :], ""
        if body.startswith('="'):
            value, _, body = body[2:].partition('"')
        elif body.startswith("="):
            value = body[1:].partition(",")[0]
        body = body.partition(",")[2]
        if key:
            out[key] = value
    return out


def test_attribute_lists_match_a_scanner(spark):
    rng = random.Random(1)
    bodies = ["".join(rng.choices('AB="", ', k=rng.randint(0, 14))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = {r.i: r.a for r in rows.select("i", text.attributes(F.col("body")).alias("a")).collect()}
    assert [got[i] for i in range(len(bodies))] == [scan(b) for b in bodies]


@pytest.mark.parametrize(
    ("uri", "resolved"),
    [
        ("http://o.example/x", "http://o.example/x"), ("skd://k", "skd://k"), ("//h/x", "https://h/x"), ("/x/../y", "https://cdn.example/y"),
        ("a/./b", "https://cdn.example/path/a/b"), ("../../../a", "https://cdn.example/a"), ("?q", BASE + "?q"), ("..", "https://cdn.example/"),
    ],
)
def test_resolution(spark, uri, resolved):
    row = spark.createDataFrame([(BASE, uri)], "b string, u string").select(urls.resolve(F.col("b"), F.col("u")).alias("r"))
    assert row.first().r == resolved


@pytest.mark.parametrize("cuts", [(0, 7, 20), (3, 4, 9), (0, 1, 100)])
def test_slices_of_neighbouring_intervals_cover_their_union(spark, cuts):
    rng = random.Random(sum(cuts))
    body = "".join(f"#EXTINF:{rng.choice([0.5, 1, 2.25])},\ns{i}\n" for i in range(30))
    items = discovery.items(media.segments(playlists(spark, body)))
    a, b, c = cuts

    def numbers(x, y):
        return {r.item_ord for r in discovery.time_slice(items, x, y).collect()}

    assert numbers(a, b) | numbers(b, c) == numbers(a, c)


def test_slice_keeps_initialization_until_the_clock_is_at_the_end(spark):
    body = '#EXT-X-MAP:URI="i0"\n#EXTINF:1,\na\n#EXT-X-MAP:URI="i1"\n#EXTINF:1,\nb\n#EXT-X-MAP:URI="i2"\n#EXTINF:1,\nc'
    items = discovery.items(media.segments(playlists(spark, body)))
    got = discovery.time_slice(items, 1, 2).orderBy("item_ord").collect()
    assert [r.url.rsplit("/")[-1] for r in got] == ["i0", "i1", "b"]


def test_scalars(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    lit = F.lit
    assert [one(text.seconds_of(lit(t))) for t in ("45:00", "01:02:03", "99:99", "12", "1:", ":30", "1:two")] == [2700, 3723, 6039, None, None, None, None]
    assert tuple(one(text.slice_bounds(lit("00:00:01-00:00:02")))) == (1, 2)
    assert [one(text.fixed(lit(x), lit(2))) for x in (1.005, 0.125, 2.5, 0.5)] == ["1.00", "0.13", "2.50", "0.50"]
    assert one(text.request_headers(lit("A: 1\\nB:2\nbad line\nA:  3 "))) == {"A": "3", "B": "2"}
    assert tuple(one(text.explicit_key(lit("asset-id:00ff")))) == ("asset-id", "00ff")
    assert tuple(one(text.explicit_key(lit("key-a,key-b")))) == (None, "key-a,key-b")
    assert one(urls.item_name(lit(7), lit("https://h/p/segment-42.ts?token=x"))) == "000007_segment-42.ts"
    assert one(urls.item_name(lit(1234567), lit("https://h/" + "a" * 300))) == "1234567_" + "a" * 238
    assert one(urls.range_header(lit(4), lit(5))) == "bytes=4-8"
    assert one(text.trimmed(lit("﻿　 x "))) == "x"
    assert [one(text.duration_text(lit(s))) for s in (5, 75, 3725)] == ["5s", "1m 15s", "1h 2m 5s"]
    assert one(text.megabits(lit(2400000.0))) == "2.40 Mbps" and one(text.kilobits(lit(128000.0))) == "128 kbps"
    assert one(urls.site_item_name(lit("https://h/sq/81/goap/x"))) == "81"
