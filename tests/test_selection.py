"""A caller's selection as rows, planned tracks, effective bandwidth, and resolved keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segmentry.functions import binary
from segmentry.operators import catalog, discovery, selection
from segmentry.plans import archive

VARIANTS = (
    "playlist_id string, variant_index long, url string, bandwidth double, codecs string, frame_rate double, "
    "width long, height long, audio_group_id string"
)
RENDITIONS = "playlist_id string, rendition_index long, group_id string, name string, url string, is_default boolean"
SELECTED = "playlist_id string, place long, track_id string"


def plain_fault(options, ids):
    """The rule as a loop over one selection."""
    seen = set()
    for x in ids:
        if not any(x in o for o in options):
            return selection.FOREIGN
        if x in seen:
            return selection.TWICE
        seen.add(x)
    if not ids:
        return selection.EMPTY
    return None if any(seen <= set(o) for o in options) else selection.CROSSING


def test_faults_and_tracks_against_a_loop(spark):
    rng = random.Random(5)
    v, r, s, want, taken = [], [], [], {}, {}
    for p in range(60):
        name = f"p{p}"
        groups = {g: [i for i in range(4) if rng.random() < 0.4] for g in "ab"}
        for g, members in groups.items():
            r += [(name, i + (4 if g == "b" else 0), g, "n", "u" if rng.random() < 0.9 else None, False) for i in members]
        offered = {g: [f"audio-{x[1] + 1}" for x in r if x[0] == name and x[2] == g and x[4]] for g in groups}
        used = [rng.choice(["a", "b", None]) for _ in range(3)]
        v += [(name, i, "v", 1.0, None, None, None, None, g) for i, g in enumerate(used)]
        options = [[f"video-{i + 1}", *offered.get(g, [])] for i, g in enumerate(used)]
        pool = [t for o in options for t in o] + ["audio-9"]
        ids = rng.sample(options[0], rng.randint(0, len(options[0]))) if p % 3 else [rng.choice(pool) for _ in range(rng.randint(0, 4))]
        s += [(name, 10 * k - 7, t) for k, t in enumerate(ids)]
        want[name] = plain_fault(options, ids)
        if want[name] is None:
            taken |= {(name, 10 * k - 7): t for k, t in enumerate(ids)}
    frames = spark.createDataFrame(v, VARIANTS), spark.createDataFrame(r, RENDITIONS), spark.createDataFrame(s, SELECTED)
    assert {x.playlist_id: x.fault for x in selection.faults(*frames).collect()} == want
    assert {(x.playlist_id, x.place): x.track_id for x in selection.chosen(*frames).collect()} == taken
    assert len(set(want.values())) == 5


MASTER = """#EXTM3U
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="s",NAME="One",URI="one.m3u8"
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="s",NAME="Two",URI="two.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=900,AUDIO="s"
low.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=1900,AUDIO="s"
high.m3u8
"""
MEDIA = "#EXTM3U\n#EXTINF:3,\n{0}-a.ts\n#EXTINF:2,\n{0}-b.ts\n#EXT-X-ENDLIST\n"


@pytest.fixture(scope="module")
def given(spark):
    base = "https://h.example/m/"
    rows = [("m", f"{base}list.m3u8", MASTER), ("d", f"{base}d.m3u8", MEDIA.format("d")), ("bad", f"{base}x.m3u8", "#EXT-X-STREAM-INF:NAME=x\nlow.m3u8")]
    media = [(n, f"{base}{n}.m3u8", MEDIA.format(n)) for n in ("low", "one", "two", "d")] + [("high", f"{base}high.m3u8", MASTER)]
    schema = "playlist_id string, playlist_url string, content string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(media, schema)


def test_a_selection_leads_to_items_in_its_order(spark, given):
    playlists, media = given
    selected = spark.createDataFrame([("m", 1, "audio-2"), ("m", 2, "video-1")], SELECTED)
    tracks, faults = archive.planned_tracks(playlists, selected)
    assert {(x.playlist_id, x.fault) for x in faults.collect()} == {("bad", "a stream has no bandwidth")}
    rows = archive.archive_of(tracks, media).orderBy("playlist_id", "place", "track_index").collect()
    assert [(x.playlist_id, x.track_id, x.track_index, x.url.rsplit("/", 1)[1]) for x in rows] == [
        ("d", "main", 0, "d-a.ts"), ("d", "main", 1, "d-b.ts"), ("m", "audio-2", 0, "two-a.ts"), ("m", "audio-2", 1, "two-b.ts"),
        ("m", "video-1", 0, "low-a.ts"), ("m", "video-1", 1, "low-b.ts"),
    ]


def test_without_a_caller_the_default_option_is_taken(given):
    playlists, media = given
    tracks, _ = archive.planned_tracks(playlists)
    assert [(x.place, x.track_id) for x in tracks.where("playlist_id = 'm'").orderBy("place").collect()] == [(0, "video-2"), (1, "audio-1"), (2, "audio-2")]
    assert [(x.track_id, x.fault) for x in archive.track_faults(tracks, media).collect()] == [("video-2", "a track is another master playlist")]
    assert [x.fault for x in archive.track_faults(tracks, media.where("playlist_id <> 'one'")).where("track_id = 'audio-1'").collect()] == ["a track's playlist is missing"]


def test_effective_bandwidth_decides_the_default(spark):
    options = spark.createDataFrame([("p", "a", 0, None), ("p", "b", 1, 5.0), ("p", "c", 2, 0.0), ("q", "d", 0, None)], "playlist_id string, option_id string, option_index int, bandwidth double")
    tracks = spark.createDataFrame([("p", "a", 4.0), ("p", "a", 2.0), ("p", "a", None), ("p", "c", 99.0)], "playlist_id string, option_id string, bandwidth double")
    best = catalog.default_option(catalog.with_effective_bandwidth(options, tracks)).orderBy("playlist_id").collect()
    assert [(x.playlist_id, x.option_id, x.bandwidth) for x in best] == [("p", "a", 6.0), ("q", "d", 0.0)]


@pytest.mark.parametrize(
    ("uri", "key"),
    [
        ("data:text/plain;base64,AAEC", "000102"), ("DATA:;charset=x; BASE64 ,AAEC", "000102"), ("data:;base64,AA%45C", "000102"), ("data:;base64,AAE", "0001"),
        ("data:,%00%ffa+", "00ff612b"), ("data:,é#no", "c3a9"), ("data:;base64,A", None), ("data:;base64,", ""), ("data:nothing", None), ("https://h.example/k", None),
    ],
)
def test_data_uris(spark, uri, key):
    assert spark.range(1).select(binary.inline_key(F.lit(uri)).alias("k")).first().k == key


def test_key_batches(spark):
    keys = spark.createDataFrame(
        [("p", "https://k/1", "http"), ("p", "https://k/2", "http"), ("p", "data:,ab", "inline"), ("q", "https://k/1", "http"), ("q", "skd://x", "external")],
        "playlist_id string, id string, key_kind string",
    )
    files = spark.createDataFrame([("https://k/1", bytearray(b"\x0a\xff"))], "url string, content binary")
    got = {(x.playlist_id, x.id): (x.key, x.fault) for x in discovery.resolved_keys(keys, files).collect()}
    external = (None, "an external key needs an explicit one")
    assert got == {
        ("p", "https://k/1"): ("0aff", None), ("p", "https://k/2"): (None, "a key cannot be fetched"), ("p", "data:,ab"): ("6162", None),
        ("q", "https://k/1"): external, ("q", "skd://x"): external,
    }
    assert {(x.key, x.fault) for x in discovery.resolved_keys(keys, files, ["ab"]).collect()} == {("ab", None)}
    assert {(x.key, x.fault) for x in discovery.resolved_keys(keys, files, ["a", "b"]).collect()} == {(None, "more than one explicit key")}
