"""Running state in spans: the same rows whatever the spans, and no window over a sequence."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segmentry.operators import discovery, media, output, spans, tasks
from segmentry.sources import bindings


def random_playlist(rng: random.Random) -> str:
    """Tags and URIs in any order, with faults, resets, chains of ranges and an end."""
    lines = ["#EXTM3U"]
    for _ in range(rng.randrange(1, 40)):
        kind = rng.random()
        if kind < 0.45:
            if rng.random() < 0.95:
                lines.append(f"#EXTINF:{rng.choice(['4', '2.5', '0', 'x'])},t")
            if rng.random() < 0.6:
                lines.append(rng.choice(["#EXT-X-BYTERANGE:10", "#EXT-X-BYTERANGE:7", "#EXT-X-BYTERANGE:5@100", "#EXT-X-BYTERANGE:0"]))
            lines.append(rng.choice(["a.ts", "a.ts", "a.ts", "b.ts"]))
        elif kind < 0.6:
            lines.append(rng.choice(['#EXT-X-KEY:METHOD=AES-128,URI="k1"', '#EXT-X-KEY:METHOD=AES-128,URI="k2",IV=0x1F', "#EXT-X-KEY:METHOD=NONE", "#EXT-X-KEY:METHOD=AES-128"]))
        elif kind < 0.7:
            lines.append(rng.choice(["#EXT-X-MEDIA-SEQUENCE:50", "#EXT-X-MEDIA-SEQUENCE:7"]))
        elif kind < 0.78:
            lines.append(rng.choice(['#EXT-X-MAP:URI="m.mp4"', '#EXT-X-MAP:URI="m.mp4",BYTERANGE="4@2"']))
        elif kind < 0.95:
            lines.append("# remark")
        elif kind < 0.97:
            lines.append("#EXT-X-I-FRAMES-ONLY")
    if rng.random() < 0.7:
        lines += ["#EXT-X-ENDLIST", *rng.choice([[], ["#EXTINF:1,", "late.ts"]])]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def playlists(spark):
    rng = random.Random(12)
    rows = [(f"p{i}", "https://h/d/l.m3u8", random_playlist(rng)) for i in range(150)]
    return spark.createDataFrame([*rows, (None, "https://h/d/l.m3u8", rows[0][2])], "playlist_id string, playlist_url string, content string").repartition(4).cache()


def by_text(rows) -> list[str]:
    return sorted(str(r) for r in rows)


def test_playlists_do_not_depend_on_the_spans(playlists, monkeypatch):
    found = {}
    for span in (1 << 16, 3, 1):
        monkeypatch.setattr(spans, "SPAN", span)
        found[span] = [by_text(f(playlists).collect()) for f in (media.segments, media.errors, media.summary, media.keys)]
    assert found[1 << 16] == found[3] == found[1]
    assert all(len(x) > 30 for x in found[3][:2])


def plain_offsets(rows):
    """(url, length, offset or None) of a playlist's segments to the offsets, one after another."""
    out, before = [], None
    for url, length, offset in rows:
        if length is None:
            before = None
            out.append(None)
            continue
        if offset is None and before and before[0] == url and before[1] is not None:
            offset = before[1]
        out.append(offset)
        before = (url, None if offset is None else offset + length)
    return out


@pytest.mark.parametrize("span", [1, 2, 5, 1 << 16])
def test_byte_ranges_are_those_of_one_pass(spark, monkeypatch, span):
    monkeypatch.setattr(spans, "SPAN", span)
    rng = random.Random(3)
    rows, want = [], {}
    for p in range(60):
        own = [
            (rng.choice("uuuv"), *rng.choice([(None, None), (rng.randrange(1, 9), None), (rng.randrange(1, 9), None), (4, rng.randrange(99))]))
            for _ in range(rng.randrange(1, 14))
        ]
        want |= {(p, i): o for i, o in enumerate(plain_offsets(own))}
        rows += [(p, i, True, u, None if n is None else (n, o)) for i, (u, n, o) in enumerate(own)]
    table = spark.createDataFrame(rows, "playlist_id int, line_no int, is_uri boolean, url string, asked struct<length:long,offset:long>")
    got = {(r.playlist_id, r.line_no): r.offset if r.asked else None for r in media.byte_ranges(table).collect()}
    assert got == want


def test_sums_and_last_values_before_a_row(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([None, 1, 2, 5])) for n in rng.sample(range(500), 120)]
    table = spark.createDataFrame(rows, "k string, n long, v int")
    got = spans.before(
        table, ["k"], "n", sums={"total": F.col("v"), "rows": F.lit(1)}, lasts={"last": F.col("v")},
        wholes={"most": (F.max, F.col("n"))}, span=16,
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted(x for x in rows if x[0] == r.k)
        prior = [x for x in own if x[1] < r.n]
        seen = [v for *_, v in prior if v is not None]
        assert (r.total, r.rows, r["last"], r.most) == (sum(seen), len(prior), seen[-1] if seen else None, own[-1][1])


def test_times_indexes_prefixes_and_runs_in_spans(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for t in "xyz":
        for i in range(200):
            if rng.random() < (0.999 if t == "x" else 0.97):
                rows.append((t, i, rng.choice(["media", "media", "init"]), rng.random() * 9, rng.choice(["ready", "ready", "dropped"])))
    table = spark.createDataFrame(rows, "track_id string, track_index long, kind string, duration double, status string").repartition(3)
    found = {}
    for span in (1 << 16, 7):
        monkeypatch.setattr(spans, "SPAN", span)
        timed = discovery.running_time(table, "track_id", "track_index")
        numbered = tasks.track_index(table.withColumnRenamed("track_index", "at"), "at")
        found[span] = [by_text(x.collect()) for x in (timed, numbered, output.contiguous_prefix(table), output.runs(table), output.runs(table, True))]
    assert found[7] == found[1 << 16]
    for t in "xyz":
        own = sorted(r for r in rows if r[0] == t)
        n = next((i for i, r in enumerate(own) if r[1] != i), len(own))
        assert sum(f"track_id='{t}'" in r for r in found[7][2]) == n


def test_no_window_spans_a_hot_track(spark, monkeypatch):
    """With a third of all rows on one track, a window's task holds a span of it at most."""
    monkeypatch.setattr(spans, "SPAN", 50)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("playlist_id"), F.col("id").alias("line_no"))
    lines = rows.select("playlist_id", F.lit("https://h/l.m3u8").alias("playlist_url"), "line_no", F.when(F.col("line_no") % 2 == 0, "#EXTINF:1,").otherwise("a.ts").alias("line"))
    marked = media.annotated_lines(lines)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("span_part" in w or "playlist_id#" not in w for w in windows)
    assert marked.where("is_uri").count() == 1500


def test_lines_of_tables_are_those_of_their_texts(spark):
    data = "/root/testdata/sf0.001"
    whole = media.segments(bindings.playlist_texts(spark, data).where("playlist_id IS NOT NULL"))
    assert by_text(media.segments(bindings.playlist_lines(spark, data)).collect()) == by_text(whole.collect())
