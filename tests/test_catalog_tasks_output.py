"""Catalogs and selection, discovery, tasks and progress, ordered output."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from segmentry import choice_queries, more_queries
from segmentry.operators import catalog, discovery, output, tasks
from segmentry.plans import archive


def variants(spark, rows):
    schema = (
        "playlist_id string, variant_index long, url string, bandwidth double, codecs string, frame_rate double, "
        "width long, height long, audio_group_id string"
    )
    return spark.createDataFrame(rows, schema)


def renditions(spark, rows):
    return spark.createDataFrame(rows, "playlist_id string, rendition_index long, group_id string, name string, url string, is_default boolean")


def test_shared_external_audio_is_one_track(spark):
    v = variants(spark, [
        ("p", 0, "v1", 1e6, "avc1.4d, mp4a.40", 25.0, 640, 360, "g"), ("p", 1, "v2", 2e6, "avc1.4d", None, None, None, "g"),
        ("p", 2, "a", 64e3, "mp4a.40, EC-3", None, None, None, None),
    ])
    r = renditions(spark, [("p", 0, "g", "One", "u", True), ("p", 1, "g", "Mixed", None, False)])
    tracks = catalog.tracks(v, r).orderBy("track_ord").collect()
    assert [(t.track_id, t.type) for t in tracks] == [("video-1", "video"), ("audio-1", "audio"), ("video-2", "video"), ("audio-primary-3", "audio")]
    options = catalog.options(v, r).orderBy("option_index").collect()
    assert [o.track_ids for o in options] == [["video-1", "audio-1"], ["video-2", "audio-1"], ["audio-primary-3"]]
    assert catalog.default_option(catalog.options(v, r)).first().option_id == "option-2"
    assert catalog.automatic_choice(catalog.option_counts(v, r), True).first().choice == "ask"
    assert not any(x.missing for x in catalog.linked(v, r).collect())


def first_seen(named, groups):
    """Ids of tracks in the order they first appear: ``named`` has each variant's own track and
    group, ``groups`` the external tracks of each group."""
    found = {}
    for own, group in named:
        found |= dict.fromkeys([own, *groups.get(group, [])])
    return list(found)


def test_renditions_of_all_playlists_are_tracks_of_each_that_names_their_group(spark):
    sizes = {"a": 1, "b": catalog.BLOCK, "c": 2 * catalog.BLOCK + 1, "d": 0, "unnamed": 3}
    names = [g for g, n in sizes.items() for _ in range(n)]
    random.Random(5).shuffle(names)
    shared = [(i, g, "n", "u" if i % 9 else None, False) for i, g in enumerate(names)]
    playlists = {"p": ["b", None, "c", "b", "d", "a", "c"], "q": [None], "r": ["c", "c"], "s": ["a", "b"]}
    v = variants(spark, [(k, i, "v", 1.0, "avc1", None, None, None, g) for k, named in playlists.items() for i, g in enumerate(named)])
    audio = {g: [f"audio-{i + 1}" for i, x in enumerate(names) if x == g and i % 9] for g in sizes}
    want = {k: first_seen([(f"video-{i + 1}", g) for i, g in enumerate(named)], audio) for k, named in playlists.items()}
    for r in (renditions(spark, [(None, *x) for x in shared]).drop("playlist_id"), renditions(spark, [(k, *x) for k in playlists for x in shared])):
        rows = sorted(catalog.tracks(v, r).collect(), key=lambda t: (t.playlist_id, t.track_ord))
        assert {k: [t.track_id for t in rows if t.playlist_id == k] for k in playlists} == want
        assert [t.track_ord for t in rows] == [i for k in sorted(want) for i in range(len(want[k]))]
        assert all((t.type, t.url) == (("audio", "u") if t.track_id.startswith("audio") else ("video", "v")) for t in rows)


def test_catalog_tracks_has_each_supplier_in_all_playlists_that_name_its_nation(spark, tmp_path):
    customers, suppliers = [(i, i * 7 % 5) for i in range(600)], [(i, i % 6) for i in range(40)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, f"n{k}", n) for k, n in suppliers], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    audio = {n: [f"audio-{k}" for k, m in suppliers if m == n and k % 3] for n in range(6)}
    want = {}
    for part in range(12):
        # The last tag of a playlist has no URI if its key is divisible by seven; one of eleven has no bandwidth.
        sound = [(k, n) for k, n in customers if k // 50 == part and k % 11 and (k % 7 or k % 50 != 49)]
        want[f"m{part}"] = first_seen([(f"{'video' if k % 15 else 'audio-primary'}-{k % 50 + 1}", n) for k, n in sound], audio)
    rows = more_queries.catalog_tracks(spark, str(tmp_path)).orderBy("playlist_id", "track_ord").collect()
    assert {k: [t.track_id for t in rows if t.playlist_id == k] for k in want} == want
    assert len(rows) == sum(map(len, want.values()))


def shuffled(spark, frame) -> int:
    """Rows that a frame's stages write to shuffles, without broadcasts."""
    context, known = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(known)
    try:
        spark.conf.set(known, -1)
        context.setJobGroup("shuffled", "", False)
        done = set(context.statusTracker().getJobIdsForGroup("shuffled"))
        frame().write.format("noop").mode("overwrite").save()
        jobs = set(context.statusTracker().getJobIdsForGroup("shuffled")) - done
        stages = {s for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds}
        ran = [s for s in stages if context.statusTracker().getStageInfo(s)]
        return sum(context._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in ran)
    finally:
        spark.conf.set(known, before)
        context.setLocalProperty("spark.jobGroup.id", None)


def test_tracks_of_large_groups_are_not_shuffled(spark, monkeypatch):
    """Fifty playlists that name a group of 900: shuffled are rows, not pairs of a row and a list."""
    monkeypatch.setattr(catalog, "BLOCK", 1)
    v = variants(spark, [(f"p{i}", 0, "v", 1.0, "avc1", None, None, None, "a") for i in range(50)])
    r = renditions(spark, [(None, i, "a", "n", "u", False) for i in range(900)]).drop("playlist_id")
    assert catalog.tracks(v, r).count() == 50 * 901
    assert 0 < shuffled(spark, lambda: catalog.tracks(v, r)) < 25_000


def test_linked_pairs_of_two_lists_stand_together(spark, monkeypatch):
    """A writer's columns repeat at once, and not after a whole group, which is longer than a page may be."""
    monkeypatch.setattr(catalog, "TILE", 5)
    v = variants(spark, [("p", i, "v", 1.0, "avc1", None, None, None, "ab"[i % 2]) for i in range(40)] + [("p", 40, "v", 1.0, "avc1", None, None, None, "none"), ("p", 41, "v", 1.0, "avc1", None, None, None, None)])
    r = renditions(spark, [("p", i, "ab"[i % 2], "n", "u" if i % 7 else None, i % 3 == 0) for i in range(200)])
    rows = catalog.linked(v, r).coalesce(1).collect()
    want = [(i, f"audio-{k + 1}", k % 3 == 0, 100, False) for i in range(40) for k in range(200) if k % 2 == i % 2 and k % 7]
    want += [(40, None, None, None, True), (41, None, None, None, False)]
    assert sorted(map(repr, ((x.variant_index, x.audio_track_id, x.is_default, x.members, x.missing) for x in rows))) == sorted(map(repr, want))
    seen, gaps = {}, []
    for at, x in enumerate(rows):
        gaps += [at - seen[x.audio_track_id]] if x.audio_track_id in seen else []
        seen[x.audio_track_id] = at
    assert sorted(gaps)[len(gaps) // 2] <= 5


def test_equal_bandwidth_goes_to_the_first_option(spark):
    v = variants(spark, [("p", i, "u", b, None, None, None, None, None) for i, b in enumerate((1.0, 7.0, 7.0))])
    assert catalog.default_option(catalog.options(v, renditions(spark, []))).first().option_index == 1


def test_selection_faults(spark):
    options = F.array(F.array(F.lit("v1"), F.lit("a1")), F.array(F.lit("v2"), F.lit("a2")))

    def fault(*ids):
        chosen = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")
        return spark.range(1).select(catalog.selection_fault(chosen, options).alias("x")).first().x

    assert fault("v1") is None and fault("a1", "v1") is None
    assert fault() == "nothing is selected" and fault("v1", "v1") == "a track is selected twice"
    assert fault("x") == "a track is not offered" and fault("v1", "a2") == "no option has all selected tracks"


def test_titles_and_bandwidth(spark):
    track = F.struct(
        F.lit("video-1").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(1280).alias("width"), F.lit(720).alias("height"),
        F.lit(29.97).alias("frame_rate"), F.array(F.lit("avc1")).alias("codecs"),
    )
    audio = F.struct(
        F.lit("a").alias("id"), F.lit("One").alias("name"), F.lit("en").alias("language"), F.lit(6).alias("channels"),
        F.array().cast("array<string>").alias("codecs"), F.lit(128000.0).alias("bandwidth"),
    )
    row = spark.range(1).select(
        catalog.video_title(track).alias("v"), catalog.audio_title(audio).alias("a"),
        catalog.option_title(F.array(F.lit("x")), F.array().cast("array<string>"), F.lit(2.4e6)).alias("o"),
        catalog.effective_bandwidth(F.lit(0.0), F.array(F.lit(5.0))).alias("zero"),
        catalog.effective_bandwidth(F.lit(None).cast("double"), F.array(F.lit(5.0), F.lit(None).cast("double"))).alias("sum"),
    ).first()
    assert (row.v, row.a, row.o) == ("1280x720 · 29.97 fps · avc1", "One (en) · 6 ch · 128 kbps", "video: x | 2.40 Mbps")
    assert (row.zero, row.sum) == (0.0, 5.0)


def test_unseen_items_by_identity(spark):
    rows = [("t", "media", None, None, 5, 0), ("t", "media", None, None, 5, 1), ("u", "media", None, None, 5, 2)]
    rows += [("t", "init", "i", (0, 9), None, 3), ("t", "init", "i", (0, 9), None, 4), ("t", "init", "i", (9, 9), None, 5)]
    found = spark.createDataFrame(rows, "track_id string, kind string, url string, byte_range struct<offset:long,length:long>, sequence_id long, item_ord int")
    found = discovery.identity(found)
    assert sorted(r.item_ord for r in discovery.unseen(found, found.where("false")).collect()) == [0, 2, 3, 5]
    once = discovery.unseen(found, found.where("false"))
    assert discovery.unseen(found, once).count() == 0


def test_sites_and_timeouts(spark):
    def site(key, path, mode):
        args = [F.lit(x).cast("string") for x in (key, path, mode)]
        return spark.range(1).select(discovery.site_of(*args).alias("x")).first().x

    assert site("abematv-license://x", "p", "follow") == "abema" and site(None, "https://x.googlevideo.com", "follow") == "youtube"
    assert site("k", "https://x.googlevideo.com", "archive") == "common" and site(None, "bcovlive", "follow") == "common"
    row = spark.range(1).select(
        discovery.refresh_seconds(F.lit(3), F.lit(float("nan"))).alias("a"), discovery.refresh_seconds(F.lit(30), F.lit(5.0)).alias("b"),
        discovery.attempt_seconds(F.lit(9), F.lit(2)).alias("c"), discovery.item_seconds(F.lit(2.0)).alias("d"), discovery.poll_seconds(F.lit(9.0)).alias("e"),
    ).first()
    assert tuple(row) == (20.0, 60.0, 10, 40.0, 5.0)


def test_task_ids_cross_spans(spark):
    rows = spark.range(0, 500).selectExpr("id * 3 as event_id", "concat('t', id % 4) as track_id")
    got = tasks.task_id(tasks.track_index(rows, "event_id"), "event_id", span=64).orderBy("event_id").collect()
    assert [r.task_id for r in got] == list(range(500)) and [r.track_index for r in got] == [i // 4 for i in range(500)]


def test_progress_of_one_track(spark):
    rows = spark.createDataFrame([("t", "init", None, "ready"), ("t", "media", 2.0, "ready"), ("t", "media", 3.0, "dropped"), ("v", "media", 1.0, None)],
                                 "track_id string, kind string, duration double, status string")
    got = {r.track_id: tuple(r)[1:] for r in tasks.progress(rows).collect()}
    assert got == {"t": (3, 3, 2, 1, 2.0), "v": (1, 0, 0, 0, 0.0), None: (4, 3, 2, 1, 2.0)}
    row = spark.range(1).select(
        tasks.elapsed_seconds(F.lit(1000), F.lit(5000)).alias("s"), tasks.elapsed_seconds(F.lit(0), F.lit(3)).alias("least"),
        tasks.eta_text(F.lit(1000), F.lit(5000), F.lit(3), F.lit(3)).alias("eta"), tasks.eta_text(F.lit(0), F.lit(9), F.lit(0), F.lit(3)).alias("none"),
    ).first()
    assert tuple(row) == (4, 1, "0s", "--")


def test_media_rates_round_ties_as_their_sql(spark, tmp_path):
    """72 events last 570 seconds: 2026.35 seconds of media are 3.555 for each of these."""
    import duckdb

    ties = [2026.35, 2026.34, 1935.15, 2345.55, 2.85, 0.0]
    rows = [(72 * u + i, u, "error" if i % 5 == 3 else "view", played if i == 0 else 0.0) for u, played in enumerate(ties) for i in range(72)]
    rows += [(1000 + i, 6, None if i < 3 else "view", 1.5) for i in range(6)] + [(1010 + i, 7, "view", None) for i in range(3)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(choice_queries.ORACLE["media_rates"]).fetchall())
    assert [w[2] for w in want] == ["3.56", "3.55", "3.40", "4.12", "0.01", "0.00", "0.09", None]
    assert sorted(map(tuple, choice_queries.media_rates(spark, str(tmp_path)).collect())) == want


def test_attempts_fold_to_outcomes(spark):
    rows = [(1, 1, False), (1, 2, False), (2, 1, True), (3, 1, False), (3, 2, True), (4, 1, False), (4, 2, False), (4, 3, True)]
    got = {r.task_id: (r.status, r.errors) for r in tasks.outcomes(spark.createDataFrame(rows, "task_id int, attempt int, ok boolean"), 2).collect()}
    assert got == {1: ("dropped", 2), 2: ("ready", 0), 3: ("ready", 1), 4: ("dropped", 2)}


def test_track_and_total_faults(spark):
    tracks = spark.createDataFrame([("Video",), ("video",), ("a b",), ("x",)], "track_id string")
    assert {r.track_id: r.fault for r in tasks.track_faults(tracks).collect()} == {
        "Video": "a track id is not unique", "video": "a track id is not unique", "a b": "a track id is malformed",
    }
    batches = spark.createDataFrame([("x", 0, 2, 4), ("x", 1, 2, None), ("y", 0, 1, 4), ("y", 1, 1, 5), ("z", 0, 1, 2), ("z", 1, 2, None)],
                                    "track_id string, batch int, items int, total int")
    assert {r.track_id: r.fault for r in tasks.total_faults(batches).collect()} == {"y": "a total changes", "z": "a total is too small"}
    assert sorted(r.track_id for r in tasks.unknown_tracks(batches, tracks).select("track_id").distinct().collect()) == ["y", "z"]


def test_config_status_and_names(spark):
    config = spark.createDataFrame([(None, 7, 5), (0, None, None), (3, None, None)], "threads int, source_request_attempts int, task_attempts int")
    got = tasks.normalized_config(config).collect()
    assert tuple(got[0]) == (5, 7, 5, None) and got[1].fault and not got[2].fault
    row = spark.range(1).select(
        tasks.session_status(F.lit("draining"), F.lit(False), F.lit(False)), tasks.session_status(F.lit("running"), F.lit(True), F.lit(False)),
        tasks.session_status(F.lit("finalizing"), F.lit(True), F.lit(True)), tasks.filename_fault(F.lit("a/b")), tasks.filename_fault(F.lit("a")),
        tasks.failure_reason(F.lit(None).cast("string"), F.lit(500), F.lit("m")),
    ).first()
    assert tuple(row) == ("downloading", "stopping", "merging", "a file name is invalid", None, "500")


def outcomes(spark, text, track="t"):
    rows = [(track, i, {"R": "ready", "D": "dropped"}[c], f"{i};") for i, c in enumerate(text) if c != "."]
    random.Random(len(text)).shuffle(rows)
    return spark.createDataFrame(rows, "track_id string, track_index long, status string, payload string")


@pytest.mark.parametrize(("text", "whole"), [("DRDDRD", ["1;", "4;"]), ("RR", ["0;1;"]), ("DD", []), ("RDR", ["0;", "2;"])])
def test_gaps_split_runs(spark, text, whole):
    rows = outcomes(spark, text)
    assert [r.payload for r in output.concentrated(rows, "payload").orderBy("run").collect()] == whole
    joined = output.concentrated(rows, "payload", ignore_gaps=True).collect()
    assert [r.payload for r in joined] == (["".join(whole)] if whole else [])


def test_prefix_waits_for_missing_outcomes(spark):
    rows = outcomes(spark, "RD.RR")
    expected = spark.createDataFrame([("t", 5), ("empty", 0)], "track_id string, expected int")
    assert sorted(r.track_index for r in output.contiguous_prefix(rows).collect()) == [0, 1]
    assert {r.track_id: (r.next_index, r.complete) for r in output.completeness(rows, expected).collect()} == {"t": (2, False), "empty": (0, True)}
    assert output.duplicate_outcomes(rows.unionByName(rows.where("track_index = 3"))).count() == 1


def test_paths(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert [one(output.output_base(F.lit(p))) for p in ("./episode.final.ts", "./episode.release", "./episode.MP4", "a/b")] == ["episode.final", "./episode.release", "episode", "a/b"]
    assert all(one(output.output_base(F.lit(f"a/../x/./e.{e.upper()}"))) == "x/e" for e in output.VIDEO_EXTENSIONS)
    assert [one(output.output_base(F.lit(p))) for p in ("e.mxf", "d/.ts", "/../e.vob", "../e.mpe")] == ["e.mxf", "d/.ts", "/e", "../e"]
    several = [output.container_path(F.lit("o"), F.lit("t1"), F.lit(e), F.lit(m)) for e, m in (("ts", False), ("ts", True), ("T", True))]
    assert [one(c) for c in several] == ["o.ts", "o.t1.ts", None]
    runs = output.runs(outcomes(spark, "RDR")).select("track_id", "run").distinct()
    assert sorted(r.path for r in output.output_paths(runs, F.lit("o"), "ts").collect()) == ["o_0.ts", "o_1.ts"]
    paths = spark.createDataFrame([("a", "ts"), ("b", "ts"), ("c", "ts")], "base string, extension string")
    existing = spark.createDataFrame([("a.ts",), ("b_0.ts",)], "path string")
    assert sorted(r.path for r in output.free_path(paths, existing, 9).collect()) == ["a_9.ts", "b_9.ts", "c.ts"]


def test_mux_plans(spark):
    rows = [("r1", "video", 1), ("r1", "audio", 1), ("r2", "video", 2), ("r2", "audio", 1), ("r3", "video", 1), ("r3", "audio", 0), ("r4", "audio", 1)]
    got = {r.resource: r.mux for r in output.mux_plan(spark.createDataFrame(rows, "resource string, type string, paths int"), "resource").collect()}
    assert got == {"r1": True, "r2": False, "r3": False, "r4": False}
    muxers = spark.createDataFrame([("mkvmerge", 0, False), ("ffmpeg", 1, True)], "name string, priority int, available boolean")
    assert output.first_available(muxers).first().name == "ffmpeg"
    args = spark.range(1).select(output.mux_arguments(F.lit("ffmpeg"), F.lit("o"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first().x
    assert args == ["-y", "-i", "a", "-i", "b", "-map", "0", "-map", "1", "-c", "copy", "-movflags", "+faststart", "o"]


def test_a_drop_splits_its_own_track_only(spark):
    rows = outcomes(spark, "RDR", "v").unionByName(outcomes(spark, "RR", "a"))
    types = spark.createDataFrame([("v", "video"), ("a", "audio"), ("none", "audio")], "track_id string, type string")
    assert {r.track_id: r.paths for r in archive.artifacts(rows, types).collect()} == {"v": 2, "a": 1, "none": 0}


def test_keys(spark):
    held = spark.createDataFrame([("a", "0" * 32, 1)], "id string, key string, version int")
    more = spark.createDataFrame([("a", "1" * 32, 2), ("b", "2" * 32, 1)], "id string, key string, version int")
    assert {r.id: r.key[0] for r in discovery.upsert_keys(held, more).collect()} == {"a": "1", "b": "2"}
    assert [r.id for r in discovery.missing_keys(more, held).collect()] == ["b"]
    kinds = spark.createDataFrame([("p", "external"), ("p", "http")], "playlist_id string, key_kind string")
    assert discovery.external_keys_without_explicit(kinds, 0).first().fault and not discovery.external_keys_without_explicit(kinds, 1).first().fault
