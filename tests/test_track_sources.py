"""Sources that a user writes: declarations, batches, streams and recorded playlists."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from segmentry.operators import tasks
from segmentry.plans import archive, follow
from segmentry.sources import tracks
from segmentry.sources.tracks import Batch, Track, TrackSource
from segmentry.streaming import runs


class Timetable(TrackSource):
    """Two tracks; refresh r of a track brings its items r and r + 1."""

    continuous = True

    def shards(self):
        return {"none": [], "cancelled": None}.get(self.options.get("fault"), ["sea", "Land"])

    def tracks(self, shard, start, end):
        yield Track(shard if self.options.get("fault") != "id" else "a/b", "audio", f"https://h/{shard}")
        if self.options.get("fault") == "twice":
            yield Track(shard.upper())

    def latest(self):
        return int(self.options.get("refreshes", "1"))

    def discover(self, shard, start, end):
        name = {"undeclared": "other"}.get(self.options.get("fault"), shard)
        for r in range(start, end):
            at = r if self.options.get("fault") != "early" else r - 1
            yield Batch(name, at, [("media", f"https://h/{shard}/{i}.ts", 2.0, (i, 4), None, i, None) for i in (r, r + 1)])


class Columnar(TrackSource):
    schema = "n long"

    def shards(self):
        return [0, 1, 2]

    def tracks(self, shard, start, end):
        return [Track(f"t{shard}")]

    def discover(self, shard, start, end):
        name = f"t{shard}" if self.options.get("fault") != "undeclared" else "u"
        yield pa.RecordBatch.from_pydict({"track_id": [name] * 2, "refresh": [0, 0], "n": [shard, 10 + shard]})


@pytest.fixture(scope="module")
def formats(spark):
    spark.dataSource.register(tracks.track_format("timetable", Timetable))
    spark.dataSource.register(tracks.track_format("columnar", Columnar))
    return spark


def test_items_of_a_source_become_tasks(formats):
    rows = formats.read.format("timetable").option("refreshes", "3").load()
    assert rows.rdd.getNumPartitions() == 2  # one task for each track
    items = tasks.track_index(rows.withColumn("at", F.struct("refresh", "item_ord")), "at").collect()
    found = sorted((r.track_id, r.track_index, r.url, r.byte_range.offset) for r in items)
    assert len(found) == 12 and found[:2] == [("Land", 0, "https://h/Land/0.ts", 0), ("Land", 1, "https://h/Land/1.ts", 1)]
    listed = formats.read.format("timetable").option("rows", "tracks").load().collect()
    assert {tuple(r) for r in listed} == {("sea", "audio", "https://h/sea", True), ("Land", "audio", "https://h/Land", True)}


def test_record_batches_of_a_source(formats):
    assert sorted(r.n for r in formats.read.format("columnar").load().collect()) == [0, 1, 2, 10, 11, 12]
    with pytest.raises(PySparkException, match="not declared"):
        formats.read.format("columnar").option("fault", "undeclared").load().collect()


@pytest.mark.parametrize(
    ("fault", "told"),
    [("none", "at least one track"), ("id", "invalid id"), ("twice", "declared twice"), ("undeclared", "not declared"), ("early", "not asked for")],
)
def test_faults_of_sources(formats, fault, told):
    with pytest.raises(PySparkException, match=told):
        formats.read.format("timetable").option("fault", fault).load().collect()


def test_a_cancelled_source_has_no_rows(formats):
    assert formats.read.format("timetable").option("fault", "cancelled").load().count() == 0


def test_a_stream_of_a_source_goes_on_from_its_checkpoint(formats, tmp_path):
    folder = str(tmp_path / "out")
    for upto, rows in (("2", 8), ("2", 8), ("5", 20)):
        stream = formats.readStream.format("timetable").option("refreshes", upto).load()
        assert runs.drained(stream, folder).count() == rows
    refreshes = formats.read.parquet(f"{folder}/out").groupBy("refresh").count().collect()
    assert {r.refresh: r["count"] for r in refreshes} == dict.fromkeys(range(5), 4)


TEXT = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:{}\n{}"


def refresh(name, r, items, end=False, status=200):
    body = "".join(f"#EXTINF:3,\n{i}.ts\n" for i in items) + "#EXT-X-ENDLIST" * end
    return (name, r, status, f"https://h/{name}/live.m3u8", TEXT.format(items[0] if items else 0, body))


COLUMNS = f"track_id string, refresh long, {tracks.REFRESHES}"


def test_recorded_playlists_in_batch_and_stream(spark, tmp_path):
    path, out = str(tmp_path / "rec"), str(tmp_path / "out")
    parts = [
        [refresh("a", 0, [4, 5]), refresh("b", 0, [0])],
        [refresh("a", 2, [6, 7], end=True), refresh("a", 1, [5, 6]), refresh("b", 1, [], status=404)],
    ]
    for n, rows in enumerate(parts, 1):
        tracks.record(spark.createDataFrame(rows, COLUMNS), path, n, shards=4)
        stream = tracks.recorded_stream(spark, path)
        runs.drain(stream, out + "/parsing", follow.write_parsed(out + "/parsed"))
        parsed = spark.readStream.schema(follow.PARSED).parquet(out + "/parsed/batch-*")
        got = runs.drained(follow.followed(parsed), out + "/tracks").collect()
    items = sorted((r.track_id, r.refresh, r.sequence_id) for r in got if r.event == "item")
    assert items == [("a", 0, 4), ("a", 0, 5), ("a", 1, 6), ("a", 2, 7), ("b", 0, 0)]
    assert {(r.track_id, r.event) for r in got if r.event != "item"} == {("a", "ended"), ("b", "ended")}
    assert tracks.recorded(spark, path).count() == 5
    last = {r.playlist_id: r for r in tracks.last_playlists(tracks.recorded(spark, path)).collect()}
    assert "7.ts" in last["a"].content and "0.ts" in last["b"].content and last["a"].playlist_url == "https://h/a/live.m3u8"
    plan = archive.archive_items(tracks.last_playlists(tracks.recorded(spark, path))).collect()
    assert sorted((r.track_id, r.track_index, r.url) for r in plan)[0] == ("a", 0, "https://h/a/6.ts")


def test_a_recording_written_again_replaces_itself_and_none_is_no_source(spark, tmp_path):
    path = str(tmp_path / "rec")
    for _ in range(2):
        tracks.record(spark.createDataFrame([refresh("a", 0, [1])], COLUMNS), path, 1)
    assert tracks.recorded(spark, path).count() == 1
    assert tracks.recorded(spark, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(PySparkException, match="need a path"):
        spark.read.format(tracks.RECORDED).load().count()
