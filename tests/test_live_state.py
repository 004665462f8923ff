"""State of live tracks: runs of numbers, late refreshes, and a pace for each track."""

from __future__ import annotations

import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from segmentry.plans import follow
from segmentry.streaming import live, runs


def test_intervals_are_sets_of_numbers():
    rng = random.Random(1)
    for _ in range(60):
        seen, plain = live.Intervals(), set()
        for n in (rng.randrange(40) for _ in range(60)):
            assert (n in seen) == (n in plain)
            assert seen.add(n) == (n not in plain)
            plain.add(n)
        assert sorted(plain) == [n for low, high in seen.runs for n in range(low, high + 1)]
        assert all(b[0] > a[1] + 1 for a, b in zip(seen.runs, seen.runs[1:], strict=False))
        assert live.Intervals(reversed(seen.runs)).runs == seen.runs


class FakeState:
    """A value or list state of one key."""

    def __init__(self) -> None:
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value if isinstance(self.value, tuple) else iter(self.value or ())

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class FakeHandle:
    def __init__(self) -> None:
        self.states, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.states.setdefault(name, FakeState())

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def parsed(refresh, numbers, start=None, end=False, status=200, fault=None):
    rows = [(refresh, status, end, fault, None, i, "media", str(n), n, f"{n}.ts") for i, n in enumerate(numbers)]
    if start:
        rows.append((refresh, status, end, fault, None, len(rows), "init", start, None, start))
    if not rows:
        rows.append((refresh, status, end, fault, None, None, None, None, None, None))
    return rows


COLUMNS = ["refresh", "status", "has_end_list", "fault", "sealed", "item_ord", "kind", "identity", "sequence_id", "url"]


def fed(processor, *refreshes):
    frame = pd.DataFrame([r for rows in refreshes for r in rows], columns=COLUMNS)
    out = [f for f in processor.handleInputRows(("t",), iter([frame]), None)]
    return [(int(r.refresh), r.event, None if pd.isna(r.sequence_id) else int(r.sequence_id)) for f in out for r in f.itertuples()]


def test_late_refreshes_bring_their_items_and_state_holds_gaps_only():
    handle, follower = FakeHandle(), live.Follow()
    follower.init(handle)
    assert fed(follower, parsed(4, range(100, 104), start="i")) == [(4, "item", n) for n in range(100, 104)] + [(4, "item", None)]
    assert fed(follower, parsed(1, range(90, 102), start="i")) == [(1, "item", n) for n in range(90, 100)]
    assert fed(follower, parsed(1, [1, 2])) == []  # comes again
    assert fed(follower, parsed(2, [], status=404)) == []  # a late fault is past
    assert handle.states["media"].value == [(90, 103)] and handle.states["refreshes"].value == [(1, 2), (4, 4)]
    for r in range(5, 300):
        fed(follower, parsed(r, range(100 + r, 104 + r)))
    assert handle.states["media"].value == [(90, 103), (105, 402)]  # 104 never came
    assert fed(follower, parsed(400, [], status=404)) == [(400, "ended", None)]
    assert handle.states["media"].value is None and fed(follower, parsed(401, [7])) == []


def clock(ms):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)


def tick(handle, poll, now):
    """Run the timers that are due by now, as Spark does."""
    out = []
    for at in sorted(t for t in handle.timers if t <= now):
        handle.timers.discard(at)
        out += [tuple(r) for f in poll.handleExpiredTimer(("t",), clock(now), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)) for r in f.itertuples(index=False)]
    return out


def came(poll, now, *rows):
    frame = pd.DataFrame(rows, columns=["refresh", "average", "done"])
    assert list(poll.handleInputRows(("t",), iter([frame]), clock(now))) == []


@pytest.mark.parametrize(("average", "wait"), [(2.5, 2500), (9.0, 5000), (0.0, 5000), (None, 5000), (0.04, 40), (float("nan"), 5000)])
def test_a_track_is_asked_at_its_pace(average, wait):
    handle, poll = FakeHandle(), live.Poll()
    poll.init(handle)
    now = 1_000_000
    for refresh in range(3):
        came(poll, now, (refresh, average, False))
        assert tick(handle, poll, now + wait - 1) == []
        assert tick(handle, poll, now + wait) == [("t", refresh + 1, now + wait)]
        assert tick(handle, poll, now + 10 * wait) == []  # asked once, until it comes
        now += 20 * wait


def test_tracks_that_are_over_and_late_refreshes_set_no_timer():
    handle, poll = FakeHandle(), live.Poll()
    poll.init(handle)
    came(poll, 0, (5, 1.0, False))
    came(poll, 500, (3, 4.0, False))  # late
    assert handle.timers == {1000}
    came(poll, 600, (6, 2.0, False))  # came before it was asked for
    assert handle.timers == {2600}
    came(poll, 700, (7, 2.0, True))
    assert handle.timers == set() and tick(handle, poll, 9000) == []
    came(poll, 800, (8, 2.0, False))
    assert handle.timers == set()


def test_timers_of_a_stream(spark, tmp_path):
    """Three tracks of different paces, by the real clock."""
    feed = str(tmp_path / "feed")
    rows = [("fast", 0, 0.2, False), ("slow", 0, 60.0, False), ("over", 0, 0.2, True)]
    spark.createDataFrame(rows, "track_id string, refresh long, average double, done boolean").write.parquet(feed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    stream = spark.readStream.schema("track_id string, refresh long, average double, done boolean").parquet(feed)
    query = live.poll_times(stream).writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if len(got := spark.table("asked").collect()) >= 2:
                break
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r.track_id, r.refresh) for r in got} == {("fast", 1), ("slow", 1)}
    due = {r.track_id: r.due for r in got}
    assert 4000 < due["slow"] - due["fast"] < 5800  # 5 s at most, 0.2 s


def test_late_refreshes_of_a_stream(spark, tmp_path):
    text = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:{}\n"
    body = lambda lo, hi: text.format(lo) + "".join(f"#EXTINF:1,\n{n}.ts\n" for n in range(lo, hi))
    schema = "track_id string, refresh long, status int, playlist_url string, content string"
    batches = [[("t", 3, 200, "https://h/l", body(13, 16))], [("t", 1, 200, "https://h/l", body(11, 14))], [("t", 4, 200, "https://h/l", body(14, 17) + "#EXT-X-ENDLIST")]]
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for rows in batches:
        follow.parsed_refreshes(spark.createDataFrame(rows, schema)).write.mode("append").parquet(feed)
        got = runs.drained(follow.followed(spark.readStream.schema(follow.PARSED).parquet(feed)), out).collect()
    assert sorted((r.sequence_id, r.refresh) for r in got if r.event == "item") == [(11, 1), (12, 1), (13, 3), (14, 3), (15, 3), (16, 4)]
    assert [r.event for r in got if r.event != "item"] == ["ended"]
