"""Live discovery as streams: items seen once, refresh policy, ordered emission."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST = 1 << 62
OUTCOME = "track_id string, track_index long, status string, payload string"
#: ``event`` is ``item``, ``ended`` or ``fatal``; the last two have no item.
FOLLOWED = (
    "track_id string, refresh long, event string, fault string,"
    " kind string, identity string, sequence_id long, url string"
)


def first_seen(found: DataFrame) -> DataFrame:
    """Each item of a track once, whenever it comes.

    A lower sequence number that was never seen is new, so the state has no watermark
    and grows with the number of distinct items.
    """
    return found.dropDuplicates(["track_id", "kind", "identity"])


def merged(streams: list[DataFrame]) -> DataFrame:
    """All producers' items in one stream."""
    first, *more = streams
    for stream in more:
        first = first.unionByName(stream)
    return first


def new_keys(found: DataFrame, held: DataFrame) -> DataFrame:
    """Keys ``id`` that are neither held nor seen before; what is resolved is never dropped."""
    return found.join(held.select("id"), "id", "left_anti").dropDuplicates(["id"])


def poll(average: float | None) -> dict[str, str]:
    """Arguments of a trigger that polls at one track's pace, for a query of that track alone;
    :class:`Poll` keeps the paces of many tracks."""
    return {"processingTime": f"{round(pace(average) * 1000)} milliseconds"}


def live_totals(found: DataFrame) -> DataFrame:
    """Items discovered so far for each track; totals of live tracks are open."""
    return found.groupBy("track_id").agg(F.count(F.lit(1)).alias("total"))


class Intervals:
    """A set of whole numbers as runs ``(low, high)``: as large as its gaps, not its numbers."""

    def __init__(self, runs: Iterable[tuple[int, int]] = ()) -> None:
        self.runs = sorted((int(low), int(high)) for low, high in runs)
        self.changed = False

    def add(self, n: int) -> bool:
        """Take a number in; whether it was not there."""
        at = bisect_right(self.runs, (n, MOST))
        low = high = n
        if at and self.runs[at - 1][1] >= n:
            return False
        begin = at
        if at and self.runs[at - 1][1] == n - 1:
            begin, low = at - 1, self.runs[at - 1][0]
        if at < len(self.runs) and self.runs[at][0] == n + 1:
            at, high = at + 1, self.runs[at][1]
        self.runs[begin:at] = [(low, high)]
        self.changed = True
        return True

    def __contains__(self, n: int) -> bool:
        at = bisect_right(self.runs, (n, MOST))
        return bool(at) and self.runs[at - 1][1] >= n


class ContiguousPrefix(StatefulProcessor):
    """Holds outcomes until all before them are there, then emits them in order.

    A second outcome of an index is dropped: the first is the one that counts. What is held
    is read once for a batch of a track, and written only if it has changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "track_index long, waiting long")
        self.held = handle.getListState("held", "track_index long, status string, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, waiting = self.next.get() if self.next.exists() else (0, 0)
        held = {int(index): tuple(outcome) for index, *outcome in self.held.get()} if waiting else {}
        for frame in rows:
            for index, *outcome in zip(frame["track_index"], frame["status"], frame["payload"], strict=True):
                if index >= at:  # what is held came first
                    held.setdefault(int(index), tuple(outcome))
        ready = []
        while at in held:
            ready.append((key[0], at, *held.pop(at)))
            at += 1
        if held:
            self.held.put([(index, *outcome) for index, outcome in held.items()])
        elif waiting:
            self.held.clear()
        self.next.update((at, len(held)))
        if ready:
            yield pd.DataFrame(ready, columns=["track_id", "track_index", "status", "payload"])

    def close(self) -> None:
        pass


def ordered_outcomes(outcomes: DataFrame) -> DataFrame:
    """The longest prefix of every track's outcomes, emitted as it grows.

    Needs the RocksDB state store, as all queries with this kind of state do.
    """
    return (
        outcomes.select("track_id", "track_index", "status", "payload")
        .groupBy("track_id")
        .transformWithStateInPandas(ContiguousPrefix(), OUTCOME, "Append", "None")
    )


class Refreshes(StatefulProcessor):
    """A track's refreshes: it ends at an end mark, or at an HTTP fault after its first item."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "started boolean, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, done = self.state.get() if self.state.exists() else (False, False)
        out = []
        for refresh, status, items, end in sorted(
            row for frame in rows for row in zip(frame["refresh"], frame["status"], frame["items"], frame["has_end_list"], strict=True)
        ):
            if done:
                continue
            verdict = "ok"
            if not 200 <= status < 300:
                verdict = "fatal" if not started else "ended" if 400 <= status < 600 else "retry"
            elif end:
                verdict = "ended"
            started |= verdict in ("ok", "ended") and items > 0
            done = verdict in ("fatal", "ended")
            out.append((key[0], int(refresh), verdict))
        self.state.update((bool(started), bool(done)))
        if out:
            yield pd.DataFrame(out, columns=["track_id", "refresh", "verdict"])

    def close(self) -> None:
        pass


def refresh_policy(refreshes: DataFrame) -> DataFrame:
    """``track_id, refresh, verdict`` (ok, retry, ended, fatal) until a track is over."""
    return (
        refreshes.select("track_id", "refresh", "status", "items", "has_end_list")
        .groupBy("track_id")
        .transformWithStateInPandas(Refreshes(), "track_id string, refresh long, verdict string", "Append", "None")
    )


class Follow(StatefulProcessor):
    """A track's refreshes in order: items not seen before, until the track is over.

    A refresh that cannot be used ends the session before the first item; after it, an HTTP
    fault ends the track and any other is passed over. SAMPLE-AES that the explicit keys do
    not serve is always fatal. A refresh that comes again does not count. One that comes
    late, after a later one, still brings the items that no other has; its faults are past.

    What a track has seen is kept as runs of sequence numbers, so the state grows with the
    gaps and not with the items, beside the initializations, which are few. It is read once
    for a batch of a track.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "items long, last long, done boolean")
        self.media = handle.getListState("media", "low long, high long")
        self.refreshes = handle.getListState("refreshes", "low long, high long")
        self.starts = handle.getListState("starts", "identity string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.exists()
        items, last, done = self.state.get() if known else (0, -1, False)
        if done:
            return
        media, refreshes = (Intervals(s.get() if known else ()) for s in (self.media, self.refreshes))
        starts = {identity for (identity,) in self.starts.get()} if known else set()
        n_starts = len(starts)
        out: list[tuple] = []
        rows_ = pd.concat(list(rows), ignore_index=True)
        rows_ = rows_.where(rows_.notna(), None)
        for refresh, found in rows_.groupby("refresh", sort=True):
            refresh = int(refresh)
            if done or not refreshes.add(refresh):
                continue
            late, last = refresh < last, max(last, refresh)
            head = found.iloc[0]
            code = int(head["status"] or 0)
            reached = 200 <= code < 300
            fault = head["fault"] if reached else f"status {code}"
            sealed = found["sealed"].dropna()
            if reached and not fault and len(sealed):
                out.append((key[0], refresh, "fatal", sealed.iloc[0], None, None, None, None))
                done = True
            elif fault:
                done = not late and (items == 0 or 400 <= code < 600)
                if done:
                    event = "fatal" if items == 0 else "ended"
                    out.append((key[0], refresh, event, fault, None, None, None, None))
            else:
                some = found[found["kind"].notna()].sort_values("item_ord")
                for kind, identity, sequence_id, url in zip(*(some[c] for c in ("kind", "identity", "sequence_id", "url")), strict=True):
                    if kind == "media":
                        number = int(sequence_id)
                        fresh = media.add(number)
                    else:
                        number, fresh = None, identity not in starts
                        starts.add(identity)
                    if fresh:
                        out.append((key[0], refresh, "item", None, kind, identity, number, url))
                        items += 1
                if head["has_end_list"]:
                    out.append((key[0], refresh, "ended", None, None, None, None, None))
                    done = True
        self.state.update((items, last, bool(done)))
        if done:  # nothing will be asked of it again
            for state in (self.media, self.refreshes, self.starts):
                state.clear()
        else:
            for state, seen in ((self.media, media), (self.refreshes, refreshes)):
                if seen.changed:
                    state.put(seen.runs)
            if len(starts) > n_starts:
                self.starts.put([(identity,) for identity in sorted(starts)])
        if out:
            frame = pd.DataFrame(out, columns=["track_id", "refresh", "event", "fault", "kind", "identity", "sequence_id", "url"])
            yield frame.astype({"sequence_id": "Int64"})

    def close(self) -> None:
        pass


#: A track is to be asked for ``refresh`` at a time in milliseconds.
ASKED = "track_id string, refresh long, due long"
PACE = 5.0


def pace(average: float | None) -> float:
    """Seconds between two refreshes of a track: its average segment, at most five."""
    return min(PACE, average) if average is not None and average > 0 else PACE


class Poll(StatefulProcessor):
    """When each track is to be asked again: at its own pace, by a timer of its own.

    Input is what came of a refresh: ``track_id, refresh, average, done``. A refresh that
    comes sets the track's timer; when it runs out the next refresh is asked for, once. A
    track that is over is not asked for again, and what comes late sets no timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "refresh long, due long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, due, done = self.state.get() if self.state.exists() else (-1, 0, False)
        now, average = timerValues.getCurrentProcessingTimeInMs(), None
        before = last
        for frame in rows:
            for refresh, seconds, over in zip(frame["refresh"], frame["average"], frame["done"], strict=True):
                done |= bool(over)
                if refresh > last:
                    last, average = int(refresh), None if pd.isna(seconds) else float(seconds)
        if due and (done or last > before):
            self.handle.deleteTimer(due)
            due = 0
        if last > before and not done:
            due = now + round(1000 * pace(average))
            self.handle.registerTimer(due)
        self.state.update((last, due, bool(done)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, due, done = self.state.get()
        if not done and due and expiredTimerInfo.getExpiryTimeInMs() == due:
            self.state.update((last, 0, False))
            yield pd.DataFrame([(key[0], last + 1, due)], columns=["track_id", "refresh", "due"])

    def close(self) -> None:
        pass


def poll_times(refreshes: DataFrame) -> DataFrame:
    """``ASKED`` rows of a stream of refreshes ``track_id, refresh, average, done``."""
    return (
        refreshes.select("track_id", "refresh", "average", "done")
        .groupBy("track_id")
        .transformWithStateInPandas(Poll(), ASKED, "Append", "ProcessingTime")
    )
