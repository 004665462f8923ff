"""Sources of tracks that a user writes, as Spark data sources for batch and stream.

A :class:`TrackSource` says in which shards it can be read, which tracks a shard has, and
what a shard gave from one refresh to another. :func:`track_format` makes a data source of
it, so that ``spark.read.format(name)`` and ``spark.readStream.format(name)`` give its rows:
a task for each shard, and in a stream one offset, the number of refreshes so far. What
follows (items, tasks, follow mode) does not know where rows come from.

Options of every such format: ``rows`` is ``batches`` (the default) or ``tracks``, which
lists the declared tracks; the rest goes to the source.

A stream starts again from its checkpoint, so a source must give the same rows for the same
refreshes each time it is asked. A source without shards has nothing to declare, which is a
fault; one that gives None instead was cancelled and has no rows. A track's id names
files, so it is checked, and two ids that differ in case only are the same.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from segmentry.operators.tasks import TRACK_ID

#: What a source of items gives for each of them.
ITEMS = (
    "kind string, url string, duration double, byte_range struct<offset:long,length:long>,"
    " encryption struct<scheme:string,key_id:string,iv:string>, item_ord long, total long"
)
#: What a source of playlists gives for each refresh.
REFRESHES = "status int, playlist_url string, content string"
TRACKS = "track_id string, type string, source_path string, continuous boolean"


@dataclass(frozen=True)
class Track:
    id: str
    type: str = "video"
    source_path: str | None = None


@dataclass(frozen=True)
class Batch:
    """What one refresh of a track gave: rows in the order of the source's schema."""

    track_id: str
    refresh: int
    rows: Sequence[tuple] = field(default_factory=tuple)


class TrackSource(ABC):
    """What a user's source states; its instances are sent to the tasks."""

    #: Columns behind ``track_id`` and ``refresh``.
    schema = ITEMS
    #: Whether the tracks may go on.
    continuous = False

    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)

    @abstractmethod
    def shards(self) -> Sequence[Any] | None:
        """Parts that are read on their own, a track each where they are few; None if cancelled."""

    @abstractmethod
    def tracks(self, shard: Any, start: int, end: int) -> Iterable[Track]:
        """The tracks of a shard that may come in these refreshes, asked for in its task."""

    @abstractmethod
    def discover(self, shard: Any, start: int, end: int) -> Iterator[Batch | pa.RecordBatch]:
        """What the shard gave in the refreshes from ``start`` to before ``end``.

        Record batches have ``track_id``, ``refresh`` and the columns of the schema.
        """

    def latest(self) -> int:
        """How many refreshes there are so far; a source of a snapshot has one."""
        return 1


@dataclass
class _Span(InputPartition):
    shard: Any
    start: int
    end: int


def _declared(source: TrackSource, span: _Span) -> dict[str, Track]:
    found: dict[str, Track] = {}
    lower: set[str] = set()
    for track in source.tracks(span.shard, span.start, span.end):
        if not re.fullmatch(TRACK_ID, track.id):
            raise ValueError(f"a track has an invalid id: {track.id!r}")
        if track.id.lower() in lower:
            raise ValueError(f"a track is declared twice: {track.id!r}")
        found[track.id] = track
        lower.add(track.id.lower())
    return found


def _rows(source: TrackSource, span: _Span, listed: bool) -> Iterator[tuple | pa.RecordBatch]:
    declared = _declared(source, span)
    if listed:
        for track in declared.values():
            yield (track.id, track.type, track.source_path, source.continuous)
        return
    known = pa.array(list(declared), pa.string())
    for batch in source.discover(span.shard, span.start, span.end):
        if isinstance(batch, pa.RecordBatch):
            if not pc.all(pc.is_in(batch.column("track_id"), known)).as_py() and batch.num_rows:
                raise ValueError("a batch is of a track that was not declared")
            yield batch
            continue
        if batch.track_id not in declared:
            raise ValueError(f"a batch is of a track that was not declared: {batch.track_id!r}")
        if not span.start <= batch.refresh < span.end:
            raise ValueError(f"a batch is of a refresh that was not asked for: {batch.refresh}")
        for row in batch.rows:
            yield (batch.track_id, batch.refresh, *row)


def _spans(source: TrackSource, start: int, end: int) -> list[_Span]:
    shards = source.shards()
    if shards is not None and not len(shards):
        raise ValueError("a source must declare at least one track")
    return [_Span(shard, start, end) for shard in shards or ()]


class _Reader(DataSourceReader):
    def __init__(self, source: TrackSource, listed: bool) -> None:
        self.source, self.listed = source, listed

    def partitions(self) -> Sequence[InputPartition]:
        # Without a part there would be one call with none.
        return _spans(self.source, 0, self.source.latest()) or [_Span(None, 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple | pa.RecordBatch]:
        if partition.end:
            yield from _rows(self.source, partition, self.listed)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, source: TrackSource) -> None:
        self.source = source

    def initialOffset(self) -> dict:
        return {"refreshes": 0}

    def latestOffset(self) -> dict:
        return {"refreshes": self.source.latest()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _spans(self.source, start["refreshes"], end["refreshes"])

    def read(self, partition: _Span) -> Iterator[tuple | pa.RecordBatch]:
        yield from _rows(self.source, partition, False)


def track_format(name: str, source: type[TrackSource]) -> type[DataSource]:
    """A data source of the name, for ``spark.dataSource.register``."""

    class TrackFormat(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _listed(self) -> bool:
            rows = self.options.get("rows", "batches")
            if rows not in ("batches", "tracks"):
                raise ValueError("rows must be batches or tracks")
            return rows == "tracks"

        def schema(self) -> str:
            return TRACKS if self._listed() else f"track_id string, refresh long, {source.schema}"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(source(self.options), self._listed())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(source(self.options))

    return TrackFormat


class RecordedPlaylists(TrackSource):
    """Refreshes of live or finished playlists, recorded as files that any task can open.

    Option ``path``: a folder as :func:`record` writes it, in any store that Arrow reads.
    Each recording adds a folder named by how many there are then, with a folder for each
    shard; so a listing of names tells what is new, a task opens the files of its shard
    and no other, and what came late is found where it came.
    """

    schema = REFRESHES
    continuous = True

    def __init__(self, options: Mapping[str, str]) -> None:
        super().__init__(options)
        if "path" not in self.options:
            raise ValueError("recorded playlists need a path")

    def _folders(self, *below: str, wanted: str) -> list[str]:
        """Values of the folders ``wanted=<value>`` below the path."""
        store, root = fs.FileSystem.from_uri(self.options["path"])
        at = "/".join([root.rstrip("/"), *below])
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        names = (f.base_name for f in found if f.type == fs.FileType.Directory)
        return [n.partition("=")[2] for n in names if n.startswith(f"{wanted}=")]

    def latest(self) -> int:
        return max(map(int, self._folders(wanted="part")), default=0)

    def shards(self) -> Sequence[str] | None:
        parts = self._folders(wanted="part")
        return sorted({s for p in parts for s in self._folders(f"part={p}", wanted="shard")}, key=int) or None

    def _data(self, shard: str, start: int, end: int) -> ds.Dataset | None:
        store, root = fs.FileSystem.from_uri(self.options["path"])
        places = [f"{root.rstrip('/')}/part={n}/shard={shard}" for n in range(start + 1, end + 1)]
        files = [f.path for p in places for f in store.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.path.endswith(".parquet")]
        return ds.dataset(files, filesystem=store, format="parquet") if files else None

    def tracks(self, shard: str, start: int, end: int) -> Iterator[Track]:
        data, seen = self._data(shard, start, end), set()
        for batch in data.to_batches(columns=["track_id", "playlist_url"]) if data else ():
            for name, url in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                if name not in seen:
                    seen.add(name)
                    yield Track(name, source_path=url)

    def discover(self, shard: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        data = self._data(shard, start, end)
        columns = ["track_id", "refresh", "status", "playlist_url", "content"]
        yield from data.to_batches(columns=columns) if data else ()


RECORDED = "recorded_playlists"


def record(refreshes: DataFrame, path: str, part: int, shards: int = 32) -> None:
    """Add refreshes (``track_id, refresh`` and ``REFRESHES``) as the ``part``-th recording, from 1.

    All refreshes of a track are in one shard. Writing a part again replaces it.
    """
    shard = F.pmod(F.xxhash64("track_id"), F.lit(shards)).cast("int")
    rows = refreshes.select(
        F.col("track_id").cast("string"), F.col("refresh").cast("long"), F.col("status").cast("int"), "playlist_url", "content"
    )
    rows.withColumn("shard", shard).write.partitionBy("shard").mode("overwrite").parquet(f"{path}/part={part}")


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All refreshes recorded so far."""
    spark.dataSource.register(track_format(RECORDED, RecordedPlaylists))
    return spark.read.format(RECORDED).option("path", path).load()


def recorded_stream(spark: SparkSession, path: str) -> DataFrame:
    """Refreshes as they are recorded, those of one recording in one batch or earlier."""
    spark.dataSource.register(track_format(RECORDED, RecordedPlaylists))
    return spark.readStream.format(RECORDED).option("path", path).load()


def last_playlists(refreshes: DataFrame) -> DataFrame:
    """``playlist_id, playlist_url, content`` of each track's last refresh that was reached."""
    last = F.max_by(F.struct("playlist_url", "content"), F.col("refresh")).alias("last")
    return refreshes.where("status BETWEEN 200 AND 299").groupBy("track_id").agg(last).select(
        F.col("track_id").alias("playlist_id"), "last.*"
    )
