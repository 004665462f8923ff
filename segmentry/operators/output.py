"""Ordered output: contiguous prefixes, runs between gaps, paths, mux plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.operators import spans

# File extensions of video containers.
VIDEO_EXTENSIONS = (
    "3g2", "3gp", "asf", "avi", "flv", "m2ts", "m4v", "mkv", "mov", "mp4", "mpe",
    "mpeg", "mpg", "mts", "ogv", "rm", "rmvb", "ts", "vob", "webm", "wmv",
)


def contiguous_prefix(rows: DataFrame) -> DataFrame:
    """Outcomes that can be written: those without a missing index before them.

    A track is counted in spans of its indexes.
    """
    at = spans.before(rows, ["track_id"], "track_index", sums={"prefix_at": F.lit(1).cast("long")})
    return at.where("track_index = prefix_at").drop("prefix_at")


def completeness(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``track_id, next_index, complete``: the first index without an outcome."""
    found = contiguous_prefix(rows).groupBy("track_id").agg(F.count(F.lit(1)).alias("next_index"))
    return expected.join(found, "track_id", "left").select(
        "track_id",
        F.coalesce("next_index", F.lit(0)).alias("next_index"),
        (F.coalesce("next_index", F.lit(0)) >= F.col("expected")).alias("complete"),
    )


def duplicate_outcomes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("track_id", "track_index").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def runs(rows: DataFrame, ignore_gaps: bool = False) -> DataFrame:
    """Add ``run`` to ready outcomes: it grows at each one that follows a drop.

    Drops before the first, after the last, and several in a row start nothing. A track is
    gone through in spans: the status before a row, and the starts before it, are carried on.
    """
    ready = F.col("status") == "ready"
    if ignore_gaps:
        return rows.where(ready).withColumn("run", F.lit(0).cast("long"))
    seen = spans.before(rows, ["track_id"], "track_index", lasts={"status_before": F.coalesce("status", F.lit("dropped"))})
    starts = ready & (F.coalesce("status_before", F.lit("dropped")) == "dropped")
    marked = seen.withColumn("starts", starts.cast("long"))
    counted = spans.before(marked, ["track_id"], "track_index", sums={"run_before": F.col("starts")})
    return counted.withColumn("run", F.col("run_before") + F.col("starts") - 1).where(ready).drop("starts", "status_before", "run_before")


def concentrated(rows: DataFrame, payload: str, ignore_gaps: bool = False) -> DataFrame:
    """``track_id, run, items, payload``: each run's payloads one after another."""
    return (
        runs(rows, ignore_gaps)
        .groupBy("track_id", "run")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.expr(f"listagg(`{payload}`) WITHIN GROUP (ORDER BY track_index)").alias("payload"),
        )
    )


def output_paths(run_rows: DataFrame, base: Column, extension: str) -> DataFrame:
    """Add ``path``: the plain one if a track has one run, else with the run's number."""
    one = F.count(F.lit(1)).over(Window.partitionBy("track_id")) == 1
    numbered = F.concat(base, F.lit("_"), F.col("run"), F.lit(f".{extension}"))
    return run_rows.withColumn("path", F.when(one, F.concat(base, F.lit(f".{extension}"))).otherwise(numbered))


def joined_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, and without parts that ``..`` leaves again."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")

    def step(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = (p == "..") & last.isNotNull() & (last != "..")
        lost = (p == "..") & last.isNull() & rooted
        return F.when(back, F.slice(kept, 1, F.size(kept) - 1)).when(lost, kept).otherwise(F.concat(kept, F.array(p)))

    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(F.aggregate(parts, none, step), "/"))


def output_base(path: Column) -> Column:
    """The path without its extension, if that is one of a video container. Other paths
    stay as they are written; a name of which all is behind its only dot has no extension."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    bare = joined_path(F.regexp_replace(path, r"\.[^./]+$", ""))
    return F.when(extension.isin(*VIDEO_EXTENSIONS), bare).otherwise(path)


def container_path(base: Column, track_id: Column, extension: Column, several: Column) -> Column:
    """``base[.track].ext``; null where the extension is not 1 to 10 of a-z and 0-9."""
    middle = F.when(several, track_id)
    return F.when(extension.rlike("^[a-z0-9]{1,10}$"), F.concat_ws(".", base, middle, extension))


def free_path(paths: DataFrame, existing: DataFrame, now_ms: int) -> DataFrame:
    """``base, extension, path``: with the time where the path, or its first run, exists."""
    plain = F.concat_ws(".", "base", "extension")
    first = F.concat(F.col("base"), F.lit("_0."), F.col("extension"))
    asked = paths.withColumn("path", F.explode(F.array(plain, first)))
    hits = asked.join(existing.select("path"), "path", "left_semi").select("base", "extension").distinct()
    hits = hits.withColumn("taken", F.lit(True))
    return paths.join(hits, ["base", "extension"], "left").select(
        "base",
        "extension",
        F.when(F.col("taken"), F.concat(F.col("base"), F.lit(f"_{now_ms}."), F.col("extension"))).otherwise(plain).alias("path"),
    )


def kept_items(rows: DataFrame) -> DataFrame:
    """Without merging: ``track_id, track_index, filename`` of the ready items, in no
    artifact; a caller writes them partitioned by track."""
    return rows.where("status = 'ready'").select("track_id", "track_index", "filename")


def ordered_paths(run_paths: DataFrame, tracks: DataFrame) -> DataFrame:
    """``place, path``: all outputs, by the declared order of tracks and then by run.

    Outputs are counted by track and numbered within it, and the tracks' counts are added
    up in spans of their order, so only the spans' totals are ordered as a whole.
    """
    counts = run_paths.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    counted = tracks.select("track_id", "track_ord").join(counts, "track_id")
    first = spans.before(counted, [], "track_ord", sums={"first": F.col("n")}).select("track_id", "first")
    at = Window.partitionBy("track_id").orderBy("run")
    return run_paths.join(first, "track_id").select(
        (F.col("first") + F.row_number().over(at) - 1).alias("place"), "track_id", "path"
    )


def snapshot(progress: DataFrame, outputs: DataFrame) -> DataFrame:
    """Progress of every track beside its outputs; ``fault`` where a track has no output state."""
    held = outputs.withColumn("known", F.lit(True))
    return (
        progress.join(held, "track_id", "left")
        .withColumn("fault", F.when(F.col("known").isNull(), "a track has no output state"))
        .drop("known")
    )


def mux_plan(artifacts: DataFrame, group: str) -> DataFrame:
    """Whether the artifacts of a group are muxed: a video, an audio, and one path each.

    ``artifacts``: the group, ``type`` and ``paths``, the number of paths; tracks without
    any are no artifacts.
    """
    return (
        artifacts.where("paths > 0")
        .groupBy(group)
        .agg(
            F.bool_or(F.col("type") == "video").alias("has_video"),
            F.bool_or(F.col("type") == "audio").alias("has_audio"),
            F.bool_and(F.col("paths") == 1).alias("whole"),
        )
        .withColumn("mux", F.col("has_video") & F.col("has_audio") & F.col("whole"))
    )


def first_available(muxers: DataFrame, *hosts: str) -> DataFrame:
    """The available muxer of least priority, of each of ``hosts`` if named; a failed probe is none."""
    return muxers.where("available").groupBy(*hosts).agg(F.min_by("name", "priority").alias("name"))


def mux_arguments(name: Column, output: Column, inputs: Column) -> Column:
    """Arguments of the muxer programs, as an array."""
    ffmpeg = F.concat(
        F.array(F.lit("-y")),
        F.flatten(F.transform(inputs, lambda p: F.array(F.lit("-i"), p))),
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(inputs) - 1), lambda i: F.array(F.lit("-map"), i.cast("string")))),
        F.array(F.lit("-c"), F.lit("copy"), F.lit("-movflags"), F.lit("+faststart"), output),
    )
    return F.when(name == "mkvmerge", F.concat(F.array(F.lit("-o"), output), inputs)).when(name == "ffmpeg", ffmpeg)
