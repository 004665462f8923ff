"""Tasks: numbering of discovered items, attempts and outcomes, progress, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from segmentry.functions.text import duration_text, hundredths
from segmentry.operators import spans

ATTEMPTS = 5
TRACK_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"


def track_index(rows: DataFrame, order: str) -> DataFrame:
    """Add ``track_index``: the place of an item in its track, from 0.

    Where ``order`` is a whole number a track is counted in spans; another order has no
    spans, and a track is then one window.
    """
    if isinstance(rows.schema[order].dataType, IntegralType):
        return spans.before(rows, ["track_id"], order, sums={"track_index": F.lit(1).cast("long")})
    at = Window.partitionBy("track_id").orderBy(order)
    return rows.withColumn("track_index", F.row_number().over(at).cast("long") - 1)


def task_id(rows: DataFrame, order: str, span: int = 100_000) -> DataFrame:
    """Add ``task_id``: the place in discovery order over all tracks, from 0.

    ``order`` is a unique whole number. Rows are counted in spans of it, the spans'
    counts are summed in order, and rows are numbered within their span, so no task
    sees more than a span or the list of spans.
    """
    rows = rows.withColumn("span", F.expr(f"`{order}` div {span}"))
    counts = rows.groupBy("span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("span").orderBy(order)
    return (
        rows.join(starts, "span")
        .withColumn("task_id", F.col("first") + F.row_number().over(within) - 1)
        .drop("span", "first")
    )


def outcomes(attempts: DataFrame, budget: int = ATTEMPTS) -> DataFrame:
    """Fold ``task_id, attempt, ok`` to one outcome: ready if one of the first ``budget``
    attempts succeeded. ``errors`` counts the failed ones before that."""
    tried = attempts.where(F.col("attempt") <= budget)
    won = F.min(F.when(F.col("ok"), F.col("attempt")))
    return (
        tried.groupBy("task_id")
        .agg(won.alias("won"), F.max("attempt").alias("last"))
        .select(
            "task_id",
            F.when(F.col("won").isNotNull(), "ready").otherwise("dropped").alias("status"),
            F.coalesce(F.col("won") - 1, F.col("last")).alias("errors"),
        )
    )


def progress(rows: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Counters for each track, and for all of them where ``track_id`` is null.

    ``rows``: ``track_id, kind, duration, status`` with a null status while a task is
    open. ``declared``: ``track_id, declared_total``. Durations are summed as decimals.
    """
    ready, dropped = F.col("status") == "ready", F.col("status") == "dropped"
    played = F.when(ready & (F.col("kind") == "media"), F.col("duration").cast("decimal(20,6)"))
    tracks = rows.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(ready).alias("successful"),
        F.count_if(dropped).alias("dropped"),
        F.coalesce(F.sum(played), F.lit(0)).alias("successful_duration"),
    )
    if declared is None:
        tracks = tracks.withColumn("total", F.col("discovered"))
    else:
        tracks = tracks.join(declared, "track_id", "left").withColumn(
            "total", F.coalesce("declared_total", "discovered")
        )
    return tracks.groupingSets([["track_id"], []], "track_id").agg(
        F.sum("total").alias("total"),
        (F.sum("successful") + F.sum("dropped")).alias("completed"),
        F.sum("successful").alias("successful"),
        F.sum("dropped").alias("dropped"),
        F.sum("successful_duration").cast("double").alias("successful_duration"),
    )


def expected_counts(tracks: DataFrame, rows: DataFrame) -> DataFrame:
    """Number of tasks of every track, of those without any too."""
    counts = rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("expected"))
    return tracks.select("track_id").join(counts, "track_id", "left").select(
        "track_id", F.coalesce("expected", F.lit(0)).alias("expected")
    )


def elapsed_seconds(started: Column, now: Column) -> Column:
    """Milliseconds to whole seconds, half up, at least 1."""
    return F.greatest(F.lit(1), F.floor((now - started) / 1000 + 0.5))


def eta_text(started: Column, now: Column, completed: Column, total: Column) -> Column:
    used = now - started
    left = F.greatest(F.lit(0), F.floor((used / completed * total - used) / 1000 + 0.5))
    return F.when(completed == 0, "--").otherwise(duration_text(left))


def track_faults(tracks: DataFrame) -> DataFrame:
    """``track_id, fault``: malformed ids, and ids that differ in case only."""
    same = Window.partitionBy(F.lower("track_id"))
    return tracks.select(
        "track_id",
        F.when(~F.col("track_id").rlike(TRACK_ID), "a track id is malformed")
        .when(F.count(F.lit(1)).over(same) > 1, "a track id is not unique")
        .alias("fault"),
    ).where("fault IS NOT NULL")


def unknown_tracks(batches: DataFrame, tracks: DataFrame) -> DataFrame:
    return batches.join(tracks.select("track_id"), "track_id", "left_anti")


def total_faults(batches: DataFrame) -> DataFrame:
    """``track_id, fault`` of declared totals that change or are below what was found.

    ``batches``: ``track_id, batch, items, total`` with a null total where none is given.
    """
    upto = Window.partitionBy("track_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        batches.withColumn("found", F.sum("items").over(upto))
        .withColumn("least", F.min("total").over(upto))
        .withColumn("most", F.max("total").over(upto))
        .groupBy("track_id")
        .agg(
            F.when(F.bool_or(F.col("least") < F.col("most")), "a total changes")
            .when(F.bool_or(F.col("found") > F.col("least")), "a total is too small")
            .alias("fault")
        )
        .where("fault IS NOT NULL")
    )


def filename_fault(name: Column) -> Column:
    bad = (F.coalesce(name, F.lit("")) == "") | name.isin(".", "..") | name.contains("/") | name.contains("\\")
    return F.when(bad, "a file name is invalid")


def session_status(state: Column, cancelled: Column, merging: Column) -> Column:
    """Public status of a session's internal state; a stop shows while work goes on."""
    return (
        F.when(cancelled & state.isin("idle", "preparing", "running", "draining"), "stopping")
        .when(state.isin("running", "draining"), "downloading")
        .when(state == "finalizing", F.when(merging, "merging").otherwise("downloading"))
        .otherwise(state)
    )


def failure_reason(
    code: Column, http_status: Column, message: Column, status_text: Column | None = None, kind: Column | None = None
) -> Column:
    """Code, else HTTP status with its text, else message, else the error's kind."""
    text = F.coalesce(status_text if status_text is not None else F.lit(""), F.lit(""))
    words = F.trim(F.concat_ws(" ", http_status.cast("string"), text))
    return F.coalesce(
        F.nullif(code, F.lit("")),
        F.when(http_status.isNotNull(), words),
        F.nullif(message, F.lit("")),
        *([kind] if kind is not None else []),
        F.lit("UNKNOWN"),
    )


def rates(progress_: DataFrame, seconds: Column) -> DataFrame:
    """Progress with items and seconds of media for each second, as texts of two places."""
    return progress_.select(
        "*",
        hundredths(F.col("successful") / seconds).alias("chunks_per_second"),
        hundredths(F.col("successful_duration") / seconds).alias("media_per_second"),
    )


def admitted(outcomes_: DataFrame) -> DataFrame:
    """One outcome for each place of a track, the earliest by ``arrival``: later ones never
    reach the counters."""
    names = ["track_id", "track_index"]
    rest = [c for c in outcomes_.columns if c not in names]
    first = F.min_by(F.struct(*rest), F.col("arrival"))
    return outcomes_.groupBy(*names).agg(first.alias("first")).select(*names, "first.*")


def normalized_config(config: DataFrame) -> DataFrame:
    """Defaults of 5, and a fault for counts that are no positive safe integers."""
    names = ("threads", "source_request_attempts", "task_attempts")
    whole = {n: F.coalesce(F.col(n).cast("double"), F.lit(5.0)) for n in names}
    bad = [(v < 1) | (v != F.floor(v)) | (v > 2**53 - 1) for v in whole.values()]
    fault = F.when(bad[0] | bad[1] | bad[2], "a count is not a positive integer")
    return config.withColumns({n: v.cast("long") for n, v in whole.items()} | {"fault": fault})
