"""Media playlists: lines to segments, keys, summaries and errors.

A playlist's state at a line is what the lines before it say: the last key tag, the last
sequence tag and the segments since, the tags since the last URI. It is found by windows
over spans of lines and carried from span to span, so no task holds a playlist. A fault
is a row of ``errors``, the first of a playlist; its segments are still returned, so a
caller decides whether to keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.functions.text import attributes, parse_float, parse_int, tag_body, trimmed
from segmentry.functions.urls import key_kind, resolve
from segmentry.operators import spans
from segmentry.operators.syntax import lines

DEFAULT_DURATION = 5.0
LARGEST_SAFE = 2**53 - 1


def _byte_range(text: Column) -> Column:
    """``length[@offset]`` as a struct; ``valid`` tells whether the text is sound."""
    length = F.regexp_extract(text, r"^([0-9]+)(?:@([0-9]+))?$", 1).try_cast("decimal(38,0)")
    offset = F.regexp_extract(text, r"^([0-9]+)(?:@([0-9]+))?$", 2).try_cast("decimal(38,0)")
    sound = length.between(1, LARGEST_SAFE) & F.coalesce(
        offset.between(0, LARGEST_SAFE) & (offset + length - 1 <= LARGEST_SAFE), F.lit(True)
    )
    return F.struct(
        length.try_cast("long").alias("length"),
        offset.try_cast("long").alias("offset"),
        F.coalesce(sound, F.lit(False)).alias("valid"),
    )


def _key_event(id_: Column) -> Column:
    """What a key tag with attributes ``a`` says; one that clears has a null method."""
    method, iv = F.try_element_at("a", F.lit("METHOD")), F.try_element_at("a", F.lit("IV"))
    form = F.coalesce(F.nullif(F.try_element_at("a", F.lit("KEYFORMAT")), F.lit("")), F.lit("identity"))
    known = method.isin("AES-128", "SAMPLE-AES")
    sample = method == "SAMPLE-AES"
    digits = F.nullif(F.regexp_extract(iv, r"^0[xX]([0-9a-fA-F]{1,32})$", 1), F.lit(""))
    no_iv = F.coalesce(iv, F.lit("")) == ""
    fault = (
        F.when(~F.coalesce(known, F.lit(False)), None)
        .when(F.col("target").isNull(), "a key has no URI")
        .when(id_.isNull(), "a URI cannot be resolved")
        .when(sample & no_iv, "a SAMPLE-AES key has no IV")
        .when(~no_iv & digits.isNull(), "an IV is malformed")
        .when(sample & ~form.isin("identity", "com.apple.streamingkeydelivery"), "a key format is unknown")
    )
    return F.struct(
        F.when(known, method).alias("method"),
        F.when(known, id_).alias("key_id"),
        F.when(known, key_kind(id_)).alias("key_kind"),
        F.when(known, digits).alias("iv"),
        F.when(sample, form).alias("key_format"),
        fault.alias("fault"),
    )


def annotated_lines(playlists: DataFrame) -> DataFrame:
    """Every line up to the end mark with the state that holds there.

    ``playlists`` have their text as ``content``, or are rows of single lines already (see
    :func:`syntax.lines`). No window spans a playlist. Lines are first counted by spans of
    their numbers, so each knows how many URIs are before it; then they meet in spans of
    that count, whose ends are URIs, so a segment's tags are in its own span, and what
    goes on (key, sequence base, place in the chain of byte ranges) is carried over.
    """
    line, body = F.col("line"), tag_body(F.col("line"))

    def tag(name: str) -> Column:
        return line.startswith(f"#EXT-X-{name}")

    counted = spans.before(
        lines(playlists), ["playlist_id"], "line_no",
        sums={"uris": (~line.startswith("#")).cast("long")},
        wholes={"i_frames": (F.max, tag("I-FRAMES-ONLY")), "end_line": (F.min, F.when(tag("ENDLIST"), F.col("line_no")))},
    ).where("end_line IS NULL OR line_no <= end_line")
    parsed = (
        counted.withColumn("is_uri", ~line.startswith("#"))
        .withColumn("is_key", tag("KEY"))
        .withColumn("is_map", tag("MAP"))
        .withColumn("is_reset", tag("MEDIA-SEQUENCE"))
        .withColumn("is_inf", line.startswith("#EXTINF"))
        .withColumn("is_range", tag("BYTERANGE"))
        .withColumn("is_end", tag("ENDLIST"))
        .withColumn("a", F.when(F.col("is_key") | F.col("is_map"), attributes(body)))
        .withColumn(
            "target",
            F.when(F.col("is_uri"), line).otherwise(F.nullif(F.try_element_at("a", F.lit("URI")), F.lit(""))),
        )
        .withColumn("url", F.when(F.col("target").isNotNull(), resolve(F.col("playlist_url"), F.col("target"))))
        .withColumn("key_event", F.when(F.col("is_key"), _key_event(F.col("url"))))
        .withColumn(
            "range_text",
            F.when(F.col("is_range"), body).when(
                F.col("is_map"), F.nullif(F.try_element_at("a", F.lit("BYTERANGE")), F.lit(""))
            ),
        )
        .withColumn("asked_here", F.when(F.col("range_text").isNotNull(), _byte_range(F.col("range_text"))))
        .withColumn("inf", F.when(F.col("is_inf"), parse_float(F.split_part(body, F.lit(","), F.lit(1)))))
        .withColumn("base_here", F.when(F.col("is_reset"), parse_int(body)))
        .drop("a", "range_text", "playlist_url")
        .withColumn(spans.PART, spans.part_of(["playlist_id"], F.col("uris")))
        .repartition(spans.PART)
    )
    one = Window.partitionBy(spans.PART, "uris")
    seconds = F.when((F.col("inf") == 0) | F.col("inf").isNull(), DEFAULT_DURATION).otherwise(F.col("inf"))
    tagged = (
        parsed.withColumn("infs", F.sum(F.col("is_inf").cast("int")).over(one))
        .withColumn("ranges", F.sum(F.col("is_range").cast("int")).over(one))
        .withColumn("duration", F.when(F.col("is_uri"), F.max(F.when(F.col("is_inf"), seconds)).over(one)))
        .withColumn("own_range", F.max(F.when(F.col("is_range"), F.col("asked_here"))).over(one))
        .withColumn("asked", F.when(F.col("is_uri"), F.col("own_range")).when(F.col("is_map"), F.col("asked_here")))
        .drop("own_range", "asked_here", "inf")
    )
    rows = _carried_ranges(
        tagged,
        sums={"seg_ord": (F.col("is_uri") | F.col("is_map")).cast("long")},
        lasts={"key": F.col("key_event"), "base": F.col("base_here"), "reset": F.when(F.col("is_reset"), F.struct("uris"))},
    )
    passed = F.col("uris") - F.coalesce("reset.uris", F.lit(0))
    return (
        rows.withColumn("key", F.coalesce("key_event", "key"))
        .withColumn("sequence_id", F.when(F.col("is_uri"), F.coalesce("base", F.lit(0)) + passed))
        .drop("base", "base_here", "reset")
    )


def byte_ranges(rows: DataFrame) -> DataFrame:
    """Add ``offset``, ``length`` and ``derivable``: implicit offsets follow the segment
    before, if that has a range of the same resource.

    ``rows`` have ``playlist_id, line_no, is_uri, url, asked``.
    """
    return _carried_ranges(rows.withColumn(spans.PART, spans.part_of(["playlist_id"], F.col("line_no"))).repartition(spans.PART))


def _carried_ranges(
    rows: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None
) -> DataFrame:
    """As :func:`byte_ranges`, of rows that have their part and are dealt by it; ``sums`` and
    ``lasts`` are carried along in the same join, as :func:`spans.before` does.

    A range without an offset goes on from the last one that starts: its offset, and the
    lengths since. Within a span only the first segment does not see the one before it, so
    that one is decided where the spans' totals are put in order.
    """
    sums, lasts, part, is_uri = sums or {}, lasts or {}, spans.PART, F.col("is_uri")
    here = Window.partitionBy(part).orderBy("line_no")
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = here.rowsBetween(Window.unboundedPreceding, -1)
    zero, ranged = F.lit(0).cast("long"), F.col("asked").isNotNull()
    size = F.when(is_uri, F.col("asked.length"))
    implicit = ranged & F.col("asked.offset").isNull()

    def follows(prior: str) -> Column:
        return F.coalesce(F.col(f"{prior}.ranged") & (F.col(f"{prior}.url") == F.col("url")), F.lit(False))

    held = (
        rows.withColumns({f"of_{n}": c for n, c in {**sums, **lasts}.items()})
        .withColumn("prior", F.last(F.when(is_uri, F.struct("url", ranged.alias("ranged"))), ignorenulls=True).over(ahead))
        .withColumn("sized", F.coalesce(F.sum(size).over(ahead), zero))
        .withColumn("chained", is_uri & implicit & follows("prior"))
        .withColumn("first_open", is_uri & implicit & F.col("prior").isNull())
        .withColumn("start_here", F.when(is_uri & ~F.col("chained") & ~F.col("first_open"), F.struct("asked.offset", "sized")))
        .withColumn("start", F.last("start_here", ignorenulls=True).over(so_far))
    )
    totals = held.groupBy(part).agg(
        F.sum(size).alias("size"),
        spans.last_of(F.col("start_here"), "line_no").alias("start"),
        F.min_by(F.struct(F.col("first_open").alias("open"), "url"), F.when(is_uri, F.col("line_no"))).alias("first"),
        F.max_by(F.struct("url", ranged.alias("ranged")), F.when(is_uri, F.col("line_no"))).alias("final"),
        *(F.sum(f"of_{n}").alias(n) for n in sums),
        *(spans.last_of(F.col(f"of_{n}"), "line_no").alias(n) for n in lasts),
    )
    upto = spans.earlier(["playlist_id"])

    def start(offset: Column, sized: Column) -> Column:
        return F.struct(offset.cast("long").alias("offset"), sized.alias("sized"))

    broken = F.col("first.open") & ~F.col("first_chained")
    carried = (
        totals.withColumn("in_size", F.coalesce(F.sum("size").over(upto), zero))
        .withColumn("prior", F.last("final", ignorenulls=True).over(upto))
        .withColumn("url", F.col("first.url"))
        .withColumn("first_chained", F.coalesce(F.col("first.open"), F.lit(False)) & follows("prior"))
        .withColumn("lead", F.when(broken, start(F.lit(None), F.col("in_size"))))
        .withColumn(
            "end_start",
            F.when(F.col("start").isNotNull(), start(F.col("start.offset"), F.col("start.sized") + F.col("in_size"))).otherwise(F.col("lead")),
        )
        .select(
            part, "in_size", "first_chained",
            F.coalesce("lead", F.last("end_start", ignorenulls=True).over(upto)).alias("lead"),
            *(F.sum(n).over(upto).alias(f"in_{n}") for n in sums),
            *(F.last(n, ignorenulls=True).over(upto).alias(f"in_{n}") for n in lasts),
        )
    )
    own = F.col("start").isNotNull()
    since = F.when(own, F.col("sized") - F.col("start.sized")).otherwise(F.col("sized") + F.col("in_size") - F.col("lead.sized"))
    offset = F.when(~is_uri, F.col("asked.offset")).when(
        F.col("asked.length").isNotNull(), F.when(own, F.col("start.offset")).otherwise(F.col("lead.offset")) + since
    )
    return held.join(carried, part).select(
        *(f"`{c}`" for c in rows.columns if c != part),
        (~implicit | F.col("chained") | (F.col("first_open") & F.col("first_chained"))).alias("derivable"),
        F.col("asked.length").alias("length"),
        offset.alias("offset"),
        *((F.coalesce(F.sum(f"of_{n}").over(ahead), zero) + F.coalesce(f"in_{n}", zero)).alias(n) for n in sums),
        *(F.coalesce(F.last(f"of_{n}", ignorenulls=True).over(ahead), f"in_{n}").alias(n) for n in lasts),
    )


def _fault() -> Column:
    """Fault of a line, or null."""
    is_uri, is_map = F.col("is_uri"), F.col("is_map")
    encrypted = F.col("key.method").isNotNull()
    ranged = F.col("asked").isNotNull()
    return (
        F.when(F.col("key_event.fault").isNotNull(), F.col("key_event.fault"))
        .when(is_uri & (F.coalesce("infs", F.lit(0)) == 0), "a segment has no duration")
        .when(is_uri & (F.col("infs") > 1), "a segment has several durations")
        .when(is_uri & (F.col("ranges") > 1), "a segment has several byte ranges")
        .when(is_map & F.col("target").isNull(), "an initialization has no URI")
        .when((is_uri | is_map) & F.col("url").isNull(), "a URI cannot be resolved")
        .when((is_uri | is_map) & ranged & ~F.col("asked.valid"), "a byte range is invalid")
        .when(is_map & ranged & F.col("asked.offset").isNull(), "an initialization range has no offset")
        .when(is_uri & ranged & (~F.col("derivable") | F.col("offset").isNull()), "a byte range has no offset to follow")
        .when(is_uri & ranged & (F.col("offset") + F.col("length") - 1 > LARGEST_SAFE), "a byte range is invalid")
        .when(is_map & (F.col("key.method") == "SAMPLE-AES"), "an initialization is SAMPLE-AES encrypted")
        .when(is_map & encrypted & F.col("key.iv").isNull(), "an encrypted initialization has no IV")
        .when(is_uri & F.col("i_frames") & encrypted & ranged, "an I-frame byte range is encrypted")
        .when(F.col("is_end") & ((F.col("infs") > 0) | (F.col("ranges") > 0)), "a tag applies to no segment")
    )


def errors(playlists: DataFrame) -> DataFrame:
    """``playlist_id, line_no, error``: the first fault of every faulty playlist.

    What a playlist's end leaves open counts behind its last line, so after any line's fault.
    """
    ends = (
        annotated_lines(playlists)
        .withColumn("error", _fault())
        .groupBy("playlist_id")
        .agg(
            F.min(F.when(F.col("error").isNotNull(), F.struct("line_no", "error"))).alias("first"),
            (F.max("line_no") + 1).alias("line_no"),
            F.max("end_line").alias("end_line"),
            F.max(F.when(F.col("is_inf") | F.col("is_range"), F.col("line_no"))).alias("last_tag"),
            F.coalesce(F.max(F.when(F.col("is_uri"), F.col("line_no"))), F.lit(-1)).alias("last_uri"),
            F.max(F.col("is_map")).alias("maps"),
            F.max(F.col("is_uri") & (F.col("key.method") == "SAMPLE-AES")).alias("samples"),
        )
    )
    left_open = F.when(
        F.col("end_line").isNull() & (F.col("last_tag") > F.col("last_uri")), "a tag applies to no segment"
    ).when(F.col("maps") & F.col("samples"), "an initialization is SAMPLE-AES encrypted")
    return (
        ends.withColumn("last", F.when(left_open.isNotNull(), F.struct("line_no", left_open.alias("error"))))
        .select("playlist_id", F.coalesce("first", "last").alias("fault"))
        .where("fault IS NOT NULL")
        .select("playlist_id", "fault.*")
    )


def segments(playlists: DataFrame) -> DataFrame:
    """Initialization and media segments in order, with what is in force for each."""
    return (
        annotated_lines(playlists)
        .where("is_uri OR is_map")
        .select(
            "playlist_id",
            "seg_ord",
            F.when(F.col("is_uri"), F.lit("media")).otherwise(F.lit("init")).alias("kind"),
            "url",
            "duration",
            "sequence_id",
            F.when(F.col("asked").isNotNull(), F.struct("offset", "length")).alias("byte_range"),
            F.when(
                F.col("key.method").isNotNull(),
                F.struct("key.method", "key.key_id", "key.key_kind", "key.iv", "key.key_format"),
            ).alias("encryption"),
        )
    )


def keys(playlists: DataFrame) -> DataFrame:
    """Distinct keys of a playlist, in the order they first appear."""
    return (
        annotated_lines(playlists)
        .where("key_event.key_id IS NOT NULL")
        .groupBy("playlist_id", F.col("key_event.key_id").alias("id"))
        .agg(F.min("line_no").alias("key_ord"), F.max_by("key_event.key_kind", "line_no").alias("key_kind"))
    )


def has_end_list(content: Column) -> Column:
    """Whether a playlist's text has the end mark."""
    return F.coalesce(F.exists(F.split(content, r"\r?\n"), lambda x: trimmed(x).startswith("#EXT-X-ENDLIST")), F.lit(False))


def summary(playlists: DataFrame) -> DataFrame:
    """End mark, total duration, segment count, and the average, NaN without segments."""
    rows = annotated_lines(playlists)
    count = F.count_if("is_uri")
    total = F.coalesce(F.sum(F.when(F.col("is_uri"), F.col("duration").cast("decimal(20,6)"))), F.lit(0)).cast("double")
    return rows.groupBy("playlist_id").agg(
        F.max("end_line").isNotNull().alias("has_end_list"),
        count.alias("segments"),
        total.alias("total_duration"),
        F.when(count > 0, total / count).otherwise(F.lit(float("nan"))).alias("average_duration"),
    )
