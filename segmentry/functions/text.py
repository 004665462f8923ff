"""Scalar expressions for playlist text: trimming, tags, attributes, numbers, times."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All white space that the format's trimming removes, the byte order mark included.
BLANK = r"[\s\p{Z}\uFEFF]+"
#: Key, quoted value, bare value of one attribute; an open quote runs to the end.
ATTRIBUTE = r'([^=,]*)(?:=(?:"([^"]*)"?|([^,]*)))?[^,]*(?:,|$)'
LARGEST_SAFE = 2**53 - 1


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def tag_body(line: Column) -> Column:
    """Text behind the first colon, empty where there is none."""
    at = F.instr(line, ":")
    return F.when(at > 0, F.substr(line, at + 1)).otherwise(F.lit(""))


def attributes(body: Column) -> Column:
    """Attribute list as a map; of a repeated key the last value stays.

    Keys are taken as they are written: blanks belong to them.
    """
    group = [F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2, 3)]
    pairs = F.transform(
        F.arrays_zip(group[0].alias("k"), group[1].alias("q"), group[2].alias("b")),
        lambda x: F.struct(
            x["k"].alias("key"),
            F.concat(x["q"], x["b"]).alias("value"),
        ),
    )
    named = F.filter(pairs, lambda x: x["key"] != "")
    keys = F.transform(named, lambda x: x["key"])
    last = F.filter(
        named,
        lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]),
    )
    return F.map_from_entries(last)


def parse_float(text: Column) -> Column:
    """Longest numeric prefix as a double, null where there is none."""
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    return F.regexp_extract(text, number, 1).try_cast("double")


def parse_int(text: Column) -> Column:
    """Leading integer, null where there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")


def whole_number(text: Column) -> Column:
    """The whole trimmed text as a double, null if it is anything else."""
    return F.when(
        F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        F.trim(text).try_cast("double"),
    )


def is_safe(number: Column) -> Column:
    return (number >= -LARGEST_SAFE) & (number <= LARGEST_SAFE)


@F.pandas_udf(StringType())
def fixed(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Decimal text of the exact binary value, ties away from zero."""

    def one(x: float, n: int) -> str | None:
        if x is None or pd.isna(x):
            return None
        return str(Decimal(x).quantize(Decimal(1).scaleb(-int(n)), ROUND_HALF_UP))

    return pd.Series([one(x, n) for x, n in zip(values, digits, strict=True)])


def hundredths(number: Column) -> Column:
    """Decimal text of two places, ties away from zero, judged on a hundred times the number.

    A quotient that should be a tie often has a binary value just below it, which
    :func:`fixed` rounds down; times a hundred it is one again.
    """
    return (F.round(number * 100).try_cast("decimal(18,0)") / 100).cast("decimal(20,2)").cast("string")


def seconds_of(text: Column) -> Column:
    """``[h:]m:s`` in base 60; null unless it has two or more parts of digits only."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("long"))
    folded = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 60 + p)
    return F.when(text.rlike(r"^[0-9]+(:[0-9]+)+$"), folded)


def slice_bounds(text: Column) -> Column:
    """``start-end`` as a struct of seconds."""
    return F.struct(
        seconds_of(F.split_part(text, F.lit("-"), F.lit(1))).alias("start"),
        seconds_of(F.split_part(text, F.lit("-"), F.lit(2))).alias("end"),
    )


def request_headers(text: Column) -> Column:
    """``name: value`` lines as a map; a written backslash-n ends a line as well."""
    lines = F.split(text, r"\\n|\n")
    good = F.filter(lines, lambda x: x.rlike(r"^[^ :]+:.+$"))
    pairs = F.transform(
        good,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([^ :]+):(.+)$", 1).alias("key"),
            trimmed(F.regexp_extract(x, r"^([^ :]+):(.+)$", 2)).alias("value"),
        ),
    )
    keys = F.transform(pairs, lambda x: x["key"])
    last = F.filter(
        pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"])
    )
    return F.map_from_entries(last)


def explicit_key(text: Column) -> Column:
    """``kid:key`` at the first colon, else the key alone."""
    at = F.instr(text, ":")
    return F.struct(
        F.when(at > 0, F.substr(text, F.lit(1), at - 1)).alias("kid"),
        F.when(at > 0, F.substr(text, at + 1)).otherwise(text).alias("key"),
    )


def duration_text(seconds: Column) -> Column:
    """Remaining time as ``Ns``, ``Nm Ns`` or ``Nh Nm Ns``."""
    s = seconds.cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(minutes, F.lit("m "), s % 60, F.lit("s")))
        .otherwise(F.concat(hours, F.lit("h "), F.floor((s % 3600) / 60), F.lit("m "), s % 60, F.lit("s")))
    )


def number_text(number: Column) -> Column:
    """A double in its shortest decimal form, whole ones without a point."""
    return F.regexp_replace(number.cast("double").cast("string"), r"\.0$", "")


def megabits(bandwidth: Column) -> Column:
    return F.concat(fixed(bandwidth / 1_000_000, F.lit(2)), F.lit(" Mbps"))


def kilobits(bandwidth: Column) -> Column:
    return F.concat(fixed(bandwidth / 1000, F.lit(0)), F.lit(" kbps"))
