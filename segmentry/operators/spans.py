"""Running state over long ordered sequences, in two levels.

What holds at a row often depends on all rows before it: a count, a sum, the last value of
some kind. A window over a whole sequence does that in one task, however long it is. Here a
sequence is cut into spans of its order. Rows meet those of their span only; each span's
totals, one row, are carried along the sequence; and a row joins what is carried into its
span. The largest task holds a span, or the totals of one sequence.

Rows are dealt by ``struct(keys, span)``, which is never null, so null keys are keys as others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places of the order that make a span.
SPAN = 1 << 16
PART = "span_part"


def part_of(keys: Sequence[str], place: Column, span: int | None = None) -> Column:
    """The part of a row: its keys, and which span of a whole-number place it is in."""
    size = F.lit(span or SPAN).cast("long")
    return F.struct(*keys, F.floor(place / size).alias("span"))


def earlier(keys: Sequence[str]):
    """Over parts: those of the same keys before this one."""
    own = [F.col(PART).getField(k) for k in keys]
    return Window.partitionBy(*own).orderBy(F.col(PART).getField("span")).rowsBetween(Window.unboundedPreceding, -1)


def whole(keys: Sequence[str]):
    """Over parts: all of the same keys."""
    return Window.partitionBy(*(F.col(PART).getField(k) for k in keys))


def last_of(value: Column, order: str) -> Column:
    """Aggregate: the last value that is not null."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def before(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    wholes: Mapping[str, tuple[Callable[[Column], Column], Column]] | None = None,
    span: int | None = None,
) -> DataFrame:
    """``rows`` with, under each name, what the rows before it in the order of ``keys`` give.

    ``sums``: the sum, 0 where there is none. ``lasts``: the last value that is not null.
    ``wholes``: an aggregate of a column, such as ``(F.max, column)``, over all rows of the
    keys. ``order`` is a column of distinct whole numbers.
    """
    sums, lasts, wholes = sums or {}, lasts or {}, wholes or {}
    values = {f"of_{n}": c for n, c in {**sums, **lasts}.items()} | {f"of_{n}": c for n, (_, c) in wholes.items()}
    held = rows.withColumns(values | {PART: part_of(keys, F.col(order), span)}).repartition(PART)
    totals = held.groupBy(PART).agg(
        *(F.sum(f"of_{n}").alias(n) for n in sums),
        *(last_of(F.col(f"of_{n}"), order).alias(n) for n in lasts),
        *(f(F.col(f"of_{n}")).alias(n) for n, (f, _) in wholes.items()),
    )
    upto, every = earlier(keys), whole(keys)
    carried = totals.select(
        PART,
        *(F.sum(n).over(upto).alias(f"in_{n}") for n in sums),
        *(F.last(n, ignorenulls=True).over(upto).alias(f"in_{n}") for n in lasts),
        *(f(F.col(n)).over(every).alias(n) for n, (f, _) in wholes.items()),
    )
    here = Window.partitionBy(PART).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return held.join(carried, PART).select(
        *(f"`{c}`" for c in rows.columns),
        *((F.coalesce(F.sum(f"of_{n}").over(here), zero) + F.coalesce(f"in_{n}", zero)).alias(n) for n in sums),
        *(F.coalesce(F.last(f"of_{n}", ignorenulls=True).over(here), f"in_{n}").alias(n) for n in lasts),
        *wholes,
    )
