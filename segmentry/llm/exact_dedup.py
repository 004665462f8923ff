"""Exact deduplication by a tree merge of sorted digest runs.

Every row is reduced to an entry: the SHA-256 of its text, a check (the MD5 and the length
of the text), its identifier and a count. Each partition of the input makes one run: its
entries, added up where digest and check are equal. A run is cut by the leading bits of
the digests into slices, and a slice is one sorted array, so a run is in order from slice
to slice and within each, and no row of the tree holds more than about ``SLICE`` digests.

Runs are merged in binomial rounds: in each round the run numbers lose the same number of
bits, so ``2**bits`` runs meet slice by slice. Their sorted arrays are put one behind the
other and sorted, which for sorted parts is a multiway merge, and equal neighbours are
folded to the best identifier and the sum of the counts. Entries are equal neighbours only
if digest and check agree, so every level verifies what it merges: texts that a digest
confuses keep entries, and identifiers, of their own. After the last round one run is left.

Nothing but entries of about 100 bytes is exchanged; texts are read where they lie.

Defined cases: a null text counts as empty; texts are equal when their UTF-8 bytes
are; among rows with the same id and text one row stays (the lowest row number of
one reading); a null id loses to any other id; an empty table gives an empty result;
columns of the input with the names of the result are no obstacle, as only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, quoted

#: Distinct digests in a slice of a run, about.
SLICE = 8192
ROUNDS = 2
#: What tells texts apart, in the order in which runs are sorted.
KEY = ("digest", "check")


def _identity(keep: str, id_: Column, row: Column) -> Column:
    """Sort key of a row: known ids first, then the id, then the row number."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    # Structs order by their fields; a null field is the smallest of all.
    if keep == "smallest":
        return F.struct(id_.isNull().alias("unknown"), id_.alias("id"), row.alias("row"))
    return F.struct(id_.isNotNull().alias("known"), id_.alias("id"), (-row).alias("row"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(run: Column, keep: str) -> Column:
    """A sorted array of entries with equal neighbours folded to one."""

    def same(a: Column, b: Column) -> Column:
        return (a["digest"] == b["digest"]) & (a["check"] == b["check"])

    def fold(m: Column) -> Column:
        begins = F.filter(
            F.sequence(F.lit(1), F.size(m)),
            lambda i: F.when(i == 1, True).otherwise(~same(F.element_at(m, i - 1), F.element_at(m, i))),
        )

        def entry(i: Column, k: Column, s: Column) -> Column:
            end = F.when(k + 1 < F.size(s), F.try_element_at(s, k + 2)).otherwise(F.size(m) + 1)
            best = F.element_at(m, i if keep == "smallest" else end - 1)
            n = F.aggregate(F.slice(m, i, end - i), F.lit(0).cast("long"), lambda total, x: total + x["n"])
            return F.struct(best["digest"].alias("digest"), best["check"].alias("check"), best["best"].alias("best"), n.alias("n"))

        return _let(begins, lambda s: F.transform(s, lambda i, k: entry(i, k, s)))

    return _let(run, fold)


def first_runs(rows: DataFrame, keep: str, slice_bits: int) -> DataFrame:
    """``run, slice, entries``: the sorted run of every partition ``part`` of ``rows``."""
    best = F.min("best") if keep == "smallest" else F.max("best")
    entries = (
        rows.select(F.col("part").alias("run"), *KEY, _identity(keep, F.col("id"), F.col("row")).alias("best"))
        .groupBy("run", *KEY)
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        # The leading bits of the digest: slices are in the order of what they hold.
        .withColumn("slice", F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - slice_bits))
    )
    listed = entries.groupBy("run", "slice").agg(F.collect_list(F.struct(*KEY, "best", "n")).alias("entries"))
    return listed.withColumn("entries", F.array_sort("entries"))


def merge_round(runs: DataFrame, keep: str, bits: int) -> DataFrame:
    """Each ``2**bits`` runs merged to one: the run numbers lose their lowest bits."""
    met = runs.groupBy(F.shiftright("run", bits).alias("run"), "slice").agg(F.collect_list("entries").alias("parts"))
    return met.select("run", "slice", _folded(F.array_sort(F.flatten("parts")), keep).alias("entries"))


def merged_runs(runs: DataFrame, keep: str, depth: int, rounds: int = ROUNDS) -> DataFrame:
    """The one run of ``2**depth`` runs, after up to ``rounds`` rounds."""
    left = depth
    for after in range(rounds - 1, -1, -1):
        bits = left - depth * after // rounds
        if bits:
            runs = merge_round(runs, keep, bits)
        left -= bits
    return runs


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    rounds: int = ROUNDS,
    slice_size: int = SLICE,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``row, id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says which id of a group of equal texts stays. ``row_col`` has the row numbers;
    without it rows are numbered as they are first read. See the module's text for the
    cases of nulls, ties and empty tables.
    """
    text = F.coalesce(quoted(text_col), F.lit("")).cast("binary")
    row = F.monotonically_increasing_id() if row_col is None else quoted(row_col)
    rows = materialize(
        docs.select(
            quoted(id_col).alias("id"),
            row.alias("row"),
            F.spark_partition_id().alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.concat(F.unhex(F.md5(text)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0"))).alias("check"),
        ),
        "digests",
    )
    number, parts = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("part"), F.lit(0))).first()
    slice_bits = max(0, (number // slice_size).bit_length())
    run = merged_runs(first_runs(rows, keep, slice_bits), keep, int(parts).bit_length(), rounds)
    # Rows that share their text with none need no partner.
    groups = materialize(run.select(F.inline("entries")).where("n > 1"), "groups")
    best = F.col("best")
    mine = _identity(keep, F.col("id"), F.col("row"))
    return rows.join(groups, [*KEY], "left").select(
        "row",
        "id",
        F.when(best.isNull(), F.col("id")).otherwise(best["id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (best.isNull() | (mine == best)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
) -> DataFrame:
    """``docs`` with all its columns, one row for each distinct text.

    Which row stays is decided as in :func:`exact_groups`. Rows that repeat both id
    and text are one document and give one row.
    """
    row = free_name(docs, "row")
    # Numbered once, in a written copy: a second numbering may differ.
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    groups = exact_groups(numbered, id_col, text_col, keep, row_col=row)
    gone = materialize(groups.where("NOT kept").select(F.col("row").alias(row)), "copies")
    discard(groups)
    return numbered.join(gone, row, "left_anti").drop(row)
