"""Packing of documents into token sequences by bounded-space online best fit.

Each task packs its own pieces as they come. It holds a fixed number of open bins,
found by their free space: a bitset has one bit for every amount of free space, set
where an open bin has it, so the bin that a piece fits best is the lowest set bit at
or above the piece's length. A piece that fits nowhere opens a bin; if that is one too
many, the fullest bin closes first. Pieces arrive in an order that depends only on
their values, a buffer of them at a time with the longest first, so a task that is
run again packs the same sequences, and memory is bounded by the buffer and the
open bins, whatever a task reads.

Defined cases: a null text is an empty document, which is its end id alone; rows that
repeat are packed once for each row; null ids are packed like others; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import quoted
from .tokens import cut_pieces, default_tokenizer, output

SEQUENCE = 2048
OPEN_BINS = 4096
BUFFER = 16_384


@dataclass
class BestFit:
    """Open bins by free space."""

    capacity: int
    open_bins: int
    first: int = 0
    opened: int = 0
    in_use: int = 0
    bits: int = 0
    bins: dict[int, list[int]] = field(default_factory=dict)

    def _take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.in_use -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """Number of the bin that gets the piece, and the piece's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.in_use >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.first + self.opened
            self.opened += 1
        rest = free - length
        if rest:
            self.bins.setdefault(rest, []).append(number)
            self.bits |= 1 << rest
            self.in_use += 1
        return number, self.capacity - free


def _pack(
    batches: Iterator[pa.RecordBatch], capacity: int, open_bins: int, buffer: int
) -> Iterator[pa.RecordBatch]:
    fit = BestFit(capacity, open_bins, first=TaskContext.get().partitionId() << 40)

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        lengths = table.column("length").to_pylist()
        number, offset = [0] * len(lengths), [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
            number[i], offset[i] = fit.place(lengths[i])
        table = table.append_column("sequence_id", pa.array(number, pa.int64()))
        table = table.append_column("offset", pa.array(offset, pa.int64()))
        return table.to_batches()[0]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = buffer - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) >= buffer:
                yield packed(pa.Table.from_batches(held))
                held = []
    if held:
        yield packed(pa.Table.from_batches(held))


def pack_pieces(
    pieces: DataFrame,
    capacity: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    buffer: int = BUFFER,
) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to ``capacity``) and their
    ``sequence_id`` and ``offset``. Sequence numbers are unique, not consecutive."""
    schema = StructType(
        [
            *pieces.schema.fields,
            StructField("sequence_id", LongType()),
            StructField("offset", LongType()),
        ]
    )
    names = [quoted(c) for c in pieces.columns]
    dealt = pieces.repartition(F.xxhash64(*names)).sortWithinPartitions(F.xxhash64(*names), *names)
    return dealt.mapInArrow(lambda b: _pack(b, capacity, open_bins, buffer), schema)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = SEQUENCE,
    end_id: int = 0,
    open_bins: int = OPEN_BINS,
) -> DataFrame:
    """Rows ``id, piece, start, length, ids_crc32, sequence_id, offset``, one per piece."""
    path = tokenizer or default_tokenizer()
    schema = output(
        docs, id_col, "id", ("piece", IntegerType()), ("start", LongType()),
        ("length", LongType()), ("ids_crc32", LongType()),
    )
    pieces = docs.select(quoted(id_col), quoted(text_col)).mapInArrow(
        lambda b: cut_pieces(b, path, capacity, end_id), schema
    )
    return pack_pieces(pieces, capacity, open_bins)
