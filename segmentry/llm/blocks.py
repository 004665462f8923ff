"""Blocks of documents, and the exchange of their distinct values with buckets.

A block holds a few megabytes of documents as codes into its own list of distinct words.
Blocks send distinct values to buckets by fingerprint, and a bucket answers in the order in
which a block sent, so an exchange moves each value once for a block, however often the
block has it, and no task holds a table of all values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    real = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(upto[ends])


def word_list(packed: bytes) -> list[bytes]:
    joined = zstandard.decompress(packed)
    return joined.split(b"\n") if joined else []


def block_rows(
    batches: Iterator[pa.RecordBatch], block_bytes: int, text_at: int, lower: bool = False
) -> Iterator[pa.RecordBatch]:
    """Rows with a text as one row for each block: ``block, bytes``, the other columns as
    lists, then ``sizes`` (words of each document), ``codes`` and ``words``."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy())
        part = (size - 1).clip(0) // block_bytes
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for begin, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
            own = batch.slice(begin, end - begin)
            texts = own.column(text_at)
            flat, n = words_in(pc.ascii_lower(texts) if lower else texts)
            words = flat.dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False).astype("<i4")
            listed = "\n".join(words.dictionary.to_pylist()).encode()
            whole = pa.array([0, len(own)], pa.int32())
            rest = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([int(size[end - 1] - (size[begin - 1] if begin else 0))], pa.int64()),
                    *(pa.ListArray.from_arrays(whole, own.column(i)) for i in rest),
                    pa.array([pack(n.astype("<i8"))], pa.binary()),
                    pa.array([pack(codes)], pa.binary()),
                    pa.array([zstandard.compress(listed, 3)], pa.binary()),
                ],
                ["block", "bytes", *(batch.schema.names[i] for i in rest), "sizes", "codes", "words"],
            )
            number += 1


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def spans(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Where each bucket's values begin and end, in values that are in order of buckets."""
    if not len(bucket):
        return []
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True))


def word_order(listed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order in which words are sent, and their fingerprints in it."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))
    order = np.argsort(h, kind="stable")
    return order, h[order]


def exchanged(sent: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """``block, told``: the answers to what a block sent, bucket by bucket.

    ``sent`` has ``bucket`` and ``block``; ``answer`` makes ``block, bucket, told`` of a
    bucket's rows.
    """
    return (
        sent.groupBy("bucket")
        .applyInArrow(answer, "block long, bucket int, told binary")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "told"))).getField("told").alias("told"))
    )
