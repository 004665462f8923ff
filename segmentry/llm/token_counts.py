"""Token counts of documents in flat, unindexed token files.

A token file is nothing but ids, each document's followed by an end-of-document id.
It is read as fixed-size blocks, which know nothing of documents. Each block is
searched for end ids by one vector comparison. A document may begin blocks before it
ends, so block results are stitched by a prefix scan over the blocks of a file: the
ids before a block, the documents that ended before it, and the place after the last
end id before it. The scan runs in two levels, over blocks within a span of blocks and
over the spans of a file, so no task orders more than one span or one file's spans.

Defined cases: a null text is an empty document of 0 tokens; ids after a file's last
end id are one more document, marked as not ended; a block of no ids, a file of no
blocks and an empty table give no rows; documents that repeat give one row each;
a token id too large for the file's width is an error, never a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    LongType,
    StructField,
    StructType,
)
from pyspark.sql.window import Window

from .common import materialize, quoted
from .tokens import default_tokenizer, encoder

BLOCK_IDS = 1 << 17
SPAN = 4096


def _write_flat(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, kind: str, block_ids: int, id_type
) -> Iterator[pa.RecordBatch]:
    enc, size = encoder(path, added=False), block_ids * np.dtype(kind).itemsize
    file, block, first = TaskContext.get().partitionId(), 0, 0
    held, ids = bytearray(), []

    def row(data: bytes) -> pa.RecordBatch:
        nonlocal block, first, ids
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([file], pa.int64()),
                pa.array([block], pa.int64()),
                pa.array([data], pa.binary()),
                pa.array([first], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
            ],
            ["file", "block", "data", "first", "ids"],
        )
        block, first, ids = block + 1, first + len(ids), []
        return out

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            found = np.array(enc.ids(text.as_py() or ""), dtype="<u4")
            if len(found) and int(found.max()) >> (8 * np.dtype(kind).itemsize):
                raise ValueError(f"id {found.max()} is too large for {kind}; give more id_bytes")
            found = found.astype(kind)
            held += found.tobytes()
            held += np.array([end_id], dtype=kind).tobytes()
            ids.append(key.as_py())
            while len(held) >= size:
                yield row(bytes(held[:size]))
                del held[:size]
    if held or ids:
        yield row(bytes(held))


def write_token_files(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 50_256,
    id_bytes: int = 2,
    block_ids: int = BLOCK_IDS,
) -> tuple[DataFrame, DataFrame]:
    """Flat files ``(file, block, data)`` and the order ``(file, ordinal, id)`` they hold.

    Each input partition becomes one file. A block has ``block_ids`` little-endian
    unsigned ids of ``id_bytes`` bytes, a file's last block those that are left.
    """
    path, kind = tokenizer or default_tokenizer(), f"<u{id_bytes}"
    id_type = docs.schema[id_col].dataType
    schema = StructType(
        [
            StructField("file", LongType()),
            StructField("block", LongType()),
            StructField("data", BinaryType()),
            StructField("first", LongType()),
            StructField("ids", ArrayType(id_type)),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(id_type)
    flat = materialize(
        docs.select(quoted(id_col), quoted(text_col)).mapInArrow(
            lambda b: _write_flat(b, path, end_id, kind, block_ids, arrow), schema
        ),
        "flat",
    )
    order = flat.select("file", "first", F.posexplode("ids").alias("at", "id")).select(
        "file", (F.col("first") + F.col("at")).alias("ordinal"), "id"
    )
    return flat.select("file", "block", "data"), order


def _find_ends(
    batches: Iterator[pa.RecordBatch], end_id: int, kind: str
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, ends = [], []
        for data in batch.column(2):
            ids = np.frombuffer(data.as_buffer() or b"", dtype=kind)
            n.append(len(ids))
            ends.append(np.flatnonzero(ids == end_id))
        sizes = np.cumsum([0, *map(len, ends)])
        flat = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64())),
            ],
            ["file", "block", "n", "ends"],
        )


def scan_blocks(flat: DataFrame, end_id: int = 50_256, id_bytes: int = 2) -> DataFrame:
    """``file, block, n, ends``: the number of ids, and the places of the end ids."""
    schema = StructType(
        [
            StructField("file", flat.schema["file"].dataType),
            StructField("block", LongType()),
            StructField("n", LongType()),
            StructField("ends", ArrayType(LongType())),
        ]
    )
    blocks = flat.select("file", F.col("block").cast("long"), "data")
    return blocks.mapInArrow(lambda b: _find_ends(b, end_id, f"<u{id_bytes}"), schema)


def stitch(blocks: DataFrame, span: int = SPAN) -> DataFrame:
    """``file, ordinal, start, n_tokens, ended``: the documents of all files."""
    rows = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy("file", "span").orderBy("block").rowsBetween(*rows)
    outer = Window.partitionBy("file").orderBy("span").rowsBetween(*rows)
    zero = F.lit(0).cast("long")

    local = (
        blocks.withColumn("span", F.expr(f"block div {span}"))
        .withColumn("k", F.size("ends").cast("long"))
        .withColumn("ids_in", F.coalesce(F.sum("n").over(inner), zero))
        .withColumn("docs_in", F.coalesce(F.sum("k").over(inner), zero))
        # The place after the block's last end id, counted from the span's begin.
        .withColumn("after", F.when(F.col("k") > 0, F.col("ids_in") + F.element_at("ends", -1) + 1))
        .withColumn("after_in", F.max("after").over(inner))
    )
    spans = (
        local.groupBy("file", "span")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("after").alias("after"))
        .withColumn("ids_to", F.coalesce(F.sum("n").over(outer), zero))
        .withColumn("docs_to", F.coalesce(F.sum("k").over(outer), zero))
        .withColumn("after", F.col("ids_to") + F.col("after"))
        .withColumn("after_to", F.coalesce(F.max("after").over(outer), zero))
        .select("file", "span", "ids_to", "docs_to", "after_to")
    )
    placed = (
        local.join(spans, ["file", "span"])
        .withColumn("ids", F.col("ids_to") + F.col("ids_in"))
        .withColumn("docs", F.col("docs_to") + F.col("docs_in"))
        .withColumn("open", F.coalesce(F.col("ids_to") + F.col("after_in"), "after_to"))
    )
    ended = placed.select(
        "file", "ids", "docs", "open", "ends", F.posexplode("ends").alias("j", "end")
    ).select(
        "file",
        (F.col("docs") + F.col("j")).alias("ordinal"),
        F.when(F.col("j") == 0, F.col("open"))
        .otherwise(F.col("ids") + F.col("ends")[F.col("j") - 1] + 1)
        .alias("start"),
        (F.col("ids") + F.col("end")).alias("stop"),
        F.lit(True).alias("ended"),
    )
    last = placed.groupBy("file").agg(
        F.sum("k").alias("ordinal"),
        F.max(F.when(F.col("k") > 0, F.col("ids") + F.element_at("ends", -1) + 1)).alias("start"),
        F.sum("n").alias("stop"),
    )
    unended = last.select(
        "file", "ordinal", F.coalesce("start", zero).alias("start"), "stop",
        F.lit(False).alias("ended"),
    ).where("start < stop")
    return ended.unionByName(unended).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended"
    )


def token_counts(
    flat: DataFrame, end_id: int = 50_256, id_bytes: int = 2, span: int = SPAN
) -> DataFrame:
    """Documents and their token counts in flat blocks ``(file, block, data)``."""
    return stitch(materialize(scan_blocks(flat, end_id, id_bytes), "ends"), span)


def blocks_of_files(binary_files: DataFrame, block_bytes: int = 2 * BLOCK_IDS) -> DataFrame:
    """Blocks of whole files as Spark's ``binaryFile`` source reads them, below 2 GB each."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {block_bytes}")))
    return (
        binary_files.where("length > 0")
        .select(F.col("path").alias("file"), at.alias("block"), "content")
        .select(
            "file",
            "block",
            F.substring(
                "content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)
            ).alias("data"),
        )
    )


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Write ``docs`` as flat token files, scan them, and give each id its count."""
    flat, order = write_token_files(docs, id_col, **options)
    scan = {k: v for k, v in options.items() if k in ("end_id", "id_bytes")}
    return order.join(token_counts(flat, **scan), ["file", "ordinal"]).select(
        "id", "file", "ordinal", "start", "n_tokens"
    )
