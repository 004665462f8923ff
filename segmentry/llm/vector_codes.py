"""Short codes of vectors: product quantisation with exact nearest entries.

A component ``x`` becomes the integer ``floor(scale * x)`` and a vector is cut into equal
consecutive parts. Each part position has a codebook, which starts as that part of the
vectors with the smallest ids and is refined in rounds: every part goes to the nearest
entry, and an entry becomes the floor of the mean of its parts.

Nearest entries are found by slices. In every coordinate a codebook's entries are sorted,
and for each place in that order a mask of ``uint64`` words marks the entries before it.
The best of the entries that lie beside a part in some coordinate gives the initial
radius: an entry as near as that one differs by no more in any coordinate. So a range of
the sorted entries is selected in each coordinate by two searches, the masks at its ends
give the entries in it, and the AND of all coordinates leaves candidates among which the
nearest entry and all its ties must be. Their distances are computed exactly.

Codebooks are ``parts * entries`` short rows, whatever the number of vectors: they go to
every task, and the tasks send back sums and counts for each entry, which Spark adds up.
Vectors stay where they are; their integers are written once.

Defined cases: rows whose vector is null, is empty, or holds a null or non-finite component
are dropped. So are rows whose vector has another length than the first one by id, and rows
with a component of ``LARGEST`` or more after scaling, whose squares could pass 64 bits. Of
equal ids the smaller vector comes first, a null id comes last. With fewer vectors than
``entries`` the codebook has one entry for each. An empty table gives an empty result.
Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, materialize, quoted

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components stay below this.
LARGEST = 1 << 24
#: Parts whose candidates are held together.
AT_ONCE = 1024
#: Sums of labels that are sent to every task; more are joined by shuffle, rows dealt over
#: so many salts.
LABELS_SENT, SALTS = 50_000, 32


class SlicedBook:
    """One codebook, sorted in each coordinate, with the masks of the entries before a place."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        k, d = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(entries.T, self.order, 1)
        own = np.zeros((k, -(-k // 64)), np.uint64)
        own[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        self.before = np.zeros((d, k + 1, own.shape[1]), np.uint64)
        self.before[:, 1:] = np.bitwise_or.accumulate(own[self.order], axis=1)

    def _radius(self, x: np.ndarray) -> np.ndarray:
        """At least the distance to the nearest entry: that of the best neighbour in a coordinate."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for j, (column, order) in enumerate(zip(self.sorted, self.order, strict=True)):
            beside = order[np.searchsorted(column, x[:, j]).clip(max=len(order) - 1)]
            np.minimum(best, np.square(x - self.entries[beside]).sum(1), out=best)
        return np.sqrt(best).astype(np.int64) + 1

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Masks of the entries that may be nearest, a row of words for each part."""
        radius, mask = self._radius(x), None
        for j, column in enumerate(self.sorted):
            low = np.searchsorted(column, x[:, j] - radius)
            high = np.searchsorted(column, x[:, j] + radius, "right")
            here = self.before[j, high] ^ self.before[j, low]
            mask = here if mask is None else mask & here
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry, the lowest of ties, and the squared distance."""
        found, k = [], len(self.entries)
        for i in range(0, len(x), AT_ONCE):
            some = x[i : i + AT_ONCE]
            mask = self.candidates(some).astype("<u8").view(np.uint8)
            row, entry = np.nonzero(np.unpackbits(mask, axis=1, count=k, bitorder="little"))
            apart = some[row] - self.entries[entry]
            ranked = np.einsum("ij,ij->i", apart, apart) * k + entry
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            found.append(np.minimum.reduceat(ranked, begin))
        ranked = np.concatenate(found) if found else np.zeros(0, np.int64)
        return ranked % k, ranked // k


def _parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """Vectors as parts x rows x components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1).swapaxes(0, 1)


def _entry_sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (vector) as ``part, entry, n`` and the sum of each component, once for a task."""
    parts, k, d = books.shape
    sliced = [SlicedBook(b) for b in books]
    sums, counts = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        for p, x in enumerate(_parts_of(batch.column(0), parts)):
            entry, _ = sliced[p].nearest(x)
            counts[p] += np.bincount(entry, minlength=k)
            np.add.at(sums[p], entry, x)
    part, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
            *(pa.array(sums[part, entry, j]) for j in range(d)),
        ],
        ["part", "entry", "n", *(f"s{j}" for j in range(d))],
    )


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) as (id, label, code, error)."""
    sliced = [SlicedBook(b) for b in books]
    for batch in batches:
        code, error = np.zeros((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, np.int64)
        for p, x in enumerate(_parts_of(batch.column(2), len(books)) if batch.num_rows else ()):
            entry, far = sliced[p].nearest(x)
            code[:, p] = entry
            error += far
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
            ["id", "label", "code", "error"],
        )


def integer_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int
) -> DataFrame:
    """Written rows ``id, label, vector`` of whole vectors as integers."""
    x = quoted(vector_col)
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    # NaN compares as larger than any number.
    fit = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < LARGEST))
    rows = vectors.where(x.isNotNull() & (F.size(x) > 0) & fit).select(
        quoted(id_col).alias("id"), quoted(label_col).alias("label"), scaled.cast("array<int>").alias("vector")
    )
    written = materialize(rows, "vectors")
    first = written.orderBy(F.asc_nulls_last("id"), "vector").select(F.size("vector")).first()
    if first and first[0] % parts:
        raise ValueError(f"vectors of {first[0]} components cannot be cut into {parts} equal parts")
    return written.where(F.size("vector") == first[0]) if first else written


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks, parts x entries x components, from rows (id, vector) of integers."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number must fit in two hex digits")
    first = vectors.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
    d = books.shape[2]
    sums = [f"s{j}" for j in range(d)]
    schema = "part int, entry int, n long" + "".join(f", {s} long" for s in sums)
    for _ in range(rounds):
        found = (
            vectors.select("vector")
            .mapInArrow(lambda b, books=books: _entry_sums(b, books), schema)
            .groupBy("part", "entry")
            .agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
            .collect()
        )
        books = books.copy()  # an entry without parts stays
        for r in found:
            books[r.part, r.entry] = np.array(r[3:], np.int64) // r.n
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _with_label_sums(coded: DataFrame) -> DataFrame:
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    there = sums.withColumnRenamed("label", "of")
    if sums.count() <= LABELS_SENT:
        return coded.join(F.broadcast(there), coded["label"].eqNullSafe(there["of"])).drop("of")
    # A label may have a third of all rows: they are dealt over salts.
    there = there.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
    dealt = coded.withColumn("salt", salt)
    return dealt.join(there, (dealt["salt"] == there["at"]) & dealt["label"].eqNullSafe(there["of"])).drop("of", "at", "salt")


def compress_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """Rows ``id, label, code, error, label_error, codebooks_sha256`` of the whole vectors.

    ``code`` has two hex digits for each part, ``error`` the squared distances to the
    entries, ``label_error`` the sum of the errors of the rows with that label.
    """
    whole = integer_vectors(vectors, id_col, vector_col, label_col, parts, scale)
    books = train_codebooks(whole, parts, entries, rounds)
    schema = StructType(
        [*whole.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())]
    )
    rows = whole.select("id", "label", "vector")
    coded = materialize(rows.mapInArrow(lambda b: _coded(b, books), schema), "codes")
    discard(whole)
    return _with_label_sums(coded).withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([book[entry] for book, entry in zip(books, bytes.fromhex(code), strict=True)])
