"""Ranked lexical search: the best texts for each item by summed term impacts.

A text is a sparse vector of impacts, one for each term that some item has; an item is a
vector of term weights. A score is their inner product, in integers. The search orders
vectors by length, as LEMP does, and works on buckets of texts of like length:

1. Texts are read once, to vectors of (term, occurrences), written beside their ids. Their
   number, their terms and each term's document frequency are counted over all of them.
2. In each batch of vectors, every one is given its length and the batch is cut into
   buckets, the longest first. For an item the bucket's greatest length times the item's
   own bounds all its scores (Cauchy and Schwarz), so once that is below the item's
   threshold, this bucket and all later ones are skipped.
3. Inside a bucket, the item's heaviest coordinates are multiplied out, and what is left is
   bounded by the lengths that remain of both vectors. Texts whose sum of the two is below
   the threshold go.
4. The survivors' scores are computed anew in 64-bit integers, over all terms.

The threshold of an item is its ``k``-th best score so far. A first pass over each batch's
longest bucket alone gives all tasks one to start with; the bounds are widened by more than
double precision can lose, so no text that could count is left out. Each batch sends at
most ``k`` rows an item, and Spark ranks them.

Items are taken in blocks of at most ``ITEM_TERMS`` distinct terms (a single longer item is
a block of its own), so what goes to every task is bounded; all texts meet each block.

Defined cases: a null text or item has no terms; a text without an item's terms has score
0 and is not listed; equal scores go by ascending id, a null id last; rows that repeat are
ranked each; repeated item ids give a list for each row of theirs; empty tables give an
empty result; columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import discard, materialize, quoted

TOP = 10
#: Distinct terms of the items that are searched together.
ITEM_TERMS = 1 << 18
#: Texts in a bucket; coordinates of an item that are multiplied out before the bound.
BUCKET, HEAVY = 512, 12
#: Relative room for rounding in the bounds, which are doubles.
ROOM = 1e-9

#: Letters and digits of ASCII, A-Z lower-cased, and all bytes of other characters; the
#: rest parts terms.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


def _vectors(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) as (id, n, terms, tf): terms of items and how often they occur."""
    for batch in batches:
        size, terms, times = [], [], []
        for text in batch.column(1):
            words = terms_of(text.as_py())
            found = Counter(words)
            known = [(number[w], n) for w, n in found.items() if w in number]
            size.append(len(words))
            terms.append(np.array([t for t, _ in known], "<i4").tobytes())
            times.append(np.array([n for _, n in known], "<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.binary())],
            ["id", "n", "terms", "tf"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    """Rows (terms) as each term's number of texts, once for a task."""
    df = np.zeros(n_terms, np.int64)
    for batch in batches:
        held = [np.frombuffer(t.as_py(), "<i4") for t in batch.column(0)]
        df += np.bincount(np.concatenate([np.zeros(0, np.int32), *held]), minlength=n_terms)
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], ["term", "df"])


@dataclass
class Items:
    """Items of a block as integer weights of terms, and what the bounds need of them."""

    terms: list[np.ndarray]  # of each item, the heaviest first
    weight: list[np.ndarray]  # with repeats
    root: np.ndarray  # of each term's weight, by which both vectors are scaled
    n_texts: int
    n_terms: int

    def __post_init__(self) -> None:
        self.scaled = [w / np.maximum(self.root[t], 1e-300) for t, w in zip(self.terms, self.weight, strict=True)]
        self.length = np.array([math.sqrt(float(np.square(s).sum())) for s in self.scaled])


def make_items(counts: list[dict[int, int]], df: np.ndarray, n_texts: int, n_terms: int) -> Items:
    w = np.array([math.floor(1000 * math.log((2 * n_texts + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    root = np.sqrt(np.maximum(w, 0).astype(np.float64))
    terms, weight = [], []
    for counted in counts:
        t = np.array(list(counted), np.int64)
        q = w[t] * np.array(list(counted.values()), np.int64)
        t, q = t[q > 0], q[q > 0]
        order = np.argsort(-q, kind="stable")
        terms.append(t[order])
        weight.append(q[order])
    return Items(terms, weight, root, n_texts, n_terms)


def impacts(tf: np.ndarray, n: np.ndarray, n_texts: int, n_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a text of ``n`` terms, as an integer."""
    m = 25 + 75 * n * n_texts // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Bucket:
    """Vectors of like length, by text and by term."""

    def __init__(self, start: np.ndarray, size: np.ndarray, term: np.ndarray, impact: np.ndarray, items: Items, squares: np.ndarray) -> None:
        self.size, self.begin = size, np.cumsum(size) - size
        take = np.repeat(start - self.begin, size) + np.arange(size.sum())
        self.term, self.impact = term[take], impact[take]
        self.squares = squares
        self.longest = math.sqrt(float(squares.max()))
        text = np.repeat(np.arange(len(size)), size)
        order = np.argsort(self.term, kind="stable")
        self.by_term, self.by_text = self.term[order], text[order]
        self.coordinate = self.impact[order] * items.root[self.by_term]
        self.wanted = np.zeros(len(items.root), np.int64)

    def survivors(self, items: Items, i: int, threshold: int) -> np.ndarray:
        """Texts whose score may reach the threshold: heavy coordinates, then the lengths left."""
        terms, q = items.terms[i][:HEAVY], items.scaled[i][:HEAVY]
        rest = math.sqrt(max(items.length[i] ** 2 - float(np.square(q).sum()), 0.0)) + ROOM * items.length[i]
        low, high = np.searchsorted(self.by_term, terms), np.searchsorted(self.by_term, terms, "right")
        score, left = np.zeros(len(self.size)), self.squares.copy()
        for a, b, x in zip(low.tolist(), high.tolist(), q.tolist(), strict=True):
            own, value = self.by_text[a:b], self.coordinate[a:b]
            score[own] += x * value
            left[own] -= value * value
        bound = score + rest * np.sqrt(np.maximum(left, 0) + ROOM * self.squares)
        return np.flatnonzero(bound * (1 + ROOM) >= threshold)

    def scores(self, items: Items, i: int, texts: np.ndarray) -> np.ndarray:
        """Exact scores of some texts."""
        self.wanted[items.terms[i]] = items.weight[i]
        size = self.size[texts]
        end = np.cumsum(size)
        at = np.repeat(self.begin[texts] - (end - size), size) + np.arange(size.sum())
        total = np.concatenate([[0], np.cumsum(self.wanted[self.term[at]] * self.impact[at])])
        self.wanted[items.terms[i]] = 0
        return total[end] - total[end - size]


def _buckets(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[np.ndarray, Bucket]]:
    """Rows of a batch (id, n, terms, tf) bucket by bucket, the longest vectors first."""
    terms = [np.frombuffer(t.as_py(), "<i4") for t in batch.column(2)]
    size = np.array([len(t) for t in terms], np.int64)
    term = np.concatenate(terms).astype(np.int64)
    tf = np.concatenate([np.frombuffer(t.as_py(), "<i8") for t in batch.column(3)])
    n = np.repeat(batch.column(1).to_numpy(), size)
    impact = impacts(tf, n, items.n_texts, items.n_terms)
    start = np.cumsum(size) - size
    # Each text's own sum: a difference of running sums would be rounded by their size.
    squares = np.add.reduceat(np.append(np.square(impact * items.root[term]), 0.0), start)
    squares = np.where(size > 0, squares, 0.0)
    order = np.argsort(-squares, kind="stable")
    order = order[squares[order] > 0]
    for i in range(0, len(order), BUCKET):
        rows = order[i : i + BUCKET]
        yield rows, Bucket(start[rows], size[rows], term, impact, items, squares[rows])


def _search(
    batches: Iterator[pa.RecordBatch], items: Items, at_least: np.ndarray, k: int, leading: bool
) -> Iterator[pa.RecordBatch]:
    """Rows (item, id, score): of each batch, the ``k`` best of each item that may count.

    With ``leading`` only the longest bucket of each batch is searched.
    """
    threshold = at_least.copy()
    for batch in batches:
        if not batch.num_rows:
            continue
        rank = np.empty(batch.num_rows, np.int64)
        order = pc.array_sort_indices(batch.column(0), order="ascending", null_placement="at_end")
        rank[order.to_numpy()] = np.arange(batch.num_rows)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.terms)
        open_ = [i for i in range(len(items.terms)) if len(items.terms[i])]
        for rows, bucket in _buckets(batch, items):
            reach = items.length * bucket.longest * (1 + ROOM)
            open_ = [i for i in open_ if reach[i] >= threshold[i]]
            for i in open_:
                texts = bucket.survivors(items, i, threshold[i])
                score = bucket.scores(items, i, texts)
                good = score >= max(threshold[i], 1)
                if not good.any():
                    continue
                row, score = np.append(best[i][0], rows[texts[good]]), np.append(best[i][1], score[good])
                first = np.lexsort((rank[row], -score))[:k]
                best[i] = row[first], score[first]
                if len(first) == k:
                    threshold[i] = max(threshold[i], score[first[-1]])
            if leading:
                break
        row = np.concatenate([r for r, _ in best])
        item = np.repeat(np.arange(len(best)), [len(r) for r, _ in best])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int32()), batch.column(0).take(pa.array(row)),
                pa.array(np.concatenate([s for _, s in best])),
            ],
            ["item", "id", "score"],
        )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(texts: DataFrame, items: list[Counter], k: int) -> DataFrame:
    """``item, rank, id, score`` for a block of items, numbered from 0."""
    number = {t: i for i, t in enumerate(sorted({t for counted in items for t in counted}))}
    id_type = texts.schema["id"].dataType
    schema = StructType(
        [StructField("id", id_type), StructField("n", LongType()), StructField("terms", BinaryType()), StructField("tf", BinaryType())]
    )
    vectors = materialize(texts.mapInArrow(lambda b: _vectors(b, number), schema), "term-vectors")
    zero = F.lit(0).cast("long")
    n_texts, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), zero)).first()
    size = len(number)
    df = np.zeros(size, np.int64)
    for r in (
        vectors.select("terms").mapInArrow(lambda b: _frequencies(b, size), "term int, df long")
        .groupBy("term").agg(F.sum("df").alias("df")).collect()
    ):
        df[r.term] = r.df
    counts = [{number[t]: n for t, n in counted.items()} for counted in items]
    block = texts.sparkSession.sparkContext.broadcast(make_items(counts, df, n_texts, n_terms))
    schema = StructType([StructField("item", IntegerType()), StructField("id", id_type), StructField("score", LongType())])
    held = vectors.where(F.length("terms") > 0)

    def search(at_least: np.ndarray, leading: bool) -> DataFrame:
        return held.mapInArrow(lambda b: _search(b, block.value, at_least, k, leading), schema)

    least = np.zeros(len(items), np.int64)
    start = _ranked(search(least, True), k).where(F.col("rank") == k).select("item", "score").collect()
    for r in start:
        least[r.item] = r.score
    ranked = materialize(_ranked(search(least, False), k), "ranked")
    discard(vectors)
    return ranked


def _blocks(items: list[tuple[object, Counter]], most: int) -> Iterator[list[tuple[object, Counter]]]:
    held, terms = [], set()
    for item in items:
        if held and len(terms | item[1].keys()) > most:
            yield held
            held, terms = [], set()
        held.append(item)
        terms |= item[1].keys()
    if held:
        yield held


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_terms: int = ITEM_TERMS,
) -> DataFrame:
    """``item, rank, id, score``: the ``k`` best rows of ``docs`` for every row of ``items``.

    ``items`` are the stated queries; they are read in turn by the driver, a block at a time.
    """
    spark = docs.sparkSession
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    asked = items.select(quoted(item_col).alias("item"), quoted(item_text_col).alias("text"))
    item_type = asked.schema["item"].dataType
    result = None
    named = ((r.item, Counter(terms_of(r.text))) for r in asked.toLocalIterator())
    for block in _blocks(named, item_terms):
        ranked = _search_block(texts, [counted for _, counted in block], k)
        names = spark.createDataFrame(
            [(i, name) for i, (name, _) in enumerate(block)],
            StructType([StructField("number", IntegerType()), StructField("of", item_type)]),
        )
        named_rows = ranked.join(F.broadcast(names), F.col("item") == F.col("number")).select(
            F.col("of").alias("item"), "rank", "id", "score"
        )
        result = named_rows if result is None else result.unionAll(named_rows)
    if result is None:
        schema = [("item", item_type), ("rank", IntegerType()), ("id", texts.schema["id"].dataType), ("score", LongType())]
        return spark.createDataFrame([], StructType([StructField(*f) for f in schema]))
    return result
