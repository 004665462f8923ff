"""Near-duplicate detection by improved consistent weighted sampling.

A text is a weighted set: its distinct shingles of ``SHINGLE`` words, each with weight
term frequency times a damped inverse document frequency, ``1/2 + log4(documents /
frequency) / 2``, at most 1. It is a function of the share of documents that have the
shingle, so a pair is judged alike in tables of any size. What nearly all documents have
weighs half; what fewer than one in ``COMMON`` have weighs alike, since the copies of a
group would otherwise make their own shingles weigh less than the edits between them: a
group with a tenth of all documents would lose the links that make it one.
Document frequencies are exact for every 64-bit shingle fingerprint, and no task holds a
table of them: documents are written once as blocks of ``BLOCK_BYTES`` of text, a block
sends its distinct fingerprints to buckets by value, and a bucket returns their
frequencies in the order in which the block sent them. They stay with their document
from then on, so samples and tests weigh alike.

``BANDS * ROWS`` consistent weighted samples are drawn for each text. Two texts share a
sample with a probability equal to their weighted Jaccard similarity, so texts that are
at least ``THRESHOLD`` similar share all samples of some band with near certainty
(0.9992 at a similarity of 0.8). Texts that share a band lie in one bucket. All links
are verified by the exact weighted Jaccard similarity of the two texts.

Exact copies are one node. Within buckets, pairs are tested in three steps, and after
each the nodes linked so far are one component:

1. every node of a bucket with its most popular node, the one with the most company in
   all its buckets, as the original of many copies has,
2. in small buckets that still hold several components, all pairs of different ones,
3. in large buckets that still do, all pairs as well, but block by block: a bucket is
   dealt into tiles of ``TILE`` nodes, each pair of tiles is one group, and a group adds
   up the shared weights of its pairs shingle by shingle, which is their exact
   similarity. It returns only the links that join components, at most one for a node.

Thus a group of many near copies costs about one test for each node, rows never grow
with the square of a bucket, and no pair that shares a band is left out unless it is in
one component anyway. Components are found by label propagation with pointer jumping
over tables in the shared folder.

Defined cases: a null text counts as empty; texts of fewer than ``SHINGLE`` words have
one shingle of all their words, texts without words none; such texts are in a class
with their exact copies only; rows that repeat are copies of each other; the class id
is the smallest id of the class, and a null id is larger than any other; an empty table
gives an empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .blocks import pack, unpack
from .common import discard, free_name, materialize, quoted
from .tokens import output
from .words import Names, unpack_text, words_of

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
#: Shingles that fewer than one of so many documents have weigh alike.
COMMON = 4
#: Text in a block of documents, and for each bucket of fingerprints; buckets at least.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 1 << 22, 1 << 24, 64
#: Buckets of more nodes are compared tile by tile, not as rows of pairs.
LARGE = 24
#: Nodes of a large bucket that are compared together.
TILE = 512
#: Shingles whose samples are drawn together.
AT_ONCE = 1 << 16

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, names: Names, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order of their fingerprints, and how often each occurs."""
    words = names.of(words_of(text))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = max(1, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        h = h * _A + words[i : i + n]
    return np.unique(_mixed(h), return_counts=True)


def _give_back() -> None:
    """Freed batch memory goes back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, id, text) as one row for each block of documents, texts compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        _give_back()
        if not batch.num_rows:
            continue
        digests, packed, begin, sizes = [], [], [0], [0]
        for i, text in enumerate(batch.column(2)):
            data = (text.as_py() or "").encode()
            if sizes[-1] and sizes[-1] + len(data) > BLOCK_BYTES:
                begin.append(i)
                sizes.append(0)
            sizes[-1] += len(data)
            digests.append(hashlib.sha256(data).digest())
            packed.append(pack(data))
        offsets = pa.array([*begin, batch.num_rows], pa.int32())
        each = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(begin)),
                pa.array(sizes, pa.int64()),
                *(pa.ListArray.from_arrays(offsets, values) for values in each),
            ],
            ["block", "bytes", "rows", "ids", "digests", "packed"],
        )


def stored_blocks(numbered: DataFrame) -> DataFrame:
    """The documents (row, id, text), written once: all later jobs read these blocks."""
    types = {f.name: f.dataType for f in numbered.schema.fields}
    schema = StructType(
        [
            StructField("block", LongType()),
            StructField("bytes", LongType()),
            StructField("rows", ArrayType(LongType())),
            StructField("ids", ArrayType(types["id"])),
            StructField("digests", ArrayType(BinaryType())),
            StructField("packed", ArrayType(BinaryType())),
        ]
    )
    return materialize(numbered.select("row", "id", "text").mapInArrow(_blocks, schema), "blocks")


def _packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u4").tobytes(), 1)


def _counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), "<u4")


def _block_sets(packed: pa.Scalar, names: Names) -> list[tuple[np.ndarray, np.ndarray]]:
    return [shingles(unpack_text(x.as_py()), names) for x in packed.values]


def _sent(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct shingles in order, cut into buckets, and in how many of its
    documents each occurs."""
    names = Names()
    for batch in batches:
        _give_back()
        for block, packed in zip(batch.column(0), batch.column(1), strict=True):
            found = np.concatenate([h for h, _ in _block_sets(packed, names)])
            if not len(found):
                continue
            h, n = np.unique(found, return_counts=True)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            spans = list(zip(begin, np.append(begin[1:], len(h)), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[begin].astype(np.int32)),
                    pa.array([block.as_py()] * len(begin), pa.int64()),
                    pa.array([pack(np.diff(h[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                    pa.array([_packed_counts(n[a:b]) for a, b in spans], pa.binary()),
                ],
                ["bucket", "block", "prints", "n"],
            )


def _bucket_frequencies(table: pa.Table) -> pa.Table:
    """The frequencies of each block's shingles of one bucket, in the order sent."""
    prints = [np.cumsum(unpack(x.as_py(), "<u8"), dtype=np.uint64) for x in table.column("prints")]
    n = np.concatenate([_counts(x.as_py()) for x in table.column("n")])
    every, at = np.unique(np.concatenate(prints), return_inverse=True)
    df = np.bincount(at, n, len(every)).astype(np.int64)[at]
    ends = np.cumsum([len(x) for x in prints])
    packed = [_packed_counts(df[b - len(x) : b]) for x, b in zip(prints, ends, strict=True)]
    return pa.table(
        {"block": table.column("block"), "bucket": table.column("bucket"), "df": pa.array(packed, pa.binary())}
    )


def document_frequencies(blocks: DataFrame, text_bytes: int) -> DataFrame:
    """``block, df``: frequencies of a block's distinct shingles in order, bucket by bucket."""
    buckets = max(BUCKETS, -(-text_bytes // BUCKET_BYTES))
    return (
        blocks.select("block", "packed")
        .mapInArrow(lambda b: _sent(b, buckets), "bucket int, block long, prints binary, n binary")
        .groupBy("bucket")
        .applyInArrow(_bucket_frequencies, "block long, bucket int, df binary")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("bucket", "df"))).getField("df").alias("df"))
    )


def inverse(df: np.ndarray, total: int) -> np.ndarray:
    return 0.5 + 0.5 * np.minimum(np.log(total / df) / np.log(COMMON), 1)


@lru_cache(maxsize=1)
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma distribution of shape 2, and their logarithms."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(len(p), 1.7)
    for _ in range(60):  # Newton's method on the distribution function
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 8)
    return x.astype(np.float32), np.log(x).astype(np.float32)


def samples(h: np.ndarray, weight: np.ndarray, begin: np.ndarray, number: int) -> np.ndarray:
    """(texts, number) consistent weighted samples of the sets that begin at ``begin``."""
    gamma, log_gamma = _gamma_tables()
    log_weight = np.log(weight).astype(np.float32)
    index = np.arange(len(h), dtype=np.int64)
    out = np.empty((len(begin), number), np.uint64)
    for k in range(number):
        u = _mixed(h + np.uint64((k + 1) * int(_A) % (1 << 64)))
        r = gamma[(u & np.uint64(0xFFFF)).astype(np.intp)]
        log_c = log_gamma[((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)]
        beta = (u >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + beta)
        key = (log_c - r * (t - beta) - r).view(np.int32)
        key = key ^ ((key >> 31) & np.int32(0x7FFFFFFF))  # orders like the floats
        least = np.minimum.reduceat((key.astype(np.int64) << 32) | index, begin)
        at = least & 0xFFFFFFFF
        out[:, k] = _mixed(h[at] + t[at].astype(np.int64).astype(np.uint64) * _A)
    return out


def band_keys(drawn: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(drawn), bands), np.uint64)
    for i in range(rows):
        keys = _mixed(keys * _A + drawn[:, i::rows][:, :bands])
    return keys.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """Rows (rows, ids, digests, packed, df) of blocks as one row for each document."""
    names = Names()
    for batch in batches:
        for k in range(batch.num_rows):
            _give_back()
            rows, ids, digests = (batch.column(i)[k].values for i in range(3))
            sets = _block_sets(batch.column(3)[k], names)
            sizes = np.array([len(h) for h, _ in sets])
            ends = np.cumsum(sizes)
            df = np.zeros(0, np.uint32)
            if ends[-1]:
                each, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
                df = np.concatenate([_counts(x.as_py()) for x in batch.column(4)[k].values])
                assert len(df) == len(each), "frequencies of another block"
                df = df[at]
            keys: list = [None] * len(sets)
            held: list = []

            def draw(held, keys=keys, sets=sets, sizes=sizes, ends=ends, df=df):
                h = np.concatenate([sets[i][0] for i in held])
                tf = np.concatenate([sets[i][1] for i in held])
                own = np.concatenate([df[ends[i] - sizes[i] : ends[i]] for i in held])
                begin = np.cumsum(sizes[held]) - sizes[held]
                drawn = samples(h, tf * inverse(own, total), begin, BANDS * ROWS)
                for i, row in zip(held, band_keys(drawn, BANDS, ROWS).tolist(), strict=True):
                    keys[i] = row

            size = 0
            for i in np.flatnonzero(sizes).tolist():
                held.append(i)
                size += sizes[i]
                if size >= AT_ONCE:
                    draw(held)
                    held, size = [], 0
            if held:
                draw(held)
            packed = [_packed_counts(df[b - n : b]) for n, b in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, rows, digests, pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["id", "row", "digest", "keys", "df"],
            )


def _tested(batches: Iterator[pa.RecordBatch], total: int, threshold: float) -> Iterator[pa.RecordBatch]:
    names = Names()

    @lru_cache(maxsize=64)
    def weighted(packed: bytes, df: bytes) -> tuple[np.ndarray, np.ndarray, float]:
        h, tf = shingles(unpack_text(packed), names)
        w = tf * inverse(_counts(df), total)
        return h, w, float(w.sum())

    for batch in batches:
        _give_back()
        keep = []
        for i, (a, b, df_a, df_b) in enumerate(zip(*batch.columns[2:6], strict=True)):
            ha, wa, sa = weighted(a.as_py(), df_a.as_py())
            hb, wb, sb = weighted(b.as_py(), df_b.as_py())
            _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
            both = float(np.minimum(wa[ia], wb[ib]).sum())
            if both >= threshold * (sa + sb - both) > 0:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select([0, 1])


def shared_weights(
    sets: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray | Callable[[np.ndarray], np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Weight that each pair of sets shares, above the diagonal, and each set's own.

    ``idf`` gives the weights of shingles, or is a table of them by their lowest bits.

    A shingle that occurs several times is as many elements, so the smaller of two
    weights is the weight of the elements in both.
    """
    weigh = idf if callable(idf) else lambda h: idf[(h & np.uint64(len(idf) - 1)).astype(np.int64)]
    n = len(sets)
    shared, own = np.zeros((n, n)), np.zeros(n)
    keys, docs = [], []
    for i, (h, tf) in enumerate(sets):
        again = np.concatenate([np.arange(1, t) for t in tf[tf > 1]]).astype(np.uint64) if (tf > 1).any() else np.zeros(0, np.uint64)
        more = _mixed(np.repeat(h[tf > 1], tf[tf > 1] - 1) + again * _A)
        own[i] = float((weigh(h) * tf.astype(np.float64)).sum())
        keys.append(np.stack([np.concatenate([h, more]), np.concatenate([h, np.repeat(h[tf > 1], tf[tf > 1] - 1)])]))
        docs.append(np.full(keys[-1].shape[1], i))
    key, doc = np.concatenate(keys, 1), np.concatenate(docs)
    order = np.argsort(key[0], kind="stable")
    element, doc = key[0][order], doc[order]
    weight = weigh(key[1][order]).astype(np.float64)
    begin = np.flatnonzero(np.append(True, element[1:] != element[:-1]))
    size = np.diff(np.append(begin, len(element)))
    for many in np.unique(size[size > 1]):
        at = begin[size == many]
        if many <= 6:
            for a in range(many):
                for b in range(a + 1, many):
                    np.add.at(shared, (doc[at + a], doc[at + b]), weight[at])
        else:
            for k in at:
                held = doc[k : k + many]  # in order, as the sort is stable
                shared[np.ix_(held, held)] += weight[k]
    return np.triu(shared, 1), own


def _tile_links(table: pa.Table, total: int, threshold: float) -> pa.Table:
    """Links within one pair of tiles that join components."""
    names = Names()
    table = table.sort_by([("node", "ascending"), ("tile", "ascending")])
    node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
    tile = table.column("tile").to_numpy()
    found: tuple[list, list] = ([], [])
    if len(np.unique(label)) > 1:
        sets = [shingles(unpack_text(t), names) for t in table.column("packed").to_pylist()]
        every, first = np.unique(np.concatenate([h for h, _ in sets]), return_index=True)
        df = np.concatenate([_counts(x) for x in table.column("df").to_pylist()])[first]
        idf = inverse(df, total)
        shared, own = shared_weights(sets, lambda h: idf[np.searchsorted(every, h)])
        near = shared >= threshold * (own[:, None] + own[None, :] - shared)
        near &= (shared > 0) & (label[:, None] != label[None, :])
        if len(np.unique(tile)) > 1:  # pairs of one tile are in that tile's own group
            near &= tile[:, None] != tile[None, :]
        root = {x: x for x in label.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = top(int(label[i])), top(int(label[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found[0].append(int(node[i]))
                found[1].append(int(node[j]))
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links`` (a, b): the least node it is linked to.

    In each round nodes take the least label around them, and then the label of that
    label, until no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links")
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels"
    )
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        least = around.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        after = materialize(
            least.join(up, "label", "left").select("node", F.least("label", "higher").alias("label")), "labels"
        )
        same = after.join(labels, ["node", "label"], "left_anti").isEmpty()
        discard(labels)
        labels = after
        if same:
            discard(both)
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    row_col: str | None = None,
) -> DataFrame:
    """``row, id, class_id, class_size, kept`` of every row of ``docs``.

    The row with the smallest id of a class is kept. ``row_col`` has the row numbers;
    without it rows are numbered as they are written.
    """
    row = F.monotonically_increasing_id() if row_col is None else quoted(row_col)
    numbered = docs.select(quoted(id_col).alias("id"), row.alias("row"), quoted(text_col).alias("text"))
    blocks = stored_blocks(numbered)
    total, text_bytes = blocks.agg(
        F.coalesce(F.sum(F.size("rows")), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))
    ).first()
    schema = output(
        numbered, "id", "id",
        ("row", LongType()), ("digest", BinaryType()), ("keys", ArrayType(LongType())), ("df", BinaryType()),
    )
    frequencies = materialize(document_frequencies(blocks, text_bytes), "frequencies", "none")
    signed = materialize(
        blocks.join(frequencies, "block", "left")
        .select("rows", "ids", "digests", "packed", "df")
        .mapInArrow(lambda b: _signatures(b, total), schema),
        "signatures",
    )
    discard(frequencies)
    texts = signed.groupBy("digest").agg(F.min("row").alias("node"))
    members = materialize(
        signed.join(texts, "digest").select("row", "id", "node", F.expr("IF(row = node, keys, null)").alias("keys")),
        "members",
    )
    in_band = members.where("keys IS NOT NULL").select("node", F.posexplode("keys").alias("band", "key"))
    sizes = in_band.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = materialize(in_band.join(sizes, ["band", "key"]), "bucket-sizes")
    company = sized.groupBy("node").agg(F.sum("n").alias("company"))
    led = sized.join(company, "node").groupBy("band", "key").agg(
        F.max_by("node", F.struct("company", -F.col("node"))).alias("leader")
    )
    buckets = materialize(sized.join(led, ["band", "key"]), "buckets")
    discard(sized)
    wanted = buckets.select("node").distinct()
    # Texts are compressed where they are shuffled, here and with the pairs.
    packed = blocks.select(F.inline(F.arrays_zip(F.col("rows").alias("node"), "packed")))
    known = materialize(
        signed.select(F.col("row").alias("node"), "df").join(wanted, "node").join(packed, "node"), "candidate-texts"
    )
    discard(signed, blocks)

    def links_of(pairs: DataFrame) -> DataFrame:
        a = known.select(F.col("node").alias("a"), F.col("packed").alias("packed_a"), F.col("df").alias("df_a"))
        b = known.select(F.col("node").alias("b"), F.col("packed").alias("packed_b"), F.col("df").alias("df_b"))
        told = pairs.join(b, "b").join(a, "a").select("a", "b", "packed_a", "packed_b", "df_a", "df_b")
        return materialize(
            told.mapInArrow(lambda x: _tested(x, total, threshold), "a long, b long"), "verified"
        )

    def several(links: DataFrame, condition: str) -> DataFrame:
        """Rows (band, key, node, n, label) of the buckets that hold several components."""
        now = (
            buckets.where(condition)
            .drop("leader")
            .join(components(links), "node", "left")
            .withColumn("label", F.coalesce("label", "node"))
        )
        open_ = (
            now.groupBy("band", "key")
            .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            .where("lo <> hi")
            .select("band", "key")
        )
        return materialize(now.join(open_, ["band", "key"]), "open")

    pairs = buckets.where("node <> leader").select(
        F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")
    )
    pairs = materialize(pairs.distinct(), "pairs")
    links = links_of(pairs)

    small = several(links, f"n <= {LARGE}")
    others = small.select("band", "key", F.col("node").alias("b"), F.col("label").alias("other"))
    more = (
        small.join(others, ["band", "key"])
        .where("node < b AND label <> other")
        .select(F.col("node").alias("a"), "b")
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    links = materialize(links.unionByName(links_of(materialize(more, "pairs"))), "links")

    large = several(links, f"n > {LARGE}")
    if not large.isEmpty():
        tiles = F.expr(f"cast((n + {TILE - 1}) div {TILE} as int)")
        tiled = (
            large.withColumn("tile", F.pmod(F.xxhash64("node"), tiles).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
            .join(known, "node")
            .select(
                "band", "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
                "tile", "node", "label", "packed", "df",
            )
        )
        joined = tiled.groupBy("band", "key", "low", "high").applyInArrow(
            lambda t: _tile_links(t, total, threshold), "a long, b long"
        )
        links = materialize(links.unionByName(joined.distinct()), "links")

    classes = components(links)
    discard(known, buckets)
    labelled_rows = (
        members.select("row", "id", "node")
        .join(classes, "node", "left")
        .select("row", "id", F.coalesce("label", "node").alias("label"))
    )
    first = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col("row").alias("row"))
    heads = labelled_rows.groupBy("label").agg(F.min(first).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return labelled_rows.join(heads, "label").select(
        "row", "id", F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept")
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with all its columns, the row with the smallest id of each class."""
    row = free_name(docs, "row")
    # Numbered once, in a written copy: a second numbering may differ.
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered", "zstd")
    classes = near_duplicates(numbered, id_col, text_col, threshold, row)
    gone = materialize(classes.where("NOT kept").select("row"), "near-copies")
    discard(classes)
    return numbered.join(gone.withColumnRenamed("row", row), row, "left_anti").drop(row)
