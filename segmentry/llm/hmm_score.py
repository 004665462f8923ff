"""Scores of texts under a hidden Markov language model.

Tokens are words with A-Z lower-cased, and one end token for each text. Every token of the
training texts has an emission probability of its own in every state, however rare it is:
the model grows with the corpus, and no task holds all of it.

Documents are written once as blocks. A block exchanges its distinct tokens with buckets
for their exact counts. The model of a token is how its count is shared among the states;
a block keeps the shares of its own tokens, one byte for a state, and those of tokens that
other blocks have too are summed up in the buckets. What a state holds of all tokens is
summed from the shares as they are stored, so its emissions are a distribution.

Baum-Welch: in every iteration each block runs the scaled forward and backward recursions
over its training texts. The expected counts of a token in each state are added over all
blocks in its bucket, and the blocks get the sums back; the transitions, starts and the
mass of each state, whose number is fixed, are summed by Spark for the driver. A state
draws a token that training has from its own expected counts, or with ``BACKOFF`` from the
whole corpus; tokens that training never saw have in every state the add-half share of
one. Both weights are of shares, not of counts, so they mean the same at every size.
Scoring is the scaled forward recursion over whole texts, whose scale factors multiply to
the exact likelihood.
Recursions run over many texts at a time, sorted by length, so that each step is one small
matrix product.

The base score is the add-half unigram score from the same counts.

Defined cases: a null or blank text is its end token alone; without any training text
all counts are 0 and the model is uniform; rows that repeat are scored each; a row for
which the training condition is null is scored and not learned from; an empty table gives
an empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    LongType,
    StructField,
    StructType,
)

from .blocks import block_rows, bucket_of, pack, spans, unpack, word_list, word_order
from .common import discard, materialize, quoted
from .tokens import output

STATES = 8
ITERATIONS = 4
#: How often a state draws from the whole corpus in place of its own counts.
BACKOFF = 0.2
#: Tokens whose recursions run together.
TOKENS_AT_ONCE = 1 << 19
#: Text in a block of documents, and for each bucket of tokens; buckets at least.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 1 << 23, 1 << 24, 64

SENT = "bucket int, block long, a binary, b binary, n binary"
SENT_ARROW = pa.list_(
    pa.struct([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
)
EXPECTED = (
    "block long, shares binary, sums array<double>, sent array<struct<bucket:int,a:binary,b:binary,n:binary>>"
)


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


class Packed:
    """Sequences side by side, longest first: the symbols of step ``t`` lie together."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sequences])
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        flat = np.concatenate([sequences[i] for i in self.order])
        column = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.active = np.bincount(step)
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[self.begin[step] + column] = flat
        self.sizes = sizes

    def forward(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables, their scale factors, and the emissions."""
        e = m.emit[self.symbols]
        alpha, scale = np.empty_like(e), np.empty(len(e))
        for t, n in enumerate(self.active):
            b = self.begin[t]
            if t:
                p = self.begin[t - 1]
                a = alpha[p : p + n] @ m.move * e[b : b + n]
            else:
                a = m.start * e[:n]
            s = a.sum(1)
            a /= s[:, None]
            alpha[b : b + n], scale[b : b + n] = a, s
        return alpha, scale, e

    def log10(self, m: Hmm) -> np.ndarray:
        """Log likelihood of each sequence, in the order they were given."""
        _, scale, _ = self.forward(m)
        logs, total = np.log10(scale), np.zeros(len(self.sizes))
        for t, n in enumerate(self.active):
            total[:n] += logs[self.begin[t] : self.begin[t] + n]
        out = np.empty_like(total)
        out[self.order] = total
        return out

    def expected(self, m: Hmm, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> float:
        """Add the expected counts to the arrays; return the log10 likelihood."""
        alpha, scale, w = self.forward(m)
        w /= scale[:, None]  # becomes emission * beta / scale
        beta = np.ones((self.active[0], m.emit.shape[1]))
        inner = np.zeros_like(m.move)
        for t in range(len(self.active) - 1, -1, -1):
            b, n = self.begin[t], self.active[t]
            later = self.active[t + 1] if t + 1 < len(self.active) else 0
            if later:
                nb = self.begin[t + 1]
                after = w[nb : nb + later]
                inner += alpha[b : b + later].T @ after
                beta[:later] = after @ m.move.T
            alpha[b : b + n] *= beta[:n]
            w[b : b + n] *= beta[:n]
        moves += inner * m.move
        starts += alpha[: self.active[0]].sum(0)
        for k in range(counts.shape[1]):
            counts[:, k] += np.bincount(self.symbols, alpha[:, k], minlength=len(counts))
        return float(np.log10(scale).sum())


def _groups(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Indexes of sequences of like length, about ``TOKENS_AT_ONCE`` symbols together."""
    held, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        held.append(i)
        size += len(sequences[i])
        if size >= TOKENS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


# Counts ------------------------------------------------------------------------------


def _send_tokens(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, train, sizes, codes, words) as each bucket's tokens and their counts
    in training texts."""
    for batch in batches:
        for block, train, sizes, codes, words in zip(*batch.columns, strict=True):
            listed = word_list(words.as_py())
            if not listed:
                continue
            order, h = word_order(listed)
            taught = np.repeat(train.values.to_numpy(zero_copy_only=False), unpack(sizes.as_py(), "<i8"))
            n = np.bincount(unpack(codes.as_py(), "<i4")[taught], minlength=len(listed)).astype("<u8")[order]
            bucket, ranked = bucket_of(h, buckets), [listed[i] for i in order.tolist()]
            parts = spans(bucket)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket[i] for i, _ in parts], pa.int32()),
                    pa.array([block.as_py()] * len(parts), pa.int64()),
                    pa.array([zstandard.compress(b"\n".join(ranked[i:j]), 1) for i, j in parts], pa.binary()),
                    pa.array([pack(n[i:j]) for i, j in parts], pa.binary()),
                ],
                ["bucket", "block", "words", "n"],
            )


def _token_counts(table: pa.Table, states: int) -> pa.Table:
    """Each token's count, then its rank among the bucket's tokens of several blocks or 0.

    A bucket's first row also has ``kinds``, the number of its tokens that training has, and
    ``mass``, what the states hold of them with the first model's shares.
    """
    table = table.sort_by("block")
    n = [unpack(x, "<u8") for x in table.column("n").to_pylist()]
    words = [pa.array(word_list(x), pa.binary()) for x in table.column("words").to_pylist()]
    coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    every = np.bincount(at, np.concatenate(n), len(coded.dictionary)).astype("<u8")
    shared = (np.bincount(at, minlength=len(every)) > 1) & (every > 0)
    rank = (np.cumsum(shared) * shared).astype("<u8")
    ends = np.cumsum([len(x) for x in n])
    own = [at[e - len(x) : e] for x, e in zip(n, ends, strict=True)]
    told = [pack(np.concatenate([every[i], rank[i]])) for i in own]
    kinds = [int((every > 0).sum()), *[0] * (len(own) - 1)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(every))
    mass = (every.astype(np.float64)[:, None] * noise(h, states)).sum(0).tolist()
    return pa.table(
        {
            "block": table.column("block"), "bucket": table.column("bucket"),
            "told": pa.array(told, pa.binary()), "kinds": pa.array(kinds, pa.int64()),
            "mass": pa.array([mass, *[None] * (len(own) - 1)], pa.list_(pa.float64())),
        }
    )


COUNTED = ("block", "ids", "train", "sizes", "codes", "c", "name", "h", "tokens", "texts")


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks (block, ids, train, sizes, codes, words, told) with what is told of their tokens."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, ids, train, sizes, codes, words, told = (batch.column(i)[k] for i in range(7))
            listed = word_list(words.as_py())
            c, name, h = np.zeros((3, len(listed)), np.uint64)
            if listed:
                order, prints = word_order(listed)
                parts = [unpack(x.as_py(), "<u8") for x in told.values]
                c[order] = np.concatenate([x[: len(x) // 2] for x in parts])
                rank = np.concatenate([x[len(x) // 2 :] for x in parts])
                bucket = bucket_of(prints, buckets).astype(np.uint64)
                name[order] = np.where(rank > 0, bucket << np.uint64(32) | rank, np.uint64(0))
                h[order] = prints
            taught = train.values.to_numpy(zero_copy_only=False)
            n = unpack(sizes.as_py(), "<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(k, 1) for i in range(5)),
                    *(pa.array([pack(x)], pa.binary()) for x in (c, name, h)),
                    pa.array([int((n + 1)[taught].sum())], pa.int64()),
                    pa.array([int(taught.sum())], pa.int64()),
                ],
                list(COUNTED),
            )


# The model ---------------------------------------------------------------------------


@dataclass
class Model:
    """What all blocks share of the model; token shares stay in the blocks."""

    start: np.ndarray
    move: np.ndarray
    mass: np.ndarray  # expected tokens of each state
    ends: np.ndarray  # expected end tokens of each state
    total: int  # training tokens
    kinds: int  # distinct ones
    texts: int  # end tokens
    backoff: float = BACKOFF

    @property
    def states(self) -> int:
        return len(self.start)

    def share(self, count: np.ndarray) -> np.ndarray:
        """Add-half share of tokens in the training tokens."""
        return (count + 0.5) / (self.total + 0.5 * (self.kinds + 1))

    def hmm(self, count: np.ndarray, shares: np.ndarray) -> Hmm:
        """The model over a block's tokens, the end token last."""
        every = np.append(count, self.texts)
        corpus, unseen = self.share(every)[:, None], self.share(np.zeros(1))
        own = np.concatenate([count[:, None] * shares, self.ends[None]]) / np.maximum(self.mass, 1e-300)
        mixed = (1 - self.backoff) * (1 - unseen) * own + self.backoff * corpus
        return Hmm(self.start, self.move, np.where(every[:, None] > 0, mixed, corpus))


def first_model(total: int, kinds: int, texts: int, mass: np.ndarray) -> Model:
    """States that last and are alike but for the noise in their tokens' shares.

    ``mass`` is what that noise gives each state of the tokens other than ends.
    """
    states = len(mass)
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, move, mass + texts * even, texts * even, total, kinds, texts)


def _smoothed(counts: np.ndarray) -> np.ndarray:
    return (counts + 1) / (counts + 1).sum(-1, keepdims=True)


def next_model(m: Model, sums: np.ndarray) -> Model:
    """``sums``: moves, starts, mass of stored shares, ends, and the likelihood."""
    k = m.states
    moves, starts, mass, ends = np.split(sums[:-1], np.cumsum([k * k, k, k]))
    return replace(m, start=_smoothed(starts), move=_smoothed(moves.reshape(k, k)), mass=mass + ends, ends=ends)


def noise(h: np.ndarray, states: int) -> np.ndarray:
    """Shares that depend on the token only, so EM can break the symmetry of the states."""
    out = np.empty((len(h), states))
    for k in range(states):
        u = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        even = ((u ^ (u >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        out[:, k] = -np.log1p(-even)
    return out / out.sum(1, keepdims=True)


def to_bytes(shares: np.ndarray) -> np.ndarray:
    """Shares as bytes that go with their square roots, so small ones keep their size."""
    return np.rint(255 * np.sqrt(shares)).astype(np.uint8)


def of_bytes(stored: np.ndarray) -> np.ndarray:
    found = np.square(stored.astype(np.float64))
    return found / found.sum(1, keepdims=True)


def shared_order(name: np.ndarray) -> np.ndarray:
    """The tokens of several blocks, in the order of their buckets and ranks."""
    order = np.argsort(name, kind="stable")
    return order[np.searchsorted(name[order], 1) :]


def _shares(prior: pa.Scalar, told: pa.Scalar, name: np.ndarray, states: int, first: bool) -> np.ndarray:
    if first:
        return noise(unpack(prior.as_py(), "<u8"), states)
    stored = unpack(prior.as_py(), "u1").reshape(-1, states).copy()
    if told.is_valid:
        found = np.concatenate([unpack(x.as_py(), "u1") for x in told.values])
        stored[shared_order(name)] = found.reshape(-1, states)
    return of_bytes(stored)


def sequences_of(codes: np.ndarray, sizes: np.ndarray, end: int) -> list[np.ndarray]:
    """Each document's tokens, the end token last."""
    flat = np.insert(codes, np.cumsum(sizes), end)
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)]).tolist()
    return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _expect(batches: Iterator[pa.RecordBatch], m: Model, first: bool) -> Iterator[pa.RecordBatch]:
    """Rows (block, train, sizes, codes, c, name, prior, told) as the expected counts."""
    k = m.states
    for batch in batches:
        for block, train, sizes, codes, c, name, prior, told in zip(*batch.columns, strict=True):
            count, names = unpack(c.as_py(), "<u8"), unpack(name.as_py(), "<u8")
            shares = _shares(prior, told, names, k, first)
            hmm = m.hmm(count.astype(np.float64), shares)
            counts, moves, starts, likelihood = np.zeros_like(hmm.emit), np.zeros((k, k)), np.zeros(k), 0.0
            sequences = sequences_of(unpack(codes.as_py(), "<i4"), unpack(sizes.as_py(), "<i8"), len(count))
            taught = [s for s, t in zip(sequences, train.values.to_pylist(), strict=True) if t]
            for group in _groups(taught):
                likelihood += Packed([taught[i] for i in group]).expected(hmm, counts, moves, starts)
            own, ends = counts[:-1], counts[-1]
            n = own.sum(1)
            seen = n > 0
            shares[seen] = own[seen] / n[seen, None]
            stored, order = to_bytes(shares), shared_order(names)
            rank = names[order]
            sent = [
                {
                    "bucket": int(rank[i] >> np.uint64(32)),
                    # Ranks rise, so their steps are small numbers.
                    "a": pack(np.diff(rank[i:j] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4")),
                    "b": pack(stored[order[i:j]].reshape(-1)),
                    "n": pack(np.rint(n[order[i:j]]).astype("<u4")),
                }
                for i, j in spans((rank >> np.uint64(32)).astype(np.int64))
            ]
            # Tokens that no other block has; those of several are summed in their buckets.
            mass = (count * (names == 0)).astype(np.float64) @ of_bytes(stored)
            sums = np.concatenate([moves.ravel(), starts, mass, ends, [likelihood]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.as_py()], pa.int64()),
                    # Shares of tokens that other blocks have come from their buckets.
                    pa.array([pack((stored * (names == 0)[:, None]).reshape(-1))], pa.binary()),
                    pa.array([sums.tolist()], pa.list_(pa.float64())),
                    pa.array([sent], SENT_ARROW),
                ],
                ["block", "shares", "sums", "sent"],
            )


def _summed(table: pa.Table, states: int) -> pa.Table:
    """The shares of a bucket's tokens over all blocks, in the order each block sent.

    The first row also has ``mass``, what the states hold of these tokens.
    """
    table = table.sort_by("block")
    ranks = [np.cumsum(unpack(x, "<u4"), dtype=np.int64) - 1 for x in table.column("a").to_pylist()]
    at = np.concatenate(ranks)
    n = np.concatenate([unpack(x, "<u4") for x in table.column("n").to_pylist()])
    shares = of_bytes(np.concatenate([unpack(x, "u1") for x in table.column("b").to_pylist()]).reshape(-1, states))
    # A token that no text of a block teaches has no say, unless nobody has.
    weight = n.astype(np.float64) + 1e-9
    total = np.stack([np.bincount(at, weight * shares[:, k]) for k in range(states)], 1)
    stored = to_bytes(total / np.maximum(total.sum(1, keepdims=True), 1e-300))
    told = [pack(stored[r].reshape(-1)) for r in ranks]
    mass = (np.bincount(at, n) @ of_bytes(stored)).tolist()
    return pa.table(
        {
            "block": table.column("block"), "bucket": table.column("bucket"), "told": pa.array(told, pa.binary()),
            "mass": pa.array([mass, *[None] * (len(told) - 1)], pa.list_(pa.float64())),
        }
    )


def _collected(answers: DataFrame) -> DataFrame:
    """``block, told``: what the buckets answered to each block."""
    return answers.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "told"))).getField("told").alias("told")
    )


def _total(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of the arrays of a column, place by place."""
    out = np.zeros(size)
    for r in rows.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def _with_shares(counted: DataFrame, expected: DataFrame | None, answers: DataFrame | None) -> DataFrame:
    """``counted`` with ``prior`` and ``told``: a block's own shares, and the summed ones."""
    if expected is None:
        return counted.select("*", F.col("h").alias("prior"), F.lit(None).cast("array<binary>").alias("told"))
    own = expected.select("block", F.col("shares").alias("prior"))
    return counted.join(own, "block").join(_collected(answers), "block", "left")


def train(
    counted: DataFrame, m: Model, iterations: int
) -> tuple[Model, DataFrame | None, DataFrame | None, list[float]]:
    """The model after ``iterations`` rounds, the shares with it of blocks and of buckets,
    and the log10 likelihood of the training texts before each round."""
    expected = answers = None
    path, k = [], m.states
    for _ in range(iterations):
        rows = _with_shares(counted, expected, answers)
        first = expected is None
        after = materialize(
            rows.select("block", "train", "sizes", "codes", "c", "name", "prior", "told").mapInArrow(
                lambda b, m=m, first=first: _expect(b, m, first), EXPECTED
            ),
            "expected", "none",
        )
        if expected is not None:
            discard(expected, answers)
        expected = after
        answers = materialize(
            expected.select("block", F.inline("sent"))
            .groupBy("bucket")
            .applyInArrow(lambda t: _summed(t, k), "block long, bucket int, told binary, mass array<double>"),
            "answers", "none",
        )
        if not m.texts:
            break
        sums = _total(expected, "sums", k * k + 3 * k + 1)
        sums[k * k + k : k * k + 2 * k] += _total(answers, "mass", k)
        path.append(float(sums[-1]))
        m = next_model(m, sums)
    return m, expected, answers, path


def _score(batches: Iterator[pa.RecordBatch], m: Model, first: bool) -> Iterator[pa.RecordBatch]:
    """Rows (ids, train, sizes, codes, c, name, prior, told) as one row for each document."""
    for batch in batches:
        for j in range(batch.num_rows):
            ids, train, sizes, codes, c, name, prior, told = (x[j] for x in batch.columns)
            count, n = unpack(c.as_py(), "<u8").astype(np.float64), unpack(sizes.as_py(), "<i8")
            words = unpack(codes.as_py(), "<i4")
            hmm = m.hmm(count, _shares(prior, told, unpack(name.as_py(), "<u8"), m.states, first))
            sequences = sequences_of(words, n, len(count))
            score = np.zeros(len(n))
            for group in _groups(sequences):
                score[group] = Packed([sequences[i] for i in group]).log10(hmm)
            doc = np.repeat(np.arange(len(n)), n)
            known = np.bincount(doc, (count > 0)[words], len(n)).astype(np.int64) + (m.texts > 0)
            base = np.bincount(doc, np.log10(m.share(count))[words], len(n)) + np.log10(m.share(np.float64(m.texts)))
            yield pa.RecordBatch.from_arrays(
                [ids.values, train.values, pa.array(n + 1), pa.array(known), pa.array(base), pa.array(score)],
                ["id", "train", "n_tokens", "n_known", "base_score", "score"],
            )


def counted_blocks(
    docs: DataFrame, train_on: Column, id_col: str, text_col: str, states: int = STATES
) -> tuple[DataFrame, Model]:
    """Blocks with the exact counts of their tokens, and the first model."""
    taught = F.coalesce(train_on, F.lit(False))
    rows = docs.select(quoted(id_col).alias("id"), taught.alias("train"), quoted(text_col).alias("text"))
    ids = StructField("ids", ArrayType(rows.schema["id"].dataType))
    lists = [StructField("block", LongType()), ids, StructField("train", ArrayType(BooleanType()))]
    binary = {n: StructField(n, BinaryType()) for n in ("sizes", "codes", "words", "c", "name", "h")}
    first = StructType([lists[0], StructField("bytes", LongType()), *lists[1:], *(binary[n] for n in ("sizes", "codes", "words"))])
    blocks = materialize(rows.mapInArrow(lambda b: block_rows(b, BLOCK_BYTES, 2, lower=True), first), "token-blocks", "none")
    text_bytes = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, -(-text_bytes // BUCKET_BYTES))
    answers = materialize(
        blocks.select("block", "train", "sizes", "codes", "words")
        .mapInArrow(lambda b: _send_tokens(b, buckets), "bucket int, block long, words binary, n binary")
        .groupBy("bucket")
        .applyInArrow(lambda t: _token_counts(t, states), "block long, bucket int, told binary, kinds long, mass array<double>"),
        "counts", "none",
    )
    schema = StructType(
        [*lists, *(binary[n] for n in ("sizes", "codes", "c", "name", "h")), StructField("tokens", LongType()), StructField("texts", LongType())]
    )
    counted = materialize(
        blocks.join(_collected(answers), "block", "left")
        .select("block", "ids", "train", "sizes", "codes", "words", "told")
        .mapInArrow(lambda b: _counted(b, buckets), schema),
        "counted", "none",
    )
    zero = F.lit(0).cast("long")
    total, texts = counted.agg(F.coalesce(F.sum("tokens"), zero), F.coalesce(F.sum("texts"), zero)).first()
    kinds = answers.agg(F.coalesce(F.sum("kinds"), zero)).first()[0] + (texts > 0)
    mass = _total(answers, "mass", states)
    discard(blocks, answers)
    return counted, first_model(int(total), int(kinds), int(texts), mass)


def score_documents(
    docs: DataFrame,
    train_on: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    iterations: int = ITERATIONS,
    backoff: float = BACKOFF,
) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``train_on`` is a condition on ``docs``; rows where it holds are learned from.
    """
    counted, m = counted_blocks(docs, train_on, id_col, text_col, states)
    m, expected, answers, _ = train(counted, replace(m, backoff=backoff), iterations)
    schema = output(
        docs, id_col, "id", ("train", BooleanType()), ("n_tokens", LongType()), ("n_known", LongType()),
        ("base_score", DoubleType()), ("score", DoubleType()),
    )
    first = expected is None
    scored = (
        _with_shares(counted, expected, answers)
        .select("ids", "train", "sizes", "codes", "c", "name", "prior", "told")
        .mapInArrow(lambda b: _score(b, m, first), schema)
    )
    return scored.withColumn("train_tokens", F.lit(m.total).cast("long"))
