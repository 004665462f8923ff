"""Substring deduplication by recompression.

A window is a fixed number of consecutive words of one document. Words that lie in a
window whose words also start anywhere else are removed.

Documents are written once as blocks of ``BLOCK_BYTES`` of text, as codes into the block's
own list of distinct words. Every round of naming is a Spark job over all blocks. A block
sends its distinct symbols, counted, to buckets by their fingerprint; a bucket compares
the symbols themselves, gives each that occurs at least twice in the corpus a name of its
own, and answers the blocks in the order in which they sent. So a name stands for one
sequence of words everywhere: no two words or symbols share one.

* Round 0 names words, round 1 maximal runs of one symbol, each later round pairs: a
  symbol's name decides whether it may begin or end a pair in this round, so adjacent
  symbols pair alike wherever they stand. Symbols wider than ``WIDEST`` words pair no more.
* Within a window, a symbol is interior if no context outside the window can change it;
  its bounds are narrowed from both ends in every round. Equal windows have equal interior
  symbols at equal places. A window with an interior symbol that occurs once in the corpus
  is no repeat; windows that are left have only shared symbols, of higher level each round.
  Symbols that no such window touches leave the blocks, so the rounds get smaller.
* The windows that are left are verified: a block sends them once, as 128-bit fingerprints
  of the names of all their words, and is told which occur again.

A block adds up equal symbols and equal windows before it sends them, so what is in
every document is one row for each block.

Defined cases: a null text has no words; words are compared as they are; a document
shorter than a window keeps all its words; a window that starts twice in one document,
overlapping itself too, is a repeat; rows that repeat are repeats of each other; an
empty table gives an empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .blocks import block_rows, bucket_of, exchanged, pack, spans, unpack, word_list, word_order
from .common import discard, materialize, quoted
from .tokens import output

WINDOW = 35
#: Rounds after the words': the first names runs, the others pairs.
ROUNDS = 5
WIDEST = 16
#: Text in a block of documents, and for each bucket of symbols; buckets at least.
BLOCK_BYTES, BUCKET_BYTES, BUCKETS = 1 << 22, 1 << 24, 64

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

SENT = "array<struct<bucket:int,a:binary,b:binary,n:binary>>"
SENT_ARROW = pa.list_(
    pa.struct([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])
)
STATE = f"block long, start binary, stop binary, name binary, win binary, lo binary, hi binary, names binary, sent {SENT}"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def stored_blocks(pair: DataFrame) -> DataFrame:
    """The documents (id, text), written once: all later jobs read these blocks."""
    schema = StructType(
        [
            StructField("block", LongType()),
            StructField("bytes", LongType()),
            StructField("ids", ArrayType(pair.schema["id"].dataType)),
            StructField("sizes", BinaryType()),
            StructField("codes", BinaryType()),
            StructField("words", BinaryType()),
        ]
    )
    return materialize(pair.select("id", "text").mapInArrow(lambda b: block_rows(b, BLOCK_BYTES, 1), schema), "blocks", "none")


# Exchange with the buckets -----------------------------------------------------------


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of their fingerprints: those, a place of each, and the
    number of each pair's own among them."""
    h = _mixed(a * _A ^ _mixed(b + _B))
    found, first, at = np.unique(h, return_index=True, return_inverse=True)
    if (a[first][at] != a).any() or (b[first][at] != b).any():  # a fingerprint of two pairs
        found, first, at = np.unique(np.stack([h, a, b], 1), axis=0, return_index=True, return_inverse=True)
        found, at = found[:, 0], at.reshape(-1)
    return found, first, at


def _sent_pairs(a: np.ndarray, b: np.ndarray, buckets: int) -> list[dict]:
    if not len(a):
        return []
    h, first, at = distinct(a, b)
    n, bucket = np.bincount(at, minlength=len(h)).astype("<u4"), bucket_of(h, buckets)
    a, b = a[first], b[first]
    return [
        {"bucket": int(bucket[i]), "a": pack(a[i:j]), "b": pack(b[i:j]), "n": pack(n[i:j])}
        for i, j in spans(bucket)
    ]


def _send_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, codes, words) as rows (bucket, block, a, b, n) of words and counts."""
    for batch in batches:
        for block, codes, words in zip(*batch.columns, strict=True):
            listed = word_list(words.as_py())
            if not listed:
                continue
            order, h = word_order(listed)
            n = np.bincount(unpack(codes.as_py(), "<i4"), minlength=len(listed)).astype("<u4")[order]
            bucket, ranked = bucket_of(h, buckets), [listed[i] for i in order.tolist()]
            parts = spans(bucket)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket[i] for i, _ in parts], pa.int32()),
                    pa.array([block.as_py()] * len(parts), pa.int64()),
                    pa.array([zstandard.compress(b"\n".join(ranked[i:j]), 1) for i, j in parts], pa.binary()),
                    pa.nulls(len(parts), pa.binary()),
                    pa.array([pack(n[i:j]) for i, j in parts], pa.binary()),
                ],
                ["bucket", "block", "a", "b", "n"],
            )


def _answers(table: pa.Table) -> pa.Table:
    """The rank of each symbol of a bucket that occurs twice or more, else 0, in the order
    sent. Symbols are ordered by their own values, so every run gives the same ranks."""
    table = table.sort_by("block")
    n = [unpack(x, "<u4") for x in table.column("n").to_pylist()]
    if table.column("b").null_count:
        words = [word_list(x) for x in table.column("a").to_pylist()]
        coded = pa.chunked_array([pa.array(w, pa.binary()) for w in words]).combine_chunks().dictionary_encode()
        kinds, at = len(coded.dictionary), coded.indices.to_numpy()
    else:
        a, b = (np.concatenate([unpack(x, "<u8") for x in table.column(c).to_pylist()]) for c in "ab")
        found, _, at = distinct(a, b)
        kinds = len(found)
    again = np.bincount(at, np.concatenate(n), kinds) > 1
    rank = (np.cumsum(again) * again).astype("<u4")[at]
    ends = np.cumsum([len(x) for x in n])
    told = [pack(rank[e - len(x) : e]) for x, e in zip(n, ends, strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "told": pa.array(told, pa.binary())})


def _told(answers: pa.Scalar) -> np.ndarray:
    if not answers.is_valid:
        return np.zeros(0, np.uint64)
    return np.concatenate([unpack(x.as_py(), "<u4") for x in answers.values]).astype(np.uint64)


def global_names(rank: np.ndarray, bucket: np.ndarray, turn: int) -> np.ndarray:
    """Names of symbols by round, bucket and rank; 0 for those that occur once."""
    name = np.uint64(turn << 58) | (bucket.astype(np.uint64) << np.uint64(30)) | rank
    return np.where(rank > 0, name, np.uint64(0))


# Rounds ------------------------------------------------------------------------------


@dataclass
class State:
    """A block's symbols [start, stop) with their names, and the windows that may be
    repeats, each with the bounds of its interior. Places count words, and one more
    between documents, so symbols of two documents never touch."""

    start: np.ndarray
    stop: np.ndarray
    name: np.ndarray
    win: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def symbol_at(self, size: int) -> np.ndarray:
        """The last symbol that starts at or before each place."""
        marks = np.zeros(size, np.int32)
        marks[self.start] = 1
        return np.cumsum(marks, dtype=np.int32) - 1

    def narrowed(self, keep: np.ndarray, window: int) -> State:
        """Without the other windows, and the symbols that no window touches."""
        win, lo, hi = self.win[keep], self.lo[keep], self.hi[keep]
        size = int(self.stop[-1]) + 1 if len(self.stop) else 0
        edges = np.zeros(size + 1, np.int32)
        np.add.at(edges, win, 1)
        np.add.at(edges, win + window, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:size]) > 0)])
        used = covered[self.stop] > covered[self.start]
        return State(self.start[used], self.stop[used], self.name[used], win, lo, hi)

    def without_single(self, window: int) -> State:
        """Without the windows that have an interior symbol of no name."""
        if not len(self.win):
            return self.narrowed(np.zeros(0, bool), window)
        at = self.symbol_at(int(self.stop[-1]) + 1)
        single = np.concatenate([[0], np.cumsum(self.name == 0)])
        some = self.lo < self.hi
        first = at[self.lo]
        last = at[np.maximum(self.hi - 1, self.lo)]
        return self.narrowed(~some | (single[last + 1] == single[first]), window)

    def packed(self) -> list[bytes]:
        gap = np.diff(self.win, prepend=0)
        return [
            pack(np.diff(self.start, prepend=0).astype("<i4")),
            pack((self.stop - self.start).astype("<i4")),
            pack(self.name.astype("<u8")),
            pack(gap.astype("<i4")),
            pack((self.lo - self.win).astype("<i4")),
            pack((self.hi - self.lo).astype("<i4")),
        ]

    @staticmethod
    def of(fields: list[bytes]) -> State:
        gap, width, name, win_gap, lo, width_in = (
            unpack(x, k) for x, k in zip(fields, ("<i4", "<i4", "<u8", "<i4", "<i4", "<i4"), strict=True)
        )
        start, win = np.cumsum(gap, dtype=np.int64), np.cumsum(win_gap, dtype=np.int64)
        lo = win + lo
        return State(start, start + width, name, win, lo, lo + width_in)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of every word."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, np.arange(len(doc)) + doc


def first_state(names: np.ndarray, sizes: np.ndarray, window: int) -> State:
    """Words as symbols, and the windows without a word that occurs once."""
    _, place = places(sizes)
    n = np.arange(max(0, len(place) - window + 1))
    win = place[n][place[n + window - 1] - place[n] == window - 1]
    return State(place, place + 1, names, win, win, win + window).without_single(window)


def run_symbols(s: State) -> tuple[np.ndarray, np.ndarray]:
    """First symbol and length of the maximal runs of one symbol."""
    first = np.ones(len(s.name), bool)
    first[1:] = (s.name[1:] != s.name[:-1]) | (s.start[1:] != s.stop[:-1]) | (s.name[1:] == 0)
    begin = np.flatnonzero(first)
    return begin, np.diff(np.append(begin, len(s.name)))


def sides(s: State, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols may begin a pair in this round, and which may end one."""
    bit = _mixed(s.name + np.uint64(turn * int(_A) % (1 << 64))) >> np.uint64(63)
    free = (s.stop - s.start <= WIDEST) & (s.name != 0)
    return free & (bit == 0), free & (bit == 1)


def paired(s: State, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Symbols that form a pair with the next one."""
    return np.flatnonzero(left[:-1] & right[1:] & (s.stop[:-1] == s.start[1:]))


def new_symbols(s: State, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """What this round asks names for: two numbers for each occurrence of a new symbol."""
    if turn == 1:
        begin, length = run_symbols(s)
        many = length > 1
        return s.name[begin[many]], length[many].astype(np.uint64)
    j = paired(s, *sides(s, turn))
    return s.name[j], s.name[j + 1]


def after_round(s: State, turn: int, told: np.ndarray, buckets: int, window: int) -> State:
    """The state with this round's symbols, without the windows they settle."""
    if not len(s.win):
        return s
    a, b = new_symbols(s, turn)
    named = np.zeros(0, np.uint64)
    if len(a):
        h, _, at = distinct(a, b)
        named = global_names(told, bucket_of(h, buckets), turn)[at]
    size = int(s.stop[-1]) + 1
    of = s.symbol_at(size)
    lo, hi = s.lo, s.hi
    if turn == 1:
        begin, length = run_symbols(s)
        name = s.name[begin].copy()
        name[length > 1] = named
        after = State(s.start[begin], s.stop[begin + length - 1], name, s.win, lo, hi)
        # A run at either end may go on outside the window.
        of = after.symbol_at(size)
        lo, hi = after.stop[of[s.win]], after.start[of[s.win + window - 1]]
    else:
        left, right = sides(s, turn)
        j = paired(s, left, right)
        some = lo < hi
        x, y = of[np.minimum(lo, size - 1)], of[np.maximum(hi - 1, 0)]
        lo = np.where(some & right[x], s.stop[x], lo)
        hi = np.where(some & left[y], s.start[y], hi)
        name, stop, keep = s.name.copy(), s.stop.copy(), np.ones(len(s.name), bool)
        name[j], stop[j], keep[j + 1] = named, s.stop[j + 1], False
        after = State(s.start[keep], stop[keep], name[keep], s.win, lo, hi)
    after.lo, after.hi = lo, np.maximum(lo, hi)
    return after.without_single(window)


def _state_row(block: int, s: State, names: bytes | None, sent: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            *(pa.array([x], pa.binary()) for x in [*s.packed(), names]),
            pa.array([sent], SENT_ARROW),
        ],
        ["block", "start", "stop", "name", "win", "lo", "hi", "names", "sent"],
    )


def _first_states(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, sizes, codes, words, told) as states after the words are named."""
    for batch in batches:
        for block, sizes, codes, words, told in zip(*batch.columns, strict=True):
            listed, rank = word_list(words.as_py()), _told(told)
            names = np.zeros(len(listed), np.uint64)
            if listed:
                order, h = word_order(listed)
                names[order] = global_names(rank, bucket_of(h, buckets), 0)
            s = first_state(names[unpack(codes.as_py(), "<i4")], unpack(sizes.as_py(), "<i8"), window)
            yield _state_row(block.as_py(), s, pack(names), _sent_pairs(*new_symbols(s, 1), buckets))


def _next_states(
    batches: Iterator[pa.RecordBatch], turn: int, last: int, buckets: int, window: int
) -> Iterator[pa.RecordBatch]:
    """States and answers as the states after round ``turn``, with what the next asks."""
    for batch in batches:
        for block, *fields, told in zip(*batch.columns, strict=True):
            s = after_round(State.of([x.as_py() for x in fields]), turn, _told(told), buckets, window)
            sent = _sent_pairs(*new_symbols(s, turn + 1), buckets) if turn < last else []
            yield _state_row(block.as_py(), s, None, sent)


# Verification ------------------------------------------------------------------------


def window_prints(names: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of the names of each window's words."""
    found = []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        part, width, power, done = _mixed(names + np.uint64(base)), 1, base, None
        for bit in range(window.bit_length()):
            if window >> bit & 1:
                # The part so far, then one of this width behind it.
                if done is None:
                    done, size = part, width
                else:
                    n = len(names) - width
                    done = done[:n] * np.uint64(power) + np.pad(part, (0, size))[size:][:n]
                    done = np.pad(done, (0, width))
                    size += width
            more = np.pad(part[width:], (0, width))
            part, width, power = part * np.uint64(power) + more, 2 * width, power * power % (1 << 64)
        found.append(_mixed(done[start]))
    return found[0], found[1]


def _prints(sizes: pa.Scalar, codes: pa.Scalar, names: pa.Scalar, win: pa.Scalar, window: int):
    """Word places and document of the windows left, and their fingerprints."""
    place = np.cumsum(unpack(win.as_py(), "<i4"), dtype=np.int64)
    n = unpack(sizes.as_py(), "<i8")
    # The first place of a document is that of its first word, and one for each before it.
    begin = np.cumsum(n) - n + np.arange(len(n))
    start = place - (np.searchsorted(begin, place, side="right") - 1)
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    words = unpack(names.as_py(), "<u8")[unpack(codes.as_py(), "<i4")]
    return start, *window_prints(words, start, window)


def _send_windows(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, *fields in zip(*batch.columns, strict=True):
            sent = _sent_pairs(*_prints(*fields, window)[1:], buckets)
            if sent:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["bucket"] for x in sent], pa.int32()),
                        pa.array([block.as_py()] * len(sent), pa.int64()),
                        *(pa.array([x[k] for x in sent], pa.binary()) for k in "abn"),
                    ],
                    ["bucket", "block", "a", "b", "n"],
                )


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids, words, sizes, codes, names, win, told) as one row for each document."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, words, *fields, told = (c[k] for c in batch.columns)
            sizes, codes = unpack(fields[0].as_py(), "<i8"), unpack(fields[1].as_py(), "<i4")
            start, a, b = _prints(*fields, window)
            kept = np.ones(len(codes), bool)
            if len(start):
                hit = start[(_told(told) > 0)[distinct(a, b)[2]]]
                edges = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edges, hit, 1)
                np.add.at(edges, hit + window, -1)
                kept = np.cumsum(edges[:-1]) == 0
            upto = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
            listed = pa.array(word_list(words.as_py()), pa.binary())
            flat = listed.take(pa.array(codes[kept])) if len(listed) else listed
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat), b" ")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.values,
                    pa.array(sizes, pa.int64()),
                    pa.array(sizes - np.diff(upto), pa.int64()),
                    pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string()),
                ],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )


# The operator ------------------------------------------------------------------------

FIELDS = ("start", "stop", "name", "win", "lo", "hi")


def recompressed(blocks: DataFrame, buckets: int, window: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``block, names`` of each block's words, and ``block, win``: the windows that have
    only shared interior symbols after all rounds."""
    asked = blocks.select("block", "codes", "words").mapInArrow(
        lambda b: _send_words(b, buckets), "bucket int, block long, a binary, b binary, n binary"
    )
    state = first = materialize(
        blocks.join(exchanged(asked, _answers), "block", "left")
        .select("block", "sizes", "codes", "words", "told")
        .mapInArrow(lambda b: _first_states(b, buckets, window), STATE),
        "words-named", "none",
    )
    for turn in range(1, rounds + 1):
        sent = state.select("block", F.inline("sent"))
        after = materialize(
            state.join(exchanged(sent, _answers), "block", "left")
            .select("block", *FIELDS, "told")
            .mapInArrow(lambda b, turn=turn: _next_states(b, turn, rounds, buckets, window), STATE),
            "round", "none",
        )
        if state is not first:
            discard(state)
        state = after
    return first.select("block", "names"), state.select("block", "win")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256``: each document without repeated windows."""
    pair = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    blocks = stored_blocks(pair)
    text_bytes = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(BUCKETS, -(-text_bytes // BUCKET_BYTES))
    names, windows = recompressed(blocks, buckets, window, rounds)
    left = names.join(windows, "block")
    sent = (
        blocks.select("block", "sizes", "codes")
        .join(left, "block")
        .select("block", "sizes", "codes", "names", "win")
        .mapInArrow(
            lambda b: _send_windows(b, buckets, window), "bucket int, block long, a binary, b binary, n binary"
        )
    )
    told = materialize(exchanged(sent, _answers), "repeats")
    schema = output(
        pair, "id", "id", ("n_words", LongType()), ("n_removed", LongType()), ("kept_sha256", StringType())
    )
    return (
        blocks.join(left, "block")
        .join(told, "block", "left")
        .select("ids", "words", "sizes", "codes", "names", "win", "told")
        .mapInArrow(lambda b: _removed(b, window), schema)
    )
