"""Token ids of whole texts, by a published byte-level BPE vocabulary."""

from __future__ import annotations

import array
import os
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    ``path`` is a ``tokenizers`` file. Where a ``.tiktoken`` file of the same name
    lies beside it, the same vocabulary as ranks, texts are encoded by ``tiktoken``,
    which gives the same ids several times faster. With ``added`` false the strings
    of added tokens, such as an end mark, are ordinary text.
    """

    def __init__(self, path: str, added: bool = True) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not added
        self.marks = [t.content for t in self.slow.get_added_tokens_decoder().values()] * added
        self.fast = self._ranks(path.removesuffix(".json") + ".tiktoken")

    @staticmethod
    def _ranks(path: str):
        if not os.path.exists(path):
            return None
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, lines)}
        return tiktoken.Encoding(
            os.path.basename(path),
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={},
        )

    def ids(self, text: str) -> array.array:
        if self.fast is None or any(m in text for m in self.marks):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return array.array("I", found)


@lru_cache(maxsize=4)
def encoder(path: str, added: bool = True) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, added)


def little_endian(ids: array.array) -> bytes:
    if sys.byteorder == "big":
        ids = array.array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def output(df: DataFrame, column: str, name: str, *more: tuple[str, object]) -> StructType:
    """Schema of ``column`` under ``name``, then of the other named types."""
    first = StructField(name, df.schema[column].dataType, True)
    return StructType([first, *(StructField(n, t, True) for n, t in more)])


def cut_pieces(
    batches: Iterator[pa.RecordBatch], tokenizer: str, limit: int, end_id: int
) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to rows (id, piece, start, length, ids_crc32).

    A document is its ids and then ``end_id``. Only one longer than ``limit`` is cut;
    all its pieces but the first are ``limit`` long. A null text counts as empty.
    """
    enc = encoder(tokenizer)
    for batch in batches:
        take, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            ids = enc.ids(text.as_py() or "")
            ids.append(end_id)
            n, raw = len(ids), memoryview(little_endian(ids))
            at, size, k = 0, n % limit or limit, 0
            while at < n:
                take.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                at, size, k = at + size, limit, k + 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(take, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ],
            ["id", "piece", "start", "length", "ids_crc32"],
        )


