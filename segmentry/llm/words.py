"""Words of texts, their fingerprints, and compressed texts."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

NAMES_HELD = 100_000


class Names(dict):
    """Fingerprints of words, held for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > NAMES_HELD:
            self.clear()
        return np.array(list(map(self.__getitem__, words)), np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, as UTF-8."""
    return (text or "").encode().split()


def unpack_text(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()
