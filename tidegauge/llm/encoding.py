"""Tokenizer calls with a bounded memory of pieces already encoded."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: White space as the tokenizers' patterns know it, by code point (fixed values).
UNICODE_SPACE = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
#: A run of space and what follows it: tokens of byte_bpe_50k.json never reach across its end.
SPACE_AND_WORD = re.compile(f"[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+")
#: Words alone, for tokenizers that drop white space (word_bpe_49k.json).
WORD_ONLY = re.compile(f"[^{UNICODE_SPACE}]+")
LONG_PIECE = 256
MEMORY = 700_000
#: Rows encoded and handed on at a time.
SLICE = 512


def slices(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The batches in parts of at most ``SLICE`` rows, so that a task holds few texts and ids at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


class PieceEncoder:
    """Token ids of whole texts. Texts are cut where tokens can't reach across, pieces are encoded once.

    Two generations of at most ``memory`` pieces are kept: when the young one is full it becomes the old one,
    and old pieces that are met again move back. Pieces of over ``LONG_PIECE`` characters are
    not kept. A text with a special string is encoded as a whole, so that the library treats the
    string as it does by default.
    """

    def __init__(self, path: str, pieces: re.Pattern, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.pieces, self.memory, self.young, self.old = pieces, memory, {}, {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _learn(self, new: set[str]) -> None:
        old, young = self.old, self.young
        # Over the few new pieces: a set's intersection with a dict would walk the whole dict.
        fresh = []
        for p in new:
            if p in old:
                young[p] = old[p]
            else:
                fresh.append(p)
        found = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        young.update(zip(fresh, [self._bytes(e.ids) for e in found], strict=True))

    def encoded(self, text: str) -> bytes:
        """Ids of a text as packed integers of ``dtype``."""
        if any(s in text for s in self.special):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.pieces.findall(text)
        new = set(parts).difference(self.young)
        if new:
            self._learn(new)
        out = b"".join(map(self.young.__getitem__, parts))
        for p in [p for p in new if len(p) > LONG_PIECE]:
            del self.young[p]
        if len(self.young) > self.memory:
            self.young, self.old = {}, self.young
        return out

    def counts(self, texts: Iterable[str]) -> np.ndarray:
        return np.array([len(self.encoded(t)) // self.dtype.itemsize for t in texts], np.int64)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, pieces: re.Pattern, memory: int = MEMORY) -> PieceEncoder:
    """The encoder of this worker process."""
    key = (path, pieces.pattern, memory)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, pieces, memory)
    return _ENCODERS[key]
