"""Byte-pair encoding with a public tokenizer file, whole texts in, unsigned integer ids out.

Both supported kinds of vocabulary split text at white space before they merge, so an ASCII space, or a line end,
between two visible characters is always a token boundary. A column of texts is cut there by Arrow, each distinct piece
is encoded once per block of rows (and remembered by the worker), and the ids of all rows are put together by one
gather. A plain Latin word, with or without a mark behind it, goes straight to the merge model, which skips the
library's costly string bookkeeping; other pieces, and any whole text where this reasoning doesn't hold (runs of white
space, control marks, special-token markers), are encoded by the whole tokenizer.

Null counts as empty, and an empty text has no ids. Blocks are bounded by bytes; a longer text is one block of its own.
"""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vigil.llm.common import utf8_parts

#: Pieces in each of the two generations that a worker remembers; bounds its memory.
CACHE_PIECES = 200_000
#: Bytes of text that are encoded together.
BLOCK_BYTES = 4 << 20
#: Pieces that the whole tokenizer gets in one call; it returns far more than their ids.
_TOGETHER = 2_000
_BARE = "\x01"  # put before pieces that no space precedes: the first of a text or line
_PUNCTUATION = ".,;:!?"


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies name each byte by a printable character: itself if visible, else the next one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


_LETTERS = _byte_letters()


class Encoder:
    """path: a tokenizer file; `width` bytes hold any of its ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tokenize = self.tok.model.tokenize
        self.code, self.dtype = ("H", np.dtype("<u2")) if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else ("I", np.dtype("<u4"))
        self.width = self.dtype.itemsize
        whole = self._whole
        self.leading_space = whole("a b") == whole("a") + whole(" b") != whole("a") + whole("b")
        self.lower = whole("Ab") == whole("ab")
        self.lines = whole("a,\nB c") == whole("a,") + whole("\n") + whole("B") + whole(" c")
        self.space = chr(_LETTERS[0x20]) if self.leading_space else ""
        self.ends = {p: whole(p) for p in _PUNCTUATION}
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, space: str) -> bytes | None:
        """A word of Latin letters alone, which is one pre-token; else None."""
        if not word.isascii():
            if self.lower:
                word = "".join(map(str.lower, unicodedata.normalize("NFC", word)))
            if max(word) >= "ɐ" or not word.isalpha():
                return None
            word = word.encode().decode("latin-1").translate(_LETTERS)
        elif self.lower:
            word = word.lower()
        return array(self.code, [t.id for t in self.tokenize(space + word)]).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces; None for those that say nothing about the text around them."""
        cache, ends, odd = self.cache, self.ends, []
        for p in pieces:
            ids = None
            if p.isalpha():
                ids = self._word(p, self.space)
            elif p == "\n":
                ids = self._whole(p)
            else:
                stem, space = (p[1:], "") if p[:1] == _BARE else (p, self.space)
                if not stem or stem[0].isspace() or stem[-1].isspace() or "<|" in stem:
                    cache[p] = None
                    continue
                if tail := ends.get(stem[-1], b""):
                    stem = stem[:-1]
                if stem.isalpha() and (ids := self._word(stem, space)) is not None:
                    ids += tail
            if ids is None:
                odd.append(p)
            else:
                cache[p] = ids
        lead = " " if self.leading_space else ""
        for k in range(0, len(odd), _TOGETHER):
            some = odd[k : k + _TOGETHER]
            for p, e in zip(some, self.tok.encode_batch_fast([p[1:] if p[0] == _BARE else lead + p for p in some], add_special_tokens=False), strict=True):
                cache[p] = array(self.code, e.ids).tobytes()

    def _ids_of(self, pieces: list[str]) -> list[bytes | None]:
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        cache, older, missing = self.cache, self.older, []
        for p in pieces:
            if p not in cache:
                if p in older:
                    cache[p] = older[p]
                else:
                    missing.append(p)
        self._learn(missing)
        return list(map(cache.__getitem__, pieces))

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bare, nothing = (pa.scalar(x, pa.large_string()) for x in (_BARE, ""))
        marked = pc.replace_substring(pc.binary_join_element_wise(bare, texts, nothing), "\n", f" \n {_BARE}")
        pieces = pc.split_pattern(marked, " ")
        rows = np.asarray(pieces.offsets).astype(np.int64) - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        at = np.asarray(coded.indices)
        known = self._ids_of(coded.dictionary.to_pylist())
        unclear = np.array([k is None for k in known])
        whole = np.zeros(len(texts), bool)
        if unclear.any():
            whole |= np.add.reduceat(unclear[at], rows[:-1]) > 0
            known = [k or b"" for k in known]
        whole |= np.asarray(pc.greater(pc.count_substring(texts, _BARE), 0))
        if not self.lines:
            whole |= np.asarray(pc.greater(pc.count_substring(texts, "\n"), 0))

        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        flat = np.frombuffer(b"".join(known), self.dtype)
        begins, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
        if whole.any():
            n[np.repeat(whole, np.diff(rows))] = 0
        ends = np.cumsum(n)
        begins -= ends - n
        total = int(ends[-1])
        index = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
        at = np.repeat(begins.astype(index), n)
        at += np.arange(total, dtype=index)
        ids = flat[at]
        offsets = np.concatenate([[0], ends])[rows]
        if not whole.any():
            return ids, offsets
        parts = [np.frombuffer(self._whole(texts[i].as_py()), self.dtype) if whole[i] else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def blocks(self, column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of these rows, where each row's ids begin and the end of all)."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        off = utf8_parts(column)[1]
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
            yield i, j, *self._block(column.slice(i, j - i))
            i = j

    def ended(self, column: pa.Array, end_id: int, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """blocks() with end_id behind the ids of each row."""
        for i, j, ids, offsets in self.blocks(column, size):
            at = offsets + np.arange(j - i + 1)
            out = np.full(len(ids) + j - i, end_id, self.dtype)
            own = np.ones(len(out), bool)
            own[at[1:] - 1] = False
            out[own] = ids
            yield i, j, out, at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this worker's encoders and the pieces that they remember."""
    _ENCODERS.clear()
