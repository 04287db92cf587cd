"""Byte-level BPE ids of many texts at once, equal to the library's own, with a cache of chunks.

A text is cut at single spaces, where this family of tokenizers always starts a new pre-token
(texts with a space between two white-space characters are the exception and go to the library
whole). Arrow cuts and numbers the distinct chunks of a batch, so each is looked up once; a chunk
the worker has not seen yet is encoded by the library's model. The cache only saves work: it is
emptied when full, and ids never depend on it.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from segue.llm.shared import text_slices

CACHE_CHUNKS, CACHE_MARKS, CACHE_LENGTH = 200_000, 10_000, 64  # entries of at most so many characters
# The white-space characters, ASCII marks but the apostrophe, and the printable bytes that stand for themselves.
SPACES = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_loaded: dict[str, ByteBpe] = {}


def vocabulary_file(vocabulary: str) -> str:
    """A path is taken as it is; a bare name is looked up among the public tokenizers."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encoder(vocabulary: str) -> ByteBpe:
    """The worker's encoder of a vocabulary; its cache lives as long as the worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = ByteBpe(vocabulary)
    return _loaded[vocabulary]


class ByteBpe:
    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary_file(vocabulary))
        self.model = self.full.model
        with open(vocabulary_file(vocabulary), encoding="utf-8") as f:
            parts = json.load(f)
        pre = parts["pre_tokenizer"] or {}
        self.cuts = (
            parts["normalizer"] is None and parts["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in parts["added_tokens"])
        )
        others = [b for b in range(256) if b not in PRINTABLE]
        self.visible = {b: chr(256 + n) for n, b in enumerate(others)}
        self.space = self.visible[32]
        self.line = self._library("\n")
        self.marks: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes | None:
        """Ids of a word of Latin letters after ``lead``; None for anything else."""
        if not word.isalpha() or (not word.isascii() and max(word) >= "ɐ"):
            return None
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        ids = self.marks.get(mark)
        if ids is None:
            ids = self._library(mark)
            if len(self.marks) < CACHE_MARKS and len(mark) <= CACHE_LENGTH:
                self.marks[mark] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a space and a chunk: letters, then marks, are pre-tokens of their own."""
        word = chunk.rstrip(MARKS)
        if word[-1:] >= "ɐ" or not word[-1:].isalnum():
            return self._library(" " + chunk)
        ids = self.cache.get(word) if word != chunk else None
        if ids is None:
            ids = self._word(word, self.space)
            if ids is None:
                head, line, tail = chunk.partition("\n")
                after = tail.rstrip(MARKS)
                rest = self._word(after, "") if line and head and not head[-1].isspace() else None
                if rest is None:
                    return self._library(" " + chunk)
                ids = self.cache.get(head)
                ids = self._chunk(head) if ids is None else ids
                return ids + self.line + rest + (self._mark(tail[len(after):]) if after != tail else b"")
            if word != chunk and len(word) <= CACHE_LENGTH:
                self.cache[word] = ids
        return ids + self._mark(chunk[len(word):]) if word != chunk else ids

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        cache = self.cache
        found = list(map(cache.get, chunks))
        if None in found:
            if len(cache) > CACHE_CHUNKS:
                cache.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._chunk(chunks[i])
                    if len(chunks[i]) <= CACHE_LENGTH:
                        cache[chunks[i]] = found[i]
        return found

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten()
        first = np.asarray(lists.offsets)[:-1].astype(np.int64) - lists.offsets[0].as_py()
        coded = chunks.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        known = self._lookup(coded.dictionary.to_pylist())
        codes[first] = np.arange(len(first)) + len(known)  # a text's first chunk has no space before it
        known += [self._library(c) if c else b"" for c in chunks.take(pa.array(first)).to_pylist()]
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        pool = np.frombuffer(b"".join(known), dtype="<u4")
        length = sizes[codes]
        ends = np.cumsum(length)
        shift = (np.cumsum(sizes) - sizes)[codes] - (ends - length)
        ids = pool[np.repeat(shift, length) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.add.reduceat(length, first)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers, without added special tokens; those of one
        slice of the texts are held at a time."""
        for _, part in text_slices(texts):
            odd = np.asarray(pc.match_substring_regex(part, f"{SPACES} ({SPACES}|$)")) if self.cuts else np.ones(len(part), bool)
            rows: list[np.ndarray | None] = [None] * len(part)
            plain = np.flatnonzero(~odd)
            if len(plain):
                ids, counts = self._cut(part.take(pa.array(plain)))
                ends = np.cumsum(counts)
                for row, a, z in zip(plain.tolist(), (ends - counts).tolist(), ends.tolist()):
                    rows[row] = ids[a:z]
            for row in np.flatnonzero(odd).tolist():
                rows[row] = np.frombuffer(self._library(part[row].as_py()), dtype="<u4")
            yield from rows
