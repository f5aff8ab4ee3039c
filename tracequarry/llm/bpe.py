"""Exact byte-level BPE over a whole corpus, with a public tokenizer's vocabulary.

A text is cut into words by the tokenizer's pattern; each different word is encoded once a
worker. A word's bytes are read as Latin-1, so that an Aho-Corasick automaton of all tokens
gives the longest token at a place. The encoding takes the longest token that is compatible
with the one before, falls back to shorter prefixes and steps back where none fits; places
found to be dead ends are never tried again, so the work is linear in the word's length.
Two tokens are compatible if the merge rules keep them apart, which is told from the merges
along their boundary and remembered.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracequarry.session import spread

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: How the tokenizer divides a text into words (fixed by the vocabulary; \s is White_Space).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Remembered words and pairs a worker; beyond them the memory starts anew.
MEMORY = 400_000


class _Memory(dict):
    """A dictionary that works out what it lacks, and forgets all when full."""

    def __init__(self, work, most: int = MEMORY):
        self.work, self.most = work, most

    def __missing__(self, key):
        value = self.work(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """Encodes texts as tiktoken and tokenizers do with the same ranks."""

    def __init__(self, path: str = BYTE_BPE_50K):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = {r: len(t) for t, r in self.ranks.items()}
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.halves = {r: self._halves(t, r) for t, r in self.ranks.items() if len(t) > 1}
        self.merged = {pair: r for r, pair in self.halves.items()}
        self.shorter = {r: self._shorter(t) for t, r in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.fits = _Memory(self._fits)
        self.words = _Memory(self._word)
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: what merges of lower ranks leave of its bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            of = [self.ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(of)
            if best >= rank:
                raise ValueError(f"token {rank} cannot be merged from others")
            i = of.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _shorter(self, token: bytes) -> int:
        """The longest token that the token begins with, other than itself; -1 for none."""
        return next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the joined bytes gives back just these two tokens.

        They stay apart unless some merge across the boundary comes before the merges that
        built its neighbours: the later built of the two is undone step by step, looking at
        each pair of pieces that touched the boundary at that time.
        """
        left, right = pair
        before = len(self.ranks) + 1
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            inner_left, inner_right = self.halves.get(left), self.halves.get(right)
            if inner_left and (not inner_right or left > right):
                before, left = left, inner_left[1]
            elif inner_right:
                before, right = right + 1, inner_right[0]
            else:
                return True

    def _longest(self, text: str, at: int) -> int:
        """The longest token that starts there; each byte is a token, so there is one."""
        return next(self.automaton.iter_long(text, at))[1]

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.ranks.get(raw)
        return np.array([whole] if whole is not None else self.encode_bytes(raw), "<i4").tobytes()

    def encode_bytes(self, raw: bytes) -> list[int]:
        """The tokens of one word's bytes."""
        text, end = raw.decode("latin-1"), len(raw)
        open_at = bytearray(b"\1") * (end + 1)
        out: list[int] = []
        at = 0
        token = self._longest(text, 0) if end else -1
        while at < end:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + self.size[token]] and (last < 0 or self.fits[last, token])):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.size[token]
                token = self._longest(text, at) if at < end else -1
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.size[token]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers; none for an empty or null text."""
        if not text:
            return b""
        words = self.split_ascii(text) if text.isascii() else self.split(text)
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe:
    """One encoder a worker process."""
    return ByteBpe(path)


def as_lists(buffers: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, buffers)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(buffers), "<i4"), pa.int32()))


def encode_corpus(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(ident, ids) of every row: the token ids of its whole text, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are ordinary text.
    Repeated rows come out as often as they came in; other columns are not looked at. Each
    task encodes its part of the scan, in Arrow batches; texts are moved only where the scan
    gives fewer tasks than there are cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = as_lists([bpe.encode(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["k", "ids"])

    slim = spread(docs.select(docs[ident].alias("k"), docs[text].alias("t")))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", ident)


def count_tokens(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(ident, tokens) of every row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            sizes = pa.array([len(bpe.encode(t)) // 4 for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["k", "tokens"])

    slim = spread(docs.select(docs[ident].alias("k"), docs[text].alias("t")))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(run, f"k {kind}, tokens int").withColumnRenamed("k", ident)
