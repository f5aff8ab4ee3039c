"""Cutting long texts into overlapping pieces at natural boundaries.

Prefix sums of the tokens' lengths place every boundary of a text (paragraph, line, sentence,
word) among its tokens, one sorted array a kind. A piece ends at a boundary within the limit, of
the strongest kind that leaves it long enough, and the next one starts exactly `overlap` tokens
before that end. Of a kind's boundaries the last is taken for which that start is a boundary,
too. Where there is none, it is cut between tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracequarry.llm import bpe
from tracequarry.session import spread

#: Where texts pause, strongest first: after these bytes. Sentence ends of other scripts in UTF-8.
KINDS = ("paragraph", "line", "sentence", "word", "cut")
_WIDE = "|".join(c for c in "。！？؟।…")
_ENDS = [
    re.compile(rb"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+"),
    re.compile(rb"\r\n|\n|\r"),
    re.compile(rb"[.!?;:][)\]\"']*(?=\s)|(?:" + _WIDE.encode() + rb")"),
]
#: Characters of pieces after which they are handed on.
_HELD = 4_000_000
_OUT = "k long, piece int, start_token int, n_tokens int, shared int, boundary string, text string"


class Marked:
    """A text's tokens and the sorted token offsets of its boundaries by kind."""

    def __init__(self, text: str, encoder: bpe.ByteBpe):
        self.encoder = encoder
        self.raw = text.encode()
        words = encoder.split_ascii(text) if text.isascii() else encoder.split(text)
        coded = [encoder.words[w] for w in words]
        ids = np.frombuffer(b"".join(coded), "<i4")
        self.size = len(ids)
        self.bytes_at = np.concatenate([[0], np.cumsum(encoder.sizes[ids])])
        self.coded = coded

    @cached_property
    def at(self) -> list[np.ndarray]:
        words = np.fromiter(accumulate(len(c) // 4 for c in self.coded), np.int64, len(self.coded))
        return [*(self._tokens_at([m.end() for m in e.finditer(self.raw)]) for e in _ENDS), words]

    def _tokens_at(self, places: list[int]) -> np.ndarray:
        """Those of the byte offsets at which a token begins, as token offsets."""
        where = np.array(places, np.int64)
        k = np.searchsorted(self.bytes_at, where)
        return k[self.bytes_at[np.minimum(k, self.size)] == where]

    @cached_property
    def is_boundary(self) -> np.ndarray:
        out = np.zeros(self.size + 1, bool)
        for at in self.at:
            out[at] = True
        return out

    def last(self, kind: int, least: int, most: int, overlap: int) -> int:
        """The last boundary of the kind from `least` to `most` with another one `overlap` tokens before it, or -1."""
        at = self.at[kind]
        near = at[np.searchsorted(at, least, "left") : np.searchsorted(at, most, "right")]
        good = np.flatnonzero(self.is_boundary[near - overlap])
        return int(near[good[-1]]) if len(good) else -1

    def between(self, most: int) -> int:
        """The last token offset up to `most` that doesn't split a character."""
        while most > 0 and most < self.size and self.raw[self.bytes_at[most]] & 0xC0 == 0x80:
            most -= 1
        return most

    def text(self, start: int, end: int) -> str:
        return self.raw[self.bytes_at[start] : self.bytes_at[end]].decode()

    def grown(self, start: int, end: int) -> int:
        """By how many tokens the end's white space becomes more when nothing follows it."""
        text = self.text(self.between(max(start, end - 64)), end)
        blank = text[len(text.rstrip()) :]
        if len(blank) < 2:
            return 0
        first = int(np.searchsorted(self.bytes_at, self.bytes_at[end] - len(blank.encode()), "right")) - 1
        return max(0, len(self.encoder.encode(self.text(first, end))) // 4 - (end - first))


def cut_points(marked: Marked, limit: int, overlap: int, least_fill: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pieces in order, as token offsets."""
    out, start = [], 0
    while True:
        if marked.size - start <= limit:
            return [*out, (start, marked.size, KINDS.index("paragraph"))]
        most, end, kind = start + limit, -1, 0
        while end < 0:
            least = start + max(overlap + 1, int(limit * least_fill))
            for kind in range(len(marked.at)):
                end = marked.last(kind, least, most, overlap)
                if end >= 0:
                    break
            else:
                end, kind = marked.between(most), len(marked.at)
                if end <= start + overlap:
                    raise ValueError("a limit of so few tokens cannot hold the overlap and one character")
            if end - start + marked.grown(start, end) > limit:
                most, end = end - 1, -1
        out.append((start, end, kind))
        start = marked.between(end - overlap)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    types = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string()]
    names = ["k", "piece", "start_token", "n_tokens", "shared", "boundary", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def split_documents(
    docs: DataFrame, limit: int, overlap: int, ident: str = "doc_id", text: str = "text", path: str = bpe.BYTE_BPE_50K, keep_short: bool = False
) -> DataFrame:
    """(ident, piece, start_token, n_tokens, shared, boundary, text): texts of more tokens than `limit`, in pieces.

    Pieces are numbered from 0 and hold `limit` tokens at most; together they are the whole
    text. shared: the tokens that a piece has in common with the one before, exactly `overlap`
    (more by less than a character's tokens where a character would be split). boundary: what the piece ends with: paragraph, line, sentence, word or cut (the
    text's own end is a paragraph). Texts within the limit, null and empty ones give no row
    or, with keep_short, one piece if they aren't empty. Each row is split by itself,
    so a text of any length needs memory in proportion to itself alone; texts are moved only
    where the scan gives fewer tasks than there are cores.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            rows, held = [], 0
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # A token has one byte at least, so shorter texts need no counting.
                if not body or (not keep_short and (len(body) * 4 <= limit or len(body.encode()) <= limit)):
                    continue
                marked = Marked(body, encoder)
                if marked.size <= limit and not keep_short:
                    continue
                before = 0
                for i, (start, end, kind) in enumerate(cut_points(marked, limit, overlap)):
                    rows.append((key, i, start, end - start, before - start if i else 0, KINDS[kind], marked.text(start, end)))
                    before, held = end, held + len(rows[-1][-1])
                    if held > _HELD:
                        yield _batch(rows)
                        rows, held = [], 0
            yield _batch(rows)

    slim = spread(docs.select(docs[ident].cast("long").alias("k"), docs[text].alias("t")))
    return slim.mapInArrow(run, _OUT).withColumnRenamed("k", ident)
