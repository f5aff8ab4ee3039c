"""Encoding, packing and splitting: exact comparisons, invariants and edge texts."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracequarry.llm import bpe, packing, splitting

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary")
#: The pattern as the tokenizer's file states it, for the other implementation.
OFFICIAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ours():
    return bpe.encoder(bpe.BYTE_BPE_50K)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=OFFICIAL, mergeable_ranks=ours.ranks, special_tokens={})


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n'strevmld1\u3000\u00a0é中\x1c", max_size=60)))
def test_any_text_is_encoded_exactly(text):
    ours = bpe.encoder(bpe.BYTE_BPE_50K)
    theirs = tiktoken.Encoding("own", pat_str=OFFICIAL, mergeable_ranks=ours.ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    assert ids(ours, text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, " " * 30_000 + "x", "0123456789abcdef" * 3000, "\r\n" * 5000, "é" * 9000, "<|endoftext|>", "don't we'll I'D"])
def test_long_and_odd_texts(ours, theirs, text):
    assert ids(ours, text) == theirs.encode_ordinary(text)


def test_every_token_by_itself(ours):
    for token, rank in ours.ranks.items():
        assert ours.encode_bytes(token) == [rank]


def test_a_full_memory_starts_anew():
    memory = bpe._Memory(lambda x: x * 2, most=3)
    assert [memory[k] for k in range(10)] == [2 * k for k in range(10)] and len(memory) <= 3


DOCS = "doc_id long, text string, k string, t string, ids string"


def test_corpus(spark, theirs):
    texts = ["", None, "  \n", "int main() { return 0; }", "日本語のテキスト", "x" * 100_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "k", "t", "i") for i, t in enumerate(texts)] + [(3, texts[3], "", "", "")], DOCS)
    got = bpe.encode_corpus(docs).collect()
    assert len(got) == 9
    assert all(r.ids == (theirs.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in got)
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(docs).collect()} == {i: len(theirs.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert bpe.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0


def slow_pack(sizes, capacity):
    """Tries every level and takes the one with the least sum of squares, the fullest of equal ones."""
    counts, bins, where, out = [0] * (capacity + 1), {}, 0, []
    for s in sizes:
        best = None
        for level in [h for h in range(capacity - s, 0, -1) if counts[h]] + [0]:
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + s < capacity:
                after[level + s] += 1
            key = sum(n * n for n in after)
            if best is None or key < best[0]:
                best = (key, level, after)
        _, level, counts = best
        b = bins[level].pop() if level else where
        where += not level
        if level + s < capacity:
            bins.setdefault(level + s, []).append(b)
        out.append(b)
    return out


@pytest.mark.parametrize("capacity", [1, 7, 20, 50])
def test_packing_is_sum_of_squares(capacity):
    random.seed(capacity)
    sizes = [random.randint(1, capacity) for _ in range(400)]
    assert packing.pack(sizes, capacity) == slow_pack(sizes, capacity)


SIZED = "id long, size int, bin long, piece int, part int"


def test_containers(spark):
    random.seed(1)
    rows = [(i, random.choice([1, 5, 30, 64, 99, 100, 101, 250, 1000]), 0, 0, 0) for i in range(3000)]
    rows += [(-1, 0, 0, 0, 0), (-2, None, 0, 0, 0), (None, 5, 0, 0, 0)]
    got = packing.fill_containers(spark.createDataFrame(rows, SIZED), 100, part_items=500).collect()
    by_item, by_bin = {}, {}
    for r in got:
        by_item.setdefault(r.id, []).append((r.piece, r.size))
        by_bin[r.bin] = by_bin.get(r.bin, 0) + r.size
    sizes = {i: s for i, s, *_ in rows if i is not None and s}
    assert {i: sum(s for _, s in p) for i, p in by_item.items()} == sizes
    for i, pieces in by_item.items():
        pieces = sorted(pieces)
        assert [k for k, _ in pieces] == list(range(len(pieces))) and all(s == 100 for _, s in pieces[:-1])
        assert len(pieces) == -(-sizes[i] // 100)
    assert max(by_bin.values()) <= 100 and sum(by_bin.values()) / (100 * len(by_bin)) > 0.97


def test_items_that_cannot_share_stay_spread(spark):
    rows = [(i, 60, 0, 0, 0) for i in range(1000)]
    got = packing.fill_containers(spark.createDataFrame(rows, SIZED), 100, part_items=100).collect()
    assert len({r.bin for r in got}) == 1000
    assert packing.fill_containers(spark.createDataFrame([], SIZED), 100).count() == 0


def checked_pieces(theirs, text, rows, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece)
    raw, at = text.encode(), 0
    assert [r.piece for r in rows] == list(range(len(rows)))
    ends = []
    for k, r in enumerate(rows):
        assert 0 < r.n_tokens <= limit and len(theirs.encode_ordinary(r.text)) <= limit
        piece = r.text.encode()
        start = raw.find(piece, at)
        if k:
            assert r.start_token + r.shared == ends[-1]
            assert overlap <= r.shared <= overlap + 3 and (r.shared == overlap or not text.isascii())
        ends.append(r.start_token + r.n_tokens)
        assert start >= 0
        at = start
    assert rows[0].start_token == 0 and ends[-1] == len(theirs.encode_ordinary(text))
    assert raw.startswith(rows[0].text.encode()) and raw.endswith(rows[-1].text.encode())


PARAGRAPHS = "\n\n".join(f"Finding {k} was seen. It is a copy, and nobody checked it! See line {k}.\nThe second line of {k}." for k in range(60))
TEXTS = [PARAGRAPHS, PARAGRAPHS.replace("\n", "\r\n"), PARAGRAPHS.replace("\n", " "), "word " * 800, "x1" * 3000, "漢字" * 900, "🎉" * 500, "\n" * 4000 + "end", " " * 5000, "写" + "真。" * 700, "a\r" * 900]


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (50, 0), (200, 99)])
def test_pieces(spark, theirs, limit, overlap):
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate([*TEXTS, "", None, "short"])], DOCS)
    by = {}
    for r in splitting.split_documents(docs, limit, overlap).collect():
        by.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        if len(theirs.encode_ordinary(text)) > limit:
            checked_pieces(theirs, text, by.pop(i), limit, overlap)
    assert not by
    kept = splitting.split_documents(docs, limit, overlap, keep_short=True).where("text = 'short'").collect()
    assert [(r.piece, r.shared, r.text) for r in kept] == [(0, 0, "short")]
    assert splitting.split_documents(spark.createDataFrame([], DOCS), limit, overlap).count() == 0


def test_pieces_end_where_the_text_pauses(spark):
    docs = spark.createDataFrame([(1, PARAGRAPHS, "", "", "")], DOCS)
    rows = splitting.split_documents(docs, 64, 8).collect()
    assert {r.boundary for r in rows} <= {"paragraph", "line", "sentence"}
    assert all(r.text.endswith("\n\n") for r in rows[:-1] if r.boundary == "paragraph")
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_documents(docs, 10, 5)


def test_pieces_share_the_given_overlap_and_start_where_the_text_pauses(spark, theirs):
    docs = spark.createDataFrame([(1, PARAGRAPHS, "", "", ""), (2, PARAGRAPHS.replace("\n", " "), "", "", "")], DOCS)
    rows = splitting.split_documents(docs, 64, 8).where("piece > 0").collect()
    assert len(rows) > 30 and {r.shared for r in rows} == {8}
    marked = {k: splitting.Marked(t, splitting.bpe.encoder(splitting.bpe.BYTE_BPE_50K)) for k, t in ((1, PARAGRAPHS), (2, PARAGRAPHS.replace("\n", " ")))}
    assert all(marked[r.doc_id].is_boundary[r.start_token] for r in rows)


def test_many_pieces_of_one_text_come_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(splitting, "_HELD", 1000)
    docs = spark.createDataFrame([(1, "word " * 20_000, "", "", "")], DOCS)
    rows = splitting.split_documents(docs, 64, 8).collect()
    assert sorted(r.piece for r in rows) == list(range(len(rows))) and len(rows) > 300
