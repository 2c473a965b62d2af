"""Piece encoding: best segmentation against plain dynamic programming, and the round trip."""

import random
from types import SimpleNamespace

import pytest

from loadcast.llm import sentencepieces
from loadcast.llm.queries import TOKENIZERS


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary.load(f"{TOKENIZERS}/piece_bpe_32k.model")


def least_cost(text, vocabulary):
    """Cost of the best segmentation of a marked text, in millionths."""
    costs = {p: vocabulary.cost(s) for p, _, s in vocabulary.pieces}
    unknown = vocabulary.cost(vocabulary.lowest)
    text = sentencepieces.MARK + text.replace(" ", sentencepieces.MARK)
    best = [0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        ways = [best[b] + costs[text[b:end]] for b in range(max(0, end - vocabulary.longest), end) if text[b:end] in costs]
        if text[end - 1] not in costs:
            ways.append(best[end - 1] + unknown)
        best[end] = min(ways)
    return best[-1]


def cost_of(ids, text, vocabulary):
    by_id = {i: vocabulary.cost(s) for _, i, s in vocabulary.pieces}
    known = {c for p, *_ in vocabulary.pieces for c in p if len(p) == 1}
    total = sum(by_id.get(i, 0) for i in ids)
    return total + sum(vocabulary.cost(vocabulary.lowest) for c in text if c != " " and c not in known)


def test_encoding(spark, docs, vocabulary):
    rng = random.Random(12)
    parts = ["the", " ", "  ", "\n", "Hello", "straße", "日本", "\U0001f600", "\x00", "<0x0A>", "▁", "ing", "tion", "é", "\t", "12", "..."]
    texts = ["", " ", "the", " leading and trailing ", "a" * 40, None] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(150)]
    texts += [texts[10], "word " * 20_000, "ab" * 5_000]
    frame = docs(*enumerate(texts), (None, "null id")).selectExpr("*", "1 as part", "'x' as cell", "2 as batch")
    encoded = sentencepieces.encode(frame, vocabulary)
    got = {r.doc_id: r for r in sentencepieces.decode(encoded, vocabulary).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].ids is None and got[i].text is None and got[i].n_pieces is None
            continue
        assert got[i].text == t.replace("▁", " "), repr(t)
        assert got[i].n_pieces == len(got[i].ids)
        if t and len(t) < 2_000 and "\x00" not in t:
            assert cost_of(got[i].ids, t.replace("▁", " "), vocabulary) == least_cost(t, vocabulary), repr(t)
    assert sentencepieces.encode(docs().limit(0), vocabulary).count() == 0


def test_long_runs_are_segmented_whole(docs, vocabulary):
    rng = random.Random(3)
    url = "https://www.example.com/" + "/".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz-_0123456789", k=rng.randint(3, 20))) for _ in range(30))
    code = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2_000))
    texts = ["ab" * 5_000, url[:300], code, "=" * 1_000, " " * 333 + "x", "-." * 200 + "é" * 100, "international" * 50, "0" * 65, "deadbeef" * 8]
    once = SimpleNamespace(pieces=vocabulary.pieces, cost=vocabulary.cost, lowest=vocabulary.lowest, longest=vocabulary.longest)
    for r in sentencepieces.encode(docs(*enumerate(texts)), vocabulary).collect():
        text = texts[r.doc_id]
        assert cost_of(r.ids, text, once) == least_cost(text, once), text[:40]
        assert sentencepieces.decode_ids(r.ids, vocabulary.bytes_of()) == text


def test_parcels_hold_what_was_packed():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    codes = np.r_[rng.integers(0, 400, 5_000), 254, 255, 256, 65_535 + 255, 1 << 24]
    counts = pa.array([len(codes), None, 0], pa.int64())
    table, got = sentencepieces._unpack_texts(sentencepieces._frames(sentencepieces._framed(sentencepieces._pack_texts([7, None, 9], counts, codes))))
    assert table.to_pydict() == {"doc_id": [7, None, 9], "cells": counts.to_pylist()} and (got == codes).all()
    _, none = sentencepieces._unpack_texts(sentencepieces._pack_texts([1], pa.array([0], pa.int64()), codes[:0]))
    assert len(none) == 0
    cells = [pa.array(["▁the", "", "\U0001f600"]), pa.array(["é"]), pa.array([], pa.string())]
    got, sizes = sentencepieces._unpack_cells([sentencepieces._pack_cells(c) for c in cells])
    assert got.to_pylist() == ["▁the", "", "\U0001f600", "é"] and sizes == [3, 1, 0]


def test_cells_of_texts_join_to_the_texts(vocabulary):
    known = (*vocabulary.joints(), vocabulary.costs(), vocabulary.longest, vocabulary.cost(vocabulary.lowest))
    texts = ["a plain text, twice", "", "naïve 日本 \U0001f600\x00", "a plain text, twice", "ab" * 200]
    cells, counts = sentencepieces.cells_of(texts, *known)
    flat, at = cells.to_pylist(), 0
    for text, n in zip(texts, counts.tolist()):
        assert "".join(flat[at : at + n]) == ((sentencepieces.MARK + text.replace(" ", sentencepieces.MARK)) if text else "")
        at += n
    assert at == len(flat) and all(1 <= len(c) <= sentencepieces.LONGEST for c in flat)


def test_lattice_tasks_grow_with_the_cells(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepieces, "TASK_CELLS", 5)
    words = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(400)]
    cells = spark.createDataFrame([((i % 3 << sentencepieces.NUMBER_BITS) + i, sentencepieces.MARK + w) for i, w in enumerate(words)], "number long, cell string")
    encoded = sentencepieces.lattice(cells, vocabulary)
    assert encoded.rdd.getNumPartitions() >= 80
    ids = {r.cell: r.ids for r in encoded.collect()}
    assert all(sentencepieces.decode_ids(ids[sentencepieces.MARK + w], vocabulary.bytes_of()) == w for w in words)
    assert encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 1
