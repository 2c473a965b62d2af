"""Nearest neighbours, license scans and language identification."""

import random
import re
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadcast.llm import ann, langid, licenses
from loadcast.llm.queries import TOKENIZERS

VECTORS = "vec_id long, embedding array<float>"


def exact(rows, queries, k):
    out = {}
    for q, x in queries:
        scored = [(-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(x, v)), i) for i, v in rows if i != q]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_nearest_has_high_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 16))
    rows = [(i, (centers[i % 20] + 0.6 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    queries = rows[::20]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in ann.nearest(frame, frame.filter("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = exact(rows, queries, 10)
    hits = sum(len({r.vec_id for r in got[q]} & set(ids)) for q, ids in want.items())
    assert hits >= 0.9 * 10 * len(want)
    lookup = dict(rows)
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 11))
        assert all(r.score == pytest.approx(np.dot(np.float64(lookup[q]), np.float64(lookup[r.vec_id])), abs=1e-9) for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)


def test_nearest_edges(spark):
    same = [1.0, 0.0]
    rows = [(i, same) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [1.0]), (105, []), (106, [float("inf"), 1.0]), (None, same), (107, [0.0, 2.0])]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as list", "'x' as id", "3 as score")
    out = ann.nearest(frame, frame.filter("vec_id % 20 = 0"), k=20)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {0, 20, 40}
    for q, ids in got.items():
        assert ids == [i for i in range(21) if i != q][:20]
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert ann.nearest(few, few, k=20).count() == 6
    assert ann.nearest(few.limit(0), few, k=20).count() == 0


def test_recall_over_hundreds_of_lists(spark, monkeypatch):
    """Clusters, near copies, outliers, and queries that are centroids of lists of their own."""
    monkeypatch.setattr(ann, "LIST_ROWS", 4)
    hits = 0
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(30, 16))
    points = [centers[i % 30] + 0.5 * rng.normal(size=16) for i in range(1_500)]
    points += [p + 1e-3 * rng.normal(size=16) for p in points[:20] for _ in range(5)]  # small groups of near copies
    points += list(rng.normal(size=(400, 16)))  # outliers
    rows = [(i, (p / np.linalg.norm(p)).astype(np.float32).tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in ann.nearest(frame, frame.filter("vec_id % 10 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = np.array([x for _, x in rows], np.float32).astype(np.float64)
    for q in range(0, len(rows), 10):
        scores = v @ v[q]
        scores[q] = -np.inf
        ids, found = zip(*got[q])
        assert len(set(ids)) == 20 and list(found) == sorted(found, reverse=True)
        hits += (np.array(found) >= np.sort(scores)[::-1][19] - 1e-9).sum()
        assert np.allclose(found, scores[list(ids)], atol=1e-9)
    assert hits >= 0.95 * 20 * len(got)


def test_no_list_is_dropped(monkeypatch):
    monkeypatch.setattr(ann, "MAX_LISTS", 64)
    sample = np.random.default_rng(3).normal(size=(2_000, 8))
    lists = ann.fit_lists(sample, 64)
    assert 8 < len(lists.centroids) <= 64
    near = ((sample[:, None] - lists.centroids[None]) ** 2).sum(2).argmin(1)
    assert np.bincount(near, minlength=len(lists.centroids)).min() > 0


def plain_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts = sorted((i, p) for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels = ",".join(sorted({licenses.PHRASES[p] for _, p in starts}))
    return len(words), len(starts), starts[0][0] if starts else None, starts[-1][0] if starts else None, labels


def test_license_phrases_and_templates(docs):
    rng = random.Random(6)
    parts = ["CC", "by", "cc by", "General", "public LICENSE", "all rights reserved", "ALL RIGHTS", "reserved", "é", "K", "-", ". ", "x1", "license"]
    texts = [None, "", "cc-by", "cc by cc by", "ccby", "xcc by", "cc byx", "Ⅽc by"] + [rng.choice([" ", "-", "\n"]).join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(150)]
    texts += ["Intro. Licensed under the Apache License, Version 2.0. Tail", "RELEASED under the MIT license!", "mit license apache", "Licensed under CC BY-NC 4.0.", "word " * 50_000 + "Released under the MIT License"]
    frame = docs(*enumerate(texts)).selectExpr("*", "1 as words", "'x' as base", "2 as joined")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), repr(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    n = len(texts)
    assert [got[n - k].labels for k in (5, 4, 3, 2, 1)] == ["apache-2.0", "mit", "", "cc-by,cc-by-nc", "mit"]
    assert licenses.scan(docs().limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return langid.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")


def all_segmentations(word, probability, unseen):
    """Logarithm of the sum, in plain numbers of any size."""
    word = langid.MARK + word
    best = [Decimal(1)] + [Decimal(0)] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - 16), end):
            p = probability.get(word[begin:end], unseen if end - begin == 1 else 0.0)
            best[end] += best[begin] * Decimal(p)
    return float(best[-1].ln())


def test_word_scores_sum_over_all_segmentations(vocabulary):
    pieces = langid.Pieces.of(vocabulary)
    rng = np.random.default_rng(1)
    model = rng.random((pieces.count + 1, 3)) * 1e-3
    model[-1] = langid.UNSEEN
    words = ["the", "a", "straße", "elle", "zzzzqqq", "이것", "x" * 48, "हिन्दी", "我们在这里" * 40, "\U00030001", "abc" * 2000]
    codes, starts, _ = langid.letter_words([" ".join(words)])
    lengths = np.diff(np.r_[starts, len(codes)])
    logs = langid.word_scores(codes, starts, lengths, pieces, model)
    for l in range(3):
        table = {p: model[i, l] for i, p in enumerate(vocabulary)}
        assert logs[:, l] == pytest.approx([all_segmentations(w, table, langid.UNSEEN) for w in words])


def test_words_are_whole():
    for text, words in {"हिन्दी भाषा": 2, "\U00030001": 1, "的" * 5000: 1, "\u0301 1\u0301a\u0301b": 1, "": 0, "\u0301": 0}.items():
        assert len(langid.letter_words([text])[1]) == words
    codes, starts, text = langid.letter_words([None, "a b", "", "c"])
    assert (codes.tolist(), starts.tolist(), text.tolist()) == ([97, 98, 99], [0, 1, 2], [1, 1, 3])


def test_counts_weigh_all_segmentations(vocabulary, monkeypatch):
    monkeypatch.setattr(langid, "GRID_PLACES", 7)
    pieces = langid.Pieces.of(vocabulary)
    flat = {p: 1e-4 for p in vocabulary}
    for word in ("in", "straße", "zq", "abcdefghi" * 60):
        got = langid.expected_counts([word], np.array([0]), 1, pieces)[:, 0]
        whole = all_segmentations(word, flat, langid.UNSEEN)
        for i in np.flatnonzero(got[:-1])[:6]:
            lessened = all_segmentations(word, flat | {vocabulary[i]: 1e-4 * (1 - 1e-6)}, langid.UNSEEN)
            assert got[i] == pytest.approx((whole - lessened) / 1e-6, rel=1e-3, abs=1e-6)  # the derivative by its logarithm


def test_language_identification(docs, vocabulary):
    rng = random.Random(3)
    lexicon = {"en": "the of and with that from this which".split(), "de": "der und nicht mit dem eine auch für".split(), "fr": "les des une dans avec pour être où".split()}
    rows = [(i, " ".join(rng.choices(lexicon[l], k=rng.randint(3, 40))), l) for i in range(300) for l in [rng.choice(list(lexicon))]]
    names, model = langid.train(docs(*rows[:200], (900, "zzz", None), (901, None, "en")), vocabulary)
    assert names == ["de", "en", "fr"]
    edge = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? \n", "en"), (1003, "THE " * 30_000, "en"), (1004, "Und", "de")]
    frame = docs(*rows[200:], *edge).selectExpr("*", "'x' as lang_pred", "1 as score")
    got = {r.doc_id: r for r in langid.predict(frame, vocabulary, names, model).collect()}
    assert sum(got[i].lang_pred == l for i, _, l in rows[200:]) >= 98
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "en" and got[1004].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    none, empty = langid.train(docs().limit(0), vocabulary)
    assert none == [] and langid.predict(docs((1, "text")), vocabulary, none, empty).first().lang_pred == "und"
    assert langid.predict(docs().limit(0), vocabulary, names, model).count() == 0


def test_a_word_of_many_groups_is_scored_once(vocabulary, monkeypatch):
    monkeypatch.setattr(langid, "PIECE_CHARS", 40)
    pieces = langid.Pieces.of(vocabulary)
    model = np.random.default_rng(5).random((pieces.count + 1, 2)) * 1e-3
    texts = ["the same few words", None, "12 !?", "few others", "straße the same", "x" * 90, "", "words of the same few"] * 20
    asked = []
    scores = langid.word_scores
    monkeypatch.setattr(langid, "word_scores", lambda codes, first, lengths, *a: asked.extend("".join(map(chr, codes[f : f + n])) for f, n in zip(first, lengths)) or scores(codes, first, lengths, *a))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "doc_id"])
    rows = [r for b in langid._predict(pieces, ["a", "b"], model)(iter([batch])) for r in b.to_pylist()]
    assert sorted(asked) == sorted(set(asked)) and set(asked) == {w for t in texts for w in re.findall(r"[a-zß]+", t or "")}
    for i, r in enumerate(rows):
        codes, starts, _ = langid.letter_words([texts[i]])
        if not len(starts):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = scores(codes, starts, np.diff(np.r_[starts, len(codes)]), pieces, model).sum(0)
        assert r["lang_pred"] == "ab"[sums.argmax()] and r["score"] == pytest.approx(1 / np.exp(sums - sums.max()).sum())
    apart = sum(langid.expected_counts([t], np.array([i % 2]), 2, pieces) for i, t in enumerate(texts))
    assert langid.expected_counts(texts, np.arange(len(texts)) % 2, 2, pieces) == pytest.approx(apart)
