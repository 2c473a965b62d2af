"""Measures against plain Python, and the learned list on documents with a known rule."""

import random
import re
from collections import Counter

from loadcast.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "x y z x y z", "#*$%&|<>", "one\none\n one\n\n", "\x85 a b 　"]
    texts += ["".join(rng.choices("ab #\n\t", k=rng.randint(0, 60))) for _ in range(200)]
    texts += [" ".join(rng.choices(["le", "the", "é𝄞", "of|"], k=n)) for n in (50, 500, 3000)]
    got = {r.doc_id: r for r in quality.measured(docs(*enumerate(texts)), "doc_id").collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), repr(t)


def made(rng, bad):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(rng.randint(60, 120))]
    if bad:
        words = [w + "###" if rng.random() < 0.5 else w for w in words]
    return " ".join(words)


def test_learned_list(spark, docs):
    rng = random.Random(9)
    bad = [i % 5 == 0 for i in range(400)]
    rows = [(i, made(rng, b)) for i, b in enumerate(bad)]
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i % 2 == 0], "doc_id long, quality int, toxic int")
    frame = docs(*rows, (1000, "short"), (1001, None))
    got = {r.doc_id: r for r in quality.quality_report(frame, labels).collect()}
    assert all(got[i].kept == (not b) for i, b in enumerate(bad))
    assert got[1000].base_failed and not got[1000].kept and not got[1001].kept
    wide = frame.selectExpr("*", "1 as n_words", "'x' as kept", "2 as bad")
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, b in enumerate(bad) if not b}
    none = labels.limit(0)
    assert {r.doc_id for r in quality.keep_good(frame, none).collect()} == set(range(400))
    assert quality.quality_report(docs().limit(0), labels).count() == 0
    rules = quality.learn(quality.labelled_rows(quality.measured(frame, "doc_id"), labels))
    assert rules and all(1 <= len(r.conditions) <= quality.MAX_CONDITIONS for r in rules)
