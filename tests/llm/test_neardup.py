"""Near-duplicates against all pairs of shingle sets in plain Python."""

import random
import re

from loadcast.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def plain(rows, width, percent):
    """{doc_id: (sizes, component)}; rows that share an id are one document."""
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {d: find(d) for d, _ in sets}


def made(rng, n):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 200))] for _ in range(12)]
    rows = []
    for d in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text += rng.choice(base)[: rng.randint(0, 60)]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(t.upper() if rng.random() < 0.02 else t for t in text)))
    return rows


def test_components(docs):
    rng = random.Random(8)
    for width, percent in ((3, 85), (5, 80)):
        rows = made(rng, 160) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two words"), (3, "x")]
        want = plain(rows, width, percent)
        got = neardup.near_duplicates(docs(*rows), width, percent).collect()
        assert len(got) == len(rows)
        texts = {}
        for d, t in rows:
            texts.setdefault(d, set()).add(len(shingles(t, width)))
        for r in got:
            assert r.component_id == want[r.doc_id], r
            assert r.n_shingles in texts[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_edges(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "A b c d e f"), (None, "a b c d e f"), (None, None), (8, None), (9, "")]
    frame = docs(*rows).selectExpr("*", "'x' as node", "1 as items", "2 as bands", "3 as _key2")
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "8", "9", "None", "None"]
    report = neardup.near_duplicates(frame).collect()
    assert len(report) == 7
    assert {(r.component_id, r.kept) for r in report if r.doc_id is None} == {(None, True)}
    assert neardup.near_duplicates(docs().limit(0)).count() == 0
    assert neardup.keep_one(docs().limit(0)).count() == 0


def test_bucket_members_in_other_components_are_compared(docs):
    """A chain whose links do not go through the smallest id."""
    words = [f"w{i}" for i in range(200)]
    near = lambda n: " ".join(words[n:] + [f"x{n}_{i}" for i in range(n)])
    rows = [(i, near(4 * i)) for i in range(12)]
    want = plain(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(*rows), 3, 85).collect()} == want


def test_components_of_chains_and_stars(spark):
    from loadcast.llm.components import components

    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(500, 560)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert all(got[i] == 500 for i in [1000, *range(500, 560)])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_equal_under_polynomial_hashes_are_two(spark, docs):
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 11))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = docs((1, f"{word} x y"), (2, f"{other} x y"), (3, f"{word.upper()}\tx  y"))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_very_long_texts_and_words(spark, docs):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = docs((5, long), (6, long + " more"), (7, "z" * 3_000_000), (8, "z" * 3_000_000), (9, long.replace("w1", "v")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, 3, 85).collect()}
    assert got[5] == (399_998, 5) and got[6] == (399_999, 5) and got[7] == (1, 7) and got[8] == (1, 7) and got[9][1] == 9
