"""Fuzzy line dedup against all pairs of lines in plain Python."""

import os
import random

import pytest

from loadcast.llm import linededup

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BLANKS = " \t\n\x0b\x0c\r"


def plain(rows):
    """(doc_id, text) rows to {(doc_id, text): text of the lines that stay}."""
    places, sets = {}, {}
    for doc, text in {(d, t) for d, t in rows if t is not None}:
        for n, line in enumerate(text.split("\n")):
            line = line.strip(BLANKS)
            if len(line) >= linededup.MIN_CHARS:
                places.setdefault(line, []).append((doc, text, n))
                sets[line] = {line[i : i + linededup.WIDTH] for i in range(max(len(line) - linededup.WIDTH, 0) + 1)}
    holders, parent = {}, {line: line for line in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for line, shingles in sets.items():
        for s in shingles:
            holders.setdefault(s, []).append(line)
    for line, shingles in sets.items():
        for other in {o for s in shingles for o in holders[s]}:
            both = len(shingles & sets[other])
            if 100 * both >= linededup.PERCENT * (len(shingles) + len(sets[other]) - both):
                parent[find(line)] = find(other)
    groups = {}
    for line, at in places.items():
        groups.setdefault(find(line), []).extend(at)
    return groups


def check(docs_frame, rows):
    got = {(r.doc_id, r.before): r for r in docs_frame}
    for group in plain(rows).values():
        stays = 0
        for doc, text, n in group:
            kept = got[(doc, text)]
            stays += n not in kept.gone
        assert stays == 1
        first = min(d if d is not None else -1 << 62 for d, *_ in group)
        doc, text, n = next(g for g in group if g[2] not in got[(g[0], g[1])].gone)
        assert (doc if doc is not None else -1 << 62) == first


def run(frame):
    from pyspark.sql import functions as F

    gone = linededup.dropped_lines(frame)
    keyed = frame.select("doc_id", F.col("text").alias("before"), F.xxhash64("text").alias("text_hash")).distinct()
    same = keyed["doc_id"].eqNullSafe(gone["doc_id"]) & (keyed["text_hash"] == gone["text_hash"])
    joined = keyed.join(gone, same, "left").select(keyed["doc_id"], "before", F.coalesce("dropped", F.array()).alias("gone"))
    return joined.collect()


def test_generated_lines(spark, docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    lines = [" ".join(rng.choices(words, k=rng.randint(4, 30))) for _ in range(60)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(lines).split(" ")
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append("  " * rng.randint(0, 1) + " ".join(line))
        rows.append((d, "\n".join(text)))
    rows += [(None, rows[3][1]), (None, None), (7, rows[7][1]), (7, rows[8][1])]
    check(run(docs(*rows)), rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not available")
def test_given_documents(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    check(run(frame), rows)


def test_edges(spark, docs):
    line = "a line that is long enough to be counted"
    rows = [
        (1, f"{line}\nshort\n{line}"),
        (2, f"short\n  {line}  \n"),
        (3, None),
        (4, ""),
        (5, "x" * 100_000),
        (6, line.replace("long", "Long")),
    ]
    frame = docs(*rows).selectExpr("*", "'x' as dropped", "1 as _n1", "'y' as keys")
    out = {r.doc_id: r for r in linededup.dedup_lines(frame, min_chars=20).collect()}
    assert out[1].text == f"{line}\nshort"
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == "short\n"
    assert out[3].text is None and out[4].text == ""
    assert len(out[5].text) == 100_000
    assert out[6].text == line.replace("long", "Long")
    assert out[1]["dropped"] == "x" and out[1]["keys"] == "y"
    assert linededup.dedup_lines(docs().limit(0)).count() == 0


def test_short_lines(spark, docs):
    line = "a line that is long enough to be counted"
    rows = [
        (1, f"Menu\n\n* * *\n{line}\n}}"),
        (2, "  Menu\n\n* * *\nmenu\n你好。"),
        (3, "你好。\nShare on Facebook\nShare on Facebook"),
        (4, "Share on Facebooks\naaaaaaaaa\n}"),
        (5, "aaaaaaaa"),
    ]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs(*rows), min_chars=1).collect()}
    assert out[1] == rows[0][1]
    assert out[2] == "\nmenu\n你好。"
    assert out[3] == "Share on Facebook"
    assert out[4] == "aaaaaaaaa"  # ten of eleven shingles of the first line are known
    assert out[5] == ""


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not available")
def test_query_drops_exact_repeats_of_any_length(spark):
    from loadcast.llm.queries import op3_line_dedup

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    first = {}
    for doc in sorted(texts):
        for n, line in enumerate((texts[doc] or "").split("\n")):
            first.setdefault(line.strip(BLANKS), (doc, n))
    for r in op3_line_dedup(spark, SF_DIR).collect():
        lines = [x.strip(BLANKS) for x in (texts[r.doc_id] or "").split("\n")]
        repeats = sum(1 for n, x in enumerate(lines) if x and first[x] != (r.doc_id, n))
        assert r.n_dropped >= repeats


def mirrored(n):
    """Lines that differ in every eighth letter, in the order of the Thue-Morse word: equal under any polynomial hash modulo 2 ** 64."""
    rng = random.Random(1)
    contexts = ["".join(rng.choices("cdefghijklmnopqrstuvwxyz", k=7)) for _ in range(1 << n)]
    turns = [bin(i).count("1") % 2 for i in range(1 << n)]
    return ["".join(c + letters[t] for c, t in zip(contexts, turns)) for letters in ("ab", "ba")]


def test_lines_equal_under_polynomial_hashes_are_two(spark, docs):
    one, two = mirrored(11)
    kept = {r.doc_id: r.text for r in linededup.dedup_lines(docs((1, one), (2, two), (3, one))).collect()}
    assert kept == {1: one, 2: two, 3: ""}


def linked(spark, monkeypatch, keyed, texts, blocks):
    """Roots of the nodes of ``keyed``, and whether any bucket was compared in blocks."""
    from loadcast.llm import links

    seen = []
    monkeypatch.setattr(links, "_blocks", lambda *a: seen.append(1) or blocks(*a))
    sets = spark.createDataFrame(list(enumerate(texts)), "node long, items string")
    _, roots = links.spanning_links(
        spark.createDataFrame(keyed, "node long, key long"), lambda ids: sets.join(ids, "node", "left_semi"), linededup.PERCENT, to_sets=linededup.line_sets
    )
    return {r.node: r.root for r in roots.collect()}, bool(seen)


def test_pairs_of_small_buckets_are_listed_once(spark, monkeypatch):
    from loadcast.llm import links

    blocks = links._blocks
    texts = ["something else altogether, alone", "the same line, found in two places", "the same line, found in two places!", "again another line that is alone"]
    keyed = [(node, key) for key in range(5) for node in range(4)] + [(3, 9), (0, 9)]
    assert linked(spark, monkeypatch, keyed, texts, blocks) == ({1: 1, 2: 1}, False)
    monkeypatch.setattr(links, "PAIRED_MEMBERS", 3)
    assert linked(spark, monkeypatch, keyed, texts, blocks) == ({1: 1, 2: 1}, True)
    assert linked(spark, monkeypatch, [(0, 1), (3, 1)], texts, blocks) == ({}, False)


def test_lines_that_stay_are_not_split_again(spark, docs):
    same = [f"line {i} of the text, and no other" for i in range(400)]
    mixed = [x for i in range(400) for x in (f"own line {i * 7919} {i} here", same[i])]
    out = {r.doc_id: r.text for r in linededup.dedup_lines(docs((1, "\n".join(same)), (2, "\n".join(mixed)))).select("doc_id", "text").collect()}
    assert len(out[2].split("\n")) < len(mixed) and set(out[2].split("\n")) <= set(mixed) - set(same)
    plan = linededup.dedup_lines(docs((1, "a"), (2, "a")))._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.index("transform(array_except") if "transform(array_except" in plan else 0 :]
    assert "lambdafunction(split(" not in inner and "get(split(" not in plan


def near_lines(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60)]
    bases = [rng.choices(words, k=rng.randint(1, 30)) for _ in range(n // 5)]
    lines = []
    for _ in range(n):
        line = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            line[rng.randrange(len(line))] = rng.choice(words)
        lines.append(" ".join(line))
    return [line.strip() for line in lines], rng


def alike(x, y):
    x, y = ({t[i : i + linededup.WIDTH] for i in range(max(len(t) - linededup.WIDTH, 0) + 1)} for t in (x, y))
    return 100 * len(x & y) >= linededup.PERCENT * len(x | y)


def test_pairs_are_verified_with_each_text_cut_once():
    import pyarrow as pa

    from loadcast.llm import links

    lines, rng = near_lines(120, 8)
    lines += ["x" * 300, "x" * 400, "ab" * 100, "short", "日本語の行です。日本語の行です。", "日本語の行です。日本語の行です!"]
    pairs = [(a, b) for a in range(len(lines)) for b in rng.sample(range(len(lines)), 20)]
    cut = []

    def sets(texts):
        cut.extend(texts.to_pylist())
        return linededup.line_sets(texts)

    columns = [pa.array(c) for c in zip(*((a, b, lines[a], lines[b]) for a, b in pairs))]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "x", "y"])
    hits = [p for out in links._reaching(linededup.PERCENT, sets)(iter([batch])) for p in zip(*(c.to_pylist() for c in out.columns))]
    assert hits == [(a, b) for a, b in pairs if alike(lines[a], lines[b])] and len(hits) > 20
    assert len(cut) < 1.5 * len(pairs)  # not both texts of every pair
    none = batch.slice(0, 0)
    assert sum(out.num_rows for out in links._reaching(linededup.PERCENT, sets)(iter([none]))) == 0


def test_members_of_a_block_are_compared_by_their_rarest_items(monkeypatch):
    import pyarrow as pa

    from loadcast.llm import links

    looked, ranges = [], links._ranges
    monkeypatch.setattr(links, "_ranges", lambda starts, lengths: looked.append(lengths.sum()) or ranges(starts, lengths))

    def compared(lines, roots, own):
        table = pa.table({"node": range(len(lines)), "root": roots, "own": pa.array(own, pa.int32()), "items": lines})
        out = links._compare(linededup.PERCENT, linededup.line_sets)(table)
        return list(zip(*(c.to_pylist() for c in out.columns)))

    for seed in range(4):
        lines, rng = near_lines(150, seed)
        roots = [rng.randrange(60) for _ in lines]
        own = [rng.randrange(1 + seed % 2) for _ in lines]
        now, links_ = list(roots), []
        for p in range(len(lines)):
            for q in range(p + 1, len(lines)):
                if now[p] != now[q] and (seed % 2 == 0 or own[p] != own[q]) and alike(lines[p], lines[q]):
                    links_.append((p, q))
                    low, high = sorted((now[p], now[q]))
                    now = [low if r == high else r for r in now]
        assert compared(lines, roots, own) == links_ and links_
    looked.clear()
    rng = random.Random(2)
    common = "".join(rng.choices("abcdefgh", k=100))
    lines = [common + "".join(rng.choices("ijklmnop", k=100)) for _ in range(200)]
    assert compared(lines, list(range(200)), [0] * 200) == []
    assert sum(looked) < 200 * 200  # each set's own items, not the common ones of all pairs


def test_stars_of_sorted_buckets_go_on_across_batches():
    import pyarrow as pa

    from loadcast.llm import links

    rng = random.Random(4)
    rows = sorted((rng.randrange(-20, 20), rng.randrange(-9, 9)) for _ in range(300))
    rows += [(99, n) for n in (-5, -5, -5, 1, 1, 2, 3, 4, 5, 6)]
    first = {k: n for k, n in reversed(rows)}
    expected = sorted({(n, k, first[k]) for k, n in rows if n != first[k]})
    for size in (1, 2, 7, 1000):
        keys, nodes = zip(*rows)
        whole = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(keys)], names=["node", "key"])
        parts = [whole.slice(at, size) for at in range(0, len(rows), size)]
        got = [r for out in links._stars(iter([whole.slice(0, 0), *parts])) for r in zip(*(c.to_pylist() for c in out.columns))]
        assert sorted(got) == expected and len(set(got)) == len(got)
