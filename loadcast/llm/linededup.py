"""Fuzzy line deduplication: MinHash over character shingles, one line per component stays.

One pass over the texts gives the keys of each document's lines and a banded
signature of every line that is new in its batch, from the smallest and largest
hash under each permutation.  Lines that share a band are verified by the exact
Jaccard similarity of their shingle sets and joined to components; of all places
where a line of a component stands, the first (smallest doc_id, then text hash,
then line number) keeps it.

Lines are compared without blanks at their ends.  All but empty ones count; with
a larger ``min_chars``, shorter ones are left alone.  A line shorter than a shingle is one shingle, so it meets only lines equal to it.

Defined results: a null or empty text stays as it is; a null doc_id comes before
all others; rows equal in id and text are one document and get the same lines;
an empty table gives an empty table; other columns pass through unread.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.llm.batches import returning
from loadcast.llm.links import spanning_links
from loadcast.llm.shingles import FACTORS, SEED, SPACE, mixed, powers
from loadcast.sources.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 8  # characters of a shingle
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 1  # all but empty lines, unless the caller sets another least length
PERCENT = 80
BANDS = 12
PERMUTATIONS_PER_BAND = 2
GROUP_CHARS = 500_000

_RANDOM = np.random.default_rng(4104)
MULTIPLIERS = (_RANDOM.integers(0, 1 << 31, BANDS * PERMUTATIONS_PER_BAND, dtype=np.uint32) << np.uint32(1)) + np.uint32(1)

LINES_DDL = "doc_id long, text_hash long, keys array<long>, node long, bands array<long>"
LINES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("node", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)


class Lines:
    """All lines of some texts: places in one array of code points, without blanks at the ends, and their keys."""

    def __init__(self, texts: list[str | None], min_chars: int = MIN_CHARS, keyed: bool = True):
        joined = "\n".join(t or "" for t in texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        ends = np.r_[np.flatnonzero(codes == 10), len(codes)]
        starts = np.r_[0, ends[:-1] + 1]
        solid = np.flatnonzero(~((codes < 256) & SPACE[np.minimum(codes, 255)]))
        after = np.searchsorted(solid, starts, "left")
        before = np.searchsorted(solid, ends, "left") - 1
        some = after <= before
        self.starts = np.where(some, solid[np.minimum(after, max(len(solid) - 1, 0))] if len(solid) else 0, starts)
        self.ends = np.where(some, solid[np.maximum(before, 0)] + 1 if len(solid) else 0, self.starts)
        self.counts = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
        up, self.down = powers(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64)) * up[: len(codes)], out=self.sums[1:])
        self.lengths = self.ends - self.starts
        # the hash of a whole line is no polynomial of its characters, which long lines could share by their make
        whole = (xxhash.xxh3_64_intdigest(line.strip(BLANKS).encode("utf-8", "replace"), SEED) for line in joined.split("\n"))
        if keyed or (self.lengths < WIDTH).any():  # a short line is one shingle, its key
            self.keys = np.fromiter(whole, np.uint64, len(starts)).view(np.int64)
        self.counted = self.lengths >= max(min_chars, 1)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of these lines, one after another, and how many each has."""
        counts = np.maximum(self.lengths[which] - WIDTH + 1, 1)
        begins = np.r_[0, np.cumsum(counts)[:-1]]
        at = np.repeat(self.starts[which] - begins, counts) + np.arange(counts.sum())
        ends = np.minimum(at + WIDTH, len(self.sums) - 1)
        items = mixed((self.sums[ends] - self.sums[at]) * self.down[at])
        short = self.lengths[which] < WIDTH
        if short.any():
            items[begins[short]] = self.keys[which[short]].view(np.uint64)
        return items, counts


def band_keys(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    small = (items >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(np.r_[0, counts[:-1]])
    keys = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        folded = np.full(len(counts), band, np.uint64)
        for k in range(PERMUTATIONS_PER_BAND):
            values = small * MULTIPLIERS[band * PERMUTATIONS_PER_BAND + k]
            folded += np.minimum.reduceat(values, starts) * FACTORS[2 * k]
            folded += np.maximum.reduceat(values, starts) * FACTORS[2 * k + 1]
        keys[:, band] = mixed(folded)
    return keys.view(np.int64)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    at, size, group = 0, 0, []
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t or "") + 1
        if size >= GROUP_CHARS:
            yield at, group
            at, size, group = i + 1, 0, []
    if group:
        yield at, group


def _first_seen(lines: Lines, seen: set[int]) -> np.ndarray:
    """Lines to sketch, one for each key that is new in the batch; ``seen``, all keys of the batch so far, gets them."""
    which = np.flatnonzero(lines.counted & (lines.lengths >= WIDTH))  # shorter ones meet by their keys alone
    new = [not (k in seen or seen.add(k)) for k in lines.keys[which].tolist()]
    return which[np.array(new, bool)]


def _sketch(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for at, group in _groups(batch.column(2).to_pylist()):
                lines = Lines(group, min_chars)
                offsets = np.cumsum(np.r_[0, lines.counts]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines.keys, mask=~lines.counted))
                n = len(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + n], batch.column(1)[at : at + n], keys, *(pa.nulls(n, t) for t in LINES.types[3:])], schema=LINES
                )
                chosen = _first_seen(lines, seen)
                for low in range(0, len(chosen), 2_000):
                    part = chosen[low : low + 2_000]
                    bands = band_keys(*lines.shingles(part))
                    spans = pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS)
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            none,
                            none,
                            pa.nulls(len(part), pa.list_(pa.int64())),
                            pa.array(lines.keys[part]),
                            pa.ListArray.from_arrays(spans, pa.array(bands.reshape(-1))),
                        ],
                        schema=LINES,
                    )

    return run


def line_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of whole lines, one line after another, repeats included, and how many each has."""
    items, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, group in _groups(texts.to_pylist()):
        found = Lines(group, keyed=False).shingles(np.arange(len(group)))
        items.append(found[0])
        counts.append(found[1])
    return np.concatenate(items), np.concatenate(counts)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, dropped (numbers of lines, from 0), for documents that lose lines."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = materialize(texts.mapInArrow(returning(_sketch(min_chars)), LINES_DDL), "lines")
    places = rows.filter("keys is not null").select("doc_id", "text_hash", F.posexplode("keys").alias("line", "node")).filter("node is not null")

    def sets_of(ids: DataFrame) -> DataFrame:
        place = F.struct("doc_id", "text_hash", "line")
        first = places.join(ids, "node", "left_semi").groupBy("node").agg(F.min(place).alias("at"))
        asked = first.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.text_hash").alias("_hash")).agg(F.collect_list(F.struct("at.line", "node")).alias("asked"))
        found = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
        lines = found.select(F.split("text", "\n", -1).alias("lines"), F.inline("asked"))
        return lines.select("node", F.btrim(F.get("lines", F.col("line")), F.lit(" \t\n\x0b\x0c\r")).alias("items")).dropDuplicates(["node"])

    keyed = rows.filter("node is not null").select("node", F.explode("bands").alias("key"))
    _, roots = spanning_links(keyed, sets_of, PERCENT, to_sets=line_sets)
    group = F.coalesce("root", "node").alias("group")
    stands = places.join(roots, "node", "left").select(group, "doc_id", "text_hash", "line")
    place = F.struct("doc_id", "text_hash", "line")
    firsts = stands.groupBy("group").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = stands.join(firsts.select("group", "first"), "group").filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("dropped"))


def dedup_lines(docs: DataFrame, counts: bool = False, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text of the lines that stay; with ``counts`` also n_lines and n_dropped.

    ``n_chars``, if present, follows the text.
    """
    names = [f"`{c}`" for c in docs.columns]
    gone = materialize(dropped_lines(docs, min_chars), "dropped").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("dropped").alias("_dropped"))
    known = docs.withColumn("_key", F.xxhash64("text"))
    joined = known.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_dropped")
    # the lines are bound by an outer lambda, or each line that stays would split the text again
    left = F.get(F.transform(F.array(lines), lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n")), 0)
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(left)
    out = joined.withColumn("_n", F.coalesce(F.size(lines), F.lit(0))).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    more = [F.col("_n").cast("long").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*names, *more)
