"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes is evaluated once and gives two values,
the smallest and the largest, so a signature of 2 P values costs P evaluations;
both agree between two sets with the sets' Jaccard similarity as probability,
and their errors partly cancel.  Bands of three permutations (six values) find
candidates, full shingle sets confirm them.

Documents with equal sets are one node, so thousands of exact copies cost one
group-by row.  Defined results: a document without words has an empty set and
links with nothing; rows that share an id are one document; a row with a null
id is reported and kept, but links with nothing; an empty table gives an empty
table; columns besides the id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.llm.batches import returning, slices
from loadcast.llm.links import spanning_links
from loadcast.llm.shingles import mixed, shingle_sets
from loadcast.sources.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS = 40
PERMUTATIONS_PER_BAND = 3
GROUP_ITEMS = 200_000

_RANDOM = np.random.default_rng(1729)
MULTIPLIERS = _RANDOM.integers(0, 1 << 62, BANDS * PERMUTATIONS_PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDS = _RANDOM.integers(0, 1 << 62, 2 * PERMUTATIONS_PER_BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_hash", pa.int64()),
        ("n_shingles", pa.int64()),
        ("set_a", pa.int64()),
        ("set_b", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        ("signature", pa.binary()),
    ]
)
SKETCH_DDL = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def band_keys(items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sets, bands) keys and (sets, 2 P) bytes of the values; ``starts``: where each non-empty set begins."""
    signs = np.empty((len(starts), 2 * len(MULTIPLIERS)), np.uint8)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        folded = np.full(len(starts), band, np.uint64)
        for k in range(PERMUTATIONS_PER_BAND):
            permutation = band * PERMUTATIONS_PER_BAND + k
            values = items * MULTIPLIERS[permutation]
            for side, value in enumerate((np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts))):
                folded += value * FOLDS[2 * k + side]
                signs[:, 2 * permutation + side] = mixed(value) & np.uint64(255)
        keys[:, band] = mixed(folded)
    return keys, signs


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes = batch.column(0), batch.column(1)
            group: list[np.ndarray] = []
            done = items = 0
            for u in shingle_sets(batch.column(2), width):
                group.append(u)
                items += len(u)
                if items >= GROUP_ITEMS:
                    yield _rows(ids, hashes, group, done)
                    done, group, items = done + len(group), [], 0
            if group:
                yield _rows(ids, hashes, group, done)

    return run


def _rows(ids: pa.Array, hashes: pa.Array, sets: list[np.ndarray], at: int) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    items = np.concatenate(sets) if len(full) else np.zeros(0, np.uint64)
    starts = np.cumsum(np.r_[0, sizes[full]])[:-1]
    digest = np.zeros((2, len(sets)), np.uint64)
    keys, signs = np.zeros((0, BANDS), np.uint64), np.zeros((0, 0), np.uint8)
    if len(full):
        digest[0, full] = np.add.reduceat(items, starts)
        digest[1, full] = np.add.reduceat(mixed(items), starts)
        keys, signs = band_keys(items, starts)
    offsets = np.zeros(len(sets) + 1, np.int32)
    offsets[1:] = np.cumsum(np.where(sizes > 0, BANDS, 0))
    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
    packed: list[bytes | None] = [None] * len(sets)
    for i, sign in zip(full.tolist(), signs):
        packed[i] = sign.tobytes()
    columns = [ids[at : at + len(sets)], hashes[at : at + len(sets)], sizes, digest[0].view(np.int64), digest[1].view(np.int64), bands, pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=SKETCH)


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1), width))
            offsets = np.cumsum(np.r_[0, [len(s) for s in sets]]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["node", "items"])

    return run


def decisions(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = materialize(texts.mapInArrow(returning(_sketches(width)), SKETCH_DDL), "sketches")
    equal = ["set_a", "set_b", "n_shingles"]
    sets = rows.filter("n_shingles > 0 and doc_id is not null")
    groups = materialize(sets.groupBy(*equal).agg(F.min("doc_id").alias("node")), "groups")
    nodes = materialize(groups.join(sets.select(*equal, "doc_id", "bands", "signature"), equal).filter("doc_id = node").select("node", "bands", "signature"), "nodes")

    def sets_of(ids: DataFrame) -> DataFrame:
        # the ids grow with the documents: they are shuffled at every size, not broadcast while they are few
        found = texts.select(F.col("doc_id").alias("node"), "text").join(ids.hint("merge"), "node", "left_semi")
        return found.mapInArrow(returning(_shingles(width)), "node long, items array<long>")

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    _, roots = spanning_links(keyed, sets_of, percent, nodes.select("node", "signature"))
    grouped = groups.join(roots, "node", "left").select(*equal, F.coalesce("root", "node").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    placed = rows.join(grouped, equal, "left").withColumn("component_id", component)
    return placed.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept."""
    return decisions(docs, width, percent).drop("text_hash")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with all columns; of repeated rows one stays."""
    kept = decisions(docs, width, percent).filter("kept and doc_id is not null")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    known = docs.filter("doc_id is not null").withColumn("_key", F.xxhash64("text"))
    chosen = known.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_key") == F.col("_hash")), "left_semi")
    single = chosen.dropDuplicates(["doc_id", "_key"]).drop("_key")
    return single.unionByName(docs.filter("doc_id is null"))
