"""Verified links between similar sets, from bands to spanning links.

Nodes that share a band key form a bucket.  Each member is first paired with
the smallest node of its bucket; distinct pairs are verified on full sets and
joined to components.  What is left are buckets whose members lie in different
components: the pairs of small ones are listed, each pair once, where sets have a
short form; others are cut into blocks, each pair of blocks is a task of bounded size, and inside it members of different components are compared on full sets
until all are compared or joined, but for pairs that share none of the rare
items of which similar sets share one.  So every pair that shares a bucket is
either joined by links, compared or known to be unlike, while a bucket of n members gives some n links,
not n * n pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from loadcast.llm.batches import returning, slices
from loadcast.llm.components import components
from loadcast.sources.scratch import materialize

# Workers get this module's functions with the task, wherever the package lives.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# items of all sets, one set after another, repeats allowed, and how many each has
ToSets = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

PAIRED_MEMBERS = 32  # of a bucket whose pairs are listed, so that a pair of many buckets is compared once
BLOCK_MEMBERS = 512
BLOCK_SIGNATURES = 1024
DEVIATIONS = 6
BLOCK_ITEMS = 2_000_000
PAIRS_BYTES = 1 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def similar(sets: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of sets, given by their numbers, reach the similarity."""
    items, counts = sets[0].view(np.uint64), sets[1]
    begins, both = np.cumsum(counts) - counts, counts[x] + counts[y]
    # different slots taken are items of the union at least; what is left of all items bounds the shared ones
    slots = 1 << np.ceil(np.log2(8 * np.maximum(both, 1))).astype(np.int64)
    taken = np.zeros(slots.sum(), bool)
    for side in (x, y):
        at = items[_ranges(begins[side], counts[side])]
        at &= np.repeat((slots - 1).astype(np.uint64), counts[side])
        taken[at.view(np.int64) + np.repeat(np.cumsum(slots) - slots, counts[side])] = True
    eights = np.bitwise_count(taken.view(np.uint64))
    union = np.add.reduceat(eights, (np.cumsum(slots) - slots) // 8, dtype=np.int64) if len(slots) else slots
    hit = 100 * (both - union) >= percent * union
    x, y = x[hit], y[hit]
    if both[hit].sum():
        # each pair shifts its items by a number of its own, so that one sort brings together those of all pairs
        pair = np.concatenate([np.repeat(np.arange(len(x)), counts[side]) for side in (x, y)])
        shifted = items[np.concatenate([_ranges(begins[side], counts[side]) for side in (x, y)])] + pair.astype(np.uint64) * SPREAD
        order = np.argsort(shifted)
        ranked, second = shifted[order], order >= counts[x].sum()
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        ones, sizes = np.diff(np.r_[0, np.cumsum(second)][np.r_[starts, len(ranked)]]), np.diff(np.r_[starts, len(ranked)])
        shared = (ones > 0) & (ones < sizes)
        pair = pair[order[starts]]
        hit[hit] = 100 * np.bincount(pair[shared], minlength=len(x)) >= percent * np.bincount(pair, minlength=len(x))
    return hit


def verified(pairs: DataFrame, sets: DataFrame, percent: int, to_sets: ToSets | None = None) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    first = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    if to_sets:
        joined = pairs.join(second, "b").join(first, "a").select("a", "b", "items_a", "items_b")
        return joined.mapInArrow(returning(_reaching(percent, to_sets)), "a long, b long")
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("both")
    joined = pairs.join(second, "b").join(first, "a").withColumn("both", both)
    return joined.filter(F.col("both") * 100 >= union * percent).select("a", "b")


def _reaching(percent: int, to_sets: ToSets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for part in _parts(batch):
                n, texts = part.num_rows, pa.concat_arrays(part.columns[2:]).dictionary_encode()  # each text is cut once
                which = texts.indices.to_numpy()
                hit = pa.array(similar(to_sets(texts.dictionary), which[:n], which[n:], percent))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(hit), part.column(1).filter(hit)], names=["a", "b"])

    return run


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``PAIRS_BYTES`` of sets, or single rows."""
    sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
    part = np.cumsum(sizes) // PAIRS_BYTES
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for low, high in zip(bounds, bounds[1:]):
        yield batch.slice(low, high - low)


def spanning_links(
    keyed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, signatures: DataFrame | None = None, to_sets: ToSets | None = None
) -> tuple[DataFrame, DataFrame]:
    """(links, components) over nodes.

    keyed: (node, key), repeated rows allowed.  sets_of: sets as (node,
    items array<long>, no repeats inside) of the nodes in a frame.  signatures:
    (node, signature), repeated rows allowed, a byte per minimum or maximum; with them only members are
    compared on full sets that come near another component by their signature,
    ``DEVIATIONS`` standard errors below the wanted similarity or better.
    to_sets: makes sets of what sets_of gives as items, where that is not
    the sets but a shorter form, the text.
    """
    # one pass over the sorted keys: a member is paired with the first node of its bucket
    dealt = keyed.select("node", "key").repartition("key").sortWithinPartitions("key", "node")
    starred = materialize(dealt.mapInArrow(returning(_stars), "node long, key long, pivot long"), "buckets")
    pairs = materialize(starred.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(sets_of(needed), "sets")
    links = materialize(verified(pairs, sets, percent, to_sets).distinct(), "links")
    roots = materialize(components(links), "components")

    members = starred.select("key", F.explode(F.array("pivot", "node")).alias("node")).distinct()
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    rest = materialize(placed.join(mixed.select("key"), "key"), "rest")
    if signatures is not None:
        asked = signatures.join(rest.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        near = _blocks(rest.join(asked, "node"), "signature", BLOCK_SIGNATURES).applyInArrow(_near(percent), "key long, node long")
        rest = materialize(rest.join(near.distinct(), ["key", "node"]), "rest")
    rest = materialize(_unlike(rest), "rest")
    if to_sets:  # short forms may be sent once for each pair
        crossing = materialize(_crossing(rest, PAIRED_MEMBERS).join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(materialize(verified(crossing, sets, percent, to_sets), "links"))
        rest = materialize(_sized(rest).filter(F.col("n") > PAIRED_MEMBERS).drop("n"), "rest")
    if not rest.isEmpty():
        compared = _blocks(rest.join(sets, "node"), "items", BLOCK_MEMBERS).applyInArrow(_compare(percent, to_sets), "a long, b long")
        links = links.unionByName(materialize(compared, "links"))
    elif not to_sets:
        return links, roots
    links = links.distinct()
    return links, materialize(components(links), "components")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, key) sorted by key and node, the members of each bucket but its first, each once, with the first as pivot."""
    last = np.zeros((0, 3), np.int64)  # node, key, pivot of the row before
    for batch in batches:
        node, key = (batch.column(c).to_numpy() for c in (0, 1))
        if not len(node):
            continue
        nodes, keys = np.r_[last[:, 0], node], np.r_[last[:, 1], key]
        begins = np.r_[True, keys[1:] != keys[:-1]]
        pivots = nodes[np.maximum.accumulate(np.where(begins, np.arange(len(nodes)), 0))]
        if len(last):
            pivots[keys == last[0, 1]] = last[0, 2]  # its bucket goes on; others never hold that key
        new = ~begins & np.r_[False, nodes[1:] != nodes[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(x[new]) for x in (nodes, keys, pivots)], names=["node", "key", "pivot"])
        last = np.array([[nodes[-1], keys[-1], pivots[-1]]])


def _sized(rest: DataFrame) -> DataFrame:
    """Members with the number n of members of their bucket."""
    return rest.join(rest.groupBy("key").agg(F.count("*").alias("n")), "key")


def _crossing(rest: DataFrame, most: int) -> DataFrame:
    """Distinct pairs (a, b) of different components from buckets of at most ``most`` members."""
    few = _sized(rest).filter(F.col("n") <= most)
    first = few.select("key", F.col("node").alias("a"), F.col("root").alias("root_a"))
    second = few.select("key", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return first.join(second, "key").filter("a < b and root_a <> root_b").select("a", "b").distinct()


def _unlike(rest: DataFrame) -> DataFrame:
    """One of the buckets that hold the same members: similar sets meet in many bands, and need one comparison."""
    members = rest.groupBy("key").agg(
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"), F.min("node").alias("low")
    )
    return rest.join(members.groupBy("x", "y", "n", "low").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _blocks(sized: DataFrame, content: str, block: int) -> GroupedData:
    """Members with their content, once for each pair of blocks they belong to, grouped by pair.

    The pairs of one bucket are dealt anew: without that they would stay together, as the bucket's key deals them.
    """
    kind = dict(sized.dtypes)[content]
    items = F.size(content) if kind.startswith("array") else F.length(content) if kind == "string" else F.lit(1)
    weight = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(items) / BLOCK_ITEMS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    return (
        sized.join(weight, "key")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root", "own", content)
        .repartition("key", "i", "j")
        .groupBy("key", "i", "j")
    )


def _near(percent: int) -> Callable[[pa.Table], pa.Table]:
    def members(table: pa.Table) -> pa.Table:
        key, nodes, roots, own = (table.column(c).to_numpy() for c in ("key", "node", "root", "own"))
        signs = np.stack([np.frombuffer(s, np.uint8) for s in table.column("signature").to_pylist()])
        share = percent / 100
        least = share - DEVIATIONS * np.sqrt(share * (1 - share) / signs.shape[1])
        needed = signs.shape[1] * least  # chance agreement of bytes only adds candidates
        crossing = len(set(own.tolist())) > 1
        hit = np.zeros(len(nodes), bool)
        for p in range(len(nodes)):
            other = roots[p + 1 :] != roots[p]
            if crossing:
                other &= own[p + 1 :] != own[p]
            q = np.flatnonzero(other) + p + 1
            q = q[(signs[q] == signs[p]).sum(1) >= needed]
            hit[q] = True
            hit[p] |= len(q) > 0
        return pa.table({"key": key[hit], "node": nodes[hit]})

    return members


def _compare(percent: int, to_sets: ToSets | None) -> Callable[[pa.Table], pa.Table]:
    def links(table: pa.Table) -> pa.Table:
        nodes, roots, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
        items = table.column("items").combine_chunks()
        if to_sets:
            values, counts = to_sets(items)
        else:
            values, counts = items.flatten().to_numpy(), np.diff(np.asarray(items.offsets))
        n = len(nodes)
        order = np.argsort(values, kind="stable")
        owner, ranked = np.repeat(np.arange(n), counts)[order], values[order]
        other = np.r_[True, ranked[1:] != ranked[:-1]]
        distinct = other | np.r_[True, owner[1:] != owner[:-1]]
        owner, ids = owner[distinct], (np.cumsum(other) - 1)[distinct]
        sizes, held = np.bincount(owner, minlength=n), np.bincount(ids)
        kinds = len(held)
        rarity = np.empty(kinds, np.int64)
        rarity[np.argsort(held, kind="stable")] = np.arange(kinds)
        # each set's items from the rarest on; similar sets share one of the first that neither can miss
        items = np.sort(owner * kinds + rarity[ids]) - np.repeat(np.arange(n) * kinds, sizes)
        first = sizes - np.maximum(-(-percent * sizes // 100), 1) + 1
        offsets = np.cumsum(sizes) - sizes
        leading = np.arange(len(items)) - np.repeat(offsets, sizes) < np.repeat(first, sizes)
        order = np.argsort(items[leading], kind="stable")
        holders = np.repeat(np.arange(n), first)[order]
        holders_from = np.searchsorted(items[leading][order], np.arange(kinds + 1))

        roots, crossing = roots.copy(), len(set(own.tolist())) > 1
        mine, out = np.zeros(kinds, np.int8), []
        for p in range(n):
            leads = items[offsets[p] : offsets[p] + first[p]]
            met = np.zeros(n, bool)
            met[holders[_ranges(holders_from[leads], holders_from[leads + 1] - holders_from[leads])]] = True
            met[: p + 1] = False
            met &= roots != roots[p]
            if crossing:
                met &= own != own[p]
            met &= (100 * sizes >= percent * sizes[p]) & (100 * sizes[p] >= percent * sizes)
            q = np.flatnonzero(met)
            if not len(q):
                continue
            mine[items[offsets[p] : offsets[p] + sizes[p]]] = 1
            both = np.add.reduceat(mine[items[_ranges(offsets[q], sizes[q])]], np.cumsum(sizes[q]) - sizes[q], dtype=np.int64)
            mine[items[offsets[p] : offsets[p] + sizes[p]]] = 0
            for q in q[100 * both >= percent * (sizes[p] + sizes[q] - both)]:
                if roots[p] != roots[q]:
                    out.append((min(nodes[p], nodes[q]), max(nodes[p], nodes[q])))
                    roots[roots == max(roots[p], roots[q])] = min(roots[p], roots[q])
        low, high = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

    return links


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
