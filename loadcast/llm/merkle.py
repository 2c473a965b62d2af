"""Merkle manifest of a dataset: proofs for every row from trees whose parents keep hash states.

A group's nodes, in order, are cut into chunks of ``FANOUT ** HEIGHT``.  A task
builds the tree of one chunk.  Each parent copies its SHA-256 state before it
takes in a child, so that a child can be replaced by resuming the copy with the
replacement and the siblings to its right; what stands left of it is not hashed
again.  The tops of the chunks are the nodes of the next, much smaller, tree.
Once that is built, its proofs come back to the chunks, one row a chunk, and
every leaf gets its whole proof, and its root folded from a replacement, in one
pass.  A group with all rows is as many chunks as its size asks for.

Places in a group are counted from a range-partitioned sort: rows per partition
and group, summed over partitions.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.sources.scratch import materialize

# Workers get this module's functions with the task, wherever the package lives.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 2
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Level = tuple[list[str], list[str]]  # siblings to the left and to the right
PROOF = "array<struct<left: array<string>, right: array<string>>>"


def manifest(docs: DataFrame, replacement: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """(doc_id, lang, position, leaf, subroot, root, proof, replacement, folded_root, verified) per row of documents.

    Leaves are hashes of doc_id, source, lang, n_chars and text.  Per lang they
    stand by doc_id (nulls first, equal ids by leaf); every ``fanout`` nodes in a
    row, the last ones fewer, become the hash of their digests, until one is
    left, the subroot.  Subroots by lang (null first, bytewise) give the root
    likewise.

    proof: an array of (left, right), the siblings of each level from the leaf to
    the root.  replacement: a leaf to test in the leaf's place, the leaf itself
    where it is null or not given; folded_root is the root that follows from it,
    and verified tells whether that is the root.  A null field differs from an
    empty one; repeated rows are leaves of their own.  Further columns are
    ignored.  An empty table gives an empty manifest.
    """
    tested = F.lit(None).cast("string") if replacement is None else replacement
    leaves = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf_hash().alias("node"), tested.alias("replacement"))
    leaves = _chunked(positions(materialize(leaves, "leaves"), "tree", ["doc_id", "node", "replacement"]), fanout, height)
    within = materialize(_proofs(_tops(leaves, fanout, height), fanout, height), "subtrees")
    subroots = within.select(F.lit(0).alias("all"), "tree", F.col("top").alias("node")).distinct()
    subroots = materialize(positions(subroots, "all", ["tree"]), "subroots")
    across = _proofs(subroots.withColumn("of", F.col("tree")).withColumn("tree", F.lit("")), fanout, height)
    across = across.join(subroots.withColumnRenamed("tree", "of"), "position").select(F.col("of").alias("tree"), F.col("proof").alias("onward"), F.col("top").alias("root"))
    paths = within.join(across, "tree").select(
        "tree", F.col("position").alias("chunk"), F.concat("proof", "onward").alias("proof"), F.col("top").alias("subroot"), "root"
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, tree string, position long, leaf string, subroot string, root string, proof {PROOF}, replacement string, folded_root string"
    pairs = leaves.groupBy("tree", "chunk").cogroup(paths.groupBy("tree", "chunk"))
    told = pairs.applyInArrow(_folding(fanout, height), schema).withColumn("verified", F.col("folded_root") == F.col("root"))
    return told.withColumn("tree", F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))).withColumnRenamed("tree", "lang")


def leaf_hash(**other: Column) -> Column:
    """SHA-256 of a document's fields, ``other`` in place of some of them; each has its length before it, a null is ``-``."""
    parts = []
    for name in FIELDS:
        value = other.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof of ``manifest`` give, for a reader who has no tree."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(F.array_join(level["left"], ""), node, F.array_join(level["right"], "")), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof from the leaf to the root, each level left to right, as one text."""
    return F.array_join(F.transform(proof, lambda level: F.concat(F.array_join(level["left"], ""), F.array_join(level["right"], ""))), "")


def tampering() -> Column:
    """The leaf of a document whose n_chars was raised by one, where 7 divides the CRC-32 of its id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, leaf_hash(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest under tampering, proofs as digests."""
    proof = F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256")
    return manifest(docs, tampering()).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, their place in the group from 0, and ``size``, that of the group."""
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    written = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    written = written.withColumn("slice", F.shiftright("at", 33))
    in_group = Window.partitionBy(group)
    before = F.sum("n").over(in_group.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counted = written.groupBy(group, "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    offsets = counted.select(group, "slice", "first", before.alias("before"), F.sum("n").over(in_group).alias("size"))
    placed = written.join(offsets, [group, "slice"])
    return placed.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("position"), "size")


def _chunked(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("position") / F.lit(fanout**height)))


def _tops(chunked: DataFrame, fanout: int, height: int) -> DataFrame:
    """The tops of the chunks, as nodes (tree, position, size, node)."""
    nodes = chunked.select("tree", "chunk", "position", "size", "node")
    return materialize(nodes.groupBy("tree", "chunk").applyInArrow(_top(fanout, height), "tree string, position long, size long, node string"), "tops")


def _proofs(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """(tree, position, proof, top) of nodes (tree, position, size, node), over as many rounds of chunks as the largest tree needs."""
    if nodes.filter(F.col("size") > 1).isEmpty():
        return nodes.select("tree", "position", F.array().cast(PROOF).alias("proof"), F.col("node").alias("top"))
    chunked = _chunked(nodes, fanout, height)
    above = _proofs(_tops(chunked, fanout, height), fanout, height).withColumnRenamed("position", "chunk")
    pairs = chunked.groupBy("tree", "chunk").cogroup(above.groupBy("tree", "chunk"))
    return pairs.applyInArrow(_proving(fanout, height), f"tree string, position long, proof {PROOF}, top string")


class Chunk:
    """The lowest ``height`` levels above some nodes of a tree of ``size``, or all its levels if there are fewer."""

    def __init__(self, nodes: list[str], size: int, fanout: int, height: int):
        self.fanout, self.rows, self.states = fanout, [nodes], []
        for _ in range(height):
            if size <= 1:
                break
            parents, kept = [], []
            for at in range(0, len(nodes), fanout):
                state, copies = hashlib.sha256(), []
                for child in nodes[at : at + fanout]:
                    copies.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
                kept.append(copies)
            self.rows.append(parents)
            self.states.append(kept)
            nodes, size = parents, -(-size // fanout)
        self.top = nodes[0]

    def proof(self, place: int) -> list[Level]:
        out = []
        for row in self.rows[:-1]:
            start = place - place % self.fanout
            out.append((row[start:place], row[place + 1 : start + self.fanout]))
            place //= self.fanout
        return out

    def fold(self, place: int, node: str, proof: list[Level]) -> str:
        """The top with ``node`` at ``place``, by the states kept before it and what stands right of it."""
        for kept, (_, right) in zip(self.states, proof):
            parent, slot = divmod(place, self.fanout)
            state = kept[parent][slot].copy()
            state.update("".join((node, *right)).encode())
            node, place = state.hexdigest(), parent
        return node


def _chunk_of(table: pa.Table, fanout: int, height: int) -> tuple[pa.Table, int, Chunk]:
    """The chunk's rows in order, the first position, and their tree."""
    table = table.sort_by("position")
    nodes, first = table.column("node").to_pylist(), table.column("position")[0].as_py()
    return table, first, Chunk(nodes, table.column("size")[0].as_py(), fanout, height)


def _top(fanout: int, height: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table, first, chunk = _chunk_of(table, fanout, height)
        size = -(-table.column("size")[0].as_py() // fanout**height)
        return pa.table({"tree": table.column("tree").slice(0, 1), "position": pa.array([first // fanout**height]), "size": pa.array([size]), "node": [chunk.top]})

    return run


def _levels(path: pa.Table) -> list[Level]:
    return [(level["left"], level["right"]) for level in path.column("proof")[0].as_py()]


def _proof_array(proofs: Iterable[list[Level]]) -> pa.ListArray:
    ends, sides = [0], {"left": ([], [0]), "right": ([], [0])}
    for proof in proofs:
        for level in proof:
            for (values, offsets), digests in zip(sides.values(), level):
                values += digests
                offsets.append(len(values))
        ends.append(ends[-1] + len(proof))
    lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.string())) for v, o in sides.values()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(lists, list(sides)))


def _proving(fanout: int, height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, path: pa.Table) -> pa.Table:
        table, _, chunk = _chunk_of(table, fanout, height)
        above = _levels(path)
        proofs = _proof_array(chunk.proof(place) + above for place in range(table.num_rows))
        top = path.column("top")[0].as_py()
        return pa.table({"tree": table.column("tree"), "position": table.column("position"), "proof": proofs, "top": pa.array([top] * table.num_rows, pa.string())})

    return run


def _folding(fanout: int, height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(table: pa.Table, path: pa.Table) -> pa.Table:
        table, _, chunk = _chunk_of(table, fanout, height)
        above = _levels(path)
        states = [hashlib.sha256("".join(left).encode()) for left, _ in above]
        leaves, tested = table.column("node").to_pylist(), table.column("replacement").to_pylist()
        proofs, roots = [], []
        for place, (leaf, other) in enumerate(zip(leaves, tested)):
            proof = chunk.proof(place)
            node = chunk.fold(place, leaf if other is None else other, proof)
            for kept, (_, right) in zip(states, above):
                state = kept.copy()
                state.update("".join((node, *right)).encode())
                node = state.hexdigest()
            proofs.append(proof + above)
            roots.append(node)
        same = {c: pa.array([path.column(c)[0].as_py()] * table.num_rows, pa.string()) for c in ("subroot", "root")}
        columns = {"doc_id": table.column("doc_id"), "tree": table.column("tree"), "position": table.column("position"), "leaf": table.column("node")}
        return pa.table({**columns, **same, "proof": _proof_array(proofs), "replacement": table.column("replacement"), "folded_root": pa.array(roots, pa.string())})

    return run
