"""Embedding near-duplicates: int8 tile products with error bounds, full precision where these leave doubt.

Equal vectors of a label fold into one node.  Nodes are dealt to tiles of some
``TILE_ROWS`` rows, those with the same largest component together.  A tile is
one row: vectors of unit length rounded to int8, a scale and a bound on the
rounding error per vector, a ball around all of them, and the vectors in full
precision in a column of their own.  Two tiles meet unless their balls are too far apart.
Products of int8 tiles are exact, so each pair of vectors has rigorous bounds
below and above its cosine: it is a link, no link, or unsure.  Only tile pairs
with unsure vectors read that column, and only these pairs are computed in double
precision.

A tile pair gives sums of links per vector and one edge per joined vector, not
its links one by one; a group of n near copies so gives some n * n / TILE_ROWS
rows.  No task holds more than two tiles.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.llm.components import components
from loadcast.sources.scratch import materialize

# Workers get this module's functions with the task, wherever the package lives.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_ROWS = 1024
# Sums of products of int8 are exact in single precision up to this many.
EXACT_DIMS = 1024
# Copies of one vector are counted and joined back in so many parts.
SALTS = 64
# Room for the rounding of double precision sums of unit vectors.
ROUNDING = 1e-9
BLOCK_ROWS = 256
RECOMPUTED = 8192

FOUND = "nodes array<long>, counts array<long>, low array<long>, high array<long>"


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null, their vectors
    have the same length and a cosine of ``threshold`` or more.  Rows without a
    label, and vectors that are null, empty, zero or hold null or non-finite
    components, have no links and form a component of their own.  Repeated rows
    are rows of their own, linked with each other; a repeated vec_id gives a row
    for each.  A null vec_id never names a component that holds another; a
    component of null ids has a null component_id, and its rows are kept.
    Further columns are ignored.  An empty table gives an empty one.
    """
    rows = rows.select("vec_id", "embedding", "label")
    salted = rows.filter(_usable()).withColumn("salt", _salt())
    parts = materialize(salted.groupBy("label", "embedding", "salt").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")), "copies")
    folded = parts.groupBy("label", "embedding").agg(F.sum("copies").alias("copies"), F.min("first").alias("first"))
    vectors = materialize(folded.withColumn("node", F.monotonically_increasing_id()), "vectors")
    tiles = tiles_of(vectors)
    counts, edges = tile_links(tiles, threshold)
    roots = components(edges)

    joined = vectors.join(roots, "node", "left").join(counts, "node", "left")
    joined = joined.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1)
    joined = materialize(joined.select("label", "embedding", "root", "first", "n_links"), "linked")
    names = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    known = joined.join(names, "root").select("label", "embedding", "n_links", "component_id")
    known = parts.select("label", "embedding", "salt").join(known, ["label", "embedding"])

    usable = F.coalesce(_usable(), F.lit(False))
    keyed = rows.withColumn("salt", F.when(usable, _salt()))
    told = keyed.join(known.withColumn("linked", F.lit(True)), ["label", "embedding", "salt"], "left")
    return told.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _usable() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)


def _salt() -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")


def tiles_of(vectors: DataFrame) -> DataFrame:
    """One row per tile of (label, embedding, copies, node): quantised and full vectors, error bounds, a ball.

    A cell holds the vectors of a label whose largest component is the same, sign
    included.  Cells lie one after the other, and a vector's place in its cell is
    drawn by hash, so tiles fill evenly without a sort or a running number.
    """
    largest = F.array_max(F.transform("embedding", F.abs))
    placed = (
        vectors.withColumn("dims", F.size("embedding"))
        .withColumn("at", F.array_position(F.transform("embedding", F.abs), largest).cast("int"))
        .withColumn("cell", F.col("at") * F.when(F.element_at("embedding", F.col("at")) < 0, -1).otherwise(1))
        .drop("at")
    )
    per_label = Window.partitionBy("label", "dims")
    cells = placed.groupBy("label", "dims", "cell").agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(per_label.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    cells = cells.withColumn("tiles", F.ceil(F.sum("n").over(per_label) / TILE_ROWS).cast("int"))
    drawn = F.shiftrightunsigned(F.xxhash64("node"), 11) * (2.0**-53)
    dealt = placed.join(cells, ["label", "dims", "cell"]).withColumn("tile", F.floor((F.col("before") + drawn * F.col("n")) / TILE_ROWS).cast("int"))
    kind = vectors.schema["label"].dataType.simpleString()
    schema = (
        f"label {kind}, dims int, tile int, tiles int, nodes binary, copies binary, quantised binary, scales binary, errors binary, "
        "centre array<double>, radius double, full binary"
    )
    packed = dealt.select("label", "dims", "tile", "tiles", "node", "copies", "embedding").groupBy("label", "dims", "tile").applyInArrow(_pack, schema)
    return materialize(packed, "tiles")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and bounds on the length of what rounding leaves, of rows of unit length."""
    scales = np.abs(x).max(1) / 127
    q = np.rint(x / scales[:, None]).astype(np.int8)
    left = x - q * scales[:, None]
    return q, scales, np.sqrt((left * left).sum(1)) * (1 + ROUNDING) + ROUNDING


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1))[:, None]


def _pack(table: pa.Table) -> pa.Table:
    dims = table.column("dims")[0].as_py()
    x = table.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dims)
    u = unit(x)
    q, scales, errors = quantise(u)
    mean = u.mean(0)
    length = np.sqrt(mean @ mean)
    centre = mean / length if length > 1e-6 else u[0]
    radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
    one = {c: table.column(c).slice(0, 1) for c in ("label", "dims", "tile", "tiles")}
    blobs = {
        "nodes": table.column("node").to_numpy().astype(np.int64),
        "copies": table.column("copies").to_numpy().astype(np.int64),
        "quantised": q,
        "scales": scales,
        "errors": errors,
    }
    row = {**one, **{c: pa.array([v.tobytes()], pa.binary()) for c, v in blobs.items()}}
    row["centre"], row["radius"] = pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])
    row["full"] = pa.array([u.tobytes()], pa.binary())
    return pa.table(row)


def tile_links(tiles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((node, n_links), (a, b)): links per node, copies of the other node counted, and edges that join what links join."""
    key = ["label", "dims"]
    first = tiles.select(*key, F.col("tile").alias("i"), "tiles", F.col("centre").alias("centre_i"), F.col("radius").alias("radius_i"))
    second = tiles.select(*key, F.col("tile").alias("j"), F.col("centre").alias("centre_j"), F.col("radius").alias("radius_j"))
    across = F.aggregate(F.zip_with("centre_i", "centre_j", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), across)))
    near = angle - F.col("radius_i") - F.col("radius_j") <= float(np.arccos(threshold)) + 1e-6
    pairs = first.withColumn("j", F.explode(F.sequence("i", F.col("tiles") - 1))).join(second, [*key, "j"]).filter(near).select(*key, "i", "j")
    kind = tiles.schema["label"].dataType.simpleString()

    held = _members(pairs, tiles, ["nodes", "copies", "quantised", "scales", "errors"])
    schema = f"label {kind}, dims int, i int, j int, {FOUND}, unsure_p binary, unsure_q binary"
    sure = materialize(held.groupBy(*key, "i", "j").applyInArrow(_bounded(threshold), schema), "sure")
    unsure = sure.filter(F.length("unsure_p") > 0).select(*key, "i", "j", "unsure_p", "unsure_q")
    held = _members(unsure, tiles, ["nodes", "copies", "full"])
    exact = held.groupBy(*key, "i", "j").applyInArrow(_exact(threshold), FOUND)
    found = materialize(sure.select("nodes", "counts", "low", "high").unionByName(exact), "found")
    counts = found.select(F.explode(F.arrays_zip("nodes", "counts")).alias("x")).groupBy(F.col("x.nodes").alias("node")).agg(F.sum("x.counts").alias("n_links"))
    edges = found.select(F.explode(F.arrays_zip("low", "high")).alias("x")).select(F.col("x.low").alias("a"), F.col("x.high").alias("b"))
    return counts, edges


def _members(pairs: DataFrame, tiles: DataFrame, columns: list[str]) -> DataFrame:
    """The tiles of each pair, one row each (one in all for a tile with itself)."""
    ends = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("i", "j"))))
    return ends.join(tiles.select("label", "dims", "tile", *columns), ["label", "dims", "tile"])


class _Side:
    def __init__(self, row: dict, dims: int):
        self.nodes, self.copies = (np.frombuffer(row[c], np.int64) for c in ("nodes", "copies"))
        if "quantised" in row:
            self.q = np.frombuffer(row["quantised"], np.int8).reshape(-1, dims).astype(np.float32)
            self.scales, self.errors = (np.frombuffer(row[c], float) for c in ("scales", "errors"))
            self.lengths = self.scales * np.sqrt((self.q.astype(float) ** 2).sum(1)) * (1 + ROUNDING)
        else:
            self.x = np.frombuffer(row["full"], float).reshape(-1, dims)


def _sides(table: pa.Table) -> tuple[dict, _Side, _Side]:
    rows = sorted(table.to_pylist(), key=lambda r: r["tile"])
    return rows[0], _Side(rows[0], rows[0]["dims"]), _Side(rows[-1], rows[0]["dims"])


def bounds(a: _Side, b: _Side, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the quantised vectors, and how far the true ones may lie from them.

    With x = x' + e and y = y' + f, where x' and y' are what int8 holds,
    |x.y - x'.y'| = |x.f + e.y'| <= |f| + |e| |y'|.
    """
    dims = a.q.shape[1]
    if dims <= EXACT_DIMS:
        products = (a.q[rows] @ b.q.T).astype(float)
    else:
        steps = range(0, dims, EXACT_DIMS)
        products = sum((a.q[rows, s : s + EXACT_DIMS] @ b.q[:, s : s + EXACT_DIMS].T).astype(float) for s in steps)
    near = products * a.scales[rows, None] * b.scales
    return near, b.errors + a.errors[rows, None] * b.lengths + ROUNDING


def _bounded(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        head, a, b = _sides(table)
        same = head["i"] == head["j"]
        linked = np.zeros((len(a.nodes), len(b.nodes)), bool)
        p, q = [], []
        for at in range(0, len(a.nodes), BLOCK_ROWS):
            rows = slice(at, at + BLOCK_ROWS)
            near, off = bounds(a, b, rows)
            linked[rows] = near - off >= threshold
            unsure = (near + off >= threshold) & ~linked[rows]
            if same:
                unsure = np.triu(unsure, at + 1)
            x, y = np.nonzero(unsure)
            p.append((x + at).astype(np.int32))
            q.append(y.astype(np.int32))
        if same:
            linked = np.triu(linked, 1)
            linked |= linked.T
        one = table.slice(0, 1).select(["label", "dims", "i", "j"])
        found = _found(a, b, linked, same)
        sure = {**{c: one.column(c) for c in one.column_names}, **found}
        sure["unsure_p"], sure["unsure_q"] = (pa.array([np.concatenate(s).tobytes()], pa.binary()) for s in (p, q))
        return pa.table(sure)

    return run


def _exact(threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        head, a, b = _sides(table)
        same = head["i"] == head["j"]
        p, q = (np.frombuffer(head[c], np.int32) for c in ("unsure_p", "unsure_q"))
        linked = np.zeros((len(a.nodes), len(b.nodes)), bool)
        for at in range(0, len(p), RECOMPUTED):
            x, y = p[at : at + RECOMPUTED], q[at : at + RECOMPUTED]
            linked[x, y] = (a.x[x] * b.x[y]).sum(1) >= threshold
        if same:
            linked |= linked.T
        return pa.table(_found(a, b, linked, same))

    return run


def _found(a: _Side, b: _Side, linked: np.ndarray, same: bool) -> dict[str, pa.Array]:
    """Links per node, and an edge from the smallest node of each joined group to every other."""
    counts = {}
    for side, other, links in ((a, b, linked), (b, a, linked.T))[: 1 if same else 2]:
        at = np.flatnonzero(links.any(1))
        sums = np.array([other.copies[links[p]].sum() for p in at], np.int64)
        counts.setdefault("nodes", []).append(side.nodes[at])
        counts.setdefault("counts", []).append(sums)
    low, high = [], []
    for group in _groups(a, b, linked):
        least = group.min()
        rest = group[group != least]
        low.append(np.full(len(rest), least))
        high.append(rest)
    lists = {**counts, "low": low, "high": high}
    return {c: pa.array([np.concatenate(v).tolist() if v else []], pa.list_(pa.int64())) for c, v in lists.items()}


def _groups(a: _Side, b: _Side, linked: np.ndarray) -> Iterator[np.ndarray]:
    """Nodes that links of the two tiles join, group by group."""
    todo = linked.any(1)
    while todo.any():
        rows = np.zeros(len(todo), bool)
        columns = np.zeros(linked.shape[1], bool)
        fresh = np.array([np.argmax(todo)])
        while len(fresh):
            rows[fresh] = True
            met = linked[fresh].any(0) & ~columns
            columns |= met
            fresh = np.flatnonzero(linked[:, met].any(1) & ~rows) if met.any() else fresh[:0]
        todo &= ~rows
        yield np.unique(np.concatenate([a.nodes[rows], b.nodes[columns]]))
