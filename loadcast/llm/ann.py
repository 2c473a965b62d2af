"""Approximate nearest neighbours with balanced posting lists.

A bounded sample of the vectors is split again and again into few clusters until
each is small, which gives centroids of lists of similar length.  Centroids are
joined to a neighbour graph that every task holds in memory and searches by
beams.  A vector goes to each list whose centroid is at most ``REPLICATE`` times
as far as its nearest one, so vectors at a border stand in several lists; a
query reads the lists within ``PROBE`` times the nearest distance, and more until
these hold ``LEAST_TIMES`` times the rows it asks for.  Lists meet their queries
in blocks of bounded size, whatever the longest list is.

The result is what these lists hold, so it is approximate; tests measure its recall
against brute force.

Largest inner product becomes nearest distance by one more coordinate that
brings all vectors to one norm.  Scores are sums in double precision in the
order of the components, so equal vectors tie exactly.

Equal vectors share a search, and of each only the ``k + 1`` smallest ids can be
among the ``k`` nearest, so a vector held by a third of all rows costs no more
than another.

Defined results: vectors that are null, empty, zero, of another length than most
or with null or non-finite components take no part, nor do rows without an id;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.sources.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 20_000  # the centroids are fitted on so many vectors at most
LIST_ROWS = 256  # wanted length of a list
MAX_LISTS = 4_096  # bound of what is broadcast
DEGREE = 24
BEAM = 64
REPLICATE = 1.06
PROBE = 1.35
MAX_COPIES = 6
LEAST_LISTS = 4  # lists that a query reads whatever their distance
LEAST_TIMES = 4
BLOCK_ROWS = 4_096


@dataclass
class Lists:
    """Centroids and the graph between them; at most MAX_LISTS rows."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the beam's centroids, nearest first, by search along the graph."""
        count = len(self.centroids)
        width = min(BEAM, count)
        norms = (self.centroids**2).sum(1)
        beam = np.broadcast_to(self.entries[:width], (len(vectors), min(width, len(self.entries))))
        own = (vectors**2).sum(1)[:, None]
        seen = np.zeros((len(vectors), count), bool)
        distances = np.full((len(vectors), count), np.inf)
        rows = np.arange(len(vectors))[:, None]
        fresh = beam
        while True:
            # distances of centroids met for the first time, for all queries at once
            new = np.zeros_like(seen)
            new[rows, fresh] = True
            new &= ~seen
            if not new.any():
                break
            q, c = np.nonzero(new)
            distances[q, c] = own[q, 0] + norms[c] - 2 * np.einsum("ij,ij->i", vectors[q], self.centroids[c])
            seen |= new
            beam = np.argpartition(distances, width - 1, axis=1)[:, :width]
            fresh = self.graph[beam].reshape(len(vectors), -1)
        found = np.take_along_axis(distances, beam, 1)
        order = np.argsort(found, axis=1, kind="stable")
        return np.take_along_axis(beam, order, 1), np.sqrt(np.maximum(np.take_along_axis(found, order, 1), 0))


def fit_lists(sample: np.ndarray, lists: int) -> Lists:
    """Centroids of about ``lists`` lists; with more than ``MAX_LISTS`` parts the leaves are made larger, no part is dropped."""
    leaf = max(1, len(sample) // max(1, lists))
    centers = _leaves(sample, leaf)
    while len(centers) > MAX_LISTS:
        leaf = leaf * 3 // 2 + 1
        centers = _leaves(sample, leaf)
    rng = np.random.default_rng(11)
    norms = (centers**2).sum(1)
    between = norms[:, None] + norms[None] - 2 * centers @ centers.T
    graph = np.argsort(between, axis=1, kind="stable")[:, 1 : DEGREE + 1] if len(centers) > 1 else np.zeros((1, 1), int)
    entries = rng.choice(len(centers), min(len(centers), 16), replace=False)
    return Lists(centers, graph, entries)


def _leaves(sample: np.ndarray, leaf: int) -> np.ndarray:
    """Means of the parts that the sample is split into until each has about ``leaf`` rows."""
    rng = np.random.default_rng(11)
    parts, centroids = [np.arange(len(sample))], []
    while parts:
        part = parts.pop()
        if len(part) <= leaf * 3 // 2 or len(np.unique(sample[part], axis=0)) == 1:
            centroids.append(sample[part].mean(0))
            continue
        ways = int(min(8, max(2, round(len(part) / leaf))))
        centers = sample[rng.choice(part, ways, replace=False)]
        for _ in range(8):
            near = ((sample[part][:, None, :] - centers[None]) ** 2).sum(2)
            chosen = near.argmin(1)
            centers = np.stack([sample[part[chosen == w]].mean(0) if (chosen == w).any() else centers[w] for w in range(ways)])
        kids = [part[chosen == w] for w in range(ways) if (chosen == w).any()]
        if len(kids) == 1:
            centroids.append(sample[part].mean(0))
        else:
            parts += kids
    return np.asarray(centroids)


def valid(column: str) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def _lists_of(lists: Lists, top: float, ratio: float, most: int, counts: np.ndarray | None = None, least: int = 0):
    """Lists of vectors or, with ``counts`` (rows by list), of queries, which read on until they have met ``least`` rows."""
    query = counts is not None

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column(1))
            squares = (vectors**2).sum(1)
            if query:
                lifted = np.c_[vectors * (top / np.sqrt(squares))[:, None], np.zeros(len(vectors))]
            else:
                lifted = np.c_[vectors, np.sqrt(np.maximum(top * top - squares, 0))]
            for low in range(0, len(lifted), 1024):
                ids, far = lists.nearest(lifted[low : low + 1024])
                near = far <= ratio * far[:, :1] + 1e-12
                if query:
                    held = counts[ids]
                    near |= np.cumsum(held, axis=1) - held < least
                    near[:, :LEAST_LISTS] = True
                near[:, most:] = False
                rows, ranks = np.nonzero(near)
                at = pa.array(rows + low)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(ids[rows, ranks].astype(np.int32)), pa.array(ranks == 0)],
                    names=["id", "vector", "list", "home"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            q, v = _matrix(queries.column("vector").combine_chunks()), _matrix(rows.column("vector").combine_chunks())
            names, ids = queries.column("id").to_numpy(), rows.column("id").to_numpy()
            for low in range(0, len(q), 256):
                rough = q[low : low + 256] @ v.T
                cut = -np.partition(-rough, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
                a, b = np.nonzero(rough >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])
                exact = np.zeros(len(a))
                for d in range(v.shape[1]):
                    exact += q[a + low, d] * v[b, d]
                order = np.lexsort((ids[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                first = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, int)
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
                keep = rank < k
                out["query"].append(names[a[keep] + low])
                out["vec_id"].append(ids[b[keep]])
                out["score"].append(exact[keep])
        join = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
        return pa.table({"query": join(out["query"], pa.int64()), "vec_id": join(out["vec_id"], pa.int64()), "score": join(out["score"], pa.float64())})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest among ``rows`` for each of ``queries`` (both vec_id, embedding)."""
    spark = rows.sparkSession
    clean = lambda df: df.select("vec_id", "embedding").filter("vec_id is not null").filter(valid("embedding"))
    every, asked = clean(rows), clean(queries)
    usual = every.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every, asked = (df.filter(F.size("embedding") == usual["n"]) for df in (every, asked))
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    held = materialize(every.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1), "ann-rows")
    single = held.filter("nth = 1")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, top = held.agg(F.count("*"), F.sqrt(F.max(square))).first()
    share = single.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("embedding").toPandas()
    sample = np.stack([np.asarray(x, np.float64) for x in share["embedding"]])
    sample = np.c_[sample, np.sqrt(np.maximum(top * top - (sample**2).sum(1), 0))]
    lists = fit_lists(sample, min(MAX_LISTS, max(1, total // LIST_ROWS)))

    kinds = asked.groupBy("embedding").agg(F.min("vec_id").alias("id"))
    ddl = "id long, vector array<float>, list int, home boolean"
    vector = F.col("embedding").cast("array<float>").alias("vector")
    posted = materialize(
        held.select(F.col("vec_id").alias("id"), vector).mapInArrow(_lists_of(lists, top, REPLICATE, MAX_COPIES), ddl), "ann-lists"
    )
    kinds = materialize(kinds, "ann-kinds")
    homes = posted.filter("home").select("id", "vector", "list")
    counts = np.zeros(len(lists.centroids), np.int64)
    for r in homes.groupBy("list").count().collect():
        counts[r["list"]] = r["count"]
    read = _lists_of(lists, top, PROBE, BEAM, counts, LEAST_TIMES * (k + 1))
    probes = materialize(kinds.select("id", vector).mapInArrow(read, ddl), "ann-probes")
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    sizes = blocks(posted, "row_blocks").join(blocks(probes, "query_blocks"), "list")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(sizes, "list").withColumn("i", own("query_blocks")).withColumn("j", others("row_blocks")).select("list", "i", "j", "id", "vector")
    right = posted.join(sizes, "list").withColumn("j", own("row_blocks")).withColumn("i", others("query_blocks")).select("list", "i", "j", "id", "vector")
    by = ["list", "i", "j"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search(k + 1), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.distinct().withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    found = ranked(found).drop("place")
    named = asked.join(kinds, "embedding").select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = named.join(found, "query").filter("query_id <> vec_id")
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
