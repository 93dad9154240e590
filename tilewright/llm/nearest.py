"""Approximate nearest neighbours by largest inner product: a navigable small-world graph per shard, and the shards' results merged.

Vectors are dealt into shards of bounded size by a hash of their id. A shard's vectors get one more component that makes all norms equal, so that
nearness by inner product is plain nearness. Its graph has layers of exponentially fewer nodes; each layer is a flat array of neighbour numbers
(-1 pads). Equal vectors of a shard are one node with many ids. A search goes down the layers and then widens on the lowest one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

SHARD = 8192
QUERY_BLOCK = 2048
K = 20
QUERY_MODULUS = 20
DEGREE, LOW_DEGREE, CANDIDATES = 12, 32, 56
#: Of full shards of Gaussian vectors of 64 dimensions, which have no clusters, a search finds 0.92 of the 20 nearest.
BEAM, EXPAND = 160, 6


def levelled(vectors: np.ndarray) -> np.ndarray:
    """float32 copies with one more component, so that all have the largest norm."""
    norms = np.square(vectors).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], 1).astype(np.float32)


def layer_neighbours(x: np.ndarray, degree: int, candidates: int = CANDIDATES) -> np.ndarray:
    """Flat neighbour array (n x degree) of one layer: near vectors that aren't nearer to a neighbour already chosen, then links back, then the nearest of the rest."""
    n = len(x)
    if n <= degree + 1:
        all_ = np.tile(np.arange(n), (n, 1))
        rows = all_[all_ != np.arange(n)[:, None]].reshape(n, n - 1) if n > 1 else np.zeros((1, 0), int)
        return np.pad(rows, ((0, 0), (0, degree - (n - 1))), constant_values=-1).astype(np.int32)
    c = min(candidates, n - 1)
    chosen = np.full((n, degree), -1, np.int32)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        m = len(sims)
        sims[np.arange(m), at + np.arange(m)] = -np.inf
        near = np.argpartition(-sims, c - 1, 1)[:, :c]
        own = np.take_along_axis(sims, near, 1)
        order = np.argsort(-own, 1)
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        between = np.einsum("mid,mjd->mij", x[near], x[near], optimize=True)
        keep, closest = np.zeros((m, c), bool), np.full((m, c), -np.inf, np.float32)
        for i in range(c):
            keep[:, i] = (own[:, i] > closest[:, i]) & (keep.sum(1) < degree // 2)
            closest = np.where(keep[:, i : i + 1], np.maximum(closest, between[:, i]), closest)
        rank = np.argsort(~keep, 1, kind="stable")[:, :degree]  # the diverse ones first, then the nearest others
        chosen[at : at + m] = np.take_along_axis(near, rank, 1)
    # links back: half of the places at most
    src, dst = np.repeat(np.arange(n), degree // 2), chosen[:, : degree // 2].ravel()
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    ok = place < degree // 2
    out = np.concatenate([chosen, np.full((n, degree // 2), -1, np.int32)], 1)
    out[dst[ok], degree + place[ok]] = src[ok]
    return out


def build(vectors: np.ndarray, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the lowest up: (nodes ascending, neighbour array in places of nodes). The lowest has all vectors, each next one about one in DEGREE."""
    x = levelled(vectors)
    level = np.floor(-np.log(np.random.default_rng(seed).random(len(x))) / np.log(DEGREE)).astype(int)
    layers, nodes = [], np.arange(len(x))
    while len(nodes):
        layers.append((nodes, layer_neighbours(x[nodes], LOW_DEGREE if not layers else DEGREE)))
        if len(nodes) == 1:
            break
        above = nodes[level[nodes] >= len(layers)]
        nodes = above if len(above) else nodes[:0]
    return layers


def widen(x: np.ndarray, queries: np.ndarray, neighbours: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: places and inner products of the beam best found, falling; -1 pads."""
    q, n = len(queries), len(x)
    beam = min(beam, n)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    ids, sims, done = np.full((q, beam), n), np.full((q, beam), -np.inf, np.float32), np.ones((q, beam), bool)
    rows = np.arange(q)
    seen[rows[:, None], entry] = True
    k = entry.shape[1]
    ids[:, :k], sims[:, :k], done[:, :k] = entry, np.einsum("qd,qkd->qk", queries, x[entry]), False
    padded = np.where(neighbours < 0, n, neighbours)
    active = rows
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        width = min(EXPAND, beam)
        pick = np.argpartition(-open_, width - 1, 1)[:, :width]
        real = np.take_along_axis(open_, pick, 1) > -np.inf
        alive = real.any(1)
        active, pick, real = active[alive], pick[alive], real[alive]
        if not len(active):
            break
        base = np.where(real, ids[active[:, None], pick], n)
        d = done[active]
        np.put_along_axis(d, pick, True, 1)
        new = np.where(base[:, :, None] == n, n, padded[np.minimum(base, n - 1)]).reshape(len(active), -1)
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[active[:, None], new]] = n
        seen[active[:, None], new] = True
        fresh = np.where(new == n, -np.inf, np.einsum("qd,qkd->qk", queries[active], x[np.minimum(new, n - 1)], optimize=True)).astype(np.float32)
        ids_, sims_, done_ = np.concatenate([ids[active], new], 1), np.concatenate([sims[active], fresh], 1), np.concatenate([d, new == n], 1)
        best = np.argpartition(-sims_, beam - 1, 1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, best, 1) for a in (ids_, sims_, done_))
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isinf(sims), -1, ids), sims


def search(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Places of the beam nearest found of each query, nearest first, -1 pads."""
    queries = queries.astype(np.float32)
    at = np.zeros((len(queries), 1), int)
    for up in range(len(layers) - 1, -1, -1):
        nodes, neighbours = layers[up]
        found, _ = widen(x[nodes], queries, neighbours, at, beam if up == 0 else 4)
        if up == 0:
            return found
        best = nodes[found[:, :1]]
        at = np.searchsorted(layers[up - 1][0], best)
    return at


def usable(column: str = "embedding"):
    """Neither null, empty nor zero, and without null or non-finite components."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def graphs(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per shard and dimension: dim, shard, the vectors, their ids and the layers as flat binary arrays. Written to the shared folder."""

    def make(key, frame):
        import pandas as pd

        dim, shard = key
        frame = frame.sort_values("vec_id", kind="stable")
        x = np.array(frame["embedding"].tolist(), np.float64).reshape(len(frame), dim)
        nodes, node_of = np.unique(x, axis=0, return_inverse=True)
        layers = build(nodes)
        blob = lambda a, t: np.ascontiguousarray(a, t).tobytes()
        return pd.DataFrame([{"dim": int(dim), "shard": int(shard), "vectors": blob(nodes, "<f8"), "ids": blob(frame["vec_id"], "<i8"), "node_of": blob(node_of.ravel(), "<i4"), "layer_nodes": [blob(a, "<i4") for a, _ in layers], "layer_links": [blob(b, "<i4") for _, b in layers]}])

    dealt = vectors.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, vectors binary, ids binary, node_of binary, layer_nodes array<binary>, layer_links array<binary>"), "graphs")


def search_shard(graph, queries, k: int = K, beam: int = BEAM):
    """The k nearest of one shard for a block of queries: query_id, vec_id, score (double, of the original vectors)."""
    import pandas as pd

    row = graph.iloc[0]
    dim = int(row["dim"])
    x = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
    ids, node_of = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["node_of"], "<i4")
    layers = [(np.frombuffer(a, "<i4").astype(int), np.frombuffer(b, "<i4").reshape(len(a) // 4, -1)) for a, b in zip(row["layer_nodes"], row["layer_links"], strict=True)]
    order = np.argsort(node_of, kind="stable")  # ids ascend within a node
    first = np.searchsorted(node_of[order], np.arange(len(x) + 1))
    qid = queries["query_id"].to_numpy(np.int64)
    qs = np.array(queries["embedding"].tolist(), np.float64).reshape(len(queries), dim)
    found = search(x.astype(np.float32), layers, qs, beam)
    scores = np.where(found < 0, -np.inf, np.einsum("qd,qkd->qk", qs, x[np.maximum(found, 0)], optimize=True))
    out_q, out_v, out_s = [], [], []
    for i in range(len(qs)):
        # nodes by exact score; of a node's ids the k + 1 smallest are enough
        got: list[tuple[float, int]] = []
        for p in np.argsort(-scores[i], kind="stable").tolist():
            if found[i, p] < 0 or len(got) >= k and -got[k - 1][0] > scores[i, p]:
                break
            node = found[i, p]
            got += [(-scores[i, p], v) for v in ids[order[first[node] : min(first[node + 1], first[node] + k + 1)]].tolist() if v != qid[i]]
            got.sort()
            del got[k:]
        out_q += [qid[i]] * len(got)
        out_v += [v for _, v in got]
        out_s += [-s for s, _ in got]
    return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, query_block: int = QUERY_BLOCK, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found of all rows of vectors but its own; ties to the smaller vec_id.

    vectors and queries have vec_id and embedding. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part; a query meets vectors of its own length only. Repeated rows of vectors are candidates each; of queries with the
    same id one counts. With k or fewer candidates all are returned; without any, no row. Every task holds one shard and one block of queries.
    """
    clean = lambda df: df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable())
    vectors, queries = clean(vectors), clean(queries).dropDuplicates(["vec_id"])
    shards = max(1, -(-vectors.count() // shard))
    blocks = max(1, -(-queries.count() // query_block))
    graph = graphs(vectors, shards)
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select(F.col("vec_id").alias("query_id"), F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "embedding")
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return search_shard(a, b, k, beam)

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_MODULUS == 0))
