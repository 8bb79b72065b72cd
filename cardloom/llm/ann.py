"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 6000
QUERY_ROWS = 6000


def _search(graph: np.ndarray, base: np.ndarray, entry: int, queries: np.ndarray, beam: int, wide: int = 4):
    """Beam search of several queries at once: (ids, squared distances), nearest first.

    Every round opens each query's ``wide`` nearest unopened nodes and keeps the ``beam``
    nearest of what it has seen, until all of those have been opened.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n, beam), -1, dtype=np.int64)
    dist = np.full((n, beam), np.inf, dtype=np.float32)
    opened = np.ones((n, beam), dtype=bool)
    seen = np.zeros((n, len(base)), dtype=bool)
    ids[:, 0], opened[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = ((queries - base[entry]) ** 2).sum(1)
    active = np.arange(n)
    while len(active):
        key = np.where(opened[active], np.inf, dist[active])
        pick = np.argsort(key, axis=1, kind="stable")[:, :wide]
        good = np.take_along_axis(key, pick, 1) < np.inf
        at = active[:, None]
        opened[at, pick] = True
        near = np.where(good[:, :, None], graph[np.maximum(ids[at, pick], 0)], -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[at, np.maximum(near, 0)]
        # A node reached twice in a round counts once.
        order = np.argsort(near, axis=1, kind="stable")
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        who, where = np.nonzero(fresh)
        new = near[who, where]
        seen[active[who], new] = True
        far = np.full(near.shape, np.inf, dtype=np.float32)
        far[who, where] = ((base[new] - queries[active[who]]) ** 2).sum(1)
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_dist = np.concatenate([dist[active], far], axis=1)
        all_open = np.concatenate([opened[active], ~fresh], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, best, 1)
        dist[active] = np.take_along_axis(all_dist, best, 1)
        opened[active] = np.take_along_axis(all_open, best, 1)
        active = active[(~opened[active]).any(1)]
    ids[~np.isfinite(dist)] = -1
    return ids, dist


def _prune(base: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Robust pruning: take the nearest candidate, drop those that are closer to it, by
    the factor ``relax``, than to the point; repeat. -1 pads both ways."""
    n = len(points)
    candidates = np.where(candidates == points[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    vectors = base[np.maximum(candidates, 0)]
    dist = ((vectors - base[points][:, None, :]) ** 2).sum(2)
    dist[candidates < 0] = np.inf
    norms = (vectors**2).sum(2)
    out = np.full((n, degree), -1, dtype=np.int64)
    rows = np.arange(n)
    for k in range(degree):
        pick = dist.argmin(1)
        some = np.isfinite(dist[rows, pick])
        if not some.any():
            break
        out[some, k] = candidates[rows, pick][some]
        chosen = vectors[rows, pick]
        apart = norms + norms[rows, pick][:, None] - 2 * np.einsum("nmd,nd->nm", vectors, chosen)
        dist[relax * relax * apart <= dist] = np.inf
        dist[rows, pick] = np.inf
    return out


def build_graph(base: np.ndarray, degree: int = 32, beam: int = 64, relax: float = 1.2, batch: int = 256):
    """(graph, entry): out-neighbours of every row of ``base``, and where searches start.

    From a random graph, batches of rows are searched for greedily; what they find, pruned,
    becomes their neighbours, and the rows themselves are offered to those in turn.
    """
    n = len(base)
    rng = np.random.default_rng(11)
    graph = np.full((n, degree), -1, dtype=np.int64)
    if n > 1:
        first = min(degree // 2, n - 1)
        graph[:, :first] = (np.arange(n)[:, None] + rng.integers(1, n, (n, first))) % n
    entry = int(((base - base.mean(0)) ** 2).sum(1).argmin()) if n else 0
    order = rng.permutation(n)
    for at in range(0, n, batch):
        points = order[at : at + batch]
        found, _ = _search(graph, base, entry, base[points], beam)
        graph[points] = _prune(base, points, np.concatenate([found, graph[points]], axis=1), degree, relax)
        target = graph[points].ravel()
        source = np.repeat(points, degree)[target >= 0]
        target = target[target >= 0]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        offered = np.full((len(nodes), count.max() if len(nodes) else 0), -1, dtype=np.int64)
        offered[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        for k in range(0, len(nodes), batch):
            part = nodes[k : k + batch]
            joint = np.concatenate([graph[part], offered[k : k + batch]], axis=1)
            graph[part] = _prune(base, part, joint, degree, relax)
    return graph, entry


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    rows = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0), dtype)


def _index_shard(degree: int, beam: int, relax: float):
    """One shard as one row: vectors and graph as bytes, keys, and the smallest ids."""

    def index(base: pa.Table) -> pa.Table:
        exact = _matrix(base["vector"], np.float64)
        graph, entry = build_graph(exact.astype(np.float32), degree, beam, relax)
        return pa.table({
            "dim": base["dim"][:1], "shard": base["shard"][:1], "entry": pa.array([entry], pa.int64()),
            "vectors": pa.array([exact.tobytes()], pa.binary()),
            "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
            "keys": pa.array([base["key"].to_pylist()], pa.list_(pa.string())),
            "leasts": pa.array([base["least"].to_pylist()], pa.list_(pa.int64())),
        })

    return index


def _search_block(take: int, degree: int, beam: int, batch: int = 128):
    """Search one indexed shard for one block of queries: the ``take`` nearest of each."""

    def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out_query, out_key, out_dist = [], [], []
        if len(shard) and len(queries):
            row = {c: shard[c][0].as_py() for c in ("dim", "entry", "vectors", "graph", "keys", "leasts")}
            exact = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            graph = np.frombuffer(row["graph"], np.int32).reshape(-1, degree).astype(np.int64)
            small, names, keys = exact.astype(np.float32), np.array(row["leasts"]), row["keys"]
            wanted, owners = _matrix(queries["vector"], np.float64), queries["query"].to_pylist()
            for at in range(0, len(wanted), batch):
                ids, _ = _search(graph, small, row["entry"], wanted[at : at + batch].astype(np.float32), beam)
                for k, near in enumerate(ids):
                    near = near[near >= 0]
                    dist = np.sqrt(((exact[near] - wanted[at + k]) ** 2).sum(1))
                    best = np.lexsort((names[near], dist))[:take]
                    out_query += [owners[at + k]] * len(best)
                    out_key += [keys[i] for i in near[best]]
                    out_dist.append(dist[best])
        dist = np.concatenate(out_dist) if out_dist else np.zeros(0)
        return pa.table({
            "query": pa.array(out_query, pa.string()), "key": pa.array(out_key, pa.string()), "score": pa.array(dist),
        })

    return search


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, degree: int = 32, beam: int = 96, relax: float = 1.2,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every query row.

    Both tables have vec_id and embedding. score is the Euclidean distance in double
    precision; ties go to the smaller vec_id; rows with the query's vec_id are left out.
    Rows take no part if the vector is null or zero or holds nulls, NaN or infinity, or if
    vec_id is null. Vectors are compared with those of equal length only. Other columns
    are ignored.

    Equal vectors are indexed once, with the k + 1 smallest ids they have, which is all
    that a result can show. Every distinct vector is in the graph of one shard (dealt by
    hash, about ``shard_rows`` each). Graphs are built once and written, one row a shard.
    Distinct query vectors are dealt into blocks of about ``query_rows``, and every block
    searches every shard: a task holds one shard and one block, however many there are.
    """
    from .common import written

    def usable(df: DataFrame) -> DataFrame:
        good = F.expr(
            "vec_id is not null and embedding is not null and size(embedding) > 0"
            " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
            " and exists(embedding, x -> x <> 0)"
        )
        vector = F.transform("embedding", lambda x: x.cast("double") + 0.0)
        rows = df.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        return rows.withColumn("key", F.concat_ws("/", F.size("vector"), F.hex(F.xxhash64("vector")), F.hex(F.xxhash64(F.lit(1), "vector"))))

    few = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    base = written(
        usable(vectors).withColumn("nth", few).filter(F.col("nth") <= k + 1)
        .groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")),
        "vectors",
    )
    asked = written(usable(queries), "queries")
    distinct = asked.dropDuplicates(["key"]).select(F.col("key").alias("query"), "vector")
    shards = max(1, round(base.count() / shard_rows))
    blocks = max(1, ceil(asked.select("key").distinct().count() / query_rows))
    dim = F.size("vector").alias("dim")
    dealt = base.select(
        dim, F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", F.col("ids")[0].alias("least"), "vector"
    )
    index = written(
        dealt.groupBy("dim", "shard").applyInArrow(
            _index_shard(degree, beam, relax),
            "dim int, shard int, entry long, vectors binary, graph binary, keys array<string>, leasts array<long>",
        ),
        "graphs",
    )
    each_block = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each_shard = distinct.select(
        dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "query", "vector",
    )
    pair = ["dim", "shard", "block"]
    found = each_block.groupBy(*pair).cogroup(each_shard.groupBy(*pair)).applyInArrow(
        _search_block(k + 1, degree, beam), "query string, key string, score double"
    )
    found = found.join(base.select("key", "ids"), "key")
    nearby = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("ids")[0]))
    best = found.withColumn("nth", nearby).filter(F.col("nth") <= k + 1).groupBy("query").agg(
        F.collect_list(F.struct("score", "ids")).alias("found")
    )
    pairs = F.flatten(
        F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["score"].alias("score"), i.alias("vec_id"))))
    )
    mine = F.slice(F.array_sort(F.filter(pairs, lambda p: p["vec_id"] != F.col("query_id"))), 1, k)
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query"))
        .join(best, "query")
        .select("query_id", F.posexplode(mine).alias("at", "hit"))
        .select(
            "query_id", (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"),
        )
    )
