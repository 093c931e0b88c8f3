"""Centroid clustering by kd-tree filtering.

Vectors become whole numbers, so that sums and distances are exact and do not depend on how rows are dealt out. Each task builds kd-trees
over its own vectors, once; a node holds its box, its number of vectors and their sum. In a round the trees are filtered by the centroids:
a centroid is dropped for a node if some other is strictly nearer to every point of the node's box; a node with one centroid left is
assigned whole, by its count and sum; what reaches a leaf is compared exactly. Per task one row for each centroid leaves, and Spark adds
them up, so the driver sees centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, in_arrow

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Vectors of a tree and of a leaf.
TREE, LEAF = 8192, 16
#: Whole numbers lie within this, so that no sum of squares of twice their differences passes 64 bits.
BOUND = 1 << 25

_TREES = "ids array<long>, points binary, lo binary, hi binary, sums binary, start binary, stop binary, child binary"
_KINDS = {"points": np.int32, "lo": np.int32, "hi": np.int32, "sums": np.int64, "start": np.int32, "stop": np.int32, "child": np.int32}
_FLAT = ("start", "stop", "child")


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the vectors in the tree, and its nodes, the root first: box, sum, range of vectors, and the first of two children, -1 in leaves.

    A node is cut at the median of its widest side. Equal vectors are never cut.
    """
    order, ranges, nodes = np.arange(len(x)), [(0, len(x))], []
    for a, b in ranges:
        p = x[order[a:b]]
        lo, hi = p.min(0), p.max(0)
        d = int((hi - lo).argmax())
        child = -1
        if b - a > leaf and hi[d] > lo[d]:
            m = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(p[:, d], m)]
            child = len(ranges)
            ranges += [(a, a + m), (a + m, b)]
        nodes.append((lo, hi, p.sum(0), a, b, child))
    return order, {k: np.array(v) for k, v in zip(("lo", "hi", "sums", "start", "stop", "child"), zip(*nodes))}


def filtered(t: dict[str, np.ndarray], c: np.ndarray, each: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Vectors of each centroid, their sums, and, if asked for, the centroid of each vector. Ties go to the smaller number."""
    k = len(c)
    count, sums = np.zeros(k, np.int64), np.zeros((k, c.shape[1]), np.int64)
    own = np.zeros(len(t["points"]), np.int32) if each else None
    norm = (c * c).sum(1)
    node, may = np.zeros(1, np.int64), np.ones((1, k), bool)
    while len(node):
        lo, hi = t["lo"][node].astype(np.int64), t["hi"][node].astype(np.int64)
        off = 2 * c[None] - (lo + hi)[:, None]
        star = np.where(may, (off * off).sum(2), np.iinfo(np.int64).max).argmin(1)
        w = c[None] - c[star][:, None]
        best = (np.where(w > 0, hi[:, None], lo[:, None]) * w).sum(2)
        may &= norm[None] - norm[star][:, None] - 2 * best <= 0
        one, end = may.sum(1) == 1, t["child"][node] < 0
        for i in np.flatnonzero(one):
            j = int(may[i].argmax())
            n = node[i]
            count[j] += t["stop"][n] - t["start"][n]
            sums[j] += t["sums"][n]
            if each:
                own[t["start"][n] : t["stop"][n]] = j
        left = np.flatnonzero(end & ~one)
        if len(left):
            size = t["stop"][node[left]] - t["start"][node[left]]
            at = np.repeat(t["start"][node[left]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            for i in range(0, len(at), 4096):
                here = at[i : i + 4096]
                p = t["points"][here].astype(np.int64)
                d = np.where(np.repeat(may[left], size, 0)[i : i + 4096], norm[None] - 2 * (p @ c.T), np.iinfo(np.int64).max)
                j = d.argmin(1)
                count += np.bincount(j, minlength=k)
                np.add.at(sums, j, p)
                if each:
                    own[here] = j
        more = np.flatnonzero(~end & ~one)
        node = np.concatenate([t["child"][node[more]], t["child"][node[more]] + 1]).astype(np.int64)
        may = np.concatenate([may[more], may[more]])
    return count, sums, own


def _whole(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """(vec_id, v) of the vectors that count."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return own.where(F.col("v").isNotNull() & (F.size("v") == dimensions) & ~odd)


def _numbers(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(x) and np.abs(x).max() > BOUND:
        raise ValueError(f"a component times {scale} is beyond {BOUND}: distances would pass 64 bits")
    return x.astype(np.int64).reshape(-1, dimensions)


def _trees(own: DataFrame, dimensions: int, scale: int, most: int, leaf: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        xs: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            i, x = pa.concat_arrays(ids), np.concatenate(xs)
            order, t = tree(x, leaf)
            t["points"] = x[order]
            i = i.take(pa.array(order))
            ids.clear(), xs.clear()
            return pa.RecordBatch.from_arrays([pa.array([i.to_pylist()], pa.list_(pa.int64())), *(pa.array([t[k].astype(_KINDS[k]).tobytes()], pa.binary()) for k in _KINDS)], ["ids", *_KINDS])

        for b in batches:
            for i in range(0, len(b), most):
                part = b.slice(i, most)
                if xs and sum(map(len, xs)) + len(part) > most:
                    yield made()
                ids.append(part.column(0))
                xs.append(_numbers(part.column(1), dimensions, scale))
        if sum(map(len, xs)):
            yield made()

    return in_arrow(own, run, _TREES)


def _read(b: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, dict[str, np.ndarray]]]:
    for i in range(len(b)):
        t = {k: np.frombuffer(b.column(k)[i].as_buffer(), kind) for k, kind in _KINDS.items()}
        yield b.column("ids")[i].values, {k: x if k in _FLAT else x.reshape(-1, dimensions) for k, x in t.items()}


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, most: int = TREE, leaf: int = LEAF
) -> DataFrame:
    """One row per vector that counts: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid.

    Vectors of another length, null ones and those with null or non-finite components have no row. A component x counts as floor(scale * x).
    The first centroids are the vectors of the smallest sha256 of `seed:vec_id` (a null vec_id: the empty string; ties: the smaller
    vector); with fewer vectors than `clusters` there are as many as vectors. A round assigns each vector to its nearest centroid (ties:
    the smaller number) and moves each centroid that has vectors to their floored mean; others stay. Repeated rows and ids are vectors
    each. No vectors give no rows. Components so large that a distance would pass 64 bits raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    own = _whole(vectors, id_col, vector_col, dimensions)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = own.select(key.alias("key"), F.transform("v", lambda x: F.floor(x * scale)).alias("v")).orderBy("key", "v").limit(clusters).collect()
    trees = cut(_trees(own, dimensions, scale, most, leaf))
    c = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)

    def summed(c: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, sums = np.zeros(len(c), np.int64), np.zeros_like(c)
            for b in batches:
                for _, t in _read(b, dimensions):
                    n, s, _ = filtered(t, c)
                    count += n
                    sums += s
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(count[has]), pa.array(sums[has].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

        each = in_arrow(trees, run, "cluster int, n long, s array<long>").select("cluster", "n", F.posexplode("s").alias("i", "s"))
        return each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    for _ in range(rounds if len(c) else 0):
        moved = c.copy()
        for r in summed(c).collect():  # clusters * dimensions rows
            moved[r.cluster, r.i] = r.s // r.n
        c = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, t in _read(b, dimensions):
                _, _, own = filtered(t, c, each=True)
                off = t["points"].astype(np.int64) - c[own]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(own), pa.array((off * off).sum(1))], ["vec_id", "cluster", "distance"])

    rows = cut(in_arrow(trees, assign, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    said = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), x) for j, x in enumerate(c.tolist())]
    named = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rows of the table embeddings, all rounds written out."""
    near = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v.e[i] - {c}.e[i]) * (v.e[i] - {c}.e[i])))"
    out = [
        f"""WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS k, e FROM v QUALIFY k < {clusters})"""
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT v.rn, min({{'d': CAST({near.format(n=dimensions, c=f'c{i}')} AS BIGINT), 'k': c{i}.k}}) AS m FROM v, c{i} GROUP BY v.rn)")
        if i < rounds:
            out.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(x.e, c{i}.e) AS e FROM c{i} LEFT JOIN (
  SELECT k, list(CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY p) AS e FROM (
    SELECT m.k AS k, p, CAST(sum(e[p]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (rn), range(1, {dimensions} + 1) t(p) GROUP BY ALL) GROUP BY k) x USING (k))"""
            )
    last = f"a{rounds}"
    return ",\n".join(out) + f"""
SELECT v.vec_id, CAST(m.k AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM {last} JOIN v USING (rn) JOIN c{rounds} c ON c.k = m.k"""
