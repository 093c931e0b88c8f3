"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors whose cosine is at least c lie at a squared distance of at most 2 - 2c. A fixed rotation spreads each vector over all
coordinates; these are split into low-dimensional blocks, and each block gets a share of that distance in proportion to its
dimensions. If every block of a pair were beyond its share, the pair would be beyond the whole; so a linked pair is within
the share in at least one block. Each block is joined on a grid over its first coordinates, every vector also looking into the
lower neighbouring cells within reach. What is within a block's share is verified by the exact cosine of the given components, and counted in the
first such block only. Vectors travel as they are given, as single precision where that holds them, and are rotated where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, cut, in_arrow, parts
from tesserae.llm.simhash import _runs

COSINE = 0.93
BLOCK = 8
#: Coordinates of a block that its grid is over.
GRID = 2
#: Vectors of a cell compared in one task are at most twice as many; larger cells are dealt out as pairs of chunks.
CHUNK = 4096
_EPS = 1e-9


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, block: int = BLOCK) -> list[slice]:
    n = max(1, dim // block)
    at = [dim * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


def _cells(x: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, cell, home): each row's own cell, then the lower neighbouring cells within reach. x: rows by grid coordinates."""
    width = 2 * reach
    own = np.floor(x / width).astype(np.int64)
    yield np.arange(len(x)), own, True
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * x.shape[1], indexing="ij"), -1).reshape(-1, x.shape[1])
    for s in steps[: len(steps) // 2]:  # those before (0, .., 0) in lexicographic order
        gap = np.where(s < 0, x - own * width, np.where(s > 0, (own + 1) * width - x, 0.0))
        at = np.flatnonzero((gap * gap).sum(1) <= reach * reach + _EPS)
        if len(at):
            yield at, own[at] + s, False


def _packed(v: np.ndarray) -> list[bytes]:
    """Each vector as bytes, in single precision where that is exact."""
    short = v.astype(np.float32)
    exact = (short == v).all(1)
    return [b"f" + a.tobytes() if e else b"d" + x.tobytes() for a, x, e in zip(short, v, exact)]


def _unpacked(raw: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float32 if x[:1] == b"f" else np.float64, offset=1).astype(np.float64) for x in raw])


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors of length one; squares of very large or small components neither overflow nor vanish."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _turned(unit: np.ndarray) -> np.ndarray:
    """Rotated, to twelve places, so that every task that meets a pair makes the same of it."""
    return np.round(unit @ rotation(unit.shape[1]), 12)


def _dealt(classes: DataFrame, cosine: float, block: int, grid: int) -> DataFrame:
    """(grp, blk, cell, home, id, mult, vec): every vector in each block's cells."""
    budget = 2 - 2 * cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grps, mults, dims = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(4).to_numpy()
            vectors = b.column(3)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                v = flat[offsets[own][:, None] + np.arange(dim)]
                raw = pa.array(_packed(v), pa.binary())
                w = _turned(_unit(v))
                for j, sl in enumerate(blocks(int(dim), block)):
                    reach = float(np.sqrt(budget * (sl.stop - sl.start) / dim))
                    for at, cell, home in _cells(w[:, sl.start : min(sl.stop, sl.start + grid)], reach):
                        k = own[at]
                        code = cell[:, 0] & 0xFFFF
                        for c in range(1, cell.shape[1]):
                            code = (code << 16) | (cell[:, c] & 0xFFFF)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(grps[k]), pa.array(np.full(len(k), j, np.int32)), pa.array(code), pa.array(np.full(len(k), home)), ids.take(pa.array(k)), pa.array(mults[k]), raw.take(pa.array(at))],
                            ["grp", "blk", "cell", "home", "id", "mult", "vec"],
                        )

    return in_arrow(classes.select("id", "grp", "mult", "v", F.size("v").alias("dim")), run, "grp long, blk int, cell long, home boolean, id string, mult long, vec binary")


def _compared(mult: np.ndarray, home: np.ndarray, part: np.ndarray, both: int, v: np.ndarray, blk: int, cosine: float, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one cell's vectors in one block: for each id with links its links' copies, and the root of its links' forest.

    part: the chunk (0 or 1) of each; both: whether pairs within chunk 0 and 1 belong here, by bit.
    """
    n, dim = v.shape
    unit = _unit(v)
    w = _turned(unit)
    sls = blocks(dim, block)
    share = [(2 - 2 * cosine) * (s.stop - s.start) / dim + _EPS for s in sls]
    x = w[:, sls[blk]]
    sq = (x * x).sum(1)
    near = np.zeros((n, n), bool)
    inside = np.array([bool(both & 1), bool(both & 2)])
    for i in range(0, n, 256):
        j = slice(i, min(n, i + 256))
        ok = sq[j, None] + sq[None] - 2 * (x[j] @ x.T) <= share[blk]
        ok &= home[j, None] | home[None]
        ok &= (part[j, None] != part[None]) | inside[part[j]][:, None]
        ok &= np.arange(n)[None] > np.arange(n)[j, None]
        a, b = np.nonzero(ok)
        for k in range(0, len(a), 20_000):
            p, q = a[k : k + 20_000] + i, b[k : k + 20_000]
            hit = (unit[p] * unit[q]).sum(1) >= cosine
            p, q = p[hit], q[hit]
            d = (w[p] - w[q]) ** 2
            first = np.ones(len(p), bool)
            for s in range(blk):
                first &= d[:, sls[s]].sum(1) > share[s]
            near[p[first], q[first]] = True
    near |= near.T
    weights = mult.astype(np.float64)  # sums below 2^53 are exact
    count = np.concatenate([near[i : i + 256].astype(np.float64) @ weights for i in range(0, n, 256)]).astype(np.int64)
    linked = np.flatnonzero(count)
    root = np.full(n, -1)
    for s in linked:
        if root[s] < 0:
            root[s] = s
            queue = [s]
            while queue:
                new = near[queue.pop()] & (root < 0)
                root[new] = s
                queue.extend(np.flatnonzero(new))
    return linked, count[linked], root[linked]


def near_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """From classes of equal vectors (id, grp, mult, v) rows (id, root, n): n copies of other classes linked with id found in one
    place, and an edge to root. Sums of n are exact, as a pair is counted in one block, cell and pair of chunks only."""
    rows = _dealt(classes, cosine, block, grid)
    key = ["grp", "blk", "cell"]
    rows = cut(rows)
    size = rows.groupBy(*key).agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any")
    rows = rows.join(size.drop("any"), key)
    rows = rows.withColumn("c", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("c") - 1), lambda j: j != F.col("own"))
    pairs = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.transform(others, lambda j: F.least(j, F.col("own")) * F.col("c") + F.greatest(j, F.col("own"))))
    rows = rows.select(*key, "c", "own", "home", "id", "mult", "vec", F.explode(pairs).alias("p"))
    key = [*key, "p"]
    dealt = rows.repartition(parts(classes.sparkSession), *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, key):
            k = np.stack([t.column(x).to_numpy() for x in key])
            at = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1), len(t)]
            for i, j in zip(at, at[1:]):
                if j - i < 2:
                    continue
                g = t.slice(i, j - i)
                c, p = g.column("c")[0].as_py(), g.column("p")[0].as_py()
                ids, own, both = np.array(g.column("id").to_pylist(), object), g.column("own").to_numpy(), 1
                lo, hi = (0, 0) if c == 1 else divmod(p, c)
                if c > 1:  # pairs within chunk k belong to the pair of chunks k and k + 1
                    both = 1 * ((lo + 1) % c == hi) + 2 * ((hi + 1) % c == lo)
                who, n, root = _compared(g.column("mult").to_numpy(), g.column("home").to_numpy(zero_copy_only=False), (own == hi).astype(int) if c > 1 else np.zeros(j - i, int), both, _unpacked(g.column("vec").to_pylist()), int(k[1, i]), cosine, block)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who], pa.string()), pa.array(ids[root], pa.string()), pa.array(n.astype(np.int64))], ["id", "root", "n"])

    return in_arrow(dealt, run, "id string, root string, n long")


def embedding_groups(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, chunk: int = CHUNK) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors of equal label and cosine >= the limit), component_id, kept.

    component_id: the smallest vec_id reachable over links, the row's own included; kept: vec_id = component_id. Vectors that
    are null, empty or zero or hold null or non-finite components, and those of a null label, link with nothing. Vectors of
    different lengths never link. Equal vectors are compared once, for all their rows. A null vec_id takes part and names
    no component while another is known. Other columns are not read. An empty table gives an empty result.
    """
    own = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # The id of a class of equal vectors: a digest of the label and the components' exact text; -0.0 counts as 0.0.
    ident = F.md5(F.concat(F.col("label"), F.lit("|"), F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast("string")))
    own = own.withColumn("id", F.when(good, ident)).withColumn("grp", F.when(good, F.xxhash64("label", F.size("v"))))
    known = own.where("id is not null")
    classes = cut(known.groupBy("id").agg(F.first("grp").alias("grp"), F.count("*").alias("mult"), F.min("vec_id").alias("first_id"), F.first("v").alias("v")))
    found = cut(near_links(classes, cosine, block, grid, chunk))
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "mult", "first_id").join(n, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    lowest = named.where("root is not null").groupBy("root").agg(F.min("first_id").alias("low"))
    named = named.join(lowest, "root", "left").select("id", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("low")).alias("component_id"))
    rows = own.select("vec_id", "id")
    linked = rows.where("id is not null").join(named, "id").select("vec_id", "n_links", "component_id")
    alone = rows.where("id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
