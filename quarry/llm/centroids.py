"""Centroid clustering by annulus search, on integer vectors, so that results are exact and the same on every machine.

A centroid at distance d or less of a vector has a norm within d of the vector's. The centroids are sorted by norm; a binary search gives
a first candidate, whose distance bounds the annulus, and two more give the candidates whose norms lie in it. Only those are compared, exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Numbers that all centroids may have together: they travel with each task.
MOST = 1 << 22
#: Components beyond this count as it, and distances beyond a long as the largest long; no measurable distance is changed by that.
CLIP = 1 << 40
_LONGEST = (1 << 63) - 1
#: Vectors compared at a time.
_ROWS = 4096


def kept(embedding: Column, dims: int = DIMS) -> Column:
    """Vectors of dims components, none null or non-finite."""
    return F.coalesce((F.size(embedding) == dims) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, x: the components floor(scale * x) as 64-bit integers in a binary column."""

    def run(batches):
        for batch in batches:
            rows = batch.column("embedding")
            x = np.asarray(rows.flatten(), np.float64).reshape(-1, dims)
            x = np.clip(np.floor(x * scale), -CLIP, CLIP).astype("<i8")
            yield pa.record_batch([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, x binary")


class Annuli:
    """Centroids sorted by norm, ready to find the nearest of each vector."""

    def __init__(self, centroids: np.ndarray):
        self.whole = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.most = int(np.abs(centroids).max(initial=0))

    def _distances(self, x: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """Squared distances of rows of x to centroid k (or each row's own): exact, as floats where those suffice, else as Python's integers."""
        most = max(self.most, int(np.abs(x).max(initial=0)))
        if 4 * most * most * x.shape[1] < 1 << 53:
            gap = x.astype(np.float64) - self.whole[k]
            return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
        gap = x.astype(object) - self.whole[k]
        return (gap * gap).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller one if two are as near), squared distance, and how many centroids were compared."""
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        near = np.searchsorted(self.norms, norms)
        near = np.clip(np.where((near > 0) & (np.abs(self.norms[np.maximum(near - 1, 0)] - norms) < np.abs(self.norms[np.minimum(near, len(self.norms) - 1)] - norms)), near - 1, near), 0, len(self.norms) - 1)
        cluster = self.order[near]
        best = self._distances(x, cluster)
        # Norms and the bound are rounded; the margin is far above that, so the annulus is closed on both sides.
        bound = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-9 * norms + 1e-6
        low, high = np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")
        for at in range(int(low.min(initial=0)), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= at) & (at < high) & (near != at))
            if len(rows):
                k = self.order[at]
                d = self._distances(x[rows], k)
                better = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
                best[rows[better]], cluster[rows[better]] = d[better], k
        return cluster, np.minimum(best, _LONGEST).astype(np.int64), high - low


def _blocks(batches, dims: int):
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            yield part, np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(-1, dims)


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every non-empty centroid becomes the floor of its vectors' mean. Sums are made in each task, then by Spark: k * (dims + 1) rows."""
    k, dims = centroids.shape

    def run(batches):
        tool, sums = Annuli(centroids), np.zeros((k, dims + 1), object)
        for _, x in _blocks(batches, dims):
            cluster, _, _ = tool.nearest(x)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums[found, :dims] += np.add.reduceat(x[order], first, axis=0).astype(object) if len(found) else 0
            sums[found, dims] += np.diff(np.append(first, len(x))).astype(object)
        there = np.flatnonzero(sums[:, dims].astype(bool))
        which = np.repeat(there, dims + 1)
        yield pa.record_batch([pa.array(which, pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(there)), pa.int32()), pa.array([str(v) for v in sums[there].ravel()], pa.string())], ["cluster", "dim", "part"])

    parts = vectors.select("x").mapInArrow(run, "cluster int, dim int, part string")
    total = np.zeros((k, dims + 1), object)
    for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("part").cast("decimal(28,0)")).alias("total")).collect():
        total[r["cluster"], r["dim"]] = int(r["total"])
    out = centroids.copy()
    for c in np.flatnonzero(total[:, dims].astype(bool)):
        out[c] = [v // total[c, dims] for v in total[c, :dims]]
    return out


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and candidates (centroids compared) of every kept vector.

    Vectors of another size, or with null or non-finite components, fall out; so do null ones. Centroids start as the vectors whose
    sha256 of "seed:vec_id" is smallest (null ids last; vectors of one id in their components' order); fewer vectors give fewer clusters. Ties go to the
    smaller number. Repeated rows and null ids are vectors of their own. Empty tables give no row; other columns aren't read. Components are clipped to 2^40 and distances to the largest long,
    far beyond what embeddings hold. The centroids (clusters * dims numbers, at most MOST) travel with the tasks; the vectors, as integers, are written once to the
    shared folder and read in each round, so memory is that of a few thousand vectors a task and a lost executor costs only its tasks.
    """
    if clusters * dims > MOST:
        raise ValueError(f"clusters * dims may be {MOST} at most")
    spark = embeddings.sparkSession
    whole = embeddings.where(kept(F.col("embedding"), dims)).select("vec_id", "embedding")
    vectors = materialize(spark, _integers(whole, dims, scale), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r["x"] for r in vectors.orderBy(key.asc_nulls_last(), "x").limit(clusters).collect()]
    if not first:
        discard(spark, vectors)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, candidates int")
    centroids = np.frombuffer(b"".join(bytes(x) for x in first), "<i8").reshape(-1, dims)
    for _ in range(rounds):
        centroids = _moved(vectors, centroids)

    def run(batches):
        tool = Annuli(centroids)
        for part, x in _blocks(batches, dims):
            cluster, distance, n = tool.nearest(x)
            yield pa.record_batch([part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(n, pa.int32())], ["vec_id", "cluster", "distance", "candidates"])

    assigned = materialize(spark, vectors.mapInArrow(run, "vec_id long, cluster int, distance long, candidates int"), "assigned")
    discard(spark, vectors)
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, min(total, _LONGEST), min(sum(totals.values()), _LONGEST), names[c]) for c, total in sorted(totals.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "candidates")


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL of clustered(), all centroids compared with every vector. The vectors and centroids are in long form."""
    steps = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"v AS (SELECT r, d, CAST(floor({scale} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, (SELECT unnest(range(1, {dims + 1})) AS d))",
        f"k0 AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {clusters})",
        "c0 AS (SELECT c, d, x FROM k0 JOIN v USING (r))",
    ]
    assign = "a{0} AS (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (SELECT v.r, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS dist FROM v JOIN c{0} m ON v.d = m.d GROUP BY v.r, m.c) GROUP BY r)"
    for k in range(rounds):
        steps.append(assign.format(k))
        steps.append(f"s{k} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{k} USING (r) GROUP BY c, d)")
        steps.append(f"c{k + 1} AS (SELECT m.c, m.d, CASE WHEN s.n IS NULL THEN m.x ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS x FROM c{k} m LEFT JOIN s{k} s ON m.c = s.c AND m.d = s.d)")
    steps.append(assign.format(rounds))
    steps.append(f"names AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    steps = [s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN names USING (c)"""


ORACLE = _oracle()
