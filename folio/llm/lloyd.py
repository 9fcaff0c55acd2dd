"""Operator 11: Lloyd's rounds over two trees.

The vectors are integers. They are cut into blocks where they lie, and each block gets a cover tree: nested nets of halving
radius, every node a vector of its own. The blocks are written once. A round ships one more cover tree, that of the
centroids, and walks both down together: a pair of nodes goes when no vector below the one can have its nearest
centroid below the other. Leaves that are left are compared in integers. A task returns one row of counts and sums for
each centroid that it met, so that what a round shuffles depends on tasks and centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_tables, materialize

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors of a block, which one cover tree spans.
BLOCK = 1024
#: Components lie within this, so that squared distances of up to 64 of them fit 64 bits.
LIMIT = 1 << 26
#: Pairs whose differences are held at once.
PAIRS = 8192
#: Bounds are computed in floating point; a pair goes only when it is beyond them by more than this share.
SLACK = 1e-9

BLOCKS = "vec_ids array<bigint>, at binary, points binary, bytes int, parents binary, radii binary"


class CoverTree:
    """A cover tree over distinct integer vectors (rows of ``points``).

    ``nodes[l]`` are the vectors that are nodes at level l, each the head of its own chain downwards; ``parent[l]`` is the
    position of a node's parent among ``nodes[l - 1]``; ``radius[l]`` bounds the distance to all vectors below a node. Level
    0 is the root, at the last level every vector is a node. At level l nodes lie further than the top's radius / 2**l
    apart, and every vector lies within that of a node.
    """

    def __init__(self, points: np.ndarray, above: np.ndarray | None = None, radii: np.ndarray | None = None):
        self.points = points
        if above is None:
            above = self._nets(points)
            radii = np.zeros(above.shape, np.float64)
            for level, up in enumerate(above):
                far = np.sqrt(squared(points, points, np.arange(len(points)), up).astype(np.float64)) * (1 + SLACK)
                np.maximum.at(radii[level], up, far)
        #: above[l][i]: the node at level l that vector i lies below
        self.above, self.radii = above, radii
        self.nodes = [np.unique(up) for up in above]
        self.radius = [r[n] for r, n in zip(radii, self.nodes, strict=True)]
        self.parent = [np.zeros(1, np.int64), *(np.searchsorted(hi, up[lo]) for up, hi, lo in zip(above[:-1], self.nodes[:-1], self.nodes[1:], strict=True))]

    @staticmethod
    def _nets(points: np.ndarray) -> np.ndarray:
        """``above``: nodes are taken farthest first, a level's until every vector is within its radius."""
        n, x = len(points), points.astype(np.float64)
        square = (x * x).sum(1)
        distance = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0))
        near, owner = distance[0].copy(), np.zeros(n, np.int64)
        level_of, parent, level, cover = np.zeros(n, np.int64), np.zeros(n, np.int64), 0, float(near.max())
        taken = np.zeros(n, bool)
        taken[0] = True
        while cover > 0 and not taken.all():
            level, cover, before = level + 1, cover / 2, owner.copy()
            while near[new := int(near.argmax())] > cover:
                taken[new], level_of[new], parent[new] = True, level, before[new]
                closer = distance[new] < near
                near[closer], owner[closer] = distance[new][closer], new
            if cover < 1e-6 * (1 + float(distance.max())):
                break
        if not taken.all():  # rounding has made different vectors one
            level += 1
            level_of[~taken], parent[~taken] = level, owner[~taken]
        above = np.empty((level + 1, n), np.int64)
        up = np.arange(n)
        for i in range(level, -1, -1):
            above[i] = up
            up = np.where(level_of[up] == i, parent[up], up) if i else up
        return above

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of nodes at ``level`` + 1 in order of their parents, and where each parent's begin."""
        order = np.argsort(self.parent[level + 1], kind="stable")
        return order, np.searchsorted(self.parent[level + 1][order], np.arange(len(self.nodes[level]) + 1))


def squared(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the rows a[i] and b[j], exact."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), PAIRS):
        d = a[i[lo : lo + PAIRS]].astype(np.int64) - b[j[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def _expand(pair: np.ndarray, other: np.ndarray, children: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once for each child of its node ``pair``."""
    order, begin = children
    count = (begin[1:] - begin[:-1])[pair]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return order[np.repeat(begin[pair], count) + within], np.repeat(other, count)


def nearest(vectors: CoverTree, centroids: CoverTree, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the number of its nearest centroid (of equally near ones the least) and the squared distance.

    The third value counts the pairs of single vectors and centroids that had to be compared.
    """
    v, c, lv, lc = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        leaf = lv == len(vectors.nodes) - 1 and lc == len(centroids.nodes) - 1
        d2 = squared(vectors.points, centroids.points, vectors.nodes[lv][v], centroids.nodes[lc][c])
        if leaf:
            break
        d, wide = np.sqrt(d2.astype(np.float64)), vectors.radius[lv][v]
        least = np.full(len(vectors.nodes[lv]), np.inf)
        np.minimum.at(least, v, (d + wide) * (1 + SLACK))  # a node of the second tree is a centroid itself
        keep = (d - wide - centroids.radius[lc][c]) * (1 - SLACK) <= least[v]
        v, c = v[keep], c[keep]
        if lv < len(vectors.nodes) - 1:
            v, c = _expand(v, c, vectors.children(lv))
            lv += 1
        if lc < len(centroids.nodes) - 1:
            c, v = _expand(c, v, centroids.children(lc))
            lc += 1
    k, point = number[centroids.nodes[lc][c]], vectors.nodes[lv][v]
    order = np.lexsort((k, d2, point))
    first = order[np.searchsorted(point[order], np.arange(len(vectors.points)))]
    return k[first], d2[first], len(order)


def _block(ids: list, rows: np.ndarray) -> dict:
    if len(rows) and int(np.abs(rows).max()) > LIMIT:
        raise ValueError(f"a vector's scaled component lies beyond {LIMIT}: its squared distances don't fit a long")
    points, at = np.unique(rows, axis=0, return_inverse=True)
    tree = CoverTree(points)
    size = 2 if not len(points) or int(np.abs(points).max()) < 1 << 15 else 4
    radii = np.nextafter(tree.radii.astype(np.float32), np.float32(np.inf))
    return {"vec_ids": ids, "at": at.reshape(-1).astype(np.int16).tobytes(), "points": points.astype(f"i{size}").tobytes(), "bytes": size, "parents": tree.above.astype(np.int16).tobytes(), "radii": radii.tobytes()}


def _blocks(width: int, scale: int):
    """Blocks of vectors with their trees, from rows (vec_id, embedding)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], np.empty((0, width), np.int64)
        schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("at", pa.binary()), ("points", pa.binary()), ("bytes", pa.int32()), ("parents", pa.binary()), ("radii", pa.binary())])
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            if len(values) and np.abs(values).max() * scale > LIMIT + 1:
                raise ValueError(f"a vector's scaled component lies beyond {LIMIT}: its squared distances don't fit a long")
            ids, rows = ids + b.column(0).to_pylist(), np.concatenate([rows, np.floor(scale * values).astype(np.int64)])
            while len(ids) >= BLOCK:
                yield pa.RecordBatch.from_pylist([_block(ids[:BLOCK], rows[:BLOCK])], schema)
                ids, rows = ids[BLOCK:], rows[BLOCK:]
        if ids:
            yield pa.RecordBatch.from_pylist([_block(ids, rows)], schema)

    return make


def _read(row: dict, width: int) -> tuple[CoverTree, np.ndarray]:
    points = np.frombuffer(row["points"], f"i{row['bytes']}").astype(np.int64).reshape(-1, width)
    above = np.frombuffer(row["parents"], np.int16).astype(np.int64).reshape(-1, len(points))
    radii = np.frombuffer(row["radii"], np.float32).astype(np.float64).reshape(-1, len(points))
    return CoverTree(points, above, radii), np.frombuffer(row["at"], np.int16).astype(np.int64)


def centroid_tree(centroids: list[list[int]]) -> tuple[CoverTree, np.ndarray]:
    """The tree of the distinct centroids, and for each the least number that it has."""
    points, first = np.unique(np.array(centroids, np.int64), axis=0, return_index=True)
    return CoverTree(points), first


def _sums(centroids: list[list[int]]):
    """One row (cluster, n, sums) for each centroid that a task's vectors are nearest to."""
    width, k = len(centroids[0]), len(centroids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = centroid_tree(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for row in b.to_pylist():
                block, at = _read(row, width)
                cluster, _, _ = nearest(block, tree, number)
                copies = np.bincount(at, minlength=len(cluster))
                np.add.at(n, cluster, copies)
                np.add.at(sums, cluster, block.points * copies[:, None])
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "n": pa.array(n[met]), "sums": pa.array(list(sums[met]), pa.list_(pa.int64()))})

    return count


def _assigned(centroids: list[list[int]]):
    width = len(centroids[0])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = centroid_tree(centroids)
        for b in batches:
            for row in b.to_pylist():
                block, at = _read(row, width)
                cluster, d2, _ = nearest(block, tree, number)
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(row["vec_ids"], pa.int64()), "cluster": pa.array(cluster[at], pa.int32()), "distance": pa.array(d2[at])})

    return rows


def lloyd(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector of ``vectors`` (vec_id, embedding), and the centroids.

    Vectors with other than ``width`` components, or with null, infinite or undefined ones, are left out, null vectors too; a
    component x becomes floor(scale * x). The first centroids are the ``k`` vectors of least sha256 of ``seed:vec_id``;
    a null id counts as an empty one there, and of equal ids the vector that sorts first comes first. Fewer vectors than
    ``k`` give as many centroids, none give no rows. An emptied cluster keeps its centroid; of equally near centroids
    the smaller number wins. Repeated rows stay rows; further columns play no part. A component beyond 2**26 after scaling
    is an error, as distances would not fit a long.
    """
    spark = vectors.sparkSession
    whole = F.col("embedding").cast("array<double>")
    fine = (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding")).filter(fine)
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(place, "embedding").limit(k).select(F.transform("embedding", lambda x: F.floor(scale * x).cast("long")).alias("c")).collect()  # k rows
    centroids = [list(r["c"]) for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    if max(abs(x) for c in centroids for x in c) > LIMIT:
        raise ValueError(f"a vector's scaled component lies beyond {LIMIT}: its squared distances don't fit a long")
    blocks = materialize(kept.mapInArrow(_blocks(width, scale), BLOCKS), "blocks")
    for _ in range(rounds):
        parts = blocks.mapInArrow(_sums(centroids), "cluster int, n bigint, sums array<bigint>")
        each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        for r in each.collect():  # one row a centroid
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    out = materialize(blocks.mapInArrow(_assigned(centroids), "vec_id bigint, cluster int, distance bigint"), "assigned")
    drop_tables(blocks)
    return out, centroids


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: see :func:`lloyd`."""
    rows, centroids = lloyd(vectors)
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    known = vectors.sparkSession.createDataFrame([(i, sha(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    each = rows.groupBy("cluster").agg(exact("distance").alias("s"))
    every = each.agg(exact("s").cast("long").alias("inertia"))  # one row
    facts = each.join(known, "cluster").crossJoin(every).select("cluster", F.col("s").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def _sql() -> str:
    """The rounds as one chain of table expressions, a row for each component."""
    tables = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {WIDTH})",
        f"v AS MATERIALIZED (SELECT r, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {WIDTH + 1}) AS t(i))",
        f"firsts AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS k FROM kept QUALIFY k < {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT k, i, x FROM firsts JOIN v USING (r))",
    ]
    for n in range(ROUNDS + 1):
        tables.append(f"a{n} AS MATERIALIZED (SELECT r, k, d FROM (SELECT v.r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} AS c USING (i) GROUP BY v.r, c.k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < ROUNDS:
            tables.append(f"c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN (SELECT k, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{n} JOIN v USING (r) GROUP BY k, i) AS m USING (k, i))")
    tables.append(f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c{ROUNDS} GROUP BY k)")
    return f"""WITH {', '.join(tables)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN h USING (k)"""


SQL = _sql()
