"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are cut into blocks of bounded size, and every pair of blocks is one group of a
shuffle. In it tiles of int8 codes are multiplied (as float32, in which such products are exact), each
cosine is bounded by the residuals of both codes, the pairs whose upper bound reaches the query's k-th
lower bound are computed in double precision, and a heap of k is kept for each query. The heaps of all
groups are merged at the end.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without vec_id; vectors meet queries of their own length only. Rows that repeat a vec_id count once
in a result, with their best score. Exact copies of a vector within a tile are compared once, which is
whole: only the k + 1 smallest ids of equal vectors can be among the k nearest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a block of queries and of candidates (as doubles), and rows of a tile.
QUERY_BYTES, CANDIDATE_BYTES, TILE_ROWS = 4 << 20, 16 << 20, 4096
#: Columns whose int8 products add up exactly in float32: 1024 x 127 x 127 < 2**24.
EXACT_COLUMNS = 1024


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Codes:
    """int8 codes of unit vectors, with what the bounds need."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of tiny or huge components neither vanish nor overflow
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        scale = np.abs(unit).max(axis=1, keepdims=True) / 127
        code = np.rint(unit / scale)
        near = code * scale
        self.code, self.scale = code.astype(np.int8), scale[:, 0]
        self.residual = np.sqrt(((unit - near) ** 2).sum(axis=1))
        self.length = np.sqrt((near * near).sum(axis=1))


def tile_bounds(q: Codes, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(approximate cosines, their error bounds): |u.v - u'.v'| <= |v - v'| + |u - u'| |v'| for unit u, v."""
    product = np.zeros((len(q.code), len(c.code)))
    for at in range(0, q.code.shape[1], EXACT_COLUMNS):
        part = slice(at, at + EXACT_COLUMNS)
        product += q.code[:, part].astype(np.float32) @ c.code[:, part].astype(np.float32).T
    product *= q.scale[:, None] * c.scale[None, :]
    return product, c.residual[None, :] + q.residual[:, None] * c.length[None, :] + 1e-9


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, components added in order, so equal rows give equal scores."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot += x * y
        aa += x * x
        bb += y * y
    with np.errstate(all="ignore"):
        out = dot / np.sqrt(aa * bb)
        odd = ~np.isfinite(out) | (aa * bb < 1e-280)  # components whose squares vanish or overflow
        if odd.any():
            a, b = (v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True) for v in (a, b))
            out[odd] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.clip(out, -1.0, 1.0)


class Search:
    """Heaps of the k nearest of each query, fed tile by tile."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.codes = ids, vectors, k, Codes(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.held: list[set[int]] = [set() for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}")[:, 0], return_inverse=True)[1]
        # rank of each row among its equals, by id; further ones than k + 1 distinct ids cannot be needed
        first = np.lexsort((ids, same))
        s, i = same[first], ids[first]
        new = np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1])]
        first, s = first[new], s[new]
        starts = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1]
        rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
        keep = first[rank <= self.k]
        ids, vectors = ids[keep], vectors[keep]
        codes = Codes(vectors)
        for at in range(0, len(self.ids), 512):
            self._tile(slice(at, min(at + 512, len(self.ids))), ids, vectors, codes)

    def _tile(self, part: slice, ids: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        q = Codes.__new__(Codes)
        q.code, q.scale, q.residual, q.length = (getattr(self.codes, n)[part] for n in ("code", "scale", "residual", "length"))
        near, error = tile_bounds(q, codes)
        own = self.ids[part][:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - error)
        floor = self.floor[part]
        if len(ids) > self.k:
            # one of the k nearest so far may have this tile's id again (a repeated row), so the tile's bound stands alone
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k]) if len(np.unique(ids)) == len(ids) else floor
        rows, cols = np.nonzero((near + error >= floor[:, None]) & ~own)
        for at in range(0, len(rows), 100_000):
            r, c = rows[at : at + 100_000], cols[at : at + 100_000]
            scores = cosine(self.vectors[part][r], vectors[c])
            for n, s, i in zip((r + part.start).tolist(), scores.tolist(), ids[c].tolist(), strict=True):
                self._push(n, s, i)
        self.floor[part] = [h[0][0] if len(h) == self.k else -np.inf for h in self.heaps[part]]

    def _push(self, n: int, score: float, i: int) -> None:
        heap, held = self.heaps[n], self.held[n]
        if len(heap) == self.k and (score, -i) <= heap[0]:
            return
        if i in held:
            old = next(e for e in heap if e[1] == -i)
            if old[0] < score:
                heap[heap.index(old)] = (score, -i)
                heapq.heapify(heap)
            return
        held.add(i)
        if len(heap) < self.k:
            heapq.heappush(heap, (score, -i))
        else:
            held.discard(-heapq.heapreplace(heap, (score, -i))[1])

    def results(self) -> Iterator[tuple[int, int, float]]:
        for q, heap in zip(self.ids.tolist(), self.heaps, strict=True):
            for s, i in heap:
                yield q, -i, s


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of vectors, its own id apart.

    Both have vec_id and embedding; other columns are not read. Queries that repeat a vec_id: the one with the smallest vector counts.
    """
    spark = vectors.sparkSession
    good = usable(vectors).select("vec_id", "embedding")
    asked = materialize(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    n, width = good.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    row = 8 * (width or 1)
    of_queries = max(1, -(-asked.count() * row // QUERY_BYTES))
    of_candidates = max(-(-n * row // CANDIDATE_BYTES), 2 * spark.sparkContext.defaultParallelism)
    # a row's place, not its id, picks the block: an id that many rows repeat is no group
    place = lambda blocks: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = asked.withColumn("q", place(of_queries)).select("vec_id", "embedding", "q", each(of_candidates).alias("c"))
    right = good.withColumn("c", place(of_candidates)).select("vec_id", "embedding", each(of_queries).alias("q"), "c")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        rows, lengths = [], c.embedding.map(len)
        for length, part in q.groupby(q.embedding.map(len)) if len(q) else ():
            there = c[lengths == length]
            if len(there):
                found = Search(part.vec_id.to_numpy(np.int64), _matrix(part.embedding), k)
                for at in range(0, len(there), TILE_ROWS):
                    tile = there[at : at + TILE_ROWS]
                    found.add(tile.vec_id.to_numpy(np.int64), _matrix(tile.embedding))
                rows += found.results()
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
