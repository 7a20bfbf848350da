"""Exact top-k inner products by pivot-table elimination.

Vectors of integers; the score is the inner product, so score = (|q|^2 + |v|^2 - d(q, v)^2) / 2. The distances of every
vector to ``PIVOTS`` pivots are computed once, where the vectors are read. For a query and a candidate the largest
difference of their distances to any pivot is a lower bound of d(q, v), which bounds the score from above; candidates
are evaluated in falling order of that bound until the k-th best score exceeds the next bound.

Queries against all rows go in blocks: candidates are dealt by id into ``cells``, queries into groups, and a cell works
on one pair of them; memory is bounded by the size of a cell. A candidate is sent once for each query group, a query
once for each candidate cell, and each cell returns at most k rows a query; a window takes the k best of those.

Edge cases: null vectors, and vectors with a null or non-finite component or of another length than the
commonest, take no part. Rows that repeat both id and vector count once; a query's own row is told by its id, so other vectors of that
id are left out with it. Ties go to the smaller id. Fewer than k candidates give all of them; an empty table an empty
result. Scores beyond 64 bits are held at the bounds of long. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 24
#: Most candidates and queries of a cell, about.
CELL_ROWS, CELL_QUERIES = 16_384, 4096
SCALE = 64


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every vector whose components are all finite."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def pivots_of(rows: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """At most ``most`` vectors of the commonest length above 0 (the smaller of equally common ones), chosen by hash:
    the only rows that reach the driver."""
    sizes = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return np.zeros((0, 0), dtype=np.int64)
    held = rows.filter(F.size("v") == sizes[0].n).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).collect()
    return np.array([r.v for r in held], dtype=np.int64)


def with_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, d): vectors and their distances to the pivots, packed as binary."""
    p = pivots.astype(np.float64)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            right = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == p.shape[1])
            v = np.array(lists.take(pa.array(right)).flatten().to_numpy(), dtype=np.int64).reshape(len(right), p.shape[1])
            d = np.sqrt(((v[:, None, :].astype(np.float64) - p[None]) ** 2).sum(axis=2)) if len(right) else np.zeros((0, len(p)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(right)), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in d], pa.binary())], ["vec_id", "v", "d"]
            )

    return rows.mapInArrow(measured, "vec_id long, v binary, d binary")


class Rows:
    """Integer vectors with exact inner products, in the narrowest float that holds every partial sum exactly."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.norms = (v.astype(np.float64) ** 2).sum(axis=1)
        top = self.norms.max(initial=0.0)
        # a partial sum of products of two vectors is at most the larger squared norm
        self.kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else None
        self.wide = v.astype(self.kind) if self.kind else None

    def products(self, other: Rows, i: int, take: np.ndarray | None) -> np.ndarray:
        """Of row i of ``other`` with the rows ``take`` (None: all)."""
        if self.kind is None or other.kind is None:
            rows = self.v if take is None else self.v[take]
            q = [int(x) for x in other.v[i]]
            return np.array([min(max(sum(int(a) * b for a, b in zip(r, q, strict=True)), -(1 << 63)), (1 << 63) - 1) for r in rows], dtype=np.int64)
        q = other.wide[i].astype(np.promote_types(self.kind, other.kind))
        return ((self.wide if take is None else self.wide[take]) @ q).astype(np.int64)


def search_cell(qid: np.ndarray, q: np.ndarray, qd: np.ndarray, cid: np.ndarray, c: np.ndarray, cd: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate ids, scores): the k best candidates of each query in this cell.

    Candidates are evaluated in blocks of falling bounds, 4 k, then 64 k, then all that are left; before each block
    those whose bound is below the k-th best score so far are out, and when none is left the search is exact.
    """
    queries, rows = Rows(q), Rows(c)
    scale = max(rows.norms.max(initial=0.0), queries.norms.max(initial=0.0))
    near, ask = np.ascontiguousarray(cd.T, np.float32), qd.astype(np.float32)  # by pivot
    # rounding to single precision never lowers a bound below the score
    slack = 1 + 1e-5 * scale
    half = (rows.norms / 2).astype(np.float32)
    gap, other = np.empty(len(cid), np.float32), np.empty(len(cid), np.float32)
    out = []
    for i in range(len(qid)):
        np.abs(np.subtract(near[0], ask[i, 0], out=gap), out=gap)
        for j in range(1, len(near)):
            np.abs(np.subtract(near[j], ask[i, j], out=other), out=other)
            np.maximum(gap, other, out=gap)
        bound = half - gap * gap / 2 + np.float32(queries.norms[i] / 2 + slack)
        left = np.flatnonzero(cid != qid[i])
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for size in (4 * k, 64 * k, len(left)):
            if len(scores) == k:
                left = left[bound[left] >= scores[-1]]
            if not len(left):
                break
            if len(left) > size:
                cut = np.argpartition(bound[left], len(left) - size)
                take, left = left[cut[len(left) - size :]], left[cut[: len(left) - size]]
            else:
                take, left = left, left[:0]
            # with most rows still in, one product with all of them is cheaper than picking them out
            new = rows.products(queries, i, None)[take] if rows.kind and len(take) * 8 > len(cid) else rows.products(queries, i, take)
            if len(scores) == k:
                better = new >= scores[-1]
                take, new = take[better], new[better]
            elif len(new) > 4 * k:
                better = new >= np.partition(new, len(new) - k)[len(new) - k]
                take, new = take[better], new[better]
            ids, scores = np.concatenate([ids, cid[take]]), np.concatenate([scores, new])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        out.append((i, ids, scores))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row that ``is_query`` (a column of
    ``vec_id``) marks, its own id left out."""
    rows = integers(vectors, id_col, vector_col, scale)
    p = pivots_of(rows, pivots)
    schema = "query_id long, twin long, vec_id long, score long"
    if not len(p):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, m = p.shape[1], len(p)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    cells, groups = max(1, -(-counts.n // CELL_ROWS)), max(1, -(-counts.q // CELL_QUERIES))
    table = with_distances(rows, p)
    cell = F.pmod(F.xxhash64("vec_id"), F.lit(cells))
    group = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    as_candidates = table.withColumn("g", every(groups)).withColumn("cell", cell).withColumn("query", F.lit(False))
    as_queries = table.filter(is_query).withColumn("g", group).withColumn("cell", every(cells)).withColumn("query", F.lit(True))
    dealt = as_candidates.unionByName(as_queries).withColumn("pair", F.col("cell") * groups + F.col("g")).drop("cell", "g")

    def searched(cell_rows: pa.Table) -> pa.Table:
        # rows that repeat both id and vector count once
        t = cell_rows.group_by(["vec_id", "v", "query"]).aggregate([("d", "min")])
        ids = t["vec_id"].to_numpy()
        v = np.frombuffer(b"".join(t["v"].to_pylist()), np.int64).reshape(-1, width)
        d = np.frombuffer(b"".join(t["d_min"].to_pylist()), np.float64).reshape(-1, m)
        ask = t["query"].to_numpy(zero_copy_only=False).astype(bool)
        twin = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in v[ask]], np.int64)
        found = search_cell(ids[ask], v[ask], d[ask], ids[~ask], v[~ask], d[~ask], k)
        name, own = ids[ask], twin
        sizes = [len(s) for _, _, s in found]
        at = np.repeat([i for i, _, _ in found], sizes).astype(np.int64)
        both = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in (1, 2)]
        return pa.table({"query_id": pa.array(name[at], pa.int64()), "twin": pa.array(own[at], pa.int64()), "vec_id": pa.array(both[0], pa.int64()), "score": pa.array(both[1], pa.int64())})

    best = dealt.groupBy("pair").applyInArrow(searched, schema)
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
