"""Exact top-k by inner product with no random access.

Candidates are dealt to blocks of bounded size.  In a block each dimension is a list sorted by value, read
from its top for queries with a positive weight and from its bottom for negative ones.  After a stretch of
sorted reading, every candidate has an upper score (unread entries at the list's frontier) and a lower one
(unread entries at the list's far end).  Candidates whose upper score is under the k-th best lower score are
out; reading stops for a query when only a handful is left, whose final scores are then resolved.  Bounds
are computed for all queries of a block at once: they are products of the weights with the candidates' read
entries, filled up with frontier or far-end values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS, QUERY_ROWS = 8192, 4096
#: Shares of the lists that are read between two looks at the bounds.
DEPTHS = (0.5, 0.75, 0.875, 1.0)
LIMIT = float(2**62)


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, vec): floor(scale * x) as packed 64-bit integers, values beyond
    2**62 held there.  Rows with a null id, a null vector or a component that is null or not finite go."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(scan, "vec_id long, vec binary")


def unpack(rows: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as one matrix; shorter ones are filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        v = np.frombuffer(r, "<i8")
        out[i, : len(v)] = v
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; where they could leave 64 bits they are held at its ends."""
    most = float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0)) * max(1, len(q))
    if most < 2.0**62:
        return x @ q
    lo, hi = -(1 << 63), (1 << 63) - 1
    return np.array([min(hi, max(lo, sum(int(a) * int(b) for a, b in zip(row, q, strict=True)))) for row in x], np.int64)


def block_top_k(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: list[np.ndarray], k: int):
    """For each query the (row, score) of its k best rows of the block, ties to smaller ids.

    ``own``: rows of the block that are the query itself.
    """
    n, width = x.shape
    order = np.argsort(-x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, 0).astype(np.float64)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], 0)
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    up, down = np.maximum(qf, 0), np.minimum(qf, 0)
    size = np.abs(xf).max(initial=0) * np.abs(qf).max(initial=0) * max(width, 1)
    slack = 0.0 if size < 2.0**52 else size * max(width, 1) * 2.0**-50
    active = np.arange(len(q))
    columns = np.arange(n)
    result: list = [None] * len(q)
    for depth in DEPTHS:
        t = max(1, min(n, int(np.ceil(n * depth))))
        top_read, low_read = rank[columns] < t, rank[columns] >= n - t
        xs = xf[columns]
        upper = up[active] @ np.where(top_read, xs, lists[t - 1]).T + down[active] @ np.where(low_read, xs, lists[n - t]).T + slack
        lower = up[active] @ np.where(top_read, xs, lists[-1]).T + down[active] @ np.where(low_read, xs, lists[0]).T - slack
        for a, i in enumerate(active):
            if len(own[i]):
                at = np.flatnonzero(np.isin(columns, own[i]))
                upper[a, at] = lower[a, at] = -np.inf
        m = min(k, len(columns))
        bar = np.partition(lower, len(columns) - m, axis=1)[:, len(columns) - m]
        alive = (upper >= bar[:, None]) & (upper > -np.inf)
        left = alive.sum(1)
        stop = (left <= 8 * k) | (t == n)
        for a in np.flatnonzero(stop):
            rows = columns[alive[a]]
            score = exact_scores(x[rows], q[active[a]])
            best = np.lexsort((ids[rows], ~score))[:k]  # ~score orders as -score does, without overflow
            result[active[a]] = (rows[best], score[best])
        keep = ~stop
        if not keep.any():
            break
        columns = columns[alive[keep].any(0)]
        active = active[keep]
    return result


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: each query's k best other rows.

    Every row but the query's own is a candidate, exact repeats of the query included; a repeated query is
    answered once per row.  Of a row that repeats, no more than k + 1 copies can matter, and these are
    kept.  Vectors of different lengths are filled up with zeros.  With fewer than k candidates all are returned; an
    empty table, or one without queries, gives an empty result.  Other columns are ignored.
    """
    rows = quantized(vectors.select("vec_id", "embedding"), scale).groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "nra-vectors")
    queries = rows.filter(is_query)
    n, asked = rows.count(), queries.count()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-asked // QUERY_ROWS))
    block, part = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)), F.pmod(F.xxhash64("vec", "vec_id"), F.lit(parts))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    copied = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k + 1)))))
    candidates = copied.select("vec_id", "vec", block.alias("block"), every(parts).alias("part"))
    asking = queries.select("vec_id", "vec", every(blocks).alias("block"), part.alias("part"), "copies")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"query_id": [], "query": [], "copies": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            cand, ask = left.column("vec").to_pylist(), right.column("vec").to_pylist()
            ids, qids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            width = max(map(len, cand + ask)) // 8
            place: dict = {}
            for i, key in enumerate(zip(ids.tolist(), cand, strict=True)):
                place.setdefault(key, []).append(i)
            times = right.column("copies").to_pylist()
            own = [np.array(place.get(key, [])[:1], int) for key in zip(qids.tolist(), ask, strict=True)]
            for i, (r, s) in enumerate(block_top_k(unpack(cand, width), ids, unpack(ask, width), own, k)):
                out["query_id"] += [qids[i]] * len(r)
                out["query"] += [ask[i]] * len(r)
                out["copies"] += [times[i]] * len(r)
                out["vec_id"] += ids[r].tolist()
                out["score"] += s.tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("query", pa.binary()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    found = candidates.groupBy("block", "part").cogroup(asking.groupBy("block", "part")).applyInArrow(search, "query_id long, query binary, copies long, vec_id long, score long")
    w = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    answers = ranked.withColumn("answer", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return answers.select("query_id", "rank", "vec_id", "score")
