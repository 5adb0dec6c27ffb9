"""Nearest neighbours by largest inner product as a block matrix join (operator 6).

1. Quantise: every vector becomes one int8 row with a scale of its own, the norm of its quantisation error and the norm of what
   it stands for. Only these rows, an eighth of the vectors' size, are dealt out to blocks.
2. Tiles: queries and candidates are dealt into blocks by a hash of their id, and each pair of blocks is one task: a
   product of int8 tiles approximates every inner product, and with the norms of the quantisation errors,

       |q.x - q'.x'| <= |q| |x - x'| + |q - q'| |x'|,

   gives bounds. Pairs whose upper bound reaches the query's k-th largest lower bound of the tile survive.
3. Merge: a query's k-th largest lower bound over all its tiles cuts the survivors once more.
4. Recheck: surviving pairs meet the original vectors by id and are recomputed in double precision, products added from the first
   component to the last; bounded heaps, one for each query and share of its pairs, then one for each query, keep the k best.

The bounds hold for every pair, so the result is exact: no candidate of the final list can be missed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; a query meets only
vectors of its own dimension. A query's own id is never its answer. Rows repeating an id count once, with the
smallest vector. With fewer than k candidates all are returned. Ties go to the smaller id. Extra columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.llm.common import saved, tidy

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
#: Pairs of a query that one heap looks through before its best go on to the query's own.
SHARE = 4096
#: Over the rounding of the bounds themselves, which are computed in double precision.
_SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the errors and of the quantised rows."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added from left to right."""
    return np.cumsum(q * x, axis=1)[:, -1] if q.shape[1] else np.zeros(len(q))


def tile(left: dict[str, np.ndarray], right: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, lower and upper bounds) of the pairs of a tile that can be among the query's k best. ``left`` and ``right``
    hold id, rows (int8), scale, error, back (norm of the quantised row) and norm."""
    kind = np.float32 if left["rows"].shape[1] <= 1000 else np.float64  # sums of products below 2**24 are exact
    across = right["rows"].T.astype(kind)
    ids, out = right["id"], []
    step = max(1, 4_000_000 // max(1, len(ids)))
    for lo in range(0, len(left["id"]), step):
        own = {c: v[lo : lo + step] for c, v in left.items()}
        near = (own["rows"].astype(kind) @ across).astype(np.float64) * (own["scale"][:, None] * right["scale"])
        bound = (own["norm"][:, None] * right["error"] + own["error"][:, None] * right["back"]) * (1 + _SLACK) + _SLACK * own["norm"][:, None] * (right["back"] + right["error"])
        itself = own["id"][:, None] == ids
        low = np.where(itself, -np.inf, near - bound)
        kth = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own["id"]), -np.inf)
        i, j = np.nonzero((near + bound >= kth[:, None]) & ~itself)
        out.append((own["id"][i], ids[j], low[i, j], (near + bound)[i, j]))
    return tuple(np.concatenate([o[n] for o in out]) if out else np.empty(0, np.int64 if n < 2 else float) for n in range(4))


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_QUANTISED = "id long, dim int, rows binary, scale double, error double, back double, norm double"


def _quantise(batches):
    import pyarrow as pa

    for batch in batches:
        dims = batch.column(2).to_numpy()
        for dim in np.unique(dims).tolist():  # a matrix for each dimension
            some = batch.filter(pa.array(dims == dim))
            x = _matrix(some.column(1))
            q, scale, error, back = quantised(x)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(2), pa.array([r.tobytes() for r in q], pa.binary()), *map(pa.array, (scale, error, back, np.linalg.norm(x, axis=1)))],
                ["id", "dim", "rows", "scale", "error", "back", "norm"],
            )


def _side(table) -> dict[str, np.ndarray]:
    side = {c: table[c].to_numpy() for c in ("id", "scale", "error", "back", "norm")}
    return side | {"rows": np.frombuffer(b"".join(table["rows"].to_pylist()), np.int8).reshape(len(side["id"]), -1)}


def _tiles(k: int):
    def run(left, right):
        import pyarrow as pa

        found = tile(_side(left), _side(right), k) if left.num_rows and right.num_rows else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * 2
        return pa.table(dict(zip(("query_id", "vec_id", "low", "high"), map(pa.array, found))))

    return run


def _scores(batches):
    import pyarrow as pa

    for batch in batches:
        q, v, dims = batch.column(2), batch.column(3), batch.column(4).to_numpy()
        scores = np.empty(len(dims))
        for dim in np.unique(dims).tolist():
            own = pa.array(dims == dim)
            scores[dims == dim] = exact(_matrix(q.filter(own)), _matrix(v.filter(own)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["query_id", "vec_id", "score"])


def _merge(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for query, ids, scores in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                best = heapq.nsmallest(k, zip((-s for s in scores), ids))
                out += [(query, n, v, -s) for n, (s, v) in enumerate(best, 1)]
            a, b, c, d = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return run


_RANKED = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and v is not null").filter((F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by ``every``."""
    rows = saved(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "nearest-rows")
    small = saved(rows.select("id", "v", "dim").mapInArrow(tidy("nearest", _quantise), _QUANTISED), "nearest-int8")
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    n, n_queries = small.agg(F.count("*"), F.count_if(is_query)).first()
    n_blocks, n_query_blocks = max(1, -(-n // candidate_block)), max(1, -(-n_queries // query_block))

    def spread(block: int) -> F.Column:
        return F.pmod(F.xxhash64("id"), F.lit(block)).cast("int")

    left = small.filter(is_query).withColumns({"i": spread(n_query_blocks), "j": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))})
    right = small.withColumns({"j": spread(n_blocks), "i": F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))})
    found = left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j")).applyInArrow(_tiles(k), "query_id long, vec_id long, low double, high double")
    found = saved(found, "nearest-found")

    # the k-th largest lower bound of a query, from the k largest of each share of its pairs
    share = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.lit(n_blocks * k) / SHARE))).cast("int")
    by_bound = Window.partitionBy("query_id", "share").orderBy(F.col("low").desc())
    top = found.withColumn("share", share).withColumn("r", F.row_number().over(by_bound)).filter(F.col("r") <= k)
    floors = top.groupBy("query_id").agg(F.sort_array(F.collect_list("low"), asc=False).alias("lows")).select("query_id", F.get("lows", F.lit(k - 1)).alias("floor"))
    left_over = found.join(floors, "query_id").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query_id", "vec_id")

    queries = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "dim")
    pairs = left_over.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(queries, "query_id")
    scored = pairs.select("query_id", "vec_id", "q", "v", "dim").mapInArrow(tidy("nearest", _scores), "query_id long, vec_id long, score double")
    lists = scored.groupBy("query_id", share.alias("share")).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("score").alias("scores"))
    firsts = lists.select("query_id", "ids", "scores").mapInArrow(tidy("nearest", _merge(k)), _RANKED)
    lists = firsts.groupBy("query_id").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("score").alias("scores"))
    return lists.mapInArrow(tidy("nearest", _merge(k)), _RANKED)
