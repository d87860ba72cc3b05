"""Nearest neighbours by inner product, with randomly rotated one-bit codes.

A vector o is padded to a multiple of 64 dimensions, divided by its length and
rotated by a fixed random rotation; the signs of the result, packed into bits,
are its code.  With x the code's unit vector (entries +-1/sqrt(D)), <o, x> is
kept beside the code as the correction scalar, and

    <q, o> ~ |o| * <Rq, x> / <o/|o|, x>

is an unbiased estimate whose error exceeds
``slack * |q| |o| sqrt((1 - <o,x>^2) / <o,x>^2) / sqrt(D - 1)`` only rarely.
A query's threshold is the worst exact score of the ``k`` vectors with the best
estimates; every vector whose estimate plus its error bound reaches it is
scored exactly on the original vectors, in double precision.

Vectors and queries are hashed into blocks of bounded size, and each pair of a
query block and a vector block is one group of an equi-join; its ``k`` best
per query are merged at the end.  Nothing is fitted to the data (the rotation
depends on the dimension only), so every row is in the index.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components take no part, neither do null ids; vectors of another dimension are
no candidates of a query.  A query's own id is no candidate.  Ties go to the
smaller id; a candidate id that comes up in several rows is ranked for each.
Rows of one query id share one ranked list of ``k``; equal ones are one query.  With fewer than
``k`` candidates, all are returned.  Only ``id_col`` and ``vector_col`` are
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK, QUERY_BLOCK = 16_384, 1024


def rotation(dim: int, seed: int = 6) -> np.ndarray:
    """A random rotation of the padded space (rows: the images' axes)."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def codes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, correction scalars <o/|o|, x>, and lengths."""
    lengths = np.linalg.norm(vectors, axis=1)
    turned = (vectors / lengths[:, None]) @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(turned.shape[1]), lengths


def search_block(query_ids, queries, ids, vectors, k: int, slack: float):
    """(query, id, score) of up to ``k`` best vectors for each query."""
    packed, scalars, lengths = codes(vectors)
    size = packed.shape[1] * 8
    signs = np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1
    error = lengths * np.sqrt(np.maximum(1 - scalars ** 2, 0)) / scalars / math.sqrt(size - 1) * slack
    turned = (queries @ rotation(vectors.shape[1]).T).astype(np.float32)
    order = np.argsort(ids, kind="stable")  # so that ties end in the smaller id
    ids, vectors, signs, error = ids[order], vectors[order], signs[order], error[order]
    gain = (lengths / scalars)[order] / math.sqrt(size)
    out_q, out_i, out_s = [], [], []
    for begin in range(0, len(queries), 64):
        estimates = (turned[begin:begin + 64] @ signs.T) * gain
        for row, query in enumerate(queries[begin:begin + 64]):
            mine = query_ids[begin + row]
            estimate = np.where(ids == mine, -np.inf, estimates[row])
            others = int((ids != mine).sum())
            if not others:
                continue
            best = np.argpartition(-estimate, min(k, others) - 1)[:min(k, others)]
            threshold = (vectors[best] @ query).min()
            near = np.flatnonzero(estimate + error * np.linalg.norm(query) >= threshold)
            near = np.union1d(near, best)
            exact = (vectors[near] * query).sum(1)
            top = np.argsort(-exact, kind="stable")[:k]
            out_q += [mine] * len(top)
            out_i += ids[near[top]].tolist()
            out_s += exact[top].tolist()
    return out_q, out_i, out_s


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, slack: float = 1.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest rows
    of each row for which ``is_query`` (on ``id_col``) holds."""
    vector = F.col(vector_col).cast("array<double>")
    rows = (vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), vector.alias("v"))
            .where(_usable(F.col("v"))).withColumn("dim", F.size("v")))
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()  # one row
    blocks, query_blocks = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    # Keys of both sides are longs: a cogroup does not bring their types together.
    def deal(n):
        return F.pmod(F.xxhash64("id", "v"), F.lit(n).cast("long"))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    base = rows.withColumn("b", deal(blocks)).withColumn("qb", every(query_blocks)).select("dim", "b", "qb", "id", "v")
    asks = (rows.where("q").dropDuplicates(["id", "v"]).withColumn("qb", deal(query_blocks)).withColumn("b", every(blocks))
            .select("dim", "b", "qb", "id", "v"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()

            def matrix(t):
                flat = t.column("v").combine_chunks().flatten()
                return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)

            found = search_block(left.column("id").to_numpy(), matrix(left), right.column("id").to_numpy(), matrix(right), k, slack)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = (asks.groupBy("dim", "b", "qb").cogroup(base.withColumnRenamed("b", "b2").withColumnRenamed("qb", "qb2").groupBy("dim", "b2", "qb2"))
             .applyInArrow(search, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
