"""Nearest neighbours by a block matrix join.

Unit vectors are rounded to int8 with a scale each. Query blocks and candidate blocks meet in tiles; the tile is one
integer-valued matrix product, and the norms of the rounding residuals bound the error of each product:
|q.c - Q.C| <= |q - Q| |C| + |q| |c - C|. A pair survives if its upper bound reaches the k-th best lower bound of its
query. Survivors are recomputed in float inside the tile, whose bounds are narrower by orders of magnitude, so a tile sends on k pairs a query and those that tie
to float precision, also where all vectors lie closer together than the rounding to int8. What is left over all tiles is computed again in double precision on the original
vectors and the best k are merged by bounded heaps (rank limits that Spark applies before and after the shuffle).
The bounds never lose a true neighbour, so the result is exact.

Each vector (int8 and float32) is sent once for each block of the other side: block sizes are the memory knob (a tile works in pieces of
`STEP` candidates). Equal vectors tie exactly, so only the k + 1 smallest ids of each distinct vector are candidates; a
vector shared by a third of the table costs k + 1 rows.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without an id take
no part; of rows that share an id the smallest vector counts; vectors of other lengths never meet; fewer than k
candidates give fewer rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.common import stored

K = 5
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
STEP = 2048
SLACK = 1e-6  #: covers the rounding of the bounds themselves
FLOAT = 1e-6  #: bound of the error of products of unit vectors rounded to float32, summed in double precision
EXACT = 1024  #: components whose int8 products float32 adds up exactly
PAIRS = 1 << 16  #: survivors that are recomputed at once


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding as array<double>), one row an id."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0)) \
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _quantised(batches):
    for batch in batches:
        vec = batch.column("embedding")
        flat, off = vec.flatten().to_numpy(zero_copy_only=False), np.diff(vec.offsets.to_numpy())
        dim = int(off[0]) if len(off) else 0
        if len(off) and (off == dim).all():
            parts = [flat.reshape(-1, dim)]
        else:
            parts = [p[None, :] for p in np.split(flat, np.cumsum(off)[:-1])]
        code, unit, size, lost = [], [], [], []
        for x in parts:
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            scale = np.abs(x).max(1, keepdims=True) / 127
            c = np.rint(x / scale).astype(np.int8)
            code += [r.tobytes() for r in c]
            unit += [r.tobytes() for r in x.astype(np.float32)]
            size.append(scale[:, 0])
            lost.append(np.linalg.norm(x - c * scale, axis=1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(off, pa.int32()), pa.array(code, pa.binary()), pa.array(unit, pa.binary()), pa.array(np.concatenate(size) if size else [], pa.float64()),
             pa.array(np.concatenate(lost) if lost else [], pa.float64())], names=["vec_id", "dim", "code", "unit", "scale", "lost"])


def _matrix(t: pa.Table):
    ids = t.column("vec_id").to_numpy()
    code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32)
    unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float32).reshape(len(ids), -1)
    return ids, code, unit, t.column("scale").to_numpy(), t.column("lost").to_numpy()


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes."""
    return sum((q[:, a:a + EXACT] @ c[:, a:a + EXACT].T).astype(np.float64) for a in range(0, q.shape[1], EXACT))


def _recomputed(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[np.einsum("pd,pd->p", q[i[a:a + PAIRS]], c[j[a:a + PAIRS]], dtype=np.float64) for a in range(0, len(i), PAIRS)]])


def _best(i: np.ndarray, score: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) best scores of each row, largest first; -2 where there are fewer."""
    order = np.lexsort((-score, i))
    i, score = i[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    out = np.full((rows, k), -2.0)
    out[i[nth < k], nth[nth < k]] = score[nth < k]
    return out


def _tile(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "low": [], "high": []}
        if left.num_rows and right.num_rows:
            q_id, q, q_unit, q_scale, q_lost = _matrix(left)
            c_id, c, c_unit, c_scale, c_lost = _matrix(right)
            best = np.full((len(q_id), k), -2.0)
            i, v, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for a in range(0, len(c_id), STEP):
                b = slice(a, a + STEP)
                dot = _products(q, c[b]) * q_scale[:, None] * c_scale[b]
                err = q_lost[:, None] * (1 + c_lost[b]) + c_lost[b] + SLACK
                dot[q_id[:, None] == c_id[b]] = -9
                need = -np.partition(-np.concatenate([best - FLOAT, dot - err], axis=1), k - 1, axis=1)[:, k - 1]
                new, j = np.nonzero((dot + err >= need[:, None]) & (dot > -5))
                i, v, score = np.concatenate([i, new]), np.concatenate([v, c_id[b][j]]), np.concatenate([score, _recomputed(q_unit, c_unit[b], new, j)])
                best = _best(i, score, len(q_id), k)
                ok = score + FLOAT >= best[i, -1] - FLOAT
                i, v, score = i[ok], v[ok], score[ok]
            out = {"query_id": q_id[i], "vec_id": v, "low": score - FLOAT, "high": score + FLOAT}
        return pa.table({n: pa.array(x, pa.int64() if n.endswith("id") else pa.float64()) for n, x in out.items()})
    return run


def nearest(vectors: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of every row for which `is_query` (a condition on vec_id) holds."""
    base = stored(usable(vectors), "vectors")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    schema = "vec_id bigint, dim int, code binary, unit binary, scale double, lost double"
    cand = base.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).select("vec_id", "embedding")
    query = base.where(is_query)
    n_q, n_c = query.count(), base.count()
    q_blocks, c_blocks = max(1, -(-n_q // query_block)), max(1, -(-n_c // candidate_block))

    def dealt(df, own, blocks, other, others):
        r = df.mapInArrow(_quantised, schema).withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        return r.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))

    left, right = dealt(query, "qb", q_blocks, "cb", c_blocks), dealt(cand, "cb", c_blocks, "qb", q_blocks)
    pairs = stored(left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb"))
                   .applyInArrow(_tile(k), "query_id bigint, vec_id bigint, low double, high double"), "survivors")
    top = Window.partitionBy("query_id").orderBy(F.col("low").desc())
    need = pairs.select("query_id", "low", F.row_number().over(top).alias("n")).where(F.col("n") <= k) \
        .groupBy("query_id").agg(F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(-2.0)).alias("need"))
    left_over = pairs.join(need, "query_id").where(F.col("high") >= F.col("need")).select("query_id", "vec_id")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def unit(c):
        m = F.array_max(F.transform(c, F.abs))
        x = F.transform(c, lambda v: v / m)
        return F.struct(x.alias("x"), F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)).alias("n"))

    both = left_over.join(base.select("vec_id", unit(F.col("embedding")).alias("c")), "vec_id") \
        .join(query.select(F.col("vec_id").alias("query_id"), unit(F.col("embedding")).alias("q")), "query_id")
    score = both.select("query_id", "vec_id", F.col("q.x").alias("a"), F.col("c.x").alias("b"), (F.col("q.n") * F.col("c.n")).alias("norm")) \
        .select("query_id", "vec_id", (dot / F.col("norm")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
