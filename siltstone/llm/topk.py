"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging.

Queries and rows are packed into tiles (one binary matrix per row, of the narrowest numbers that
hold its components), each query tile meets each row tile once, a matrix product scores the pair
block by block, and the k best per query leave it. Lists are merged FAN_IN tiles at a time until
one list per query is left. What is shipped are the rows once for each query tile and the queries
once for each row tile, so tiles are as large as a task holds, but not fewer than there are cores.

Defined cases: a vector that is null, empty, or holds a component that is null or not finite, before
or after scaling, takes no part, nor does a null id; a product beyond the range of a long counts as
the nearest end of it, and products between are exact; an empty table gives no rows; columns
beside vec_id and embedding are not looked at; vectors of different lengths are not compared; of rows that repeat an
id the smallest vector counts; ties go to the smaller id; a query with fewer than k candidates
gets all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

SCALE, TILE, QUERY_TILE, FAN_IN = 256, 1 << 16, 1 << 14, 16
#: Bytes of a tile's numbers, as doubles.
TILE_BYTES = 64 << 20
#: Rows of a tile and queries that one product takes.
BLOCK, QUERY_BLOCK = 8192, 256
ENDS = -(2**63), 2**63 - 1


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (whole numbers as doubles), one row per id."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0)).where(~bad)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def packed(rows: DataFrame, tiles: int, schema: str) -> DataFrame:
    """dim, tile, ids, kind (of numbers), mat: the rows of a tile as one matrix."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        mat = np.floor(SCALE * np.stack(pdf["v"].to_numpy()).astype(np.float64))
        most = np.abs(mat).max(initial=0)
        mat = mat.astype(np.int16) if most < 2**15 else mat.astype(np.int32) if most < 2**31 else mat
        names = ["dim", schema, f"{schema}_ids", f"{schema}_kind", f"{schema}_mat"]
        return pd.DataFrame([[key[0], key[1], pdf["vec_id"].to_numpy(np.int64).tobytes(), mat.dtype.str, mat.tobytes()]], columns=names)

    rows = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int").alias("tile"))
    return rows.groupBy("dim", "tile").applyInPandas(pack, f"dim int, {schema} int, {schema}_ids binary, {schema}_kind string, {schema}_mat binary")


def score_pairs(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            q_ids, r_ids = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.r_ids, np.int64)
            q = np.frombuffer(row.q_mat, np.dtype(row.q_kind)).reshape(len(q_ids), row.dim)
            r = np.frombuffer(row.r_mat, np.dtype(row.r_kind)).reshape(len(r_ids), row.dim)
            # products of whole numbers are exact in doubles below 2**53
            exact = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(r.astype(np.float64)).max(initial=0)) * row.dim < 2.0**53
            for at in range(0, len(q_ids), QUERY_BLOCK):
                qi, kept = q_ids[at : at + QUERY_BLOCK], []
                for to in range(0, len(r_ids), BLOCK):
                    rows, ri = r[to : to + BLOCK], r_ids[to : to + BLOCK]
                    s = q[at : at + QUERY_BLOCK].astype(np.float64) @ rows.astype(np.float64).T if exact else long_products(q[at : at + QUERY_BLOCK], rows)
                    i, j = pick(s, qi, ri, k)
                    kept.append(pd.DataFrame({"query_id": qi[i], "tile": row.r, "vec_id": ri[j], "score": s[i, j].astype(np.int64)}))
                every = pd.concat(kept).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                yield every[every.groupby("query_id").cumcount() < k]


def long_products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers of any size, within the range of a long."""
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, r)]
    return np.clip(whole[0] @ whole[1].T, *ENDS)


def pick(s: np.ndarray, q_ids: np.ndarray, r_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each query, its own id left out."""
    own = q_ids[:, None] == r_ids[None, :]
    if s.dtype == object:
        order = [sorted((j for j in range(len(r_ids)) if not own[i, j]), key=lambda j, i=i: (-s[i, j], r_ids[j]))[:k] for i in range(len(q_ids))]
        return np.array([i for i, o in enumerate(order) for _ in o], int), np.array([j for o in order for j in o], int)
    s = np.where(own, -np.inf, s)
    if len(r_ids) > k:
        least = np.partition(s, len(r_ids) - k, axis=1)[:, len(r_ids) - k]
    else:
        least = np.full(len(q_ids), -np.inf)
    i, j = np.nonzero((s >= least[:, None]) & ~own)
    order = np.lexsort((r_ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    turn = np.arange(len(i)) - np.searchsorted(i, i)
    return i[turn < k], j[turn < k]


def search(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest inner product for each query."""
    (n_rows, dim), n_queries = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # a tile is one group of doubles in a task, so its rows are bounded by their bytes too
    most = max(1, TILE_BYTES // (8 * (dim or 1)))
    r_tiles, q_tiles = max(1, -(-n_rows // min(TILE, most)), min(2 * cores, -(-n_rows // BLOCK))), max(1, -(-n_queries // min(QUERY_TILE, most)))
    r = packed(rows, r_tiles, "r")
    q = packed(queries, q_tiles, "q")
    pairs = r.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1)))).join(q, ["dim", "q"])
    pairs = pairs.select("dim", "r", "r_ids", "r_kind", "r_mat", "q_ids", "q_kind", "q_mat").repartition(r_tiles * q_tiles, "r", F.crc32("q_ids"))
    lists = pairs.mapInPandas(lambda b: score_pairs(b, k), "query_id bigint, tile int, vec_id bigint, score bigint")
    left = r_tiles
    while True:
        left = -(-left // FAN_IN)
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN).cast("int"))
        order = W.partitionBy("query_id", "tile").orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if left <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(valid(table(spark, sf_dir, "embeddings")), "vectors")
    return search(rows.where("vec_id % 50 = 0"), rows, 5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM e q JOIN e r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id),
t AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
