"""Exact top-k search by inner product: score histograms narrow each query's k-th value, then a filter takes the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.shared import discard, written


@dataclass(frozen=True)
class TopK:
    """``scale``: a component x becomes floor(scale * x). ``bins``: bins of one histogram.

    ``rows`` candidates and ``queries`` queries are scored against each other in one task at a time.
    """

    k: int = 20
    scale: int = 64
    bins: int = 256
    rows: int = 8192
    queries: int = 2048


LARGEST = 2.0 ** 62  # scores of vectors with a larger squared norm would not fit a long


def quantised(vectors: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, row, v, dims, norm2) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1)) < LARGEST
    return vectors.where(F.col(id).isNotNull() & v.isNotNull() & whole & fits).select(
        F.col(id).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
        F.transform(v, lambda x: F.floor(x * scale)).alias("v")).withColumn("dims", F.size("v")).withColumn(
        "norm2", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def _matrix(table: pa.Table, name: str, dims: int, kind) -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, dims).astype(kind)


def _scores(candidates: pa.Table, queries: pa.Table, exact: bool):
    """Blocks (ids of candidates, scores queries x candidates, mask of other ids)."""
    dims = queries.column("dims")[0].as_py()
    kind = np.float64 if exact else np.int64  # sums of whole numbers under 2**53 are exact as doubles
    q, ids = _matrix(queries, "v", dims, kind), queries.column("id").to_numpy()
    c, others = _matrix(candidates, "v", dims, kind), candidates.column("id").to_numpy()
    for at in range(0, len(c), 1024):
        scores = (q @ c[at: at + 1024].T).astype(np.int64)
        yield others[at: at + 1024], scores, others[None, at: at + 1024] != ids[:, None]


def top_k(vectors: DataFrame, is_query, id: str = "vec_id", vector: str = "embedding", how: TopK = TopK()) -> DataFrame:
    """(query_id, rank, id, score): each query's ``how.k`` highest inner products with the other vectors, in whole numbers.

    ``is_query`` is a condition on ``id``. All scores of a query are counted into a histogram over the range that can
    hold the k-th value; the bin that holds it is the next range, until it is one value wide. Then all scores above
    that value and the smallest ids of those equal to it are taken. Scores are computed anew in each pass, block
    against block, and never stored.

    Ties go to the smaller id. Vectors that are null, hold a null, a NaN or an infinity, have a null id or a squared
    norm that does not fit a long take no part; vectors of another length than the query are no candidates of it.
    Rows with equal ids are one query, and no candidates of it; otherwise each row is a candidate. Fewer candidates
    than k: all of them. No rows give no rows; extra columns are ignored.
    """
    data = written(quantised(vectors, id, vector, how.scale), "vectors")
    asked = data.where(is_query(F.col("id"))).groupBy("id").agg(F.min_by(F.struct("v", "dims"), "row").alias("s")).select(
        "id", "s.v", "s.dims")
    size = data.agg(F.count("*"), F.coalesce(F.max("norm2"), F.lit(0))).first()
    parts = max(1, math.ceil(size[0] / how.rows))
    lots = max(1, math.ceil(asked.count() / how.queries))
    reach, exact, k, bins = int(size[1]), size[1] < 2 ** 53, how.k, how.bins
    candidates = data.select("id", "v", "dims", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part")).withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = asked.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int"))
    at = ["dims", "part", "lot"]

    def paired(state: DataFrame, f, schema: str) -> DataFrame:
        dealt = state.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        return dealt.groupBy(*at).cogroup(candidates.groupBy(*at)).applyInArrow(f, schema)

    def counted(width: int):
        def count(queries: pa.Table, others: pa.Table) -> pa.Table:
            ids, low = queries.column("id").to_numpy(), queries.column("low").to_numpy()
            total = np.zeros(len(ids) * bins, np.int64)
            if len(ids) and others.num_rows:
                for _, scores, other in _scores(others, queries, exact):
                    place = (scores - low[:, None]) // width
                    row, column = np.nonzero((place >= 0) & (place < bins) & other)
                    total += np.bincount(row * bins + place[row, column], minlength=len(total))
            full = np.flatnonzero(total)
            return pa.table({"id": ids[full // bins], "bin": full % bins, "n": total[full]})
        return count

    def taken(queries: pa.Table, others: pa.Table) -> pa.Table:
        ids, low = queries.column("id").to_numpy(), queries.column("low").to_numpy()
        need = k - queries.column("above").to_numpy()
        out, ties = [], {}
        if len(ids) and others.num_rows:
            for found, scores, other in _scores(others, queries, exact):
                row, column = np.nonzero((scores > low[:, None]) & other)
                out.append((ids[row], found[column], scores[row, column]))
                row, column = np.nonzero((scores == low[:, None]) & other)
                for q in np.unique(row):
                    equal = np.concatenate([ties.get(q, found[:0]), found[column[row == q]]])
                    ties[q] = np.sort(equal)[: need[q]]
        out += [(np.full(len(equal), ids[q]), equal, np.full(len(equal), low[q])) for q, equal in ties.items()]
        joined = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "id", "score"), joined)))

    levels = next(n for n in range(1, 70) if bins ** n > 2 * reach)
    state = written(asked.withColumn("low", F.lit(-reach).cast("long")).withColumn("above", F.lit(0).cast("long")), "ranges")
    for level in reversed(range(levels)):
        width = bins ** level
        counts = paired(state, counted(width), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        running = counts.withColumn("down", F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("bin"))))
        placed = state.join(running, "id", "left").groupBy("id").agg(
            F.first(F.struct("v", "dims", "lot")).alias("s"), F.first("low").alias("low"), F.first("above").alias("above"),
            F.coalesce(F.max(F.when(F.col("down") + F.col("above") >= k, F.col("bin"))), F.lit(0)).alias("bin"),
            F.collect_list(F.struct("bin", "n")).alias("bins"))  # at most one entry for each bin
        beyond = F.aggregate("bins", F.lit(0).cast("long"), lambda s, x: s + F.when(
            x["bin"] > F.col("bin"), x["n"]).otherwise(F.lit(0).cast("long")))
        after = written(placed.select("id", "s.v", "s.dims", "s.lot", (F.col("low") + F.col("bin") * width).alias("low"),
                                      (F.col("above") + beyond).alias("above")), "ranges")
        discard(state)
        state = after
    hits = paired(state, taken, "query_id long, id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
