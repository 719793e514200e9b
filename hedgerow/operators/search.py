"""Nearest chunks: exact top-k by squared L2 distance over float vectors.

Queries and vectors of one match key meet in blocks of bounded size; each task multiplies one block
of queries with one block of vectors and passes on k rows per query.  What is shuffled at the end is
k rows per query and block of vectors, never query-vector pairs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.operators import policies
from hedgerow.operators.intervals import DAY_TOP, OPEN_DAY, interval_nodes, point_nodes

BLOCK_VECTORS = 8192
BLOCK_QUERIES = 2048


def relevance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def _block_best(k: int, exclude_self: bool, names: list):
    """Best k of a block of vectors for each query of a block."""
    import numpy as np
    import pyarrow as pa

    def matrix(table):
        column = table.column("e").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float64).reshape(len(column), -1)

    def best(queries, vectors):
        rows = ([], [], [])
        if queries.num_rows and vectors.num_rows:
            q, v = matrix(queries), matrix(vectors)
            qids = queries.column("i").to_pylist()
            order = vectors.column("i").to_pylist()
            # |q|^2 - 2qv + |v|^2 ranks; the exact sum of squares is taken for what is kept
            rough = (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None, :]
            ids = np.empty(len(order), object)
            ids[:] = order
            for i, qid in enumerate(qids):
                near = rough[i]
                if exclude_self:
                    near = np.where(ids == qid, np.inf, near)
                edge = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
                where = np.flatnonzero((near <= edge + 1e-9 * (1 + abs(edge))) & (near < np.inf))
                held = sorted(zip(((v[where] - q[i]) ** 2).sum(1).tolist(), ids[where]))[:k]
                for distance, vid in held:
                    for column, value in zip(rows, (qid, vid, distance)):
                        column.append(value)
        kinds = (queries.schema.field("i").type, vectors.schema.field("i").type, pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, rows, kinds)})

    return best


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, match=None, exclude_self: bool = False,
        query_id: str = "query_id", vector_id: str = "vec_id", embedding: str = "embedding",
        block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest vectors of each query: (query_id, vec_id, distance, rank, relevance_score).

    ``match`` names the columns both sides must agree on (the search filter of each query, null equals null); they are
    join keys, so no distance is taken across them.  ``exclude_self`` leaves out the vector with the query's own id.
    Ties go to the smaller id.  Filter ``vectors`` before the call to push other predicates to the scan.

    The vectors of a match key are dealt into parts and its queries into lots, as many as their numbers ask for; every
    lot meets every part in one task.  The plan is the same at every size.
    """
    kind = queries.schema[query_id].dataType.simpleString()
    vkind = vectors.schema[vector_id].dataType.simpleString()
    keys = [match] if isinstance(match, str) else list(match or [])
    key = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in keys])) if keys else F.lit("")

    def slim(df, id_):
        return df.filter(F.col(embedding).isNotNull()).select(F.col(id_).alias("i"), F.col(embedding).alias("e"), key.alias("m"))

    asked, held = slim(queries, query_id), slim(vectors, vector_id)
    lots = asked.groupBy("m").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("lots"))
    parts = held.groupBy("m").agg(F.ceil(F.count("*") / block_vectors).cast("int").alias("parts"))
    sizes = lots.join(parts, "m")

    def one_of(n):
        return F.pmod(F.xxhash64("i"), n).cast("int")

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    asked = asked.join(sizes, "m").select("i", "e", "m", one_of("lots").alias("lot"), all_of("parts").alias("part"))
    held = held.join(sizes, "m").select("i", "e", "m", one_of("parts").alias("part"), all_of("lots").alias("lot"))
    at = ["m", "lot", "part"]
    names = [query_id, vector_id, "distance"]
    found = asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInArrow(
        _block_best(k, exclude_self, names), f"{query_id} {kind}, {vector_id} {vkind}, distance double")
    w = Window.partitionBy(query_id).orderBy("distance", vector_id)
    return (
        found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .withColumn("relevance_score", relevance(F.col("distance")))
    )


def search_documents(queries: DataFrame, chunks: DataFrame, k: int = 10, predicate: Column = None, match=None) -> DataFrame:
    """Nearest chunks with their text; ``predicate`` reaches the chunk scan before any distance.

    ``match`` names columns of both sides, such as the application or document type each query asks for.
    """
    if predicate is not None:
        chunks = chunks.filter(predicate)
    hits = knn(queries, chunks, k, match, vector_id="chunk_id")
    return hits.join(chunks.drop("embedding"), "chunk_id")


def search_policy_asof(queries: DataFrame, chunks: DataFrame, revisions: DataFrame, k: int = 10, match=None) -> DataFrame:
    """Nearest policy chunks among the revisions in force on each query's date.

    ``match`` names further columns both sides must agree on, such as the source each query asks for.
    ``queries(query_id, on_date, embedding)``; a query without a date finds nothing.  The runs of days on which a
    revision is in force come from the live revision table, so later supersession is seen.  A run is a few nodes of a
    tree over days, a date lies in one node of each level, and the node is a match key: run and date share exactly one
    node if the run holds the date.  Chunks and queries take only nodes that both sides have, so a chunk is copied for
    the parts of its run that are asked about, not for each date.
    """
    asked = queries.filter("on_date is not null").withColumn(
        "_node", F.explode(point_nodes(F.unix_date("on_date"), DAY_TOP)))
    end = F.coalesce(F.col("hi") + 1, F.lit(OPEN_DAY))
    runs = policies.reigns(revisions).select(
        "source", "revision_id", F.explode(interval_nodes(F.col("lo"), end, DAY_TOP)).alias("_node"))
    runs = runs.join(asked.select("_node").distinct(), "_node", "left_semi")
    dated = chunks.join(runs, ["source", "revision_id"])
    asked = asked.join(runs.select("_node").distinct(), "_node", "left_semi")
    more = [match] if isinstance(match, str) else list(match or [])
    return knn(asked, dated, k, match=["_node", *more], vector_id="chunk_id")
