"""Hard negatives by inner product: rotated one-bit codes bound each score, what the bounds leave open is scored exactly."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.shared import written


@dataclass(frozen=True)
class HardNegatives:
    """``positives`` of an anchor and ``negatives`` of each pair of them; ``low`` and ``high``: percent of the positive's score.

    ``scale``: a component x becomes floor(scale * x). ``planes``: bits of a query's rotated components. ``rows``
    candidates and ``anchors`` anchors meet in one task at a time.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    planes: int = 6
    seed: int = 7
    rows: int = 8192
    anchors: int = 2048


LARGEST = 2.0 ** 62  # scores of vectors with a larger squared norm need not fit a long


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _bits(positive: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words, spare bits 0."""
    packed = np.packbits(positive, axis=1, bitorder="little")
    padded = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code words, alignment with the code vector, norm of the rest) of each row.

    The code vector has components ±1 / sqrt(dims), the signs of the rotated row; a row is its alignment times the
    code vector plus a rest that is orthogonal to it.
    """
    y = vectors.astype(np.float64) @ turn.T
    along = np.abs(y).sum(axis=1) / math.sqrt(max(1, y.shape[1]))
    rest = np.sqrt(np.maximum(0.0, (y * y).sum(axis=1) - along * along))
    return _bits(y >= 0), along, rest


class Query:
    """A rotated query, its components rounded to whole steps and stored as bit planes."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray, planes: int):
        z = turn @ vector.astype(np.float64)
        self.root = math.sqrt(max(1, len(z)))
        self.norm2 = float(z @ z)
        self.low = float(z.min()) if len(z) else 0.0
        spread = float(z.max()) - self.low if len(z) else 0.0
        self.step = spread / ((1 << planes) - 1) or 1.0
        steps = np.rint((z - self.low) / self.step).astype(np.int64)
        self.planes = [_bits((steps >> k & 1).astype(bool)[None, :])[0] for k in range(planes)]
        rounded = self.low + self.step * steps
        self.total = float(rounded.sum())
        self.off = float(np.linalg.norm(z - rounded))

    def interval(self, words: np.ndarray, along: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner products with coded rows that no row can leave.

        Popcounts give the product with the code vector, up to the rounding error. The rest is orthogonal to the code
        vector, so it meets only the query's part that is, too: Cauchy-Schwarz bounds that product.
        """
        picked = np.bitwise_count(words).sum(axis=1, dtype=np.int64) * self.low
        for k, plane in enumerate(self.planes):
            picked = picked + self.step * (np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64) << k)
        t = (2 * picked - self.total) / self.root
        least = np.maximum(0.0, np.abs(t) - self.off)
        wide = along * self.off + rest * np.sqrt(np.maximum(0.0, self.norm2 - least * least))
        centre = along * t
        slack = 1e-9 * (np.hypot(along, rest) * math.sqrt(self.norm2) + 1)  # rounding of doubles
        return centre - wide - slack, centre + wide + slack


def _flat(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)


def _encoded(data: DataFrame, how: HardNegatives) -> DataFrame:
    """Add code, along and rest, one task at a time; the rotation is made anew from its seed."""
    seed = how.seed

    def encode(batches):
        turns = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = table.column("dims").to_numpy()
            words = np.empty(len(dims), object)
            along, rest = np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                turns.setdefault(d, rotation(int(d), seed))
                w, along[at], rest[at] = codes(_flat(table.take(pa.array(at)), "v", int(d)), turns[d])
                words[at] = list(w.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words, pa.list_(pa.int64())), pa.array(along), pa.array(rest)],
                [*batch.schema.names, "code", "along", "rest"])

    return data.mapInArrow(encode, "id long, label long, v array<long>, dims int, code array<long>, along double, rest double")


def _lanes(table: pa.Table, dims: int):
    words = _flat(table, "code", -(-dims // 64)).view(np.uint64)
    return (table.column("id").to_numpy(), table.column("label").to_numpy(), _flat(table, "v", dims), words,
            table.column("along").to_numpy(), table.column("rest").to_numpy())


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _kth(low: np.ndarray, k: int) -> float:
    """At least ``k`` rows reach this value; with fewer rows, minus infinity."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


def nearest(query: Query, vector, lanes, allowed: np.ndarray, k: int):
    """Row numbers and scores of the ``k`` best allowed rows, ties to smaller ids."""
    ids, _, v, words, along, rest = lanes
    at = np.flatnonzero(allowed)
    low, high = query.interval(words[at], along[at], rest[at])
    at = at[high >= _kth(low, k)]
    scores = v[at] @ vector
    best = _best(ids[at], scores, k)
    return at[best], scores[best]


def in_band(query: Query, vector, lanes, allowed: np.ndarray, bands: list[tuple[int, int]], k: int):
    """For each band (lowest, highest score): row numbers and scores of its ``k`` best allowed rows."""
    ids, _, v, words, along, rest = lanes
    at = np.flatnonzero(allowed)
    low, high = query.interval(words[at], along[at], rest[at])
    for least, most in bands:
        if least > most:
            yield at[:0], np.zeros(0, np.int64)
            continue
        sure = low[(low >= least) & (high <= most)]
        open_ = at[(high >= max(float(least), _kth(sure, k))) & (low <= most)]
        scores = v[open_] @ vector
        inside = (scores >= least) & (scores <= most)
        open_, scores = open_[inside], scores[inside]
        best = _best(ids[open_], scores, k)
        yield open_[best], scores[best]


def hard_negatives(vectors: DataFrame, is_anchor, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   how: HardNegatives = HardNegatives()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``. An anchor's positives are its ``how.positives`` best other rows of its
    label by integer inner product; for each of them come the ``how.negatives`` best rows of other labels whose score
    is ``how.low`` to ``how.high`` percent of the positive's. Ties go to the smaller id.

    Every row is stored with a one-bit code of its rotated vector and its alignment with the code vector. Popcounts
    give an interval that holds the score for certain; only rows whose interval reaches the k-th best lower bound, or
    the band, are scored. Blocks of anchors meet blocks of rows; k rows of each block are shuffled.

    Rows with a null id or label, a vector that is null or holds a null, a NaN or an infinity, or one whose squared norm
    does not fit a long, take no part; vectors of another length than the anchor's are no candidates of it. Anchor rows
    with equal ids are one anchor (the one with the least label and vector) and no candidates of it; otherwise each row
    counts. Fewer rows than asked: all of them. A positive with a negative score has no negatives. No rows give no
    rows; extra columns are ignored.
    """
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.aggregate(v, F.lit(0.0), lambda s, x: s + (F.abs(x) * how.scale + 1) * (F.abs(x) * how.scale + 1)) < LARGEST
    data = vectors.where(F.col(id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & whole & fits).select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * how.scale)).alias("v")).withColumn("dims", F.size("v"))
    data = written(_encoded(data, how), "codes")
    anchors = data.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v", "dims")).alias("s")).select(
        "id", "s.*")
    parts = max(1, math.ceil(data.count() / how.rows))
    lots = max(1, math.ceil(anchors.count() / how.anchors))
    candidates = data.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).withColumn(
        "lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = anchors.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int"))
    at = ["dims", "part", "lot"]

    def met(state: DataFrame, search, schema: str) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]

        def task(queries: pa.Table, others: pa.Table) -> pa.Table:
            out = []
            if queries.num_rows and others.num_rows:
                dims = queries.column("dims")[0].as_py()
                lanes, turn, mine = _lanes(others, dims), rotation(dims, how.seed), _flat(queries, "v", dims)
                for k, row in enumerate(queries.drop_columns(["v"]).to_pylist()):
                    out += search(row, Query(mine[k], turn, how.planes), mine[k], lanes)
            columns = list(zip(*out)) or [[] for _ in names]
            return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(names, columns)})

        dealt = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return dealt.groupBy(*at).cogroup(candidates.groupBy(*at)).applyInArrow(task, schema)

    def same(row, query, mine, lanes):
        allowed = (lanes[1] == row["label"]) & (lanes[0] != row["id"])
        near, scores = nearest(query, mine, lanes, allowed, how.positives)
        return [(row["id"], lanes[0][r], s) for r, s in zip(near, scores)]

    def other(row, query, mine, lanes):
        scores = [p["positive_score"] for p in row["positives"]]
        # smallest whole number at least low %, largest at most high %
        bands = [(-(-how.low * s // 100), how.high * s // 100) for s in scores]
        allowed = (lanes[1] != row["label"]) & (lanes[0] != row["id"])
        found = in_band(query, mine, lanes, allowed, bands, how.negatives)
        return [(row["id"], p["place"], p["positive_id"], p["positive_score"], lanes[0][r], s)
                for p, (near, got) in zip(row["positives"], found) for r, s in zip(near, got)]

    def ranked(df: DataFrame, keys: list[str], score: str, name: str, k: int, rank: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), name)
        return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)

    positives = ranked(met(asked, same, "anchor long, positive_id long, positive_score long"),
                       ["anchor"], "positive_score", "positive_id", how.positives, "place")
    gathered = positives.groupBy(F.col("anchor").alias("id")).agg(
        F.collect_list(F.struct("place", "positive_id", "positive_score")).alias("positives"))  # at most how.positives
    state = written(asked.join(gathered, "id"), "positives")
    found = met(state, other, "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = ranked(found, ["anchor_id", "place"], "negative_score", "negative_id", how.negatives, "rank")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
