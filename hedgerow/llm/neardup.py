"""Near duplicates: MinHash signatures, banding, checks on full sets, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.components import components, merged
from hedgerow.llm.shared import column_bytes, discard, mix, salted_join, small_batches, word_hashes, written


@dataclass(frozen=True)
class NearDup:
    """``bands`` x ``rows`` universal hash minima. At a similarity of 0.75, 40 bands of 5 miss a pair once in 50,000.

    ``block``: members of a bucket compared at a time, ``held``: shingles of a block of full sets (more only if one
    set alone has more). ``doubt``: pairs whose signatures agree less are not looked
    at again (four standard deviations under 0.75). ``likely``: where the first comparison inside buckets stops.
    ``most``: pairs of two components in a bucket that are confirmed one by one.
    """

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    block: int = 1024
    held: int = 1 << 20
    doubt: float = 0.63
    likely: float = 0.72
    most: int = 2


_SLICE = 1 << 19  # bytes of texts that are shingled at a time; a longer text stands alone
_PLACES = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of ``words`` words; fewer words: all as one run."""
    data, offsets = column_bytes(texts)
    lo = 0
    while lo < len(texts):
        # a few texts at a time, whatever their number in a batch: word hashes take tens of times the bytes of the texts
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _SLICE, "right")) - 1)
        yield from _shingled(data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], words)
        lo = hi


def _shingled(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    rows, hashes = word_hashes(data, offsets)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    whole = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        whole = np.full(n, words, np.uint64)
        for k in range(words):
            whole += hashes[k: k + n] * _PLACES[k]
        whole = mix(whole)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= words:
            yield np.unique(whole[lo: hi - words + 1])
        elif hi > lo:
            one = np.uint64(hi - lo) + (hashes[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64)
            yield mix(np.array([one], np.uint64))
        else:
            yield whole[:0]


def _signature(members: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(members), 512):
        np.minimum(least, (factors * members[None, at: at + 512] + terms).min(axis=1), out=least)
    return least >> np.uint64(32)


def signatures(docs: DataFrame, id: str, text: str, how: NearDup) -> DataFrame:
    """(id, n_shingles, digest of the set, signature of 16-bit minima, band keys) for every row."""
    n, words, bands, rows = how.bands * how.rows, how.words, how.bands, how.rows

    def encode(batches):
        factors = (mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
        terms = mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))[:, None]
        places = mix(np.arange(7, 7 + rows, dtype=np.uint64)) | np.uint64(1)
        salts = mix(np.arange(1000, 1000 + bands, dtype=np.uint64))
        for batch in batches:
            sizes, digests, minima, keys = [], [], [], []
            for members in shingle_sets(batch.column(1), words):
                sizes.append(len(members))
                if not len(members):
                    digests.append(None), minima.append(None), keys.append(None)
                    continue
                signature = _signature(members, factors, terms)
                digests.append(hashlib.blake2b(members.tobytes(), digest_size=16).digest())
                minima.append(signature.astype(np.uint16).tobytes())
                banded = (signature.reshape(bands, rows) * places).sum(axis=1, dtype=np.uint64) + salts
                keys.append(mix(banded).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(minima, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "digest", "signature", "keys"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        encode, "id long, n_shingles long, digest binary, signature binary, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(node, its full set, the set's size) for the documents that are in some pair."""
    def encode(batches):
        for batch in batches:
            at, members, size = 0, [], 0
            for k, found in enumerate(shingle_sets(batch.column(1), words)):
                members.append(found.tobytes())
                size += len(members[-1])
                if size >= 4 * _SLICE or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(members)), pa.array(members, pa.binary()),
                         pa.array([len(x) // 8 for x in members], pa.int64())], ["node", "members", "size"])
                    at, members, size = k + 1, [], 0

    wanted = docs.select(F.col(id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    return wanted.join(nodes, "node", "left_semi").mapInArrow(encode, "node long, members binary, size long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def check(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = sorted((len(left), len(right)))
                if 100 * small < percent * large:
                    linked.append(False)
                    continue
                at = np.searchsorted(left, right)
                both = int((left[np.minimum(at, len(left) - 1)] == right).sum()) if len(left) else 0
                linked.append(100 * both >= percent * (small + large - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                                             ["a", "b", "linked"])

    sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return sided.mapInArrow(check, "a long, b long, linked boolean").where("linked").select("a", "b").distinct()


def _grouped(batches, fields):
    """Runs of rows with one (key, i, j) in sorted batches, as (key, arrays of ``fields``); a run may span batches."""
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        columns = fields(batch)
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            key = tuple(keys[lo])
            if key != open_key:
                if parts:
                    yield open_key[0], [np.concatenate(x) for x in zip(*parts)]
                open_key, parts = key, []
            parts.append([c[lo:hi] for c in columns])
    if parts:
        yield open_key[0], [np.concatenate(x) for x in zip(*parts)]


def _dealt(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _parted(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    return buckets.join(roots.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _met(rows: DataFrame, *columns: str, held: DataFrame | None = None) -> DataFrame:
    """(key, i, j, block, node, part, what ``held`` has of a node, ``columns``): the members of buckets, once for each two
    blocks that meet.

    A bucket's ``largest`` component is cut into ``wide`` blocks (-1, -2, ...), its other members into ``narrow`` ones. The
    others' blocks meet each other and those of the largest, which need not meet each other: where one component holds
    nearly all of a bucket, rows follow its size and not its square. A node's buckets, at most one a band, are one row
    when ``held`` is joined, so that a signature or full set is joined once a node and not once a bucket.
    """
    rest = lambda p: F.sequence(F.lit(0), p.narrow - 1)
    most = lambda p: F.sequence(F.lit(0), p.wide - 1)

    def places(p):
        large = F.col("part") == p.largest
        at = F.pmod(F.xxhash64("node"), F.when(large, p.wide).otherwise(p.narrow)).cast("int")

        def pair(i, j):
            return F.struct(p.key.alias("key"), i.alias("i"), j.alias("j"), F.when(large, F.lit(-1) - at).otherwise(at).alias("block"),
                            *(p[c].alias(c) for c in columns))

        return F.when(large, F.transform(rest(p), lambda x: pair(x, F.lit(-1) - at))).otherwise(F.concat(
            F.transform(most(p), lambda x: pair(at, F.lit(-1) - x)),
            F.transform(rest(p), lambda x: pair(F.least(at, x), F.greatest(at, x)))))

    gathered = rows.groupBy("node").agg(F.max("part").alias("part"), F.collect_list(
        F.struct("key", "largest", "wide", "narrow", *columns)).alias("buckets"))
    more = [] if held is None else [c for c in held.columns if c != "node"]
    joined = gathered if held is None else gathered.join(held, "node")
    placed = joined.select("node", "part", *more, F.explode(F.flatten(F.transform("buckets", places))).alias("m"))
    return placed.select("m.key", "m.i", "m.j", "m.block", "node", "part", *more, *(f"m.{c}" for c in columns))


def _likely(buckets: DataFrame, roots: DataFrame, marks: DataFrame, how: NearDup, doubt: float, most: int) -> DataFrame:
    """(a, b, null): pairs of different components that share a bucket and agree in at least ``doubt`` of the minima.

    Each bucket with members of more than one component is cut into blocks as ``_met`` says; two blocks at a time are
    compared in memory, and a pair only in the first band it shares. For each two components that meet there, the
    ``most`` likeliest pairs come out, and (null, null, key) if there were more.
    """
    rooted = _parted(buckets, roots)
    sizes = rooted.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n")).where("most.n < n").select(
        "key", F.col("most.part").alias("largest"), F.ceil(F.col("most.n") / how.block).cast("int").alias("wide"),
        F.ceil((F.col("n") - F.col("most.n")) / how.block).cast("int").alias("narrow"))
    dealt = _met(rooted.join(sizes, "key"), "band", held=marks)
    bands, rows = how.bands, how.rows

    def compare(key, blocks, nodes, parts, minima, numbers):
        twice, found, band = blocks.min() != blocks.max(), [], numbers[0]
        for u in range(len(nodes)):
            rest = np.flatnonzero((parts[u + 1:] != parts[u]) & ((blocks[u + 1:] != blocks[u]) | (not twice))) + u + 1
            if len(rest):
                agree = (minima[rest] == minima[u]).mean(axis=1)
                rest, agree = rest[agree >= doubt], agree[agree >= doubt]
                shared = (minima[rest].reshape(-1, bands, rows) == minima[u].reshape(bands, rows)).all(axis=2).argmax(axis=1)
                near, agree = rest[shared == band], agree[shared == band]
                if len(near):
                    found.append(np.stack([np.full(len(near), u), near, (-1e6 * agree).astype(np.int64)]))
        if not found:
            return
        u, v, score = np.concatenate(found, axis=1)
        first, second = np.minimum(parts[u], parts[v]), np.maximum(parts[u], parts[v])
        order = np.lexsort((nodes[v], nodes[u], score, second, first))
        u, v, first, second = u[order], v[order], first[order], second[order]
        fresh = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank = np.arange(len(u)) - np.repeat(fresh, np.diff(np.append(fresh, len(u))))
        for x, y in zip(nodes[u[rank < most]], nodes[v[rank < most]]):
            yield min(x, y), max(x, y), None
        if (rank >= most).any():
            yield None, None, key

    def fields(batch):
        return [*(batch.column(k).to_numpy() for k in (3, 4, 5)),
                np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(6)]), batch.column(7).to_numpy()]

    def sweep(batches):
        for key, columns in _grouped(batches, fields):
            if out := list(compare(key, *columns)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "key"])

    return written(_dealt(dealt).mapInArrow(sweep, "a long, b long, key long").distinct(), "likely")


def _linked(buckets: DataFrame, roots: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """(a, b): links on full sets between different components of each bucket, at least one of each two that have any.

    The bucket's largest component is cut into blocks and so are its other members, by their number and by the size of
    their sets; the others' blocks are compared with each other and with each block of the largest component, in
    memory. Only links come out.
    """
    gathered = _parted(buckets, roots).groupBy("node").agg(F.max("part").alias("part"), F.collect_list("key").alias("keys"))
    rooted = gathered.join(sets.select("node", "size"), "node").select("node", "part", "size", F.explode("keys").alias("key"))
    parts = rooted.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sizes = parts.groupBy("key").agg(
        F.max(F.struct("n", "size", "part")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("most.n < n")

    def blocks(n, size):
        return F.greatest(F.ceil(n / how.block), F.ceil(size / how.held)).cast("int")

    sizes = sizes.select("key", F.col("most.part").alias("largest"), blocks(F.col("most.n"), F.col("most.size")).alias("wide"),
                         blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("narrow"))
    dealt = _met(rooted.join(sizes, "key"), held=sets.select("node", "members"))
    percent = how.percent

    def compare(_, blocks, nodes, parts, members):
        sizes = np.array([len(x) for x in members])
        owner, every = np.repeat(np.arange(len(nodes)), sizes), np.concatenate(members)
        group = {p: p for p in parts}
        two = blocks.min() != blocks.max()
        for u in range(len(nodes)):
            if two and blocks[u] != blocks.max():
                continue  # the other block's members look for it
            at = np.minimum(np.searchsorted(members[u], every), sizes[u] - 1)
            both = np.bincount(owner[members[u][at] == every], minlength=len(nodes))
            good = (100 * both >= percent * (sizes[u] + sizes - both)) & (parts != parts[u])
            for v in np.flatnonzero(good & (blocks != blocks[u])) if two else np.flatnonzero(good):
                x, y = group[parts[u]], group[parts[v]]
                if x != y:
                    group = {p: min(x, y) if g in (x, y) else g for p, g in group.items()}
                    yield min(nodes[u], nodes[v]), max(nodes[u], nodes[v])

    def fields(batch):
        held = np.empty(batch.num_rows, object)
        held[:] = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(6)]
        return [*(batch.column(k).to_numpy() for k in (3, 4, 5)), held]

    def sweep(batches):
        for key, columns in _grouped(batches, fields):
            if out := list(compare(key, *columns)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return _dealt(dealt).mapInArrow(sweep, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", how: NearDup = NearDup()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; documents at least ``how.percent`` % alike are linked.

    Texts with equal sets form one class and only the class's smallest id goes on. Class members meet in band buckets;
    each bucket is first held against its smallest member, links are confirmed on full sets, and components are
    formed. Buckets that then still hold several components are compared block by block, only between components: the
    likeliest pairs of each two components are confirmed next, and where a bucket has more of them, all its members
    are compared on full sets. No bucket is capped and no bucket's pairs are all written out.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows with equal ids are one document
    for linking and each gives a row. A row with a null id is linked with nothing, its component is null and it is
    kept. Extra columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = written(signatures(docs, id, text, how), "signatures")
    classes = rows.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("node"))
    classes = written(classes, "classes")
    chosen = rows.where("digest IS NOT NULL").join(
        classes.withColumnRenamed("node", "id"), ["digest", "id"], "left_semi").select(F.col("id").alias("node"), "signature", "keys")
    keyed = chosen.select("node", F.posexplode("keys").alias("band", "key"))
    centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    buckets = written(keyed.join(centres.select("key", "centre"), "key").distinct(), "buckets")
    nodes = buckets.select("node").distinct()
    sets = written(_sets(docs, nodes, id, text, how.words), "sets")
    pairs = buckets.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_confirmed(pairs, sets, how.percent), "confirmed")
    marks = chosen.select("node", "signature")
    roots = written(components(links), "roots")
    for doubt, most in ((how.likely, 1), (how.doubt, how.most)):
        found = _likely(buckets, roots, marks, how, doubt, most)
        extra = written(_confirmed(found.where("key IS NULL").select("a", "b"), sets, how.percent), "confirmed")
        roots = written(merged(roots, extra), "roots")
    left = buckets.join(found.where("key IS NOT NULL").select("key").distinct(), "key", "left_semi")
    extra = written(_linked(left.select("key", "node"), roots, sets, how), "confirmed")
    roots = written(merged(roots, extra), "roots")
    for table in (buckets, sets):
        discard(table)
    rooted = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return salted_join(rows.select("id", "n_shingles", "digest"), rooted, ["digest"], "left").withColumn(
        "component_id", alone).select(
        F.col("id").alias(id), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
