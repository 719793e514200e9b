"""SimHash near-dedup: fingerprints of shingle hashes, block keys, bit-sliced comparison, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.components import components
from hedgerow.llm.shared import discard, salted_join, written

BITS = 64


@dataclass(frozen=True)
class SimHash:
    """``words`` of a shingle, ``seed`` of its hash, ``radius``: differing bits of two linked fingerprints.

    ``bucket``: fingerprints that should share a block key; ``lot``: fingerprints compared with as many others in one
    task; ``lane_words``: words of 64 lanes that are abandoned together.
    """

    words: int = 4
    seed: int = 42
    radius: int = 4
    bucket: int = 2048
    lot: int = 16384
    lane_words: int = 8


# -- fingerprints -----------------------------------------------------------------------------------------

def _runs(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` cut at white space into runs of about ``size`` bytes."""
    lo = 0
    while len(raw) - lo > size:
        hi = lo + size
        while hi < len(raw) and raw[hi] not in b" \t\n\x0b\x0c\r":
            hi += 1
        yield raw[lo:hi]
        lo = hi
    yield raw[lo:]


def _shingle_hashes(raw: bytes, how: SimHash) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles, repeats included, a bounded number at a time."""
    kept, seen, digest, seed = [], False, xxhash.xxh64_intdigest, how.seed
    for run in _runs(raw):
        words = kept + run.lower().split()  # bytes: A-Z only, ASCII white space only
        if len(words) < how.words:
            kept = words
            continue
        joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[a: b - 1], seed) for a, b in zip(starts, ends[how.words - 1:])]
        yield np.array(hashes, np.uint64)
        seen, kept = True, words[len(words) - how.words + 1:]
    if kept and not seen:
        yield np.array([digest(b" ".join(kept), seed)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set: bits are added as bytes, 255 rows at a time."""
    total, at = np.zeros(BITS, np.int64), np.arange(0, len(hashes), 255)
    for j in range(8):
        ones = (hashes >> np.uint64(j)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(ones, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        total[j::8] = sums.sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, how: SimHash = SimHash()) -> int:
    """A bit is 1 if it is set in over half the shingle hashes; no words: 0."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes((text or "").encode(), how):
        counts += _bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str, text: str, how: SimHash) -> DataFrame:
    """(id, fp) for every row."""
    def encode(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), how) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        encode, "id long, fp long")


# -- comparison -------------------------------------------------------------------------------------------

def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 of them a word; spare lanes are 0."""
    padded = np.zeros(-(-len(fps) // BITS) * BITS, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, lanes: np.ndarray, n: int, radius: int, lane_words: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(query, lane) numbers of all pairs at most ``radius`` bits apart; ``lanes`` are planes of ``n`` fingerprints.

    The differences of a plane are added to bit-sliced counters: one word of each counter bit serves 64 lanes, and a
    carry out of the last bit is kept, so a lane that has overflowed stays out. A query's block of ``lane_words`` words
    is abandoned once every lane's count is past the radius.
    """
    size = (radius + 1).bit_length()  # counters start so that radius + 1 differences overflow
    start = (1 << size) - (radius + 1)
    width = -(-lanes.shape[1] // lane_words) * lane_words
    padded = np.zeros((BITS, width), np.uint64)
    padded[:, : lanes.shape[1]] = lanes
    blocks = padded.reshape(BITS, -1, lane_words)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    found = []
    step = max(1, (1 << 16) // max(1, width))
    for at in range(0, len(queries), step):
        asked = queries[at: at + step]
        q, block = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), np.arange(blocks.shape[1]), indexing="ij"))
        counters = [np.full((len(q), lane_words), ones if start >> s & 1 else 0, np.uint64) for s in range(size)]
        out = np.zeros((len(q), lane_words), np.uint64)
        for b in range(BITS):
            flip = np.where(asked >> np.uint64(b) & np.uint64(1), ones, np.uint64(0))
            carry = blocks[b][block] ^ flip[q][:, None]
            for c in counters:  # carry-save addition of one bit
                over = c & carry
                c ^= carry
                carry = over
            out |= carry
            if b % 8 == 7:
                live = ~(out == ones).all(axis=1)
                if not live.all():
                    q, block, out = q[live], block[live], out[live]
                    counters = [c[live] for c in counters]
                    if not len(q):
                        break
        if len(q):
            hit = np.unpackbits((~out).astype("<u8").view(np.uint8).reshape(len(q), -1), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            lane = block[row] * lane_words * BITS + lane
            inside = lane < n
            found.append((q[row[inside]] + at, lane[inside]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Numbers of pairs (a, b) that join trees; ``root``, each member's tree, is updated. Pairs within a tree cost no loop."""
    at = np.flatnonzero(root[a] != root[b])
    _, first = np.unique(np.stack([root[a[at]], root[b[at]]]), axis=1, return_index=True)
    kept, up = [], {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for k in at[first].tolist():
        x, y = top(int(root[a[k]])), top(int(root[b[k]]))
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    if up:
        to = np.arange(len(root))
        for x in sorted(up):  # a parent is smaller, so it has its top already
            to[x] = to[up[x]]
        root[:] = to[root]
    return np.array(kept, np.int64)


def _links(how: SimHash):
    """(a, b) nodes of a spanning forest of the links between the two lots of a group, or inside its only lot."""
    def compare(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        nodes, own = table.column("node").to_numpy(), table.column("lot").to_numpy()
        one = own == own.min()
        rows = np.flatnonzero(one), np.flatnonzero(~one)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = (rows[0], rows[0]) if i == j else rows if own.min() == i else rows[::-1]
        a, b = [], []
        if len(left) and len(right):
            lanes, root = planes(fps[right]), np.arange(len(fps))
            step = max(64, (1 << 20) // len(right))
            for at in range(0, len(left), step):
                q, lane = within(fps[left[at: at + step]], lanes, len(right), how.radius, how.lane_words)
                x, y = left[q + at], right[lane]
                x, y = x[x != y], y[x != y]
                kept = _forest(x, y, root)
                a.append(nodes[x[kept]]), b.append(nodes[y[kept]])
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate(a or [empty]), "b": np.concatenate(b or [empty])})

    return compare


def block_keys(n: int, how: SimHash) -> tuple[int, list[tuple[int, ...]], int]:
    """(blocks of bits, the combinations of blocks that are a key each, buckets of one combination) for ``n`` fingerprints.

    Fingerprints within the radius agree in all but ``radius`` blocks, so with ``radius + extra`` blocks they share the
    key of some ``extra`` of them. More blocks, hence narrower buckets, are taken as fingerprints grow in number.
    """
    extra = 1
    while extra < 4 and (n / how.bucket) > 2 ** (BITS * extra // (how.radius + extra) - 2):
        extra += 1
    blocks = how.radius + extra
    return blocks, list(combinations(range(blocks), extra)), max(1, round(n / how.bucket))


def simhash_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", how: SimHash = SimHash()) -> DataFrame:
    """(id, fingerprint, component_id): documents whose fingerprints differ in at most ``how.radius`` bits are linked.

    Equal fingerprints are one class, its smallest id the node. A fingerprint's bits are cut into blocks; two within
    the radius agree in one block (see ``block_keys``), so the value of each block is a key and no link is lost. A
    bucket is cut into lots, each two lots are compared bit plane by bit plane in one task, and a spanning forest of
    the links found there is passed on, never all pairs. Components are formed from those.

    Null, empty and blank texts have the fingerprint 0 and are linked like any other; fewer words than a shingle are
    one shingle. Texts of any length are hashed a run at a time. Rows with equal ids are one document and each gives a
    row. A row with a null id is linked with nothing, and its component is null. Extra columns are ignored; no rows
    give no rows.
    """
    rows = written(fingerprints(docs, id, text, how), "fingerprints")
    classes = written(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node")), "classes")
    blocks, keys, buckets = block_keys(classes.count(), how)

    def bits(k: int):
        low, high = k * BITS // blocks, (k + 1) * BITS // blocks
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1))

    codes = [F.pmod(F.xxhash64(F.lit(t), *[bits(k) for k in key]), F.lit(buckets)) for t, key in enumerate(keys)]
    keyed = written(classes.select("fp", "node", F.posexplode(F.array(*codes)).alias("t", "key")), "keyed")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select(
        "t", "key", F.ceil(F.col("n") / how.lot).cast("int").alias("lots"))
    dealt = keyed.join(sizes, ["t", "key"]).withColumn("lot", F.pmod(F.xxhash64("fp"), "lots").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select(
        "t", "key", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "fp", "node")
    links = written(dealt.groupBy("t", "key", "i", "j").applyInArrow(_links(how), "a long, b long").distinct(), "links")
    # an id with several texts joins their classes
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    joined = rows.join(several.select("id"), "id", "left_semi").distinct().join(classes, "fp").select(
        F.col("id").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(joined))
    rooted = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    found = salted_join(rows, rooted, ["fp"], "left")
    discard(keyed)
    return found.select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
