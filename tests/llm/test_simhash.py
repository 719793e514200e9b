"""SimHash fingerprints and links against plain Python."""

import re

import numpy as np
import pytest
import xxhash

from hedgerow.llm import simhash
from hedgerow.llm.queries import QUERIES
from hedgerow.llm.simhash import SimHash, block_keys, fingerprint, planes, simhash_duplicates, within


def plain(text, words=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [found[i:i + words] for i in range(len(found) - words + 1)] or ([found] if found else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    """{(id, fingerprint): smallest reachable id}"""
    prints = [(i, plain(t)) for i, t in rows]
    group = {i: i for i, _ in prints}
    again = True
    while again:
        again = False
        for i, x in prints:
            for j, y in prints:
                if (x ^ y).bit_count() <= radius and group[j] < group[i]:
                    group[i], again = group[j], True
    return sorted((i, f"{x:016x}", group[i]) for i, x in prints)


TEXTS = ["", None, "  \n ", "one", "One two three", "a b c d", "A b  c\td", "a b c d e f g h i j k l m n o p",
         "a b c d e f g h i j k l m n o q", "é x ÀB y z w", "x " * 700, "x y " * 900, " ".join(map(str, range(5000)))]


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_fingerprints(size, monkeypatch):
    runs = simhash._runs
    monkeypatch.setattr(simhash, "_runs", lambda raw: runs(raw, size))
    for text in TEXTS:
        assert fingerprint(text) == plain(text)


def near_bits(rng, centre, most):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        centre ^= 1 << int(b)
    return centre


@pytest.mark.parametrize("radius,n,words", [(4, 300, 1), (0, 70, 2), (3, 1100, 8), (7, 64, 8)])
def test_bit_sliced_distances(radius, n, words):
    rng = np.random.default_rng(n)
    held = [near_bits(rng, 0x123456789ABCDEF0, 9) if k % 3 else int(rng.integers(0, 1 << 63)) for k in range(n)]
    asked = held[:40] + [0, (1 << 64) - 1]
    q, lane = within(np.array(asked, np.uint64), planes(np.array(held, np.uint64)), n, radius, words)
    assert sorted(zip(q.tolist(), lane.tolist())) == [
        (i, j) for i, x in enumerate(asked) for j, y in enumerate(held) if (x ^ y).bit_count() <= radius]


def test_keys_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (0, 10, 10 ** 6, 10 ** 9, 10 ** 12):
        blocks, keys, buckets = block_keys(n, SimHash())
        assert buckets >= 1
        for _ in range(300):
            flipped = {int(b) for b in rng.choice(64, 4, replace=False)}
            hit = {k for k in range(blocks) if any(k * 64 // blocks <= b < (k + 1) * 64 // blocks for b in flipped)}
            assert any(not hit & set(key) for key in keys)


def test_links_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    texts = list(TEXTS)
    for text in base:
        for _ in range(6):
            edited = text.split()
            edited[int(rng.integers(0, 120))] = "edit"
            texts.append(" ".join(edited))
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)] + [(1, texts[-1]), (1, ""), (4, texts[20])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp long, node string")
    for how in (SimHash(), SimHash(bucket=4, lot=5), SimHash(bucket=1, lot=2)):
        found = simhash_duplicates(df, how=how).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == brute(rows)


def test_null_ids_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert simhash_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = simhash_duplicates(spark.createDataFrame([(None, "a"), (3, "a"), (None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in found) == sorted(
        [(0, f"{plain('a'):016x}", None), (3, f"{plain('a'):016x}", 3), (0, "0" * 16, None)])


def test_many_near_copies_give_few_links(spark):
    rng = np.random.default_rng(9)
    fps = list({near_bits(rng, 77, 2) for _ in range(1500)})
    import pyarrow as pa
    n = len(fps)
    table = pa.table({"fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "node": range(n), "lot": [0] * n, "i": [0] * n, "j": [0] * n})
    assert simhash._links(SimHash())(table).num_rows == n - 1


def test_query_on_the_small_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = QUERIES["op11_simhash_near_dedup"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == brute(rows)
