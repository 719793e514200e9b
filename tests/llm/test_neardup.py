import random
import re

from hedgerow.llm.components import components, merged
from hedgerow.llm.neardup import NearDup, _linked, _met, _sets, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, kept int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets, root = [(i, shingles(t)) for i, t, *_ in rows], {}
    for i, _ in sets:
        root.setdefault(i, i)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def words(n, rng):
    return [rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(60)) for _ in range(n)]


def test_groups_of_copies_and_chains(frame):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        text = words(80, rng)
        for _ in range(rng.choice((1, 3, 25))):
            other = list(text)
            for _ in range(rng.randrange(4)):
                other[rng.randrange(80)] = "new" + str(rng.randrange(999))
            if rng.random() < 0.3:
                text = other
            rows.append((len(rows), " ".join(other).upper() if g % 2 else "\t".join(other), "x", 1))
    got = found(near_duplicates(frame(rows, SCHEMA), how=NearDup(block=8)))
    assert got == brute(rows)
    assert len({c for _, _, c, _ in got}) < len(rows)


def test_full_sets_meet_in_blocks_of_bounded_size(frame):
    rng = random.Random(5)
    rows = []
    for size in (30, 30, 400, 2500):
        text = words(size, rng)
        for _ in range(9):
            other = list(text)
            for _ in range(rng.randrange(1 + size // 60)):
                other[rng.randrange(size)] = "new" + str(rng.randrange(999))
            rows.append((len(rows), " ".join(other)))
    docs = frame(rows, "doc_id long, text string")
    buckets = docs.selectExpr("1L AS key", "doc_id AS node")
    roots = frame([(k, 0) for k in range(5)], "node long, root long")  # a component that is known already
    sets = _sets(docs, buckets.select("node"), "doc_id", "text", 5)
    for how in (NearDup(), NearDup(block=4), NearDup(held=900)):
        links = _linked(buckets, roots, sets, how)
        got = {r.node: r.root for r in merged(roots, links).collect()}
        assert [(i, got.get(i, i)) for i, _ in rows] == [(i, c) for i, _, c, _ in brute(rows)]


def test_exactly_three_quarters(frame):
    base = [f"w{k}" for k in range(11)]  # 7 shingles
    more = base + ["x", "y"]  # 9 shingles: 7 of 9
    less = base + ["p", "q", "r"]  # 10 shingles: 7 of 10
    rows = [(1, " ".join(base), "", 0), (2, " ".join(more), "", 0), (3, " ".join(less), "", 0)]
    assert found(near_duplicates(frame(rows, SCHEMA))) == [(1, 7, 1, True), (2, 9, 1, False), (3, 10, 3, True)]


def test_short_empty_null_and_repeated_rows(frame):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, " \n", "", 0), (4, "A b", "", 0), (5, "a\tB", "", 0), (6, "b a", "", 0),
            (7, "É b", "", 0), (8, "é b", "", 0), (5, "a\tB", "", 0), (None, "a b", "", 0)]
    got = found(near_duplicates(frame(rows[:-1], SCHEMA)))
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False),
                   (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True)]
    alone = [r for r in near_duplicates(frame(rows, SCHEMA)).collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in alone] == [(None, True)]


def test_no_rows(frame):
    assert found(near_duplicates(frame([], SCHEMA))) == []


def test_components_of_a_long_path_and_a_star(frame):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(3, 3), (None, 4), (200, 199)]
    got = {r.node: r.root for r in components(frame(edges, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 141)} | {k: 7 for k in range(7, 30)} | {199: 199, 200: 199}
    assert got == want


def test_adding_edges_to_components(frame):
    first, second = [(1, 2), (5, 6), (6, 9), (20, 21)], [(9, 2), (30, 31), (31, 40), (21, 50)]
    roots = components(frame(first, "a long, b long"))
    got = {r.node: r.root for r in merged(roots, frame(second, "a long, b long")).collect()}
    assert got == {r.node: r.root for r in components(frame(first + second, "a long, b long")).collect()}


def test_rows_that_meet_follow_the_size_of_the_largest_component(frame):
    """A bucket of 200 members of one component and 4 others, in blocks of 10: each member goes once to the others' block."""
    rows = frame([(1, k, 0 if k < 200 else k, 0, 20, 1, k) for k in range(204)],
                 "key long, node long, part long, largest long, wide int, narrow int, band int")
    met = _met(rows, "band").collect()
    assert len(met) == 200 + 4 * (20 + 1)
    tasks = {}
    for r in met:
        tasks.setdefault((r.i, r.j), []).append(r)
    pairs = [tuple(sorted((x.node, y.node))) for (i, j), held in tasks.items() for x in held for y in held
             if x.part < y.part and (i == j or x.block != y.block)]
    assert len(pairs) == len(set(pairs)) == 200 * 4 + 6


def joined_rows(df):
    """Rows that the joins of a DataFrame make, as Spark counts them while it runs."""
    df.collect()
    plan, found, left = df._jdf.queryExecution().executedPlan(), [], []
    left = [plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while left:
        at = left.pop()
        if "Join" in at.nodeName():
            found.append(at.metrics().apply("numOutputRows").value())
        if "QueryStage" in at.nodeName():
            left.append(at.plan())
        left += [at.children().apply(k) for k in range(at.children().size())]
    return sum(found)


def test_what_a_node_holds_is_joined_once_whatever_its_buckets(frame):
    """30 nodes share 40 buckets: signatures are joined to 30 rows and not to 1,200."""
    rows = frame([(key, k, k, 0, 1, 3, key) for key in range(40) for k in range(30)],
                 "key long, node long, part long, largest long, wide int, narrow int, band int")
    marks = frame([(k, bytes([k])) for k in range(30)], "node long, signature binary")
    met = _met(rows, "band", held=marks)
    assert joined_rows(met) == 30
    assert met.columns == ["key", "i", "j", "block", "node", "part", "signature", "band"]
    got = met.collect()
    assert all(r.signature == bytes([r.node]) and r.band == r.key for r in got)
    # node 0 is the largest component of each bucket and meets 3 blocks of others; those meet it and each other
    assert len(got) == 40 * (3 + 29 * (1 + 3))
