import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hedgerow.llm import decontam
from hedgerow.llm.decontam import Decontamination, clean, overlaps

DOCS, ITEMS = "doc_id long, text string, item_id int", "item_id long, text string, doc_id int"
PASSAGE = [f"word{k}" for k in range(40)]


def brute(docs, items, how=Decontamination()):
    """All windows of all alignments, without any seeds."""
    def toks(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    out = {}
    for d, text, *_ in docs:
        h = toks(text)
        for i, other, *_ in items:
            g = toks(other)
            if not g or d is None or i is None:
                continue
            width = min(how.window, len(g))
            for at in range(len(h) - width + 1):
                for b in range(len(g) - width + 1):
                    matched = sum(x == y for x, y in zip(h[at:at + width], g[b:b + width]))
                    if matched * 100 >= width * how.percent:
                        best = (-matched, at, width)
                        out[d, i] = min(out.get((d, i), best), best)
    return {(d, i, -m, w, at) for (d, i), (m, at, w) in out.items()}


def found(df):
    return {(r.doc_id, r.item_id, r.matched, r.compared, r.doc_at) for r in df.collect()}


def documents():
    swapped = [w if k % 6 else f"other{k}" for k, w in enumerate(PASSAGE)]
    return [
        (1, "before it " + " ".join(PASSAGE) + " after it", 1), (2, "x " * 300 + ", ".join(swapped).upper() + ".", 1),
        (3, " ".join(PASSAGE[:15]), 1), (4, "clean text of its own " * 20, 1), (5, None, 1), (6, "", 1), (7, "a short item!", 1),
        (8, " ".join(reversed(PASSAGE)), 1), (None, " ".join(PASSAGE), 1), (1, "again", 1), (9, " ".join(PASSAGE) + " " + " ".join(PASSAGE), 1),
        (10, " ".join(PASSAGE[10:32]), 1), (11, "É" + " ".join(PASSAGE[5:30]), 1)]


def items():
    return [(0, " ".join(PASSAGE), 1), (1, "A short item", 1), (2, None, 1), (3, "", 1), (4, " ".join(PASSAGE[:12]), 1), (None, "clean text", 1),
            (0, " ".join(PASSAGE), 1)]


def test_equals_brute_force(frame):
    docs, bench = documents(), items()
    got = found(overlaps(frame(docs, DOCS), frame(bench, ITEMS)))
    assert got == brute(docs, bench)
    assert {d for d, *_ in got} == {1, 2, 3, 7, 9, 10, 11}  # 3 holds all of item 4


def test_shuffled_seeds_give_the_same(frame):
    docs, bench = documents(), items()
    assert found(overlaps(frame(docs, DOCS), frame(bench, ITEMS), how=Decontamination(rows=0))) == brute(docs, bench)


def test_clean_keeps_other_rows(frame):
    got = clean(frame(documents(), DOCS), frame(items(), ITEMS))
    assert got.columns == ["doc_id", "text", "item_id"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 4), (False, 5), (False, 6), (False, 8), (True, 0)]


def test_no_rows(frame):
    docs, bench = frame(documents(), DOCS), frame(items(), ITEMS)
    assert found(overlaps(docs.limit(0), bench)) == found(overlaps(docs, bench.limit(0))) == set()


def test_main_path_runs_no_python(frame, capsys):
    overlaps(frame(documents(), DOCS), frame(items(), ITEMS)).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "InArrow" not in plan and decontam


@pytest.mark.parametrize("width", range(1, 21))
def test_every_pattern_that_counts_is_hit(width):
    """Whatever tokens an overlap that counts differs in, its mask lies somewhere on equal ones."""
    how = Decontamination()
    differ = max(n for n in range(width + 1) if (width - n) * 100 >= width * how.percent)
    mask = how.mask(width)
    kept = [k for k, c in enumerate(mask) if c == "1"]
    assert "0" in mask or not differ or len(kept) == 1
    for gone in map(set, combinations(range(width), differ)):
        assert any(not gone & {at + k for k in kept} for at in range(width - len(mask) + 1))


def test_masks():
    assert Decontamination().mask(20) == "1000010000100001" and Decontamination().mask(12) == "1001001001"
    assert set(Decontamination().masks) == {Decontamination().mask(n) for n in range(1, 21)}


def test_equals_all_alignments_without_seeds(frame):
    draw = random.Random(3)
    bench = [(n, " ".join(f"i{n}t{k}" for k in range(n)), 1) for n in (1, 2, 4, 5, 7, 9, 10, 11, 12, 15, 16, 20, 31)]
    docs = []
    for n, text, _ in bench:
        for changes in range(7):
            g = text.split()
            for k in draw.sample(range(n), min(changes, n)):
                g[k] = f"new{k}"
            docs.append((len(docs), " ".join(["before"] * draw.randrange(5) + g + ["after"] * draw.randrange(5)), 1))
    tail = [f"i31t{k}" for k in range(11, 31)]
    docs.append((900, " ".join("other" if k in (0, 2, 10, 12) else w for k, w in enumerate(tail)), 1))  # the masks hit none of these two
    docs.append((901, " ".join("other" if k in (3, 7, 11) else f"i15t{k}" for k in range(15)), 1))
    docs.append((902, "i5t0 i5t1 other i5t3 i5t4", 1))
    got = found(overlaps(frame(docs, DOCS), frame(bench, ITEMS)))
    assert got == brute(docs, bench)
    assert {900, 901, 902} <= {d for d, *_ in got}


def test_texts_are_cut_into_tokens_once(frame, capsys):
    """However many masks there are: one scan of the documents, one split of each text."""
    rows = frame(documents(), DOCS).select(F.col("doc_id").alias("id"), decontam._hashed("text").alias("h"))
    placed = decontam._placed(rows, "id", list(Decontamination().masks))
    placed.explain()
    assert capsys.readouterr().out.count("split(") == 1
    one_by_one = [r for mask in Decontamination().masks for r in decontam._placed(rows, "id", [mask]).collect()]
    assert sorted(placed.collect(), key=str) == sorted(one_by_one, key=str)
