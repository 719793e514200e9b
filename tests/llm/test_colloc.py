"""Collocations by stripes against plain Python."""

import re
from collections import Counter as Count

import numpy as np
import pytest

from hedgerow.llm import colloc
from hedgerow.llm.colloc import Collocations, collocations


def brute(rows, how):
    counts, words_of = {}, Count()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        f = counts.setdefault(lang, Count())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(words)
            f.update(tuple(words[i:i + n]) for n in range(1, how.longest + 1) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = [w for w in f if len(w) > 1 and f[w] >= how.least]
        scored = []
        for w in frequent:
            if any(100 * f[v] >= how.covered * f[w] for v in frequent if len(v) > len(w)
                   and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))):
                continue
            score, k = min((1000000 * f[w] ** 2 // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w)))
            scored.append((-score, -f[w], " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[: how.first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    words = ["new", "York", "city", "the", "of", "É", "é", "a'b", "x-y", "日本", "the"]
    rows = []
    for k in range(150):
        n = int(rng.integers(0, 90))
        text = " ".join(words[i] + (["", "", "", ".", ",", "\n", "\t", "  ", "!?"][int(rng.integers(0, 9))]) for i in rng.integers(0, len(words), n))
        rows.append((text, ["en", "de", None, "und", ""][k % 5]))
    rows += [("New York city hall " * 20, "en"), ("a a a a " * 9, "de"), (None, "en"), ("", None), (" \t.\n", "fr"), ("one", "it")]
    rows += [("new york. " * 30, "en")] * 3 + [("z q v w " * 700, "nl")]
    return rows


SCHEMA = "text string, lang string, words string, n long, part int, prefix string"


@pytest.mark.parametrize("how,piece", [
    (Collocations(), 1 << 20), (Collocations(held=50, part_bytes=900, segments=3, first=9), 64),
    (Collocations(longest=4, held=333, part_bytes=2000, covered=70, least=4), 100), (Collocations(longest=2, held=7), 1 << 20)])
def test_against_brute_force(spark, monkeypatch, how, piece):
    monkeypatch.setattr(colloc, "_PIECE", piece)
    rows = corpus()
    df = spark.createDataFrame([(*r, "w", 1, 2, "p") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in collocations(df, how=how).collect()) == brute(rows, how)


@pytest.mark.parametrize("held,piece", [(1, 1), (2, 3), (5, 8), (1000, 16)])
def test_counts_go_on_over_parts_of_a_text(monkeypatch, held, piece):
    monkeypatch.setattr(colloc, "_PIECE", piece)
    import pyarrow as pa

    text = "a b c a b. c a b c d e, a b c a  b c " * 3
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text.encode()])], ["lang", "text"])
    found = Count()
    for out in colloc._counted(3, Collocations(held=held, longest=4))([batch]):
        for row in out.to_pylist():
            words = row["words"].split(" ")
            prefix, widths, nexts, counts = (np.frombuffer(row[k], "<i4") for k in ("prefix", "width", "next", "count"))
            at = iter(zip(nexts, counts))
            for s, width in enumerate(widths):
                head = prefix[s * (row["n"] - 1):(s + 1) * (row["n"] - 1)]
                for _ in range(width):
                    last, count = next(at)
                    found[tuple(words[k] for k in (*head, last))] += int(count)
    want = Count()
    for piece_ in re.split("[.,]", text):
        words = piece_.split()
        want.update(tuple(words[i:i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    assert found == want


def test_large_counts_are_exact(spark, monkeypatch):
    from pyspark.sql import Row

    big = 3_000_000_017
    stripes = [Row(lang="x", prefix=[], next=["p", "q"], count=[big, big - 5], total=None),
               Row(lang="x", prefix=["p"], next=["q"], count=[big - 7], total=None),
               Row(lang="x", prefix=None, next=None, count=None, total=2 * big)]
    schema = "lang string, prefix array<string>, next array<string>, count array<long>, total long"
    monkeypatch.setattr(colloc, "merged_stripes", lambda *_: spark.createDataFrame(stripes, schema))
    found = collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [("x", 1, "p q", big - 7, big, big - 5, 2 * big,
                                          1000000 * (big - 7) ** 2 // (big * (big - 5)))]


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
