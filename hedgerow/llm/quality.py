"""Document quality by attention-based multiple-instance learning: passages are the instances, documents the bags."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgerow.llm.learning import labelled_sample, shifted, sigmoid
from hedgerow.llm.shared import column_bytes, pieces, word_hashes, word_spans


@dataclass(frozen=True)
class Quality:
    """``rows``: labelled documents of at most ``chars`` characters to fit on. ``words``: words of a passage.

    ``hidden``, ``gate``: widths of the passage code and of the attention. ``steps`` of Adam over the whole sample.
    """

    rows: int = 4000
    chars: int = 200_000
    words: int = 100
    hidden: int = 16
    gate: int = 8
    steps: int = 250


def _classes() -> np.ndarray:
    """Rows of byte classes: odd symbols, any punctuation, digits, capitals, letters, bytes beyond ASCII."""
    table = np.zeros((6, 256), bool)
    for b in range(256):
        c = chr(b)
        table[0, b] = c in "#$%&*+<=>@\\^_`{|}~"
        table[1, b] = b < 128 and not c.isalnum() and not c.isspace() and b > 31
        table[2, b], table[3, b] = b < 128 and c.isdigit(), b < 128 and c.isupper()
        table[4, b], table[5, b] = b >= 128 or c.isalpha(), b >= 128
    return table


_CLASS = _classes()
FEATURES = 17


def _cuts(data: np.ndarray, offsets: np.ndarray, words: int, size: int):
    """Groups (offsets of parts, row of each part) of about ``size`` bytes; longer texts are cut between passages."""
    ends, owners = [0], []
    for row, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
        ends.append(int(lo))
        if hi - lo > size:
            seen, step = 0, words * max(1, size // (20 * words))
            for a, b in pieces(data[lo:hi], np.array([0, hi - lo])):
                starts, _ = word_spans(data[lo:hi], np.array([0, hi - lo]), a, b)
                at = np.arange(-seen % step, len(starts), step)
                found = [int(lo + starts[k]) for k in at if seen + k]
                ends += found
                owners += [row] * len(found)
                seen += len(starts)
        owners.append(row)
    ends = np.array([*ends[1:], int(offsets[-1])], np.int64)
    owners, begin = np.array(owners), 0
    while begin < len(owners):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + size, "right")) - 1)
        yield ends[begin: end + 1], owners[begin:end]
        begin = end


def passages(texts: pa.Array, words: int, size: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(row of each passage, its features) over all words of all texts; a text without words has one passage of zeros.

    About ``size`` bytes are worked on at a time, whatever the lengths of the texts.
    """
    data, offsets = column_bytes(texts)
    rows, features = [np.zeros(0, np.int64)], [np.zeros((0, FEATURES))]
    for ends, owners in _cuts(data, offsets, words, size):
        part, x = _features(data[ends[0]: ends[-1]], ends - ends[0], words)
        rows.append(owners[part])
        features.append(x)
    rows, features = np.concatenate(rows), np.concatenate(features)
    empty = np.setdiff1d(np.arange(len(texts)), rows)
    owner = np.concatenate([rows, empty])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([features, np.zeros((len(empty), FEATURES))])[order]


def _features(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    rows, hashes = word_hashes(data, offsets)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, FEATURES))
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    place = np.arange(len(rows)) - first[rows]
    fresh = np.append(True, (rows[1:] != rows[:-1]) | (place[1:] % words == 0))
    number = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(rows)))
    columns = [[] for _ in range(9)]
    for lo, hi in pieces(data, offsets):
        starts, ends = word_spans(data, offsets, lo, hi)
        raw = data[lo:hi]
        columns[0].append(ends - starts)
        for k in range(6):
            total = np.zeros(hi - lo + 1, np.int32)
            np.cumsum(_CLASS[k][raw], out=total[1:])
            columns[1 + k].append(total[ends - lo] - total[starts - lo])
        columns[7].append(_CLASS[0][data[ends - 1]] | ((ends - starts > 2) & (data[ends - 1] == 33) & (data[ends - 2] == 33)))
        columns[8].append((starts > 0) & (data[np.maximum(starts - 1, 0)] == 10))
    size, odd, marks, digits, capitals, letters, beyond, tail, line = (np.concatenate(c).astype(np.float64) for c in columns)
    once = np.append(False, (hashes[1:] == hashes[:-1]) & ~fresh[1:]).astype(float)
    twice = np.zeros(len(rows))
    twice[2:] = (hashes[2:] == hashes[:-2]) & ~fresh[2:] & ~fresh[1:-1]
    key = np.sort((number.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28)))
    distinct = np.bincount((key[np.append(True, key[1:] != key[:-1])] >> np.uint64(36)).astype(np.int64), minlength=len(begin))
    add = lambda x: np.add.reduceat(x, begin)
    total = np.maximum(add(size), 1)
    features = np.stack([
        total / count / 10, add(odd) / total, add(marks) / total, add(digits) / total, add(capitals) / total,
        add(beyond) / total, add((letters == 0).astype(float)) / count, add(tail) / count, add(once) / count,
        add(twice) / count, distinct / count, add(((size == 1) & (odd == 1)).astype(float)) / count, np.log1p(count) / 5,
        add((size >= 12).astype(float)) / count, add((size <= 3).astype(float)) / count, add(line) / count,
        add((capitals >= letters - beyond).astype(float)) / count], axis=1)
    return rows[begin], features


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    words: int


def _forward(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, owner: np.ndarray):
    """Passage codes, gated attention inside each document, document logits; ``owner`` numbers documents from 0."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    a = (t * g) @ p["w"]
    a = np.exp(a - np.maximum.reduceat(a, begin)[owner])
    a /= np.add.reduceat(a, begin)[owner]
    z = np.add.reduceat(a[:, None] * h, begin)
    return h, t, g, a, z, z @ p["c"] + p["d"][0]


def _gradients(p, x, begin, owner, y):
    h, t, g, a, z, logit = _forward(p, x, begin, owner)
    dl = (sigmoid(logit) - y) / len(y)
    dz = dl[:, None] * p["c"]
    da = (dz[owner] * h).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, begin)[owner])
    dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl,
            "d": np.array([dl.sum()])}


def fit(docs: DataFrame, labels: DataFrame, usable, how: Quality = Quality(), id: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """Fit the network on the passages of a bounded sample of documents whose label's id meets ``usable``."""
    short = docs.where(F.coalesce(F.length(text), F.lit(0)) <= how.chars)
    sample, share = labelled_sample(short, labels, id, text, label, how.rows, usable)
    size = how.words

    def encode(batches):
        for batch in batches:
            owner, x = passages(batch.column(1), size)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            bags = [x[lo:hi].ravel() for lo, hi in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.float64())), batch.column(2)],
                                             ["id", "x", "y"])

    rows = sample.select("id", "text", "y").mapInArrow(encode, sample.schema["id"].dataType.simpleString().join(
        ["id ", ", x array<double>, y int"])).toPandas().sort_values("id")  # at most how.rows rows
    random = np.random.default_rng(0)
    draw = lambda *s: random.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"W": draw(FEATURES, how.hidden), "b": np.zeros(how.hidden), "V": draw(how.hidden, how.gate),
         "U": draw(how.hidden, how.gate), "w": draw(how.gate), "c": draw(how.hidden), "d": np.zeros(1)}
    if rows.y.nunique() < 2:
        p["c"], p["d"] = np.zeros(how.hidden), np.array([shifted(0.0, 0.5, share)])
        return Model(np.zeros(FEATURES), np.ones(FEATURES), p, size)
    bags = [np.asarray(x, float).reshape(-1, FEATURES) for x in rows.x]
    x, y = np.concatenate(bags), rows.y.to_numpy(float)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    begin = np.searchsorted(owner, np.arange(len(bags)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, how.steps + 1):
        for k, g in _gradients(p, x, begin, owner, y).items():
            g = g + 1e-4 * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - 0.03 * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    p["d"] = np.array([shifted(p["d"][0], y.mean(), share)])
    return Model(mean, scale, p, size)


def quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, the probability of label 1 for each whole text.

    Null, empty and blank texts are scored as one passage of zeros. Rows keep all their columns, repeated ones too; a
    column of that name is replaced.
    """
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            owner, x = passages(pa.array(texts.tolist(), pa.string()), model.words)
            if not len(texts):
                yield pd.Series([], dtype=float)
                continue
            begin = np.searchsorted(owner, np.arange(len(texts)))
            yield pd.Series(sigmoid(_forward(model.parts, (x - model.mean) / model.scale, begin, owner)[-1]))

    return docs.withColumn("quality_score", score(F.col(text).cast("string")))
