"""Language of words and documents: a linear-chain conditional random field over affixes, n-grams and a lexicon."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgerow.llm.chain import marginals
from hedgerow.llm.shared import column_bytes, mix, pieces


@dataclass(frozen=True)
class LangId:
    """Fitted on ``rows`` texts of at most ``chars`` characters, as many of each language; ``labels`` bounds the languages.

    ``bits``: size of the hashed feature table. ``switch``: mean length of the runs that training texts are cut into
    and shuffled, so that it sees code-switched text. ``group``: words whose chains are computed at a time.
    """

    rows: int = 1000
    chars: int = 20_000
    labels: int = 100
    bits: int = 17
    steps: int = 30
    switch: int = 20
    group: int = 250_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point up to 0x2FFFF, its lower-case letter or 0; letters beyond do not occur in Unicode 15 scripts in use."""
    codes = np.zeros(0x30000, np.uint32)
    for c in range(len(codes)):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            codes[c] = ord(low[0])
    return codes, codes > 0


_LETTERS: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    """Code points as lower-case letters, 0 for what is no letter."""
    if not _LETTERS:
        _LETTERS.append(_tables()[0])
    return _LETTERS[0][np.minimum(codes, 0x2FFFF)]


def words(texts: pa.Array, bits: int):
    """(row of each word, its letters, feature numbers, start of its features) for all words of all texts, piece by piece.

    Features: letter pairs and triples with the word's ends marked, so that the outer ones are affixes, and the whole
    word. Words are runs of letters.
    """
    data, offsets = column_bytes(texts)
    shift, small = np.uint64(64 - bits), np.uint64
    for lo, hi in pieces(data, offsets):
        raw = data[lo:hi]
        code = np.zeros(int((raw & 0xC0 != 0x80).sum()) + 3, np.uint64)
        code[1:-2] = letters(np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32))
        first = np.flatnonzero(raw & 0xC0 != 0x80) + lo  # byte position of each character
        edge = np.searchsorted(first, offsets[np.searchsorted(offsets, lo, "right"): np.searchsorted(offsets, hi)]) + 1
        solid = code > 0
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        starts[edge] |= solid[edge]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        ends[edge - 1] |= solid[edge - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if not len(starts):
            continue
        before, after = code[:-2].copy(), code[2:].copy()  # of the character at 1 .. n
        before[starts - 1], after[ends - 2] = 0, 0
        own = code[1:-1]
        pair = mix(before * small(0x1000003) + own + small(1 << 40)) >> shift
        tail = mix(own * small(0x1000003) + small(1 << 40)) >> shift
        triple = mix((before << small(42)) ^ (own << small(21)) ^ after ^ small(1 << 63)) >> shift
        sizes = ends - starts
        powers = np.full(int(sizes.max()), 0x9E3779B97F4A7C17, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        at = np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.repeat(starts, sizes) + (np.arange(len(at)) - at)
        whole = np.add.reduceat(mix(code[inside]) * powers[np.arange(len(at)) - at], np.cumsum(sizes) - sizes)
        whole = mix(whole) >> shift
        # each word: its letters' pairs and triples, the pair that ends it, the word itself
        begin = 2 * (np.cumsum(sizes) - sizes) + 2 * np.arange(len(sizes))
        features = np.empty(2 * len(inside) + 2 * len(sizes), np.int64)
        slot = np.repeat(begin, sizes) + 2 * (np.arange(len(at)) - at)
        features[slot], features[slot + 1] = pair[inside - 1], triple[inside - 1]
        features[begin + 2 * sizes], features[begin + 2 * sizes + 1] = tail[ends - 2], whole
        yield np.searchsorted(offsets, first[starts - 1], "right") - 1, sizes, features, begin


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray


def fit(docs: DataFrame, usable, how: LangId = LangId(), id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit the field by full-batch gradients of its likelihood on a bounded sample of documents whose id meets ``usable``."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & usable & (F.length(text) <= how.chars)).select(
        F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.labels).collect()
    langs = sorted(r.lang for r in counts)
    if not langs:
        return Model([], np.zeros((1 << how.bits, 0), np.float32), np.zeros((0, 0)))
    each = max(1, how.rows // len(langs))
    kept = [(r.lang, min(1.0, 4.0 * each / r["count"])) for r in counts]
    share = F.create_map(*[F.lit(x) for pair in kept for x in pair])[F.col("lang")]
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.withColumn("chance", chance).where(F.col("chance") < share)  # about 4 x each of a language, before the exact cut
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "id"))
    sample = drawn.withColumn("r", rank).where(F.col("r") <= each).select("lang", "text").toPandas()  # at most how.rows
    parts = list(words(pa.array(sample["text"].tolist(), pa.string()), how.bits))
    if not parts:
        return Model(langs, np.zeros((1 << how.bits, len(langs)), np.float32), np.zeros((len(langs),) * 2))
    row = np.concatenate([p[0] for p in parts])
    number = {name: k for k, name in enumerate(langs)}
    label = sample["lang"].map(number).to_numpy()[row]
    features = np.concatenate([p[2] for p in parts])
    sizes = np.concatenate([np.diff(np.append(p[3], len(p[2]))) for p in parts])
    begin = np.cumsum(sizes) - sizes
    random = np.random.default_rng(0)
    cut = (random.random(len(row)) < 1 / how.switch) | np.append(True, row[1:] != row[:-1])
    run = np.cumsum(cut) - 1
    order = np.argsort(random.permutation(run[-1] + 1)[run], kind="stable")  # runs shuffled, words in order inside
    fresh = np.zeros(len(row), bool)
    fresh[::200] = True
    y, n, count = label[order], len(row), len(langs)
    truth = np.zeros((n, count))
    truth[np.arange(n), y] = 1
    observed = np.zeros((count, count))
    np.add.at(observed, (y[:-1][~fresh[1:]], y[1:][~fresh[1:]]), 1)
    weights, moves = np.zeros((1 << how.bits, count)), np.zeros((count, count))
    owner = np.repeat(np.arange(n), sizes)
    squares, moved = np.full(weights.shape, 1e-8), np.full(moves.shape, 1e-8)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    for _ in range(how.steps):
        emission = np.add.reduceat(weights[features], begin, axis=0)
        posterior, joint = marginals(emission[order], fresh, moves, pairs=True)
        off = (truth - posterior)[back]
        gradient = np.stack([np.bincount(features, off[owner, k], len(weights)) for k in range(count)], axis=1) / n * 1000
        gradient -= 0.002 * weights
        step = (observed - joint) / n * 1000 - 0.002 * moves
        squares += gradient ** 2
        moved += step ** 2
        weights += 0.3 * gradient / np.sqrt(squares)
        moves += 0.3 * step / np.sqrt(moved)
    return Model(langs, weights.astype(np.float32), moves)


def _posteriors(texts: pa.Array, model: Model, how: LangId):
    """(row of each word, letters, label probabilities) in groups of whole texts."""
    held, count = [], 0
    for row, sizes, features, begin in words(texts, how.bits):
        held.append((row, sizes, np.add.reduceat(model.weights[features], begin, axis=0)))
        count += len(row)
        if count >= how.group:
            row, sizes, emission = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(row, row[-1]))  # the last text may go on
            if whole:
                yield _run(row[:whole], sizes[:whole], emission[:whole], model)
            held, count = [(row[whole:], sizes[whole:], emission[whole:])], len(row) - whole
    if count:
        yield _run(*(np.concatenate(x) for x in zip(*held)), model)


def _run(row, sizes, emission, model):
    fresh = np.append(True, row[1:] != row[:-1])
    return row, sizes, marginals(emission.astype(np.float64), fresh, model.moves)


def languages(docs: DataFrame, model: Model, how: LangId = LangId(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the language that most letters of the whole text have, and its share.

    Each word's probabilities come from forward-backward over its text. ``und`` with score 0 if the text is null or
    has no letter, or nothing was learnt. Ties go to the language first in order. Repeated rows give repeated rows;
    extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by how.bits and how.labels

    def predict(batches):
        fitted = sent.value
        for batch in batches:
            votes = np.zeros((batch.num_rows, max(1, len(fitted.langs))))
            if fitted.langs:
                for row, sizes, p in _posteriors(batch.column(1), fitted, how):
                    for k in range(p.shape[1]):
                        votes[:, k] += np.bincount(row, p[:, k] * sizes, batch.num_rows)
            total, best = votes.sum(axis=1), votes.argmax(axis=1)
            known = total > 0
            names = [fitted.langs[b] if k else "und" for b, k in zip(best, known)]
            score = np.where(known, votes[np.arange(len(best)), best] / np.where(known, total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                                             ["id", "lang_pred", "score"])

    kind = docs.schema[id].dataType.simpleString()
    found = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        predict, f"id {kind}, lang_pred string, score double")
    return found.withColumnRenamed("id", id)


def word_languages(docs: DataFrame, model: Model, how: LangId = LangId(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, position, letters, lang, probability) for every word of code-switched texts, in order from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for batch in batches:
            for row, sizes, p in _posteriors(batch.column(1), sent.value, how):
                first = np.searchsorted(row, row)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - first), pa.array(sizes),
                     pa.array([sent.value.langs[b] for b in best]), pa.array(p[np.arange(len(p)), best])],
                    ["id", "position", "letters", "lang", "probability"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        label, f"id {kind}, position long, letters long, lang string, probability double").withColumnRenamed("id", id)
