"""Helpers of the operators in this folder: written intermediate tables, splits, salted joins, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a temporary folder is set; elsewhere that is an
    error, as executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="shared-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once and survives lost executors."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(table: DataFrame | None) -> None:
    """Delete a table made by ``written`` that no later result reads."""
    path = getattr(table, "_written", None)
    if path:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """End this session's Arrow batches at 2 MB (Spark: 64 MB), unless the session says otherwise; a longer row stands alone.

    A task holds several copies of a batch, in the executor's direct memory and in its Python worker. The setting stays,
    as lazy results are computed after the operator that built them has returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, "2m"))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join on ``keys`` where one key may hold a large share of ``many``; ``few`` has at most a row for each key.

    Each key's rows of ``many`` are dealt over ``salts`` partitions and ``few`` is repeated as often; adaptive
    execution splits further what is still too large.
    """
    salt = unused(many.columns + few.columns) + "salt"
    salted = many.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, salt], how).drop(salt)


def unused(columns: list[str]) -> str:
    """Underscores that no column begins with: a prefix for columns of our own."""
    prefix = "_"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def remainder(column, divisor: int):
    """crc32 of a column's text form modulo ``divisor``; a null counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


# -- hashes of words, computed on the UTF-8 bytes of a whole Arrow column ---------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE = 1 << 20  # bytes handled at a time
_HASHED = 1 << 18  # bytes hashed at a time, which takes some 30 times as many


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_FOLDED = _LETTER.copy()
_FOLDED[65:91] = _LETTER[97:123]  # A-Z as a-z, nothing else


def column_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1, 8 * array.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = _PIECE):
    """Cut the bytes into runs of about ``size`` that end at white space or where a text ends."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + size)
        while hi < n:
            near = np.flatnonzero(_SPACE[data[hi: hi + 4096]])
            ends = offsets[np.searchsorted(offsets, hi)]
            if len(near):
                hi = min(hi + int(near[0]), int(ends))
                break
            if ends <= hi + 4096:
                hi = int(ends)
                break
            hi = min(n, hi + 4096)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the words (runs without ASCII white space) in bytes ``lo`` to ``hi``."""
    solid = ~_SPACE[data[lo:hi]]
    fresh = np.zeros(hi - lo + 1, bool)
    fresh[0] = fresh[-1] = True
    fresh[offsets[np.searchsorted(offsets, lo): np.searchsorted(offsets, hi, "right")] - lo] = True
    before = np.empty(hi - lo, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(hi - lo, bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (fresh[:-1] | ~before))
    ends = np.flatnonzero(solid & (fresh[1:] | ~after)) + 1
    return starts + lo, ends + lo


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, 64-bit hash) of every word of every text, A-Z lower-cased, in order."""
    rows, hashes = [], []
    for lo, hi in pieces(data, offsets, _HASHED):
        starts, ends = word_spans(data, offsets, lo, hi)
        if not len(starts):
            continue
        powers = np.full(hi - lo, _BASE)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_FOLDED[data[lo:hi]] * powers, out=total[1:])
        back = np.full(hi - lo, _INVERSE)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        hashes.append(mix((total[ends - lo] - total[starts - lo]) * back[starts - lo] + (ends - starts).astype(np.uint64)))
        rows.append(np.searchsorted(offsets, starts, "right") - 1)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)
