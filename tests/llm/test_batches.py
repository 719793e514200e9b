"""Memory of a task follows the bytes of a batch, not its number of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hedgerow.llm import neardup, pii, toxicity
from hedgerow.llm.shared import column_bytes, word_hashes

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
MODEL = toxicity.Model({"=bad": 3.0}, [0.0] * 8, 4.0)
FIELD = pii.Model(np.zeros((pii.SHAPES, 5)), np.zeros((5, 5)), 1.0)
USES = {
    "near_duplicates": lambda d: neardup.near_duplicates(d),
    "toxicity": lambda d: toxicity.toxicity(d, MODEL),
    "find_pii": lambda d: pii.find_pii(d, FIELD),
    "redact": lambda d: pii.redact(d, FIELD),
}


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield
    spark.conf.unset(KEY)


def sizes(docs):
    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    return docs.mapInArrow(measure, "rows long, bytes long").collect()


@pytest.mark.parametrize("name", USES)
def test_batches_end_at_two_megabytes(spark, unset, name):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 20_000).alias("text"))
    assert len(sizes(docs)) == 1
    assert USES[name](docs).count() == 40
    found = sizes(docs)
    assert sum(r.rows for r in found) == 40 and max(r.bytes for r in found) < 3_000_000


def test_a_setting_of_the_session_stays(spark, unset):
    spark.conf.set(KEY, "1m")
    USES["redact"](spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    assert spark.conf.get(KEY) == "1m"


def test_hashing_words_takes_little_memory():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 300_000)]
    texts = pa.array([" ".join(words[k: k + 300]) for k in range(0, len(words), 300)] + [" ".join(words)])
    tracemalloc.start()
    rows, hashes = word_hashes(*column_bytes(texts))
    held = tracemalloc.get_traced_memory()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (hashes[rows == 1000] == hashes[rows < 1000]).all() and len(hashes) == 600_000
    assert peak - held < 25e6
