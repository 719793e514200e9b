import pytest

import corpus_pipeline
import __spark_entry__ as entry
from compare import compare, duck, sf_dir
from hedgerow.llm import decontam, pii
from test_decontam import brute as overlapping
from test_neardup import brute as grouped
from test_pii import plain

NAMES = sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit()) + ["pipeline"]


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_matches_oracle(spark, name):
    assert compare(entry.queries()[name](spark, sf_dir()), duck(sf_dir()), entry.oracle_sql()[name]) is None


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in NAMES if n != "pipeline"} == {f"op{k}" for k in range(1, 11)}


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir()}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir()}/benchmark.parquet").collect()]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir()}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir()), name)
        after = {r.doc_id: r for r in docs.collect()}
        gone = set(before) - set(after)
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            clean = [i for i in before if toxic.get(i) == 0]  # too few labels here to find all toxic ones
            assert sum(i in gone for i in clean) <= 0.05 * len(clean)
        if name == "near_duplicates":
            assert gone == {i for i, _, root, _ in grouped([(i, r.text) for i, r in before.items()]) if i != root}
        if name == "decontamination":
            assert gone == {d for d, *_ in overlapping([(i, r.text) for i, r in before.items()], bench)}
        if name == "personal_data":
            model = pii.fit(spark.createDataFrame(list(before.values())))
            for i, r in after.items():
                assert not gone and not [s for s in plain(r.text or "") if s[1] == 0] and r.n_chars == len(r.text)
                assert r.text.count("[") >= len(pii.spans(before[i].text, model, pii.Pii())[1]) > 0 or r.text == before[i].text
    assert decontam and 0 < len(after) < len(before)


def test_run_gives_the_last_stage(spark):
    assert entry.queries()["pipeline"](spark, sf_dir()).count() > 0
