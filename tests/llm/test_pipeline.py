"""The kept rows of each stage of the pipeline against brute force, on the stage's own input."""

import pytest
from test_texts import brute_components, brute_hits

import corpus_pipeline
from ctxspark.llm import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of each stage, as rows by id."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        out[name] = [{r.doc_id: r for r in x.collect()} for x in (docs, kept)]
        docs = kept
    return out


def same_rows(before, after):
    return all(before[k] == row for k, row in after.items())


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    scorer = toxicity.Scorer(toxicity.fitted(spark, FOLDER))
    assert set(after) == {k for k, r in before.items() if scorer.score(r.text) < toxicity.THRESHOLD}
    assert 0 < len(after) < len(before) and same_rows(before, after)


def test_repeated_lines_go(stages):
    before, after = stages["line_dedup"]
    assert set(after) == set(before)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    where = {}
    for k, r in before.items():
        for line in (r.text or "").split("\n"):
            where.setdefault(key(line), set()).add(k)
    changed = 0
    for k, r in before.items():
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(where[key(x)]) < 5 or max(where[key(x)]) == k]
        assert (after[k].text or "") == "\n".join(kept)
        changed += kept != lines
    assert changed


def test_one_of_near_duplicates_stays(stages):
    before, after = stages["near_duplicates"]
    assert set(after) == {c for *_, c in brute_components([(k, r.text) for k, r in before.items()])}
    assert len(after) < len(before) and same_rows(before, after)


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hits = brute_hits([r.text for r in before.values()], items)
    assert set(after) == {k for k, (_, n, _) in zip(before, hits, strict=True) if not n}
    assert len(after) < len(before) and same_rows(before, after)
