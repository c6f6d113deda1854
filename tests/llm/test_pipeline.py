import pytest

import corpus_pipeline
from __spark_entry__ import SMOKE_DIR, queries
from loadcurve.llm import packing, quality_rules, tiling
from loadcurve.llm.registry import table
from tests.llm.test_near_join import plain_components
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SMOKE_DIR, "documents").cache(), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMOKE_DIR).cache()
        docs.count()
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_each_stage_takes_effect(spark, stages):
    start, good, single, clean, redacted, packed = stages
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels, benchmark = table(spark, SMOKE_DIR, "labels"), table(spark, SMOKE_DIR, "benchmark")
    assert ids(good) == ids(quality_rules.quality_rules(start, labels).where("kept"))
    texts = {r.doc_id: r.text for r in good.collect()}
    want, sizes = plain_components(texts)
    assert ids(single) == {i for i, root in want.items() if i == root or not sizes[i]}
    assert ids(clean) == ids(single) - ids(tiling.contaminated(single, benchmark))
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (clean, redacted))
    assert before.keys() == after.keys()
    assert all(t == before[i] or "[secret]" in t for i, t in after.items())
    from tokenizers import Tokenizer
    import public_tokenizers

    check(packed.collect(), after, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.CAPACITY)


def test_run_equals_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SMOKE_DIR).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(rows) == sorted(stages[-1].select("doc_id", "piece", "ids_crc32").collect())


def test_queries_are_registered():
    names = queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
