import os

import pytest

import corpus_pipeline
from sparkloom.llm import packing, quality_rules
from sparkloom.llm.common import scratch, written

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    docs = written(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), "docs")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = written(corpus_pipeline.clean(spark, docs, SF), "clean")
    kept = {i: v for i, t in texts.items() if (v := quality_rules.judge(t.encode())).kept}
    assert clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == {i: v.text.decode() for i, v in kept.items()}
    good = written(corpus_pipeline.classify(spark, clean, SF), "good")
    assert good.columns == columns and good.count() >= 0.95 * len(kept)
    once = written(corpus_pipeline.deduplicate(spark, good, SF), "once")
    rows = once.collect()
    assert once.columns == columns and len({r.text for r in rows}) == len(rows) and {r.text for r in rows} <= {r.text for r in good.collect()}
    packed = corpus_pipeline.pack(spark, once, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in rows}
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed.sequence_id.nunique() <= packing.lower_bound(packed.length.to_numpy(), 1024) + 3
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_tables(spark):
    path = scratch(spark, "tables")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    good = "These are the words of a text that is long enough and that the rules of quality let pass at once. It ends here."
    rows = [(1, good, None, None, None, 1.0), (1, good, None, None, None, 1.0), (2, None, "en", "s", 0, None), (3, "", "en", "s", 0, None), (None, good + " More follows, all of other words than those which stand above this one, so far as one can see.", "en", "s", 0, 2.0)]
    for some in (rows, []):
        docs = written(spark.createDataFrame(some, schema), "odd")
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, path), "odd-stage")
        assert docs.select("doc_id").distinct().count() == (2 if some else 0)
