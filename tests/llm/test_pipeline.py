import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratabar.llm import quality, toxicity
from stratabar.llm.common import table
from stratabar.llm.decontaminate import find_leaks
from stratabar.llm.jaccard_join import jaccard_classes

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_rest(spark, tmp_path):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append((docs, out))
        if name != "bpe":
            assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
        docs = out
    labels, ids = table(spark, SF, "labels"), lambda df: {r["doc_id"] for r in df.collect()}
    before, after = kept[0]
    scored = toxicity.score_toxicity(before, toxicity.fit_toxicity(before, labels))
    assert ids(after) == ids(scored.filter(scored.score < toxicity.THRESHOLD))
    before, after = kept[1]
    assert ids(after) == ids(quality.with_verdict(quality.score_quality(before, quality.fit_quality(before, labels))).filter("kept"))
    before, after = kept[2]
    classes = {r["doc_id"]: r["class_id"] for r in jaccard_classes(before).collect()}
    assert ids(after) == set(classes.values())
    assert all(r["n_links"] == 0 for r in jaccard_classes(after).collect())
    before, after = kept[3]
    assert ids(after) == {r["doc_id"] for r in find_leaks(before, table(spark, SF, "benchmark")).collect() if not r["leaks"]}
    before, after = kept[4]
    assert ids(after) == ids(before)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, k):
    kind = table(spark, SF, "documents").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a few plain words " * 3, None, None, 5)], kind)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    assert out.count() == 4 if name == "bpe" else out.columns == odd.columns and out.count() <= 4
    assert stage(spark, odd.limit(0), SF).count() == 0


CLASHING = ["score", "terms", "row", "n_words", "probability", "kept", "base_failed", "leaks", "text_key", "item_id", "class_id", "n_links", "keeps", "key", "id", "n_tokens", "ids", "decoded", "h", "y"]


@pytest.mark.parametrize("k", range(5))
def test_stage_leaves_columns_of_any_name_alone(spark, k):
    docs = table(spark, SF, "documents").withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in CLASHING})
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    if k < 4:
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
    assert out.count() == corpus_pipeline.STAGES[k][1](spark, docs.drop(*CLASHING), SF).count() > 0
