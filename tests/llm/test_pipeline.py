from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from turfline.llm import bpe_codec, quality_knn, simhash_bk, source_mix

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "encode":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
    before, after = kept["quality"]
    bad = {r.doc_id for r in quality_knn.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0").collect()}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad
    before, after = kept["exact_dedup"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in after.collect())
    before, after = kept["near_dedup"]
    least = {r.component_id for r in simhash_bk.similar_groups(before).collect()}
    assert {r.doc_id for r in after.collect()} == least
    before, after = kept["mix"]
    copies = {r.doc_id: r.copies for r in source_mix.mix(before).collect() if r.copies}
    assert Counter(r.doc_id for r in after.collect()) == copies
    before, after = kept["encode"]
    assert after.count() == before.count() and after.filter(~F.col("exact")).count() == 0
    assert isinstance(bpe_codec._codecs, dict)


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0
