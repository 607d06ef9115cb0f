"""The corpus pipeline on the smallest tables, stage by stage."""

from collections import Counter

import corpus_pipeline
from folioscope.llm import decontamination, ngram_join, quality_rules
from folioscope.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != "sharding":
            assert docs.columns == columns
    kept = {row.doc_id for row in seen["quality_rules"][1].collect()}
    judged = quality_rules.judged(seen["quality_rules"][0], quality_rules.trusted_ids(spark.read.parquet(f"{SF}/labels.parquet")))
    assert kept == {row.doc_id for row in judged.where("quality.kept").collect()}
    classes = ngram_join.joined(seen["ngram_join"][0]).collect()
    assert {row.doc_id for row in seen["ngram_join"][1].collect()} == {row.component_id for row in classes}
    leaked = {row.doc_id for row in decontamination.leaks(seen["decontamination"][0], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    ids = [{row.doc_id for row in frame.collect()} for frame in seen["decontamination"]]
    assert ids[0] - ids[1] == leaked
    copies = Counter(row.doc_id for row in seen["mixing"][1].collect())
    assert max(copies.values()) <= 3 and set(copies) <= ids[1]
    assert seen["sharding"][1].count() == sum(copies.values()) and seen["sharding"][1].where("shard NOT BETWEEN 0 AND 23").isEmpty()


def test_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
