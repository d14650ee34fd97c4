from collections import Counter

from fixtures import WORD, clashing, edge_docs
from test_line_and_substring import expected_lines
from test_similar import first_of_groups

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    names = docs.columns
    out, frames = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == names
            out = out.cache()
        frames.append(out)
    identified, lines, near, mixed, packed = frames
    assert identified.count() == docs.where("text rlike '\\\\p{L}'").count()
    rows = [tuple(r) for r in identified.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == sorted((d, kept) for d, *_, kept in expected_lines(rows))
    own = [tuple(r) for r in lines.collect()]
    assert sorted(r["doc_id"] for r in near.select("doc_id").collect()) == sorted(first_of_groups(own, corpus_pipeline.LEAST_SIMILARITY))
    kept = {r["doc_id"] for r in near.collect()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert set(times) <= kept and max(times.values()) <= 3
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in near.collect()}
    assert abs(sum(size[d] * n for d, n in times.items()) - sum(size.values())) <= 0.03 * sum(size.values())
    assert Counter(r["doc_id"] for r in packed.where("start = 0").collect()) == times


def test_edges(spark, sf_dir):
    out = clashing(spark)
    names = out.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir).cache()
        assert name == "best_fit_packing" or out.columns == names
    assert out.count() > 0
    out = spark.createDataFrame([], edge_docs(spark).schema)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf_dir).cache()
    assert out.count() == 0
